"""Text functions. Those that need a state machine or a callback are Arrow-batched pandas UDFs."""

from __future__ import annotations

import posixpath
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .udf import pandas_function

#: The token patterns of the sparse encoder and of the reranker, and the number of sparse buckets.
SPARSE_TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]{1,64}|[0-9a-f]{7,40}|[A-Z][A-Z0-9_]{2,}"
RERANK_TOKEN = r"[a-zA-Z0-9_$.]+"
SPARSE_SIZE = 1 << 20


def sparse_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({SPARSE_TOKEN})"), F.lit(1)), F.lower)


def rerank_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of more than one character."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({RERANK_TOKEN})"), F.lit(1)), lambda t: F.length(t) > 1))


def overlap(q: Column, d: Column) -> Column:
    """Share of q's tokens that d has; 0 if either is empty."""
    return F.when((F.size(q) == 0) | (F.size(d) == 0), 0.0).otherwise(F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1)))


def token_bucket(token: Column) -> Column:
    """FNV-1a with 32 bits, modulo the number of buckets."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    step = lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")
    h = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: step(h, c).bitwiseAND(F.lit(4294967295).cast("long")))
    return (h % SPARSE_SIZE).cast("int")


@lru_cache(maxsize=1 << 16)
def _bucket(token: str) -> int:
    """token_bucket() of one token; frequent tokens are hashed once a process."""
    h = 2166136261
    for c in token:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h % SPARSE_SIZE


_TOKEN = re.compile(SPARSE_TOKEN)


def bucket_counts(text: str | None) -> Counter:
    """How often each of a text's buckets comes; null has none."""
    tf = Counter()
    for w, n in Counter(_TOKEN.findall(text or "")).items():
        tf[_bucket(w.lower())] += n
    return tf


def encode_sparse(text: str | None) -> list[tuple[int, float]]:
    """A text's buckets with their counts over the largest."""
    tf = bucket_counts(text)
    top = max(tf.values(), default=1)
    return [(i, n / top) for i, n in tf.items()]


@pandas_function("array<struct<idx:int,weight:double>>")
def sparse_vector(text: pd.Series) -> pd.Series:
    """encode_sparse() of each text: all in its own row, nothing is shuffled."""
    return text.map(encode_sparse)


@pandas_function("binary")
def bucket_bytes(text: pd.Series) -> pd.Series:
    """bucket_counts() of each text as bytes: all buckets, then all counts, as little-endian integers of 32 bits."""
    return text.map(lambda t: np.array([list((c := bucket_counts(t)).keys()), list(c.values())], "<i4").tobytes())


#: Texts whose vectors a task holds at a time.
SLICE = 256


def _sparse_vectors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): sparse_vector() of each text, in slices of SLICE, however many rows a batch has."""
    kind = df.schema[id_col]
    entry = pa.struct([("idx", pa.int32()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            found = [encode_sparse(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype("int32")
            flat = [pa.array([e[n] for x in found for e in x], entry.field(n).type) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, fields=list(entry)))], names=[id_col, "x"])

    schema = StructType([StructField(id_col, kind.dataType), *StructType.fromDDL("x array<struct<idx:int,weight:double>>")])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def sparse_encode(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Long form (id, idx, weight): count of a bucket over the largest count of the text, row by row."""
    return _sparse_vectors(df, id_col, text_col).select(id_col, F.explode("x").alias("x")).select(id_col, "x.idx", "x.weight")


def sparse_map(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sparse map<int,double>) of every row; empty texts have an empty map."""
    return _sparse_vectors(df, id_col, text_col).select(id_col, F.map_from_entries("x").alias("sparse"))


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def token_estimate(text: Column) -> Column:
    """ceil(cjk / 1.2 + other / 3.0), in UTF-16 units."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return F.ceil(cjk / F.lit(1.2) + (utf16_length(text) - cjk) / F.lit(3.0))


# Headers, fences, compaction ------------------------------------------------------------------------

#: What marks a comment as a licence header, and the most lines looked at.
HEADER_WORDS = ("copyright", "©", "(c)", "license", "licensed under", "all rights reserved", "spdx-license-identifier", "permission is hereby", "redistribution", "without warranty", "@file", "@author", "@copyright", "@license", "apache license", "mit license", "mozilla public")
HEADER_LINES = 80
#: What a text may begin with: blank lines, line comments (a number sign has to stand apart, else it is code), block comments.
_LEADING = rf"\A(?:[ \t]*(?:(?://[^\n]*|#(?:[ \t#=*!-][^\n]*)?|/\*[\s\S]*?\*/[ \t]*|\*[^\n]*)?(?:\r?\n|\z))){{1,{HEADER_LINES}}}+"


def strip_header(text: str | Column) -> Column:
    """struct<body, header_lines>: the text without the comments it begins with, if any of them holds one of HEADER_WORDS, and the
    number of lines taken off. At most HEADER_LINES comments and blank lines are looked at; null has no body."""
    text = F.col(text) if isinstance(text, str) else text
    lead = F.regexp_extract(text, _LEADING, 0)
    marked = F.exists(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.lower(lead).contains(w))
    n = F.when(marked, F.length(lead)).otherwise(0)
    lines = F.when(marked, F.length(lead) - F.length(F.replace(lead, F.lit("\n")))).otherwise(0)
    return F.struct(F.substring(text, n + 1, F.length(text)).alias("body"), F.coalesce(lines, F.lit(0)).alias("header_lines"))


def shift_lines(line: Column, header_lines: Column) -> Column:
    """A line of the body as a line of the whole text."""
    return line + header_lines


@pandas_function("string")
def strip_diagrams(text: pd.Series) -> pd.Series:
    """Fenced diagrams become one line that says what was there."""
    fence = re.compile(r"```(mermaid|drawio|manim)\b[^\n]*\n[\s\S]*?```", re.I)
    return text.map(lambda t: t if t is None else fence.sub(lambda m: f"[{m[1].lower()} diagram omitted — {m[0].count(chr(10)) + 1} lines]", t))


#: Lines from which code is cut, lines kept at both ends, and the size from which a brace block is folded.
COMPACT_LINES, COMPACT_HEAD, COMPACT_TAIL, FOLD_CHARS, FOLD_LINES = 48, 28, 8, 160, 4


def compact_code(text: str | Column) -> Column:
    """Long code as its first and last lines with a note between; then brace blocks, each up to its first closing brace, fold to
    their first and last line where they are long. Braces are split off as pieces, so that every piece is looked at once."""
    text = F.col(text) if isinstance(text, str) else text

    def ends(lines: Column, head: int, tail: int, note: Column) -> Column:
        return F.array_join(F.concat(F.slice(lines, 1, head), F.array(note), F.slice(lines, F.size(lines) - tail + 1, tail)), "\n")

    def note(left_out: Column, lead: str, words: str) -> Column:
        return F.concat(F.lit(f"{lead}/* ... "), left_out.cast("string"), F.lit(f" {words} ... */"))

    def cut(lines: Column) -> Column:
        rest = F.size(lines) - (COMPACT_HEAD + COMPACT_TAIL)
        return F.when(F.size(lines) > COMPACT_LINES, ends(lines, COMPACT_HEAD, COMPACT_TAIL, note(rest, "", "lines omitted"))).otherwise(F.array_join(lines, "\n"))

    def fold(piece: Column) -> Column:
        lines = F.split(piece, "\n")
        large = piece.rlike(r"\A\{[^}]*\}\z") & (F.length(piece) > FOLD_CHARS) & (F.size(lines) > FOLD_LINES)
        return F.when(large, ends(lines, 1, 1, note(F.size(lines) - 2, "  ", "lines"))).otherwise(piece)

    short = cut(F.split(F.regexp_replace(text, r"^\s+|\s+\z", ""), "\n"))
    return F.array_join(F.transform(F.regexp_extract_all(short, F.lit(r"(\{[^}]*\}|\{|[^{]+)"), F.lit(1)), fold), "")


@pandas_function("array<string>")
def markdown_links(text: pd.Series, doc_path: pd.Series) -> pd.Series:
    """Files that a Markdown text links to, relative to its place; images, schemes and anchors are left out."""

    def one(t: str | None, p: str | None) -> list[str]:
        found = [m[2] for m in re.finditer(r"(!?)\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)", t or "") if not m[1]]
        found += re.findall(r"<([^<>\s]+\.[A-Za-z0-9]+)>", t or "")
        out = set()
        for x in found:
            bare = re.split(r"[#?]", x.strip())[0]
            if bare and not re.match(r"(https?|mailto|tel|data):|#", x.strip(), re.I):
                out.add(posixpath.normpath(posixpath.join(posixpath.dirname(p or ""), bare)))
        return sorted(out)

    return pd.Series([one(t, p) for t, p in zip(text, doc_path)])


@pandas_function("array<struct<pos:int,kind:string,label:string,href:string,title:string>>")
def linked_text(text: pd.Series) -> pd.Series:
    """[label](href "title") with http, command or file targets, as text and link nodes in order."""
    link = re.compile(r"\[([^\]]+)\]\(((?:https?://|command:|file:)[^\s)]+)(?:\s+(?:\"([^\"]*)\"|'([^']*)'))?\)", re.I)

    def one(t: str | None) -> list[tuple]:
        out, at = [], 0
        for m in link.finditer(t or ""):
            if m.start() > at:
                out.append(("text", t[at : m.start()], None, None))
            out.append(("link", m[1], m[2], m[3] or m[4]))
            at = m.end()
        if at < len(t or ""):
            out.append(("text", t[at:], None, None))
        return [(i, *x) for i, x in enumerate(out)]

    return text.map(one)


@pandas_function("int")
def leading_comment_start(lines: pd.Series, start: pd.Series) -> pd.Series:
    """First line (from 1) of the comment right above a symbol: up to 40 lines up, over at most one blank line."""

    def one(ls: list[str], symbol: int) -> int:
        best, blank, i = symbol, 0, symbol - 2
        while i >= 0 and symbol - i - 1 <= 40:
            line = ls[i].strip()
            if not line:
                blank += 1
                if blank > 1:
                    break
                i -= 1
                continue
            blank = 0
            if not re.match(r"//|/\*|\*|#|--|\"\"\"|'''|@", line):
                break
            if line.startswith("*"):
                while i > 0 and not ls[i].lstrip().startswith("/*"):
                    i -= 1
            best, i = i + 1, i - 1
        return best

    return pd.Series([one(list(a), int(b)) for a, b in zip(lines, start)])


def header_breadcrumb(meta: Column) -> Column:
    """Header_1, Header_2, ... of a map, in the order of their numbers, joined by ``>``."""
    entries = F.map_entries(F.map_filter(meta, lambda k, v: k.rlike(r"^Header_[0-9]+$") & v.isNotNull() & (v != "")))
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct(F.regexp_extract(e["key"], r"(\d+)$", 1).cast("int").alias("n"), e["value"].alias("v"))))
    return F.array_join(F.transform(keyed, lambda e: e["v"]), " > ")


# Routing and intent ----------------------------------------------------------------------------------

#: Patterns of intent.
FAST = (r"^(?:解释|说明|翻译|起名|命名|这是什么|啥意思|what\s+is|what's|how\s+to\s+use|explain|translate|rename|name\s+this)", r"^(?:用一句话|简单说说|简要|briefly|in\s+short)")
REASONING = (r"\b(?:error|failed|crash|bug|exception|stack\s+trace|deadlock|memory\s+leak)\b", r"(?:报错|失败|崩溃|死锁|内存泄漏|异常|为什么.*不工作|why.*(?:fail|not\s+work))", r"\b(?:debug|diagnose|root\s+cause|troubleshoot)\b")
FATAL_EMBEDDING = ("llama-server process has terminated", "llama-server binary not found", "error starting llama-server", "cuda error", "ptx was compiled", "econnrefused", "connectex", "enotfound", "fetch failed", "socket hang up")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def intent(query: Column) -> Column:
    q = F.trim(query)
    return F.when(_any(q, REASONING), "reasoning").when(_any(q, FAST), "fast").otherwise("code")


def route_model(query: Column, models: dict[str, str], default: str) -> Column:
    """The model for a query's intent, or the default where none is set."""
    out = F.lit(default)
    for name, model in models.items():
        out = F.when(intent(query) == name, model).otherwise(out)
    return out


def targets(query: Column) -> Column:
    """doc, git, code: what a query asks about; none of them means all. The word lists are our own."""
    q = F.lower(query)
    hit = lambda name, words: F.when(q.rlike(words), name)
    out = F.array_compact(F.array(hit("doc_chunk", r"\b(readme|docs?|documentation|guide|manual|tutorial)\b|文档|说明"), hit("git_commit", r"\b(commits?|git|history|changelog|blame|who changed)\b|提交"), hit("code_chunk", r"\b(function|class|method|implement\w*|code|where is)\b|函数|实现")))
    return F.when(F.size(out) == 0, F.array(F.lit("all"))).otherwise(out)


def git_mode(query: Column) -> Column:
    """working_diff, recent_commits or null."""
    q = F.lower(query)
    return F.when(q.rlike(r"(did i|my|uncommitted|working|staged).*(modif|chang|diff)|what.*modif|未提交"), "working_diff").when(q.rlike(r"\b(last|recent|latest|show).*commits?\b|git log|最近.*提交"), "recent_commits")


def complexity(query: Column) -> Column:
    """complex for long or many-clause queries or those that ask for relations; simple otherwise."""
    q = F.lower(query)
    return F.when((F.length(q) > 120) | (F.regexp_count(q, F.lit("[;；。?？]")) > 1) | q.rlike(r"\b(architecture|compare|relationship|flow|how does .* work|call graph)\b"), "complex").otherwise("simple")


def sub_questions(query: Column, least: int = 30) -> Column:
    """Clauses of a long query; a short one stays whole."""
    parts = F.filter(F.transform(F.split(query, r"[;；]\s*"), F.trim), lambda p: p != "")
    return F.when((F.length(query) < least) | (F.size(parts) < 2), F.array(query)).otherwise(parts)


def is_fatal_embedding_error(message: Column) -> Column:
    return _any(message, tuple(re.escape(x) for x in FATAL_EMBEDDING))


def result_line(i: Column, score: Column, kind: Column, path: Column, start: Column, end: Column) -> Column:
    where = F.concat(path, F.when(start.isNotNull(), F.concat(F.lit(":"), start.cast("string"), F.lit("-"), F.coalesce(end, start).cast("string"))).otherwise(""))
    return F.concat(F.lit("#"), i.cast("string"), F.lit(" score="), F.format_string("%.4f", score), F.lit(" type="), kind, F.lit(" "), where)


# Boolean and level filters ----------------------------------------------------------------------------


def boolean_filter(text: Column, query: str) -> Column:
    """Comma-separated terms; ``!x`` excludes and wins; else any term includes. ``\\`` escapes a comma or mark."""
    terms = [t.strip() for t in re.split(r"(?<!\\),", query)]
    low, include, exclude = F.lower(text), [], []
    for t in (t for t in terms if t):
        bare = re.sub(r"\\(.)", r"\1", t[1:] if t[0] == "!" else t).lower()
        if bare:
            (exclude if t[0] == "!" else include).append(low.contains(bare))
    keep = F.lit(True) if not include else F.lit(False)
    for c in include:
        keep = keep | c
    for c in exclude:
        keep = keep & ~c
    return keep


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ``**`` over folders, ``*`` and ``?`` inside one, ``{a,b}``, ``[..]``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" and body else body) + "]", end + 1
            continue
        if c == "{":
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            out, i = out + ")", i + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:"}.get(c, "|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{out}$"


def marker_filter(severity: Column, path: Column, text: Column, levels: set[str], include: list[str], exclude: list[str], words: str = "") -> Column:
    """Level, include and exclude globs, and text (negated by a leading ``!``), all to hold."""
    keep = severity.isin(*levels)
    if include:
        keep = keep & path.rlike("|".join(map(glob_regex, include)))
    if exclude:
        keep = keep & ~path.rlike("|".join(map(glob_regex, exclude)))
    if words:
        hit = F.lower(text).contains(words.lstrip("!").lower())
        keep = keep & (~hit if words[0] == "!" else hit)
    return keep


# Lines, positions, indentation ------------------------------------------------------------------------


def eol_stats(text: Column) -> Column:
    """count, first and last line length, and kinds: 1 LF, 2 CRLF, 4 CR, added up."""
    lines = F.split(text, r"\r\n|\r|\n")
    kinds = F.when(text.rlike(r"(?<!\r)\n"), 1).otherwise(0) + F.when(text.rlike(r"\r\n"), 2).otherwise(0) + F.when(text.rlike(r"\r(?!\n)"), 4).otherwise(0)
    return F.struct((F.size(lines) - 1).alias("count"), F.length(F.element_at(lines, 1)).alias("first"), F.length(F.element_at(lines, -1)).alias("last"), kinds.alias("kinds"))


def normalise_indent(line: Column, tab: int, spaces: bool) -> Column:
    """Leading blanks in spaces only, or in tabs and a rest of spaces; a tab goes to the next stop."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    width = F.aggregate(F.filter(F.split(lead, ""), lambda c: c != ""), F.lit(0), lambda w, c: F.when(c == "\t", w - w % tab + tab).otherwise(w + 1))
    made = F.repeat(F.lit(" "), width) if spaces else F.concat(F.repeat(F.lit("\t"), F.floor(width / tab).cast("int")), F.repeat(F.lit(" "), width % tab))
    return F.concat(made, F.substring(line, F.length(lead) + 1, F.length(line)))


def word_at(text: Column, column: Column, pattern: str = r"[\w]+") -> Column:
    """The word that holds or ends at a column (from 1), with its start and end; null if none does."""
    pieces = F.regexp_extract_all(text, F.lit(rf"({pattern}|(?:(?!{pattern})[\s\S])+)"), F.lit(1))
    runs = F.aggregate(pieces, F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("start")),
                       lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(p.rlike(f"^(?:{pattern})$") & (column >= s["at"]) & (column <= s["at"] + F.length(p)), p).otherwise(s["word"]).alias("word"), F.when(p.rlike(f"^(?:{pattern})$") & (column >= s["at"]) & (column <= s["at"] + F.length(p)), s["at"]).otherwise(s["start"]).alias("start")))
    return F.when(runs["word"].isNotNull(), F.struct(runs["word"].alias("word"), runs["start"].alias("start"), (runs["start"] + F.length(runs["word"])).alias("end")))


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """Offset of a line and column (from 1); places outside are moved to the nearest inside."""
    lines = F.split(text, "\n")
    at = F.greatest(F.least(line, F.size(lines)), F.lit(1))
    before = F.aggregate(F.slice(lines, 1, at - 1), F.lit(0), lambda s, x: s + F.length(x) + 1)
    inside = F.greatest(F.least(column - 1, F.length(F.element_at(lines, at))), F.lit(0))
    return F.when(line < 1, 0).when(line > F.size(lines), F.length(text)).otherwise(before + inside)


@pandas_function("string")
def remove_accents(text: pd.Series) -> pd.Series:
    """NFD without U+0300 to U+036F."""
    return text.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ"))


@pandas_function("string")
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def preserve_case(match: Column, new: Column) -> Column:
    """A replacement in the case of what it replaces; parts between hyphens or underscores are taken one by one."""

    def simple(m: Column, n: Column) -> Column:
        first = F.substring(m, 1, 1)
        return F.when(m == "", n).when(F.upper(m) == m, F.upper(n)).when(F.lower(m) == m, F.lower(n)).when(F.upper(first) == first, F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 30))).otherwise(F.concat(F.lower(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 30)))

    def parts(sep: str) -> Column:
        return F.array_join(F.zip_with(F.split(match, sep), F.split(new, sep), simple), sep)

    def both(sep: str) -> Column:
        return match.contains(sep) & new.contains(sep) & (F.size(F.split(match, sep)) == F.size(F.split(new, sep)))

    return F.when(both("-") & ~both("_"), parts("-")).when(both("_") & ~both("-"), parts("_")).otherwise(simple(match, new))


def path_range(text: Column) -> Column:
    """path, line and column of ``path:line[:col]``, ``path(line[,col])``, ``path#line[:col]`` and the like."""
    pattern = r"^(.*?)(?:[:#(\s]|, ?|: ?line |, line )+(\d+)(?:(?:[:#.,\s]|, ?|, col(?:umn)? ?)+(\d+))?\)?:?$"
    pick = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern) & (pick(1) != ""), F.struct(pick(1).alias("path"), pick(2).try_cast("int").alias("line"), pick(3).try_cast("int").alias("column")))


#: Grammars by file extension.
GRAMMARS = {".c": "cpp", ".h": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".cs": "c-sharp", ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin"}
#: Media types by extension.
MIME = {".css": "text/css", ".csv": "text/csv", ".htm": "text/html", ".html": "text/html", ".ics": "text/calendar", ".js": "text/javascript", ".mjs": "text/javascript", ".txt": "text/plain", ".xml": "text/xml", ".gif": "image/gif", ".jpg": "image/jpg", ".png": "image/png", ".svg": "image/svg+xml", ".mp4": "video/mp4", ".wav": "audio/x-wav"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*(\.[^./\\]+)$", 1))


def lookup(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def grammar(path: Column) -> Column:
    return lookup(extension(path), GRAMMARS)


def mime(path: Column) -> Column:
    return lookup(extension(path), MIME)


def mime_matches(pattern: Column, value: Column) -> Column:
    """Equal, or ``type/*`` over the same type; ``*/*`` takes all."""
    return (pattern == "*/*") | (F.lower(pattern) == F.lower(value)) | (pattern.endswith("/*") & (F.lower(F.split_part(pattern, F.lit("/"), F.lit(1))) == F.lower(F.split_part(value, F.lit("/"), F.lit(1)))))


def char_class(c: Column, classes: dict[str, int], default: int) -> Column:
    """The class of a character: each key lists the characters of its class."""
    out = F.lit(default)
    for chars, k in classes.items():
        out = F.when(F.instr(F.lit(chars), c) > 0, k).otherwise(out)
    return out
