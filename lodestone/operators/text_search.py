"""Search in texts: matches with ranges and previews, snippets, sections, context assembly."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.udf import pandas_function

MATCHES = "array<struct<start_line:int,start_col:int,end_line:int,end_col:int,preview:string>>"

#: Texts that a task searches at a time.
SLICE = 256


def search(docs: DataFrame, id_col: str, pattern: str, quota: int = 10_000, chars: int = 250) -> DataFrame:
    """(id, matches, total, limit_hit): places from 0, lines may be crossed, previews start 20 characters before.

    At most ``quota`` matches of a text are given with places; all are counted in total, and limit_hit says that there are more
    than are given.
    """

    place = pa.struct([(c, pa.int32()) for c in ("start_line", "start_col", "end_line", "end_col")] + [("preview", pa.string())])
    kind = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(pattern)
        for part in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            rows = []
            for at, t in enumerate(part.column(1).to_pylist()):
                found, total, starts = [], 0, None
                for m in rx.finditer(t or ""):
                    if m.end() == m.start():
                        continue
                    total += 1
                    if total > quota:
                        continue
                    starts = starts or [0, *(i + 1 for i, c in enumerate(t) if c == "\n")]
                    a, b = bisect.bisect_right(starts, m.start()) - 1, bisect.bisect_right(starts, m.end()) - 1
                    left = max(starts[a], m.start() - 20)
                    found.append((a, m.start() - starts[a], b, m.end() - starts[b], t[left : left + chars].split("\n")[0] if a == b else t[left : m.end()]))
                if total:
                    rows.append((at, found, total, total > quota))
            at, found, total, hit = zip(*rows) if rows else ((), (), (), ())
            matches = pa.array([[dict(zip(place.names, f)) for f in x] for x in found], pa.list_(place))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), matches, pa.array(total, pa.int64()), pa.array(hit, pa.bool_())], names=[id_col, "matches", "total", "limit_hit"])

    schema = StructType([StructField(id_col, kind.dataType), *StructType.fromDDL(f"matches {MATCHES}, total bigint, limit_hit boolean")])
    return docs.select(id_col, "text").mapInArrow(run, schema)


def search_folders(docs: DataFrame, folder: str, id_col: str, pattern: str, most: int) -> DataFrame:
    """(folder, id, taken, limit_hit): of each folder's texts, in order of id, the matches up to ``most`` a folder; limit_hit says
    that the folder has more. Each folder is searched on its own; whether any hit its limit is their OR.

    A text with a match takes one at least, so only the first ``most`` + 1 of them can count: no folder is gathered.
    """
    n = docs.select(folder, id_col, F.regexp_count("text", F.lit(pattern)).cast("long").alias("n")).where("n > 0")
    w = Window.partitionBy(folder).orderBy(id_col)
    few = n.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most + 1)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(folder))
    few = few.withColumn("_before", before).withColumn("limit_hit", total > most).where(F.col("_before") < most)
    return few.select(folder, id_col, F.least("n", F.lit(most) - F.col("_before")).alias("taken"), "limit_hit")


def search_lines(docs: DataFrame, id_col: str, pattern: str) -> DataFrame:
    """(id, line_no, line, n) of lines with a match, without leaving the JVM."""
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("n", F.regexp_count("line", F.lit(pattern))).where("n > 0")


@pandas_function("struct<start:int,end:int>")
def find_text(text: pd.Series, snippet: pd.Series) -> pd.DataFrame:
    """Lines (from 1) of a snippet: as it is, else without fences and markup, blanks apart; nulls if it isn't there."""

    def one(t: str | None, s: str | None) -> tuple[int | None, int | None]:
        t, s = (x.replace("\r\n", "\n") if x else "" for x in (t, s))
        at = t.find(s) if s else -1
        if at >= 0:
            first = t.count("\n", 0, at) + 1
            return first, first + s.rstrip("\n").count("\n")
        plain = lambda x: re.sub(r"[*_`#>\s]+", " ", x).strip()
        want = [plain(x) for x in re.sub(r"^```\w*\n?|\n?```\s*$", "", s).split("\n")]
        want = [x for x in want if x]
        lines = [(i, plain(x)) for i, x in enumerate(t.split("\n"), 1)]
        lines = [x for x in lines if x[1]]
        for i in range(len(lines) - len(want) + 1 if want else 0):
            if all(w in lines[i + k][1] for k, w in enumerate(want)):
                return lines[i][0], lines[i + len(want) - 1][0]
        return None, None

    return pd.DataFrame([one(t, s) for t, s in zip(text, snippet)], columns=["start", "end"])


def section_headers(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, line_no, kind, label, separator) of ``#region`` and ``MARK:`` lines, from 1; headers with neither a label nor a
    separator are left out. Both are patterns over one line, so no window of lines is needed; marked_blocks() is for
    patterns over several."""
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    region = F.regexp_extract("line", r"(?i)^\s*(?://|#|/\*|--|<!--)?\s*#?\s*region\b[:\s]*(.*?)\s*(?:-->|\*/)?\s*$", 1)
    mark = F.regexp_extract("line", r"\bMARK:\s*(-?\s*.*?)\s*(?:\*/)?\s*$", 1)
    kind = F.when(F.col("line").rlike(r"(?i)^\s*(//|#|/\*|--|<!--)?\s*#?\s*region\b"), "region").when(F.col("line").rlike(r"\bMARK:"), "mark")
    raw = F.when(kind == "region", region).otherwise(mark)
    out = lines.withColumn("kind", kind).where("kind is not null")
    return out.select(id_col, (F.col("i") + 1).alias("line_no"), "kind", F.trim(F.regexp_replace(raw, r"^-+|-+$", "")).alias("label"), raw.startswith("-").alias("separator")).where("label <> '' or separator")


#: Lines looked at together, and the most lines of a header over several lines.
CHUNK_LINES, HEADER_MOST = 100, 5


def marked_blocks(docs: DataFrame, id_col: str, pattern: str) -> DataFrame:
    """(id, line_no, end_line, label, separator) of headers that a pattern with groups ``label`` and ``separator`` finds, over several
    lines. Lines are looked at in chunks of CHUNK_LINES that overlap by HEADER_MOST, so longer headers are found only where they
    lie in one chunk; one that overlaps the header before it is left out."""

    @F.pandas_udf("array<struct<line_no:int,end_line:int,label:string,separator:boolean>>")
    def run(text: pd.Series) -> pd.Series:
        rx = re.compile(pattern, re.M | re.S)

        def one(t: str | None) -> list[tuple]:
            lines, out = (t or "").split("\n"), []
            for first in range(0, len(lines), CHUNK_LINES - HEADER_MOST):
                chunk = "\n".join(lines[first : first + CHUNK_LINES])
                for m in rx.finditer(chunk):
                    g = m.groupdict()
                    a = first + chunk.count("\n", 0, m.start()) + 1
                    b = a + m[0].count("\n")
                    if (g.get("label") or g.get("separator")) and (not out or a > out[-1][1]):
                        out.append((a, b, g.get("label") or "", bool(g.get("separator"))))
            return out

        return text.map(one)

    return docs.select(id_col, F.explode(run("text")).alias("h")).select(id_col, "h.*")


def split_context(text: Column) -> Column:
    """Sections of a context by their ``--- NAME`` lines."""
    return F.filter(F.transform(F.split(text, r"\n(?=--- (?:FILE|GRAPH|LINKED CODE|GIT))"), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", "")), lambda s: s != "")


def merge_context(sections: DataFrame, budget: int, git_budget: int, excluded: list[str] | None = None) -> DataFrame:
    """sections (query_id, rank, kind, path, text) that fit: git ones into their own budget, the others into theirs, by rank."""
    if excluded:
        sections = sections.where(F.col("path").isNull() | ~F.col("path").isin(*excluded))
    git = F.col("kind") == "git"
    used = F.sum(F.length("text")).over(Window.partitionBy("query_id", git).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("used", used).where(F.col("used") <= F.when(git, git_budget).otherwise(budget))


#: Tools that write a file, and what names one in a user's text.
WRITERS, MAKER = ("edit_file", "rewrite_file", "create_file_or_folder"), "create_file_or_folder"
NAMED_FILE = r"""[`'"]?([^\s`'"]*(?:[\\/][^\s`'"]*)+\.md)[`'"]?|(?:输出|写入|write|create)[^\n]*?([^\s`'"]+\.md)"""


def deliverable(messages: DataFrame) -> DataFrame:
    """(conv_id, path): the .md file that a tool wrote last with success, else the first that a user names: with a folder,
    or on a line after a word for writing.

    messages (conv_id, turn, role, text, path), and where tools differ (tool, ok, is_folder): without these columns every
    tool row is a successful edit.
    """
    has = lambda c: c in messages.columns
    wrote = (F.col("role") == "tool") & F.lower("path").endswith(".md")
    if has("ok"):
        wrote = wrote & F.coalesce("ok", F.lit(False))
    if has("tool"):
        wrote = wrote & F.col("tool").isin(*WRITERS)
    if has("is_folder"):
        wrote = wrote & ~((F.col("tool") == MAKER) & F.coalesce("is_folder", F.lit(False)))
    edited = F.max_by("path", F.when(wrote, F.col("turn")))
    found = F.concat(*(F.regexp_extract("text", f"(?i){NAMED_FILE}", g) for g in (1, 2)))
    named = F.when(F.col("role") == "user", found)
    first = F.min_by(named, F.when(named != "", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(edited, first).alias("path"))
