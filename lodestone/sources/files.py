"""Files, listings and logs as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.udf import pandas_function
from ..session import use_checkpoints
from ..functions.text import extension, glob_regex

#: Folders that a scan leaves out, folders that come last, and what may be indexed.
SKIPPED = ("node_modules", ".git", ".build", "out", "build", "dist", "prebuilts", "prebuilt", "prebuild", "target", "bin", "obj", "venv", "env", "__pycache__", "coverage", "temp", "tmp", ".vscode", ".github", ".gitlab", ".gitea", ".svn", ".hg", ".idea", ".settings", ".circleci", ".husky", "third_party", "third-party", ".venv", ".gradle", ".cargo", ".next", ".nuxt", ".yarn", ".pnpm", "test", "tests")
LAST = ("external", "third_party", "third-party", "vendor", "vendors", "deps", "dependencies")
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".cpp", ".h", ".hpp", ".c", ".py", ".md", ".txt", ".sci", ".sce", ".m", ".java")
SPECIAL = ("compile_commands.json",)


def _folders(path: Column) -> Column:
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def in_skipped_folder(path: Column) -> Column:
    """Whether a folder of the path is on the list or begins with a dot; the file's own name isn't looked at."""
    return F.exists(_folders(path), lambda p: F.lower(p).isin(*SKIPPED) | (p.startswith(".") & ~p.isin(".", "..")))


def is_indexable(path: Column, special: Sequence[str] = SPECIAL) -> Column:
    """By extension, or by name: ``special`` names, such as those of ignore files, are indexed wherever they lie."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    parts = F.split(path, r"[/\\]")
    return base.isin(*special) | (~F.exists(parts, lambda p: p.isin(*SKIPPED[:6])) & extension(path).isin(*EXTENSIONS))


def is_ignored(path: Column, patterns: Sequence[str]) -> Column:
    """A glob fits, or the path is the pattern or below it."""
    p, out = F.replace(path, F.lit("\\"), F.lit("/")), F.lit(False)
    for g in (x.replace("\\", "/").strip() for x in patterns):
        if g:
            bare = g.rstrip("/")
            out = out | p.rlike(glob_regex(g)) | (p == bare) | p.startswith(f"{bare}/")
    return out


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content, length, modificationTime) of files below root, without those in skipped folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    return files.where(~in_skipped_folder(below(F.col("path"), root)))


def scan_bytes(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, whole) of the same files: whether as many bytes as a file has were read. No row holds a file, so it may have
    any size: files are split, and read as what lies between zero bytes (a Parquet file has one after each page's head).

    Spark leaves out empty files. A reader doesn't tell whether a zero byte ended the last piece, so one byte is left open; nor does
    it hand on a byte order mark at a file's start, which Parquet files don't have.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\0")
    pieces = (reader.option("pathGlobFilter", glob) if glob else reader).text(root)
    read = pieces.select(F.col("_metadata.file_path").alias("_at"), (F.octet_length("value") + 1).alias("n")).groupBy("_at").agg(F.sum("n").alias("n"))
    found = scan(spark, root, glob).select("path", "length", F.col("_metadata.file_path").alias("_at")).join(read, "_at", "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("path", "length", ((n == F.col("length")) | (n == F.col("length") + 1)).alias("whole"))


def below(path: Column, root: str) -> Column:
    """A path without its root."""
    return F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")


def listing(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), sibling: tuple[str, str] | None = None) -> DataFrame:
    """Paths that fit an include glob and no exclude glob. sibling=(a, b): drop *.a where the same stem has *.b."""
    out = files
    if include:
        out = out.where(F.col("path").rlike("|".join(map(glob_regex, include))))
    if exclude:
        out = out.where(~F.col("path").rlike("|".join(map(glob_regex, exclude))))
    if sibling:
        stem = lambda ext: F.regexp_extract("path", rf"^(.*)\.{re.escape(ext)}$", 1)
        having = files.where(stem(sibling[1]) != "").select(stem(sibling[1]).alias("_stem")).distinct()
        out = out.withColumn("_stem", F.when(stem(sibling[0]) != "", stem(sibling[0]))).join(having, "_stem", "left_anti").drop("_stem")
    return out


def ignore_rules(rules: Sequence[str], folder: str = "") -> list[tuple[str, bool, bool]]:
    """(regex over paths, negated, folders only) of an ignore file that lies in folder."""
    out = []
    for line in rules:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.lstrip("!")
        only_folders, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))[1:-1]
        base = re.escape(folder.rstrip("/") + "/") if folder else ""
        out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{body}$", negated, only_folders))
    return out


def drop_ignored(files: DataFrame, rule_files: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Files that no ignore file rules out, themselves or through a folder above them.

    rule_files: (folder, lines), outer folders first; later rules win, and a negated rule takes back an earlier
    one on the same path. Every ancestor of a path is tested in the row itself: no join.
    """
    rules = [r for folder, lines in rule_files for r in ignore_rules(lines, folder)]
    parts = F.filter(F.split(F.col("path"), "/"), lambda p: p != "")
    n = F.size(parts)
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("p"), (i < n).alias("dir")))

    def ignored(a: Column) -> Column:
        out = F.lit(False)
        for regex, negated, only in rules:
            fits = a["p"].rlike(regex) & (a["dir"] if only else F.lit(True))
            out = F.when(fits, not negated).otherwise(out)
        return out

    return files.where(~F.exists(ancestors, ignored))


_GLOB = re.compile(r"[*?\[{\\\\]")


@pandas_function("array<struct<ord:int,regex:string,negated:boolean,folders:boolean,kind:string,key:string>>")
def ignore_entries(folder: pd.Series, text: pd.Series) -> pd.Series:
    """The rules of ignore files, each with what a path must have to fit it: a name, an extension, a first part below the folder, or nothing."""

    def key(line: str) -> tuple[str, str]:
        line = line.strip().lstrip("!").rstrip("/")
        if "/" in line:
            first = line.lstrip("/").split("/")[0]
            return ("any", "") if _GLOB.search(first) else ("first", first)
        if not _GLOB.search(line):
            return "name", line
        return ("ext", line[2:]) if line.startswith("*.") and not _GLOB.search(line[2:]) and "." not in line[2:] else ("any", "")

    def one(f: str | None, t: str | None) -> list[tuple]:
        lines = [x for x in (t or "").splitlines() if x.strip() and not x.strip().startswith("#")]
        return [(i, *rule, *key(x)) for i, (x, rule) in enumerate(zip(lines, ignore_rules(lines, f or "")))]

    return pd.Series([one(f, t) for f, t in zip(folder, text)])


def drop_ignored_by(files: DataFrame, rule_files: DataFrame) -> DataFrame:
    """Files (path, any more) that no ignore file rules out, themselves or through a folder above them; rule_files: (folder, text).

    The same as drop_ignored(), for any number of ignore files: rules are rows. Every different path and folder meets the
    rules of the folders above it that name something it has, by an equi-join; of those that fit the deepest folder's last
    one holds. Files without a path stay; of ignore files that share a folder the one with the largest text counts.
    """
    slashed = lambda parts, n: F.array_join(F.slice(parts, 1, n), "/")
    one_each = rule_files.select(F.coalesce(F.trim(F.col("folder"), F.lit("/")), F.lit("")).alias("folder"), "text").groupBy("folder").agg(F.max("text").alias("text"))
    rules = one_each.select("folder", F.explode(ignore_entries("folder", "text")).alias("r")).select("folder", "r.*")
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    n = F.size("parts")
    above = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(slashed(F.col("parts"), i).alias("p"), (i < n).alias("dir")))
    held = files.where("path is not null").select("path").distinct().withColumn("parts", parts).select("path", F.explode(above).alias("a")).select("path", "a.p", "a.dir")
    things = held.select("p", "dir").distinct().withColumn("parts", F.split("p", "/")).withColumn("at", F.explode(F.sequence(F.lit(0), n - 1)))
    name = F.element_at("parts", -1)
    keys = F.array(
        F.struct(F.lit("name").alias("kind"), name.alias("key")), F.struct(F.lit("ext").alias("kind"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("key")),
        F.struct(F.lit("first").alias("kind"), F.get("parts", F.col("at")).alias("key")), F.struct(F.lit("any").alias("kind"), F.lit("").alias("key")),
    )
    asking = things.select("p", "dir", "at", slashed(F.col("parts"), F.col("at")).alias("folder"), F.explode(keys).alias("k")).select("p", "dir", "at", "folder", "k.*")
    fits = asking.join(rules, ["folder", "kind", "key"]).where(F.rlike("p", F.col("regex")) & (F.col("dir") | ~F.col("folders")))
    ruled = fits.groupBy("p", "dir").agg(F.max_by(~F.col("negated"), F.struct("at", "ord")).alias("out")).where("out").select("p", "dir")
    return files.join(held.join(ruled, ["p", "dir"], "left_semi").select("path").distinct(), "path", "left_anti").select(*(F.col(f"`{c}`") for c in files.columns))


def decode(content: Column) -> Column:
    """UTF-16 by its mark, else UTF-8; null for binaries (an undecodable character among the first 1000, and a NUL)."""
    mark = F.hex(F.substring(content, 1, 2))
    body = F.when(mark == "FFFE", F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE")).when(mark == "FEFF", F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE")).otherwise(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", ""))
    return F.when(F.substring(body, 1, 1000).contains("\ufffd") & body.contains("\x00"), None).otherwise(body)


# Logs ------------------------------------------------------------------------------------------------

COMMIT = "struct<path:string,added:int,deleted:int>"


def parse_log(lines: DataFrame, prefix: str = "COMMIT|") -> DataFrame:
    """(hash, author, date, message, files) from (line_no, line).

    A header line opens a record; tab lines under it are file counts (``-`` is 0). A message may hold
    pipes. Records without a hash are dropped. With a ``log`` column there are many logs, each on its own; without one, lines are
    one sequence, which is cut into ranges whose headers are counted on from those before: no task holds it all.
    """
    keys = ["log"] if "log" in lines.columns else []
    head = F.col("line").startswith(prefix)
    if keys:
        rec = F.sum(head.cast("int")).over(Window.partitionBy(*keys).orderBy("line_no"))
    else:
        use_checkpoints(lines.sparkSession)
        lines = lines.repartitionByRange("line_no").withColumn("_part", F.spark_partition_id()).checkpoint()
        heads = {r["_part"]: r["n"] for r in lines.groupBy("_part").agg(F.count_if(head).alias("n")).collect()}
        before = F.array(*(F.lit(sum(n for q, n in heads.items() if q < p)) for p in range(max(heads, default=0) + 1)))
        rec = F.get(before, F.col("_part")) + F.sum(head.cast("int")).over(Window.partitionBy("_part").orderBy("line_no"))
    df = lines.withColumn("rec", rec).where("rec > 0")
    part = F.split("line", r"\|")
    tabs = F.split("line", "\t")
    count = lambda i: F.coalesce(F.get(tabs, F.lit(i)).try_cast("int"), F.lit(0))
    rec = df.groupBy(*keys, "rec").agg(
        F.max(F.when(head, F.struct(part[1].alias("hash"), F.get(part, F.lit(2)).alias("author"), F.get(part, F.lit(3)).alias("date"), F.array_join(F.slice(part, 5, F.greatest(F.size(part), F.lit(5))), "|").alias("message")))).alias("h"),
        F.array_sort(F.collect_list(F.when(~head & (F.size(tabs) >= 3), F.struct("line_no", F.array_join(F.slice(tabs, 3, F.greatest(F.size(tabs), F.lit(3))), "\t").alias("path"), count(0).alias("added"), count(1).alias("deleted"))))).alias("f"),
    )
    files = F.transform("f", lambda x: F.struct(x["path"].alias("path"), x["added"].alias("added"), x["deleted"].alias("deleted")))
    return rec.where("h.hash <> ''").select(*keys, "h.hash", "h.author", "h.date", "h.message", files.alias("files"))


def write_log(lines: DataFrame, path: str, record: Column) -> None:
    """Writes (log, line_no, line) as text files, a folder for each log. ``record`` is a number that rises with line_no and that the
    lines of a record share: a large log is cut between records into several files, each written by its own task."""
    ranged = lines.withColumn("_record", record).repartitionByRange("log", "_record").sortWithinPartitions("log", "line_no")
    ranged.select("log", F.col("line").alias("value")).write.partitionBy("log").text(path)


def read_git_log(spark: SparkSession, path: str, prefix: str = "COMMIT|") -> DataFrame:
    """Captured ``git log --numstat`` text files: (log, hash, author, date, message, files).

    A row of the scan is a record, as the text source cuts files before header lines; so nothing is shuffled, and large files are
    read by many tasks. What stands before a file's first header is left out.
    """
    rows = spark.read.text(path, lineSep="\n" + prefix).select(F.input_file_name().alias("log"), "value", (F.col("_metadata.file_block_start") == 0).alias("_first"))
    # Of a file's rows only the first still has its prefix; where it has none it is no record.
    opening = rows.where("_first").withColumn("_at", F.monotonically_increasing_id()).groupBy("log").agg(F.min_by("value", "_at").alias("value"))
    stray = opening.where(~F.col("value").startswith(prefix)).withColumn("_first", F.lit(True))
    rows = rows.join(F.broadcast(stray), ["log", "value", "_first"], "left_anti")
    text = F.when(F.col("_first") & F.col("value").startswith(prefix), F.substring("value", len(prefix) + 1, 1 << 30)).otherwise(F.col("value"))
    rows = rows.select("log", F.split(F.regexp_replace(text, "\r$", ""), "\r?\n").alias("lines")).withColumn("head", F.split(F.get("lines", F.lit(0)), r"\|"))
    count = lambda tabs, i: F.coalesce(F.get(tabs, F.lit(i)).try_cast("int"), F.lit(0))
    tabs = F.filter(F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.split(x, "\t")), lambda t: F.size(t) >= 3)
    of = lambda t: F.struct(F.array_join(F.slice(t, 3, F.size(t)), "\t").alias("path"), count(t, 0).alias("added"), count(t, 1).alias("deleted"))
    at = lambda i: F.get("head", F.lit(i))
    message = F.array_join(F.slice("head", 4, F.greatest(F.size("head"), F.lit(1))), "|")
    return rows.where(at(0) != "").select("log", at(0).alias("hash"), at(1).alias("author"), at(2).alias("date"), message.alias("message"), F.transform(tabs, of).alias("files"))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(file, added, removed) from tab-separated lines; empty lines give nothing."""
    tabs = F.split("line", "\t")
    count = lambda i: F.coalesce(F.get(tabs, F.lit(i)).try_cast("int"), F.lit(0))
    return lines.where(F.size(tabs) >= 3).select(F.get(tabs, F.lit(2)).alias("file"), count(0).alias("added"), count(1).alias("removed"))


def commit_totals(commits: DataFrame) -> DataFrame:
    total = lambda f: F.aggregate("files", F.lit(0).cast("long"), lambda s, x: s + x[f])
    return commits.select("hash", total("added").alias("lines_added"), total("deleted").alias("lines_deleted"), F.size("files").alias("files_changed"))


def commit_document(commits: DataFrame) -> DataFrame:
    """(hash, text): a commit as plain text."""
    rows = F.transform("files", lambda f: F.concat(F.lit("- "), f["path"], F.lit(" (+"), f["added"].cast("string"), F.lit(", -"), f["deleted"].cast("string"), F.lit(")")))
    shown = F.when(F.size("files") == 0, F.lit("- (no file stats)")).otherwise(F.array_join(rows, "\n"))
    return commits.select("hash", F.concat_ws("\n", F.concat(F.lit("Commit Hash: "), "hash"), F.concat(F.lit("Author: "), "author"), F.concat(F.lit("Date: "), "date"), F.concat(F.lit("Message: "), "message"), F.lit("Modified Files:"), shown).alias("text"))


# Small formats ---------------------------------------------------------------------------------------


@pandas_function("array<struct<key:string,value:string>>")
def env_entries(text: pd.Series) -> pd.Series:
    """KEY=VALUE files: optional ``export``, ``=`` or ``:``, comments, three kinds of quotes; the last of a key wins."""
    line = re.compile(r"""^[ \t]*(?:export[ \t]+)?([\w.-]+)[ \t]*(?:=|:[ \t])[ \t]*("(?:\\.|[^"\\])*"|'[^']*'|`[^`]*`|[^\n#]*)""", re.M)

    def one(t: str | None) -> list[tuple[str, str]]:
        out = {}
        for k, v in line.findall((t or "").replace("\r\n", "\n").replace("\r", "\n")):
            v = v.strip()
            if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'`":
                v = v[1:-1].replace("\\n", "\n").replace("\\r", "\r") if v[0] == '"' else v[1:-1]
            out.pop(k, None)
            out[k] = v
        return list(out.items())

    return text.map(one)


def strip_json_comments(text: Column) -> Column:
    """JSON without // and /* */ comments and closing commas; strings stay as they are."""
    string = r'("(?:\\.|[^"\\])*")'
    bare = F.regexp_replace(text, rf"(?s){string}|//[^\n]*|/\*.*?\*/", "$1")
    return F.regexp_replace(bare, rf"{string}|,(?=\s*[}}\]])", "$1")


def read_jsonc(df: DataFrame, text_col: str, schema: str) -> DataFrame:
    return df.withColumn("value", F.from_json(strip_json_comments(F.col(text_col)), schema))


#: Tags of typed values, and how deep they are revived.
URI_TAG, REGEX_TAG, DATE_TAG, DEPTH = 1, 2, 17, 200


def typed_date(ts: Column) -> Column:
    """A time as a tagged object, for to_json()."""
    return F.struct(F.lit(DATE_TAG).alias("$mid"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("source"))


def typed_regex(source: Column, flags: Column) -> Column:
    return F.struct(F.lit(REGEX_TAG).alias("$mid"), source.alias("source"), flags.alias("flags"))


@pandas_function("array<struct<path:string,kind:string,value:string>>")
def revive_json(text: pd.Series) -> pd.Series:
    """Every leaf of a JSON text with its path: tagged URIs, patterns and times as such, other values as JSON. What lies
    deeper than DEPTH stays JSON; broken JSON and nulls give null."""

    def walk(x: object, path: str, depth: int) -> list[tuple[str, str, str]]:
        tag = x.get("$mid") if isinstance(x, dict) else None
        if tag == URI_TAG:
            return [(path, "uri", f"{x.get('scheme', 'file')}://{x.get('authority', '')}{x.get('path', '')}")]
        if tag == REGEX_TAG:
            return [(path, "regex", f"/{x.get('source', '')}/{x.get('flags', '')}")]
        if tag == DATE_TAG:
            return [(path, "date", str(x.get("source")))]
        if not isinstance(x, dict | list) or depth > DEPTH:
            return [(path, "json", json.dumps(x, ensure_ascii=False))]
        parts = x.items() if isinstance(x, dict) else enumerate(x)
        return [leaf for k, v in parts for leaf in walk(v, f"{path}.{k}" if path else str(k), depth + 1)]

    def one(t: str | None) -> list | None:
        try:
            return None if t is None else walk(json.loads(t), "", 0)
        except ValueError:
            return None

    return text.map(one)


def splice_tokens(data: Column, edits: Column) -> Column:
    """An integer array after splices (start, delete, data), the last place first."""
    order = F.array_sort(edits, lambda a, b: (b["start"] - a["start"]).cast("int"))
    return F.aggregate(order, data, lambda a, e: F.concat(F.slice(a, 1, e["start"]), e["data"], F.slice(a, e["start"] + e["delete"] + 1, F.greatest(F.size(a), F.lit(0)))))
