"""Code graphs: extraction, relations, neighbours, communities."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions.udf import pandas_function
from ..session import scratch, use_checkpoints
from ..sources.stores import replace_files

KINDS = ("calls", "imports", "inherits", "contains")

_ENDED = re.compile(r"^[ \t]*function[ \t]*(?:\[?[\w, \t]*\]?[ \t]*=[ \t]*)?([A-Za-z_]\w*)[ \t]*\(", re.M)


def _symbols_of(text: str, code: str | None = None) -> list[tuple[str, str, int, int]]:
    """(type, name, first line, last line): by tokens, or where functions end in ``end`` by those lines."""
    found = lexer.symbols(text, code)
    if found or not re.search(r"^[ \t]*end(?:function)?\b", text, re.M):
        return found
    lines, out = text.split("\n"), []
    for m in _ENDED.finditer(text):
        k = text.count("\n", 0, m.start(1))
        own = len(lines[k]) - len(lines[k].lstrip())
        end = next((j for j in range(k + 1, len(lines)) if re.match(r"[ \t]*end(?:function)?\b", lines[j]) and len(lines[j]) - len(lines[j].lstrip()) <= own), len(lines) - 1)
        out.append(("function", m[1], k + 1, end + 1))
    return out


@pandas_function("array<struct<symbol_type:string,symbol_name:string,start_line:int,end_line:int,text:string>>")
def chunk_code(text: pd.Series) -> pd.Series:
    """Symbols of a source text as chunks; a text without any is one chunk of type file."""

    def one(t: str | None) -> list[tuple]:
        if not t:
            return []
        lines = t.split("\n")
        found = _symbols_of(t) or [("file", None, 1, len(lines))]
        return [(k, n, a, b, "\n".join(lines[a - 1 : b])) for k, n, a, b in found]

    return text.map(one)


@pandas_function("array<struct<part:int,start_line:int,end_line:int,text:string>>")
def parted(text: pd.Series, start_line: pd.Series, most: pd.Series) -> pd.Series:
    """A chunk's text in parts of at most ``most`` characters, cut between lines; a longer line is a part of its own, or several."""

    def one(t: str | None, first: int, n: int) -> list[tuple]:
        out, held, size, at = [], [], 0, first
        for k, line in enumerate((t or "").split("\n"), first):
            for lo in range(0, max(len(line), 1), n):
                piece = line[lo : lo + n]
                if held and (size + 1 + len(piece) > n or lo):
                    out.append((len(out) + 1, at, k if lo else k - 1, "\n".join(held)))
                    held, size, at = [], 0, k
                size += len(piece) + (1 if held else 0)
                held.append(piece)
        return [*out, (len(out) + 1, at, k, "\n".join(held))]

    return pd.Series([one(t, int(a), int(n)) for t, a, n in zip(text, start_line, most)])


def part_chunks(chunks: DataFrame, most: int = 1500) -> DataFrame:
    """Chunks (text, start_line, ..., any more) no longer than ``most`` characters: longer ones in several rows with ``part`` from 1."""
    rest = [c for c in chunks.columns if c not in ("text", "start_line", "end_line", "part")]
    return chunks.select(*rest, F.explode(parted("text", "start_line", F.lit(most))).alias("_p")).select(*rest, "_p.*")


_RELATIONS = "array<struct<kind:string,source:string,target:string,line:int>>"


def _parsed(t: str | None) -> tuple[list[tuple], list[tuple]]:
    """(symbols, relations) of a text, which is masked and cut into tokens once."""
    t = t or ""
    masked = lexer.masked(t)
    out, symbols = [], _symbols_of(t, masked)
    for i, (line, code) in enumerate(zip(t.split("\n"), masked.split("\n")), 1):
        m = code.strip() and re.match(r"\s*(?:import\b.*?\bfrom\s*['\"]([^'\"]+)|import\s*['\"]([^'\"]+)|#include\s*[<\"]([^>\"]+)|from\s+([\w.]+)\s+import|import\s+([\w.]+)|.*\brequire\(['\"]([^'\"]+))", line)
        if m:
            out.append(("imports", None, next(g for g in m.groups() if g), i))
            continue
        own = [s for s in symbols if s[2] <= i <= s[3]]
        head = next((s for s in symbols if s[2] == i), None)
        if head and (x := re.search(r"\b(?:extends|implements)\s+([A-Za-z_]\w*)|:\s*(?:public\s+)?([A-Z]\w*)\s*\{|class\s+\w+\(([A-Za-z_]\w*)\)", code)):
            out.append(("inherits", head[1], next(g for g in x.groups() if g), i))
        if own:
            for c in re.findall(r"\b([A-Za-z_$][\w$]*)\s*\(", code):
                if c not in ("if", "for", "while", "switch", "return", "catch", "function", "def") and not (head and c == head[1]):
                    out.append(("calls", own[0][1], c, i))
    return symbols, out


@pandas_function(_RELATIONS)
def extract_relations(text: pd.Series) -> pd.Series:
    """imports (source null), calls and contains by enclosing symbol, inherits by class."""
    return text.map(lambda t: _parsed(t)[1])


@pandas_function(f"struct<symbols:array<struct<kind:string,name:string>>,relations:{_RELATIONS}>")
def parse_code(text: pd.Series) -> pd.DataFrame:
    """Both kinds and names of symbols, and relations."""
    parsed = [_parsed(t) for t in text]
    return pd.DataFrame({"symbols": [[s[:2] for s in symbols] for symbols, _ in parsed], "relations": [r for _, r in parsed]})


#: A name that more files than this define says nothing about which is meant.
MOST_DEFINITIONS = 20


def build_graph(files: DataFrame, most_definitions: int = MOST_DEFINITIONS) -> tuple[DataFrame, DataFrame]:
    """nodes (id, file, kind, name) and edges (file, src, dst, kind) from files (file, text).

    Imports are resolved by file stem and calls by symbol name: in the caller's own file if it defines the name, else in all files
    that do, unless they are more than ``most_definitions``. What is defined nowhere is left out. Files are parsed once, into
    shared storage. No table is broadcast: what a text holds isn't foreseen by the size of its file, and each is as long as the files.
    """
    use_checkpoints(files.sparkSession)
    parsed = files.select("file", parse_code("text").alias("p")).checkpoint()
    symbols = parsed.select("file", F.explode("p.symbols").alias("s")).select("file", "s.kind", "s.name").distinct()
    nodes = parsed.select(F.col("file").alias("id"), "file", F.lit("file").alias("kind"), F.col("file").alias("name"))
    nodes = nodes.unionByName(symbols.select(F.concat("file", F.lit("#"), "name").alias("id"), "file", "kind", "name")).dropDuplicates(["id"])
    rel = parsed.select("file", F.explode("p.relations").alias("r")).select("file", "r.kind", "r.source", "r.target").distinct()
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/\\]+)$", 1), r"\.[A-Za-z]+$", "")
    by_stem = files.select(F.col("file").alias("dst"), stem(F.col("file")).alias("stem"))
    imports = rel.where("kind = 'imports'").withColumn("stem", stem(F.regexp_replace("target", r"\.(?=[A-Za-z_]\w*$)", "/"))).join(by_stem.hint("shuffle_hash"), "stem").select("file", F.col("file").alias("src"), "dst", "kind")
    named = symbols.select(F.col("name").alias("target"), F.concat("file", F.lit("#"), "name").alias("dst"))
    asked = rel.where("kind in ('calls', 'inherits')")
    own = asked.join(symbols.select("file", F.col("name").alias("target")).distinct().hint("shuffle_hash"), ["file", "target"], "left_semi").withColumn("dst", F.concat("file", F.lit("#"), "target"))
    rare = named.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_definitions).select("target")
    others = asked.join(own.select("file", "target").distinct().hint("shuffle_hash"), ["file", "target"], "left_anti").join(named.join(rare.hint("shuffle_hash"), "target").hint("shuffle_hash"), "target")
    calls = own.select(*others.columns).unionByName(others).select("file", F.concat("file", F.lit("#"), "source").alias("src"), "dst", "kind")
    contains = symbols.select("file", F.col("file").alias("src"), F.concat("file", F.lit("#"), "name").alias("dst"), F.lit("contains").alias("kind"))
    return nodes, imports.unionByName(calls).unionByName(contains).where("src <> dst").distinct()


def update_graph(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with everything of files (file) replaced; empty new tables purge."""
    return replace_files(nodes, new_nodes, files), replace_files(edges, new_edges, files)


def entity_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("n"))


def relations(nodes: DataFrame, edges: DataFrame, entity: str | None = None, file: str | None = None, kind: str | None = None) -> DataFrame:
    """Edges with both ends' names and files; entity and file may be at either end."""
    if kind:
        edges = edges.where(F.col("kind") == kind)
    end = lambda n: nodes.select(F.col("id").alias(n), F.col("name").alias(f"{n}_name"), F.col("file").alias(f"{n}_file"))
    out = edges.select("src", "dst", "kind").join(end("src"), "src").join(end("dst"), "dst")
    if entity:
        out = out.where((F.col("src_name") == entity) | (F.col("dst_name") == entity))
    return out.where((F.col("src_file") == file) | (F.col("dst_file") == file)) if file else out


def related_files(nodes: DataFrame, edges: DataFrame, file: str, most: int = 20) -> DataFrame:
    """(file, kind): imports, imported_by, calls or references of a file."""
    both = relations(nodes, edges, file=file).where("src_file <> dst_file")
    there = both.where(F.col("src_file") == file).select(F.col("dst_file").alias("file"), F.when(F.col("kind") == "imports", "imports").otherwise("calls").alias("kind"))
    back = both.where(F.col("dst_file") == file).select(F.col("src_file").alias("file"), F.when(F.col("kind") == "imports", "imported_by").otherwise("references").alias("kind"))
    return there.unionByName(back).distinct().orderBy("kind", "file").limit(most)


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1, most: int | None = None) -> DataFrame:
    """(node, hop) within ``hops`` steps of seeds (node), along edges (src, dst) either way; seeds left out.

    Starts from the seeds: each hop joins the front alone, which a small front does without shuffling the edges.
    """
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        front = front.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    out = seen.where("hop > 0")
    return out.orderBy("hop", "node").limit(most) if most else out


def linked_files(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Files that hits' linked_files name."""
    return hits.select("id", F.explode("linked_files").alias("file")).join(files.select("file").distinct(), "file", "left_semi")


def modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> float:
    """Sum over communities of in / 2m - resolution * (total / 2m)^2, for undirected edges (a, b, w), each once."""
    a = assignment.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    b = assignment.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(a, "a").join(b, "b")
    ends = e.select(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("w") * 2).otherwise(0.0).alias("i"), "w").unionByName(e.select(F.col("cb").alias("c"), F.lit(0.0).alias("i"), "w"))
    per = ends.groupBy("c").agg(F.sum("i").alias("i"), F.sum("w").alias("t"))
    m2 = per.agg(F.sum("t").alias("m2"))
    got = per.crossJoin(F.broadcast(m2)).agg(F.sum(F.col("i") / F.col("m2") - resolution * (F.col("t") / F.col("m2")) * (F.col("t") / F.col("m2")))).first()[0]
    return float(got or 0.0)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back: computed once, and of a known size."""
    df.write.parquet(at := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _local_moves(both: DataFrame, strength: DataFrame, m2: float, inner: float, rounds: int, resolution: float) -> tuple[DataFrame, float]:
    """(node, community) by local moves in rounds over edges (a, b, w) both ways, best by modularity, and that; ``inner`` is the
    weight that lies inside nodes.

    Half of the nodes, by hash and round, may move at a time, so that neighbours don't swap for ever. A round is one written
    table, which also has what the modularity of the state before it takes.
    """
    state = strength.select(F.col("a").alias("node"), F.col("a").alias("community"), "k")
    best, best_q, idle = state, float("-inf"), 0
    for r in range(rounds + 1):
        total = state.groupBy("community").agg(F.sum("k").alias("tot"))
        # Staying is an option even where no neighbour is in one's own community.
        met = both.join(state.select(F.col("node").alias("b"), "community"), "b").select("a", "community", "w")
        options = met.unionByName(state.select(F.col("node").alias("a"), "community", F.lit(0.0).alias("w"))).groupBy("a", "community").agg(F.sum("w").alias("kin"))
        o = options.join(total, "community").join(state.select(F.col("node").alias("a"), F.col("community").alias("own"), "k"), "a")
        stays = F.col("community") == F.col("own")
        gain = F.col("kin") - resolution * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
        pick = o.withColumn("g", gain).groupBy("a", "own", "k").agg(F.max_by("community", F.struct("g", stays.alias("stay"), "community")).alias("to"), F.sum(F.when(stays, F.col("kin")).otherwise(0.0)).alias("kin"))
        moves = F.pmod(F.xxhash64("a", F.lit(r // 2)), F.lit(2)) == r % 2
        after = _kept(pick.select(F.col("a").alias("node"), F.when(moves, F.col("to")).otherwise(F.col("own")).alias("community"), "own", "k", "kin"), "moves")
        inside, squares = after.groupBy("own").agg(F.sum("k").alias("t"), F.sum("kin").alias("i")).agg(F.sum("i"), F.sum(F.col("t") / m2 * F.col("t") / m2)).first()
        q = (inside + inner) / m2 - resolution * squares
        best, best_q, idle = (state, q, 0) if q > best_q + 1e-12 else (best, best_q, idle + 1)
        if idle >= 4:
            break
        state = after.select("node", "community", "k")
    return best.select("node", "community"), best_q


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 8, resolution: float = 1.0) -> tuple[DataFrame, float]:
    """(node, community) and modularity of undirected edges (a, b, w).

    Nodes move until modularity stays; then communities become the nodes of a smaller graph, whose nodes move in
    turn, level by level, until a level gains nothing. Every round is cut by a written table. No edges: nothing, and 0.
    Plain modularity (``resolution`` 1) joins communities that are small beside the whole graph, however loosely they are tied;
    a resolution that grows with the graph judges them alike at every size.
    """
    both = _kept(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("a <> b").select("a", "b", F.col("w").cast("double").alias("w")), "edges")
    strength = _kept(both.groupBy("a").agg(F.sum("w").alias("k")), "strength")
    m2 = strength.agg(F.sum("k")).first()[0]
    found = strength.select(F.col("a").alias("node"), F.col("a").alias("community"))
    if not m2:
        return found.limit(0), 0.0

    def through(state: DataFrame, above: DataFrame) -> DataFrame:
        return state.withColumnRenamed("community", "_c").join(above.select(F.col("node").alias("_c"), "community"), "_c").select("node", "community")

    best_q, inner = float("-inf"), 0.0
    for _ in range(levels):
        state, q = _local_moves(both, strength, m2, inner, rounds, resolution)
        if q <= best_q + 1e-12:
            break
        found, best_q = _kept(through(found, state), "found"), q
        ends = state.select(F.col("node").alias("a"), F.col("community").alias("ca")), state.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        strength = _kept(strength.join(ends[0], "a").groupBy(F.col("ca").alias("a")).agg(F.sum("k").alias("k")), "strength")
        # What lies inside a community is part of its strength and of no move.
        both = _kept(both.join(ends[0], "a").join(ends[1], "b").where("ca <> cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "edges")
        left = both.agg(F.sum("w")).first()[0]
        if not left:
            break
        inner = m2 - left
    return found, modularity(edges, found, resolution)
