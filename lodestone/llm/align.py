"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

Texts are cut before blanks that follow another sign, where neither tokenizer has a token that goes on. A task
takes its documents in batches and aligns each different unit of a batch once. DuckDB holds the token intervals of both
sides: ASOF joins within each token's range give the overlapping pairs, a window sum over ends that both sides share
the groups. Pair counts of batches are summed in Spark, and each batch is joined with the counts of the pairs it
has, from which it scores its documents.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Characters of documents whose new units are aligned together, different units of a batch, units that are tokenised as one
#: text, such texts in one call, units and pairs in a row of a batch's tables.
STEP_CHARS, BATCH_UNITS, JOINED_UNITS, CALLED, SLICE = 4_000_000, 400_000, 512, 32, 32_768
#: A unit begins with a blank and goes on up to a blank after a sign that is no white space. A token of either side lies within one.
UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*)?|\s+")


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level tokenizer by its JSON description."""

    description: str

    def open(self) -> Callable[[list[str]], list[list[int]]]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.description)
        t.encode_special_tokens = True  # their strings inside texts are plain text
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    @cached_property
    def tokens(self) -> list[bytes]:
        """The bytes of each id: the alphabet writes printable bytes as themselves, the others from U+0100 on."""
        from tokenizers import Tokenizer

        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)}
        vocabulary = Tokenizer.from_str(self.description).get_vocab()
        out = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for w, i in vocabulary.items():
            out[i] = bytes(byte[x] for x in w) if all(x in byte for x in w) else w.encode()
        return out


@dataclass(frozen=True)
class Pieces:
    """A sentence-piece model that puts a blank before each text; it is given the units without theirs."""

    model: bytes

    def open(self) -> Callable[[list[str]], list[list[int]]]:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_proto=self.model)
        blank = [p.piece_to_id("▁")]

        def encode(texts: list[str]) -> list[list[int]]:
            return [ids if len(t) > 1 else blank for t, ids in zip(texts, p.encode([t[1:] for t in texts], num_threads=1))]

        return encode

    @cached_property
    def tokens(self) -> list[bytes]:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_proto=self.model)
        pieces = [(p.is_byte(i), p.id_to_piece(i)) for i in range(p.get_piece_size())]
        return [bytes([int(w[3:5], 16)]) if one else w.replace("▁", " ").encode() for one, w in pieces]


class Side:
    """A tokenizer opened in a task."""

    def __init__(self, tokenizer: ByteLevel | Pieces) -> None:
        self.encode, self.tokens = tokenizer.open(), tokenizer.tokens
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)

    def _spelt(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def intervals(self, units: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, valid): the tokens of all units at byte offsets of their concatenation, and which units' tokens spell them.

        Many units are tokenised as one text; a unit that ends in white space closes it. Invalid units have no tokens.
        """
        cuts = [0]
        for k, u in enumerate(units, 1):
            if k - cuts[-1] == JOINED_UNITS or u[-1].isspace() or k == len(units):
                cuts.append(k)
        spans = list(zip(cuts, cuts[1:]))
        texts = ["".join(units[lo:hi]) for lo, hi in spans]
        valid, found, starts = np.ones(len(units), bool), [], []
        encoded = chain.from_iterable(self.encode(texts[k : k + CALLED]) for k in range(0, len(texts), CALLED))
        for (lo, hi), text, ids in zip(spans, texts, encoded):
            at, made = int(ends[lo - 1]) if lo else 0, np.array(ids, np.int32)
            stops = at + np.cumsum(self.sizes[made]) if ids else np.zeros(0, np.int64)
            if self._spelt(ids) == text.encode() and np.isin(ends[lo:hi], stops).all():
                found.append(made)
                starts.append(stops - self.sizes[made])
                continue
            for k in range(lo, hi):
                ids = self.encode([units[k]])[0]
                valid[k] = self._spelt(ids) == units[k].encode()
                if valid[k]:
                    found.append(np.array(ids, np.int32))
                    starts.append((ends[k - 1] if k else 0) + np.cumsum(self.sizes[found[-1]]) - self.sizes[found[-1]])
        return np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([np.zeros(0, np.int64), *starts]), valid


@lru_cache(2)
def opened(tokenizer: ByteLevel | Pieces) -> Side:
    """One for all tasks of a worker."""
    return Side(tokenizer)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_OVERLAPS = """
    SELECT a.unit, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s WHERE a.s < b.e      -- the token that holds its first byte
    UNION ALL
    SELECT a.unit, a.id AS a, b.id AS b FROM b ASOF JOIN a ON b.s > a.s WHERE b.s < a.e       -- those that begin inside it"""
_GROUPS = """
    WITH x AS (SELECT 0 AS side, a.unit, a.s, a.id, b.e IS NOT NULL AS shared FROM a LEFT JOIN b ON a.e = b.e),
    y AS (SELECT 1 AS side, b.unit, b.s, b.id, a.e IS NOT NULL AS shared FROM b LEFT JOIN a ON a.e = b.e),
    g AS (SELECT *, coalesce(sum(shared::INT) OVER (PARTITION BY side ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS g FROM (FROM x UNION ALL FROM y))
    SELECT g, side, unit, id FROM g ORDER BY g, side, s"""
_PAIRS = """
    CREATE TEMP TABLE pairs AS SELECT a, b, n, row_number() OVER (ORDER BY a, b) - 1 AS pair FROM
        (SELECT a, b, sum(times)::BIGINT AS n FROM links JOIN used USING (unit) GROUP BY a, b)"""
_UNIT_PAIRS = "SELECT unit, pair::INT AS pair FROM links JOIN pairs USING (a, b) JOIN used USING (unit) ORDER BY unit"
_LINKS = ("unit", "a", "b")

_BATCH = "batch long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, at long, own binary, more binary, a array<int>, b array<int>, n array<long>"
_DOC, _UNITS, _PAIR = range(3)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _spelt_groups(g: np.ndarray, side: np.ndarray, unit: np.ndarray, ids: np.ndarray, units: int) -> list[str]:
    """Each unit's groups in decimal: ``a1,a2|b1;a3|b2,b3``. The tokens come ordered by group, side and place."""
    if not len(g):
        return [""] * units
    new = np.concatenate(([True], unit[1:] != unit[:-1]))
    sign = np.where(new, "", np.where(np.concatenate(([True], g[1:] != g[:-1])), ";", np.where(np.concatenate(([True], side[1:] != side[:-1])), "|", ",")))
    written = np.array([str(i) for i in range(int(ids.max()) + 1)], object)
    sizes = np.array([len(x) for x in written])[ids]
    text = "".join(chain.from_iterable(zip(sign.tolist(), written[ids].tolist())))
    ends, out = np.cumsum(sizes + ~new), [""] * units
    first = np.flatnonzero(new)
    lo = ends[first] - sizes[first]
    for u, x, y in zip(unit[first].tolist(), lo.tolist(), [*lo[1:].tolist(), len(text)]):
        out[u] = text[x:y]
    return out


class Batch:
    """Documents of a task, and what is known of their different units: counts of tokens of both sides, groups and links,
    whether the tokens don't spell the unit, the groups as text, and the links."""

    def __init__(self, number: int, left: Side, right: Side, digest: bool) -> None:
        self.number, self.sides, self.digest = number, (left, right), digest
        self.units, self.docs, self.known = Numbers(), [], 0
        self.counts = np.zeros((5, 0), np.int64)
        self.spelt: list[str] = []
        self.links: list[tuple[np.ndarray, ...]] = []
        self.times = np.zeros(0, np.int64)

    def add(self, doc_id: int | None, text: str | None) -> None:
        own = map(self.units.__getitem__, UNIT.findall(f" {text}")) if text else ()
        self.docs.append((doc_id, np.array(list(own), np.int32)))

    def _align(self, units: list[str]) -> None:
        """Aligns units that are new."""
        con = _duckdb()
        ends = np.cumsum([len(u.encode()) for u in units], dtype=np.int64)
        found = [side.intervals(units, ends) for side in self.sides]
        valid, counts = found[0][2] & found[1][2], []
        for name, side, (ids, starts, _) in zip("ab", self.sides, found):
            unit = np.searchsorted(ends, starts, "right").astype(np.int32)
            if not valid.all():
                keep = valid[unit]
                ids, starts, unit = ids[keep], starts[keep], unit[keep]
            counts.append(np.bincount(unit, minlength=len(units)))
            con.register("made", pa.table({"s": starts, "e": starts + side.sizes[ids], "id": ids, "unit": unit}))
            con.execute(f"CREATE TEMP TABLE {name} AS FROM made")
        links = con.sql(_OVERLAPS).to_arrow_table()
        unit, a, b = (links.column(c).to_numpy() for c in _LINKS)
        self.links.append((unit + np.int32(self.known), a, b))
        grouped = con.sql(_GROUPS).to_arrow_table()
        con.close()
        g, of, group_unit, ids = (grouped.column(c).to_numpy() for c in ("g", "side", "unit", "id"))
        first = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
        counts += [np.bincount(group_unit[first], minlength=len(units)), np.bincount(unit, minlength=len(units)), ~valid]
        self.spelt += _spelt_groups(g, of, group_unit, ids, len(units))
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)], axis=1)
        self.known += len(units)

    def settle(self) -> Iterator[dict]:
        """The rows of the documents since the last time: their sums, and their units' numbers."""
        new = list(islice(self.units, self.known, None))
        if new:
            self._align(new)
        sizes = np.array([len(own) for _, own in self.docs], np.int64)
        until = np.concatenate(([0], np.cumsum(sizes)))
        every = np.concatenate([np.zeros(0, np.int32), *(own for _, own in self.docs)])
        # Sums over a document's units: differences of running sums.
        sums = np.array([np.diff(np.concatenate(([0], np.cumsum(c[every])))[until]) for c in self.counts])
        whole = (sums[-1] == 0) & (sizes > 0)
        times = np.bincount(every[np.repeat(whole, sizes)], minlength=self.known)
        times[: len(self.times)] += self.times
        self.times = times
        for (doc_id, own), good, n in zip(self.docs, whole.tolist(), (sums[:-1] * whole).T.tolist()):
            text = ";".join(map(self.spelt.__getitem__, own.tolist())) if good else ""
            groups = hashlib.sha256(text.encode()).hexdigest() if self.digest and good else text
            packed = zlib.compress(own.astype("<i4").tobytes(), 1) if good else b""
            yield dict(zip(("batch", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "own"), (self.number, _DOC, doc_id, *n, groups, packed)))
        self.docs = []

    def finish(self) -> Iterator[dict]:
        """The batch's tables of units and pairs."""
        con = _duckdb()
        unit, a, b = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in self.links)]) for k in range(3))
        con.register("links", pa.table(dict(zip(_LINKS, (unit, a, b)))))
        con.register("counted", pa.table({"unit": np.arange(self.known, dtype=np.int32), "times": self.times}))
        con.execute("CREATE TEMP TABLE used AS FROM counted WHERE times > 0")
        con.execute(_PAIRS)
        links = con.sql(_UNIT_PAIRS).to_arrow_table()
        unit, pair = (links.column(c).to_numpy() for c in ("unit", "pair"))
        for lo in range(0, self.known, SLICE):
            x, y = np.searchsorted(unit, [lo, lo + SLICE])
            if y > x:
                yield {"batch": self.number, "kind": _UNITS, "at": self.known, "own": zlib.compress(unit[x:y].astype("<i4").tobytes(), 1), "more": zlib.compress(pair[x:y].astype("<i4").tobytes(), 1)}
        pairs = con.sql("SELECT a, b, n FROM pairs ORDER BY pair").to_arrow_table()
        con.close()
        for lo in range(0, pairs.num_rows, SLICE):
            yield {"batch": self.number, "kind": _PAIR, "at": lo} | {c: pairs.column(c).slice(lo, SLICE).to_pylist() for c in "abn"}


def _duckdb():
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def _batches(docs: DataFrame, left: ByteLevel | Pieces, right: ByteLevel | Pieces, step_chars: int, batch_units: int, digest: bool) -> DataFrame:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _BATCH.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        made, held = TaskContext.get().partitionId() << 32, 0
        batch = Batch(made, opened(left), opened(right), digest)

        def written(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for row in rows:
                out.append(row)
                size += len(row.get("own", b"")) + len(row.get("groups", "")) + 500
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

        for t in batches:
            for doc_id, text in zip(t.column(0).to_pylist(), t.column(1)):
                text = text.as_py()
                batch.add(doc_id, text)
                held += 100 + len(text or "")
                if held >= step_chars:
                    yield from written(batch.settle())
                    held = 0
                    if batch.known >= batch_units:
                        yield from written(batch.finish())
                        made += 1
                        batch = Batch(made, opened(left), opened(right), digest)
        yield from written(batch.settle())
        yield from written(batch.finish())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BATCH)


def _score(batch: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one batch with n_best and count_sum, from its tables and the counts of its pairs."""
    count, best = (np.zeros(counted.num_rows, np.int64) for _ in range(2))
    at = counted.column("pair").to_numpy()
    count[at], best[at] = counted.column("count").to_numpy(), counted.column("best").to_numpy()
    kind = batch.column("kind").to_numpy()
    tables, docs = batch.filter(pa.array(kind == _UNITS)), batch.filter(pa.array(kind == _DOC))
    units = max(tables.column("at").to_pylist(), default=0)
    sums = np.zeros((2, units), np.int64)
    for own, more in zip(tables.column("own").to_pylist(), tables.column("more").to_pylist()):
        unit, pair = (np.frombuffer(zlib.decompress(x), "<i4") for x in (own, more))
        np.add.at(sums[0], unit, best[pair])
        np.add.at(sums[1], unit, count[pair])
    own = [np.frombuffer(zlib.decompress(x) if x else b"", "<i4") for x in docs.column("own").to_pylist()]
    made = [pa.array([int(s[o].sum()) for o in own], pa.int64()) for s in sums]
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.table({c: made[("n_best", "count_sum").index(c)] if c in ("n_best", "count_sum") else docs.column(c) for c in names})


def align(docs: DataFrame, left: ByteLevel | Pieces, right: ByteLevel | Pieces, step_chars: int = STEP_CHARS, batch_units: int = BATCH_UNITS, digest: bool = False) -> DataFrame:
    """docs (doc_id, text, any more), row for row: n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A blank and the text are tokenised by ``left`` and ``right`` without special tokens. Texts null, empty, or with a
    unit that the tokens of either side don't spell have no tokens: zeros and no groups. Groups end where tokens of both
    sides end, and are written ``a1,a2|b1;a3|b2,b3`` (with ``digest``, as the SHA-256 of that). Links are the pairs of
    tokens that share a byte; a pair's count is its number of links in all rows; n_best are the links whose count is the
    highest of their right id, ties included. Repeated rows count as often as they come; an empty table gives no rows.

    A task holds the units and links of one batch, about ``batch_units`` different units, and the documents of a step, about
    ``step_chars`` characters, or one longer text. The vocabularies go to the tasks
    with the code; the highest counts are broadcast, at most a row for each id of the right one.
    """
    rows = stored(_batches(docs, left, right, step_chars, batch_units, digest))
    pairs = rows.where(F.col("kind") == _PAIR).select("batch", "at", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "p"))
    pairs = pairs.select("batch", (F.col("at") + F.col("place")).alias("pair"), "p.a", "p.b", "p.n")
    counts = stored(pair_counts(pairs))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    scored = counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    counted = pairs.join(scored, ["a", "b"]).select(F.col("batch").alias("of"), "pair", "count", "best")
    own = rows.where(F.col("kind") != _PAIR).select("batch", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "own", "more")
    return own.groupBy("batch").cogroup(counted.groupBy("of")).applyInArrow(_score, _RESULT)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count) of batches' partial counts (a, b, n)."""
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
