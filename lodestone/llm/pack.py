"""Token ids packed into fixed-length rows: best fit decreasing, with a segment tree over capacities.

Documents are tokenised, split losslessly into pieces of at most the row length, and packed inside
batches of bounded size while a partition streams by: no shuffle, and memory that doesn't depend on
the data. Each row is written as its ids (little-endian uint32), the cumulative segment lengths and
the position ids, which start again at 0 with each segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

#: Where the public vocabularies lie; a parameter of every function that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
ROW_TOKENS = 2048
#: Tokens that are packed together; the last row or two of each batch stay partly empty.
BATCH_TOKENS = 2_000_000
#: Characters that are encoded at once.
REGION = 100_000

SCHEMA = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, piece_starts array<bigint>, piece_lasts array<boolean>"


def tokenizer(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """The ids of a text of any length and kind. It is encoded in regions that no match leaves; a region without a place
    to cut it at, as a run of blanks or one endless word, would overflow the library's stack and goes through the rank queue."""
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    own = []

    def encode(text: str) -> list[int]:
        out = []
        for region in bpe.safe_regions(text, REGION):
            if len(region) <= 2 * REGION:
                out += library(region)
                continue
            if not own:
                own.append(bpe.Bpe(ranks, PATTERN))
            out += np.frombuffer(own[0].encode([region])[0], "<u4").tolist()
        return out

    return encode


class Capacities:
    """How many open rows have each remaining capacity; finds the tightest that still fits."""

    def __init__(self, size: int) -> None:
        self.base = 1 << size.bit_length()
        self.tree = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def push(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        v = self.base + capacity
        while v:
            self.tree[v] += 1
            v >>= 1

    def pop(self, least: int) -> tuple[int, int] | None:
        """Takes a row of the smallest remaining capacity that is at least ``least``."""
        tree, v = self.tree, self.base + least
        if not tree[v]:
            while v > 1 and (v & 1 or not tree[v + 1]):
                v >>= 1
            if v <= 1:
                return None
            v += 1
            while v < self.base:
                v = 2 * v if tree[2 * v] else 2 * v + 1
        capacity = v - self.base
        while v:
            tree[v] -= 1
            v >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of sizes (1 to capacity) by row; ties go to the earlier position."""
    open_rows, rows = Capacities(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = open_rows.pop(sizes[i])
        left, row = got if got else (capacity, len(rows))
        if not got:
            rows.append([])
        rows[row].append(i)
        if left > sizes[i]:
            open_rows.push(left - sizes[i], row)
    return rows


def _matrix(pieces: list[tuple], row_tokens: int, first: int) -> pa.RecordBatch:
    """pieces: (doc_id, start in the document, last, ids)."""
    rows = best_fit_decreasing([len(p[3]) for p in pieces], row_tokens)
    cols: list[list] = [[] for _ in range(8)]
    for k, row in enumerate(rows):
        own = [pieces[i] for i in row]
        ends = np.cumsum([len(p[3]) for p in own])
        ids = np.full(row_tokens, END, "<u4")
        ids[: ends[-1]] = np.concatenate([p[3] for p in own])
        starts = np.concatenate(([0], ends[:-1]))
        positions = np.arange(row_tokens, dtype="<u4")
        positions[: ends[-1]] -= np.repeat(starts, ends - starts).astype("<u4")
        positions[ends[-1] :] = np.arange(row_tokens - ends[-1], dtype="<u4")
        values = (first + k, int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], positions.tobytes(), [p[0] for p in own], [p[1] for p in own], [p[2] for p in own])
        for c, v in zip(cols, values):
            c.append(v)
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, vocabulary: str = VOCABULARY, batch_tokens: int = BATCH_TOKENS, text_col: str = "text") -> DataFrame:
    """Packed rows of docs (doc_id, text, any more).

    Every document ends with the END token, so null and empty texts are one END. Repeated rows are
    packed as often as they come; a null doc_id stays null. Documents of more than ``row_tokens``
    ids are cut into pieces of that length and a rest; piece_starts says where in the document
    each begins, piece_lasts whether it is the last. Rows are filled with END behind n_tokens. pack_id
    holds the partition and a running number. An empty table gives no rows. The vocabulary is read by the driver and sent
    to the tasks: its size doesn't depend on the data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks.value)
        made, held, pieces = TaskContext.get().partitionId() << 40, 0, []
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                ids = np.array([*encode(text.encode("utf-8", "replace").decode()), END], "<u4")
                for at in range(0, len(ids), row_tokens):
                    pieces.append((doc_id, at, at + row_tokens >= len(ids), ids[at : at + row_tokens]))
                held += len(ids)
                if held >= batch_tokens:
                    out = _matrix(pieces, row_tokens, made)
                    yield out
                    made, held, pieces = made + out.num_rows, 0, []
        if pieces:
            yield _matrix(pieces, row_tokens, made)

    return docs.select(F.col("doc_id").cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes packed rows; read_matrices gives them back as arrays."""
    packed.write.parquet(path)


def read_matrices(packed: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, cumulative segment lengths, position ids) row by row."""
    for r in packed.toLocalIterator():
        yield np.frombuffer(r.ids, "<u4"), np.array(r.cu_seqlens), np.frombuffer(r.position_ids, "<u4")
