"""Byte-level BPE by ranks: encoding with a hierarchical-bitmap queue of merges, and decoding.

A text is cut by the vocabulary's pattern. The matches that are new to a task are laid side by side in one
linked list of parts, which no merge leaves. The queue has a bucket for each merge rank, holding the places whose pair
merges to it, and a bitmap of the buckets that aren't empty, in levels of words: find-first-set on one word a level
gives the next rank, whatever the length. A place that another merge has changed since is stale and skipped. So n
bytes take about n pushes and merges of constant cost, and a match of some million blanks or letters is no special case.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bits of a word of the bitmap; matches that a task remembers with their ids, and the length of the longest of them.
WORD, REMEMBERED, SHORT = 256, 500_000, 64
#: Characters that are cut into matches at once, matches that are looked up at once, bytes of one linked list.
REGION, LOOKED_UP, LISTED = 1 << 20, 250_000, 1 << 20
#: Before a blank between two other signs no match goes on, whatever stands around it.
_SAFE = regex.compile(r"\S(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a line ``base64 rank`` for each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def safe_regions(text: str, size: int) -> Iterator[str]:
    """A text in regions of ``size`` characters or somewhat more, cut where no match goes on; without such a place, the rest is one."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size and (m := _SAFE.search(text, at + size)):
            end = m.end()
        yield text[at:end]
        at = end


class RankQueue:
    """Places by rank."""

    def __init__(self, ranks: int) -> None:
        self.levels = [[0] * (-(-ranks // WORD))]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * (-(-len(self.levels[-1]) // WORD)))
        self.top = self.levels[::-1]
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(place)
            return
        self.buckets[rank] = [place]
        for words in self.levels:
            at = rank // WORD
            held = words[at]
            words[at] = held | 1 << rank % WORD
            if held:
                break
            rank = at

    def first(self) -> int:
        """The smallest rank that has any place; -1: none."""
        at = 0
        for words in self.top:
            word = words[at]
            if not word:
                return -1
            at = at * WORD + (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> list[int]:
        """Empties a bucket; its places in ascending order."""
        places = self.buckets.pop(rank)
        for words in self.levels:
            at = rank // WORD
            words[at] ^= 1 << rank % WORD
            if words[at]:
                break
            rank = at
        if len(places) > 1:
            places.sort()
        return places


class Bpe:
    """Encodes and decodes by ranks, in which every single byte has one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.size, self.pattern = ranks, max(ranks.values(), default=-1) + 1, regex.compile(pattern)
        self.tokens = [b""] * self.size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte = np.array([ranks.get(bytes([c]), -1) for c in range(256)], np.int32)
        self.first_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}
        self.queue = RankQueue(self.size)

    def merged(self, pair: int) -> int:
        """The rank of the bytes of two neighbouring parts, a * size + b; -1: none."""
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        a, b = divmod(pair, self.size)
        got = self.pairs[pair] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return got

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian uint32: the pair of the smallest rank merges first, of equal ones the leftmost."""
        queue, known, size, push = self.queue, self.pairs.get, self.size, self.queue.push
        raw, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])
        n, inner = len(raw), np.ones(len(raw), bool)
        inner[ends - 1] = False  # the last byte of a piece has no pair
        first = np.full(n, -1, np.int32)
        first[:-1] = np.where(inner[:-1], self.first_pairs[raw[:-1], raw[1:]], -1)
        at = np.arange(n, dtype=np.int32)
        after, before = np.where(inner, at + 1, -1), np.where(np.concatenate(([False], inner[:-1])), at - 1, -1)
        ids, rank, right, left = (array("i", x.astype(np.int32).tobytes()) for x in (self.byte[raw], first, after, before))
        order = np.argsort(first, kind="stable").astype(np.int32)
        of = first[order]
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), n]):
            if of[lo] >= 0:
                push(int(of[lo]), int(order[lo]))
                queue.buckets[int(of[lo])] = order[lo:hi].tolist()
        while (r := queue.first()) >= 0:
            places = queue.take(r)
            for k, i in enumerate(places):
                if rank[i] != r:
                    continue
                gone = right[i]
                ids[i], rank[gone], ids[gone] = r, -1, -1
                right[i] = nxt = right[gone]
                least = r
                if nxt >= 0:
                    left[nxt] = i
                    pair = r * size + ids[nxt]
                    new = known(pair)
                    if new is None:
                        new = self.merged(pair)
                    rank[i] = new
                    if new >= 0:
                        push(new, i)
                        if new < least:
                            least = new
                else:
                    rank[i] = -1
                prev = left[i]
                if prev >= 0:
                    pair = ids[prev] * size + r
                    new = known(pair)
                    if new is None:
                        new = self.merged(pair)
                    rank[prev] = new
                    if new >= 0:
                        push(new, prev)
                        if new < least:
                            least = new
                if least < r:  # a vocabulary in which a part has a later rank than what it makes
                    for j in places[k + 1 :]:
                        push(r, j)
                    break
        left_over = np.frombuffer(ids, np.int32)
        counts = np.add.reduceat(left_over >= 0, np.concatenate(([0], ends[:-1]))) if n else []
        out, cuts = left_over[left_over >= 0].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [out[lo:hi] for lo, hi in zip([0, *cuts[:-1]], cuts)]

    def learn(self, matches: set[str]) -> dict[str, bytes]:
        """The ids of matches; short ones are remembered."""
        out, waiting, held = {}, [], 0
        for w in matches:
            piece = w.encode("utf-8", "replace")
            whole = self.ranks.get(piece)
            if whole is not None:
                out[w] = whole.to_bytes(4, "little")
                continue
            waiting.append((w, piece))
            held += len(piece)
            if held >= LISTED:
                out.update(zip((w for w, _ in waiting), self.merge([p for _, p in waiting])))
                waiting, held = [], 0
        if waiting:
            out.update(zip((w for w, _ in waiting), self.merge([p for _, p in waiting])))
        if len(self.known) + len(out) > REMEMBERED:
            self.known = {}
        self.known.update((w, ids) for w, ids in out.items() if len(w) <= SHORT)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32, as the ranks' own library gives them without special tokens."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, waiting = 0, []

        def settle() -> None:
            new = set().union(*(matches for _, matches in waiting)) - self.known.keys()
            before = self.known
            found = self.learn(new)
            for i, matches in waiting:
                out[i].append(b"".join([before.get(w) or found[w] for w in matches]))

        for i, text in enumerate(texts):
            for region in safe_regions(text, REGION):
                matches = self.pattern.findall(region)
                waiting.append((i, matches))
                held += len(matches)
                if held >= LOOKED_UP:
                    settle()
                    held, waiting = 0, []
        settle()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian uint32 ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapped(df: DataFrame, source: str, out: str, ranks: dict[bytes, int], pattern: str, what: str) -> DataFrame:
    """df with the binary column ``out``, in place of any that is named so, made of ``source`` by a method of Bpe over a list."""
    kept = [c for c in df.columns if c.lower() != out.lower() or c == source]
    rows, at, names = df.select(*(F.col(f"`{c}`") for c in kept)), kept.index(source), [c for c in kept if c.lower() != out.lower()]
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(sent.value, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                own = b.slice(lo, 256)
                values = own.column(at).to_pylist()
                made = bpe.encode([v or "" for v in values]) if what == "encode" else [bpe.decode(v or b"") for v in values]
                yield pa.RecordBatch.from_arrays([*(own.column(kept.index(c)) for c in names), pa.array(made, pa.binary())], names=[*names, out])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in names), StructField(out, BinaryType())]))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with ``out``: the ids of the whole text as little-endian uint32, row for row; a null text is empty and has none.

    ``ranks`` (a vocabulary, of a size that doesn't depend on the data) goes to the tasks by broadcast, so executors need no
    file. A column that is already named ``out`` is replaced, all others stay; an empty table gives no rows.
    """
    return _mapped(docs, text, out, ranks, pattern, "encode")


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with ``out``: the bytes that the ids of encode() stand for; null ids give none."""
    return _mapped(df, ids, out, ranks, "", "decode")
