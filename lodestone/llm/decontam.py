"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage is any ``WIDTH`` consecutive characters of an item, wherever they begin. A stretch of text within
``BUDGET`` edits of it shares at least ``WIDTH - Q + 1 - Q * BUDGET`` q-grams with it, on diagonals (text
position minus item position) at most that many apart. So shared q-grams are counted in diagonal bands that
overlap by half, in a window that slides over the item; windows that reach the bound make a region, and a
region is kept only where a banded alignment finds a passage within the budget. Nothing is cut on a grid: every
verbatim passage of WIDTH characters is found, and every longer one with BUDGET edits in some WIDTH of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

WIDTH, Q, BUDGET = 50, 10, 3
#: Benchmark characters searched for in one pass; a larger benchmark takes several passes.
PASS_CHARS = 1_000_000
#: An item's part in the index, characters of a text looked at together, and shared q-grams expanded at a time.
PIECE, WINDOW, HITS = 4096, 1 << 20, 1 << 21
_BITS = 22
_M = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one blank."""
    return " ".join((text or "").lower().split())


def codes(chars: np.ndarray) -> np.ndarray:
    """A 64-bit code for each run of Q characters."""
    with np.errstate(over="ignore"):
        c = chars.astype(np.uint64) + np.uint64(1)
        g2 = c[:-1] * _M + c[1:]
        g4 = g2[:-2] * (_M * _M) + g2[2:]
        g8 = g4[:-4] * (_M * _M * _M) + g4[4:]
        g10 = g8[:-2] * (_M * _M * _M * _M) + g2[8:]
        return g10 ^ (g10 >> np.uint64(29))


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def width_of(length: int) -> int:
    """The length of a passage of an item: items shorter than WIDTH are one passage."""
    return min(WIDTH, length)


def budget_of(length: int) -> int:
    """The edits allowed in a passage: BUDGET at full width, in proportion below, and so that four q-grams remain."""
    return max(0, min(BUDGET, length * BUDGET // WIDTH, (length - Q - 3) // Q))


@dataclass
class Index:
    """Pieces of items (item, place in the item, characters) and their q-grams, sorted by code. Items under two q-grams long
    are looked for as they are, as words of their own."""

    pieces: list[tuple[int | None, int, np.ndarray]]
    short: dict[str, list[int | None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        made = [codes(c) for _, _, c in self.pieces]
        none = np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(made)), [len(m) for m in made]) if made else none
        pos = np.concatenate([np.arange(len(m)) for m in made]) if made else none
        code = np.concatenate(made) if made else none.astype(np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, self.of, self.pos = code[order], of[order].astype(np.int32), pos[order].astype(np.int32)
        self.maybe = np.zeros(1 << _BITS, np.uint8)
        self.maybe[(code >> np.uint64(64 - _BITS)).astype(np.int64)] = 1
        self.width = np.array([width_of(len(c)) for _, _, c in self.pieces], np.int64)
        self.budget = np.array([budget_of(w) for w in self.width], np.int64)
        self.need = self.width - Q + 1 - Q * self.budget
        self._words, self._halves = None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": None, "_halves": None}

    @staticmethod
    def of_items(items: list[tuple[int | None, str | None]]) -> Index:
        return Index.of_parts([(item, 0, normalise(text)) for item, text in items])

    @staticmethod
    def of_parts(parts: list[tuple[int | None, int, str]]) -> Index:
        """parts: (item, place in the normalised item, what it has there)."""
        pieces, short = [], {}
        for item, place, plain in parts:
            c = _chars(plain)
            if len(c) >= 2 * Q:
                pieces += [(item, place + at, c[at : at + PIECE]) for at in range(0, max(1, len(c) - 2 * WIDTH), PIECE - 2 * WIDTH)]
            elif plain and not place:
                short.setdefault(plain, []).append(item)
        return Index(pieces, short)

    def halves(self) -> tuple[Index, Index]:
        if not self._halves:
            mid = len(self.pieces) // 2
            self._halves = Index(self.pieces[:mid]), Index(self.pieces[mid:])
        return self._halves

    def words(self, plain: str) -> Iterator[tuple[int | None, int, int]]:
        """(item, start, end) of short items that stand in the text as words of their own."""
        if not self.short:
            return
        if self._words is None:
            self._words = ahocorasick.Automaton()
            for k in self.short:
                self._words.add_word(k, k)
            self._words.make_automaton()
        for last, k in self._words.iter(plain):
            start, end = last - len(k) + 1, last + 1
            if not (plain[start - 1 : start].isalnum() and k[0].isalnum() or plain[end : end + 1].isalnum() and k[-1].isalnum()):
                for item in self.short[k]:
                    yield item, start, end


def banded(segments: np.ndarray, regions: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the least edits that turn the segment into a stretch of the region that begins and ends inside its
    band, and the stretch's end: an alignment of all rows at once.

    A region is its segment's length plus the band long: the band holds every diagonal on which the stretch may lie.
    Cells outside it are never visited. Characters of regions that aren't text are 0.
    """
    n, width = segments.shape
    band = regions.shape[1] - width
    step = np.arange(band + 1)
    far = np.int64(width + band + 1)
    cost = np.zeros((n, band + 1), np.int64)
    for i in range(width):
        cells = regions[:, i : i + band + 1]
        if cells.shape[1] <= band:
            cells = np.pad(cells, ((0, 0), (0, band + 1 - cells.shape[1])))
        best = cost + (cells != segments[:, i, None])
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        # Characters of the text left over: each costs one on the way to the right.
        cost = np.minimum(np.minimum.accumulate(best - step, axis=1) + step, far)
        if cost.min() > budget:
            break
    else:
        at = cost.argmin(1)
        return cost[np.arange(n), at], at + width
    return np.full(n, far), np.zeros(n, np.int64)


#: A region: piece, first and last place in the piece, edits, start and end in the text.
Region = tuple[int, int, int, int, int, int]


def regions(index: Index, chars: np.ndarray, base: int = 0) -> Iterator[tuple[int | None, int, int, int, int, int]]:
    """(item, edits, start and end in the item, start and end in the text) of every region that holds a passage.

    Memory is bounded by HITS: where a text and the items share more q-grams, first the text is halved, then the items.
    """
    if len(chars) < Q or not len(index.code):
        return
    code = codes(chars)
    at = np.flatnonzero(index.maybe[(code >> np.uint64(64 - _BITS)).astype(np.int64)])
    least = int(index.need.min())
    if len(at) < least:
        return
    # A passage has ``least`` hits within its width and budget: drop hits without such company.
    crowd = np.searchsorted(at, at + WIDTH + BUDGET) - np.arange(len(at))
    head = np.flatnonzero(crowd >= least)
    if not len(head):
        return
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, head, 1)
    np.add.at(cover, head + crowd[head], -1)
    at = at[np.cumsum(cover)[:-1] > 0]
    lo, hi = np.searchsorted(index.code, code[at], "left"), np.searchsorted(index.code, code[at], "right")
    many = hi - lo
    total = int(many.sum())
    if total < least:
        return
    if total > HITS:
        if len(chars) > 8 * WIDTH:
            mid = len(chars) // 2
            yield from regions(index, chars[: mid + 2 * WIDTH], base)
            yield from regions(index, chars[mid - 2 * WIDTH :], base + mid - 2 * WIDTH)
            return
        if len(index.pieces) > 1:
            for half in index.halves():
                yield from regions(half, chars, base)
            return
    entry = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(total)
    piece, pos, text = index.of[entry].astype(np.int64), index.pos[entry].astype(np.int64), np.repeat(at, many)
    # Few pieces share enough with the text to reach their bound at all.
    keep = (np.bincount(piece, minlength=len(index.pieces)) >= index.need)[piece]
    if not keep.any():
        return
    piece, pos, diag = piece[keep], pos[keep], (text - pos)[keep]
    whole, covered = _verbatim(index, chars, piece, pos, diag)
    for k, first, last, edits, start, end in (*whole, *_edited(index, chars, piece, pos, diag, covered)):
        item, place, _ = index.pieces[k]
        yield item, edits, place + first, place + last, base + start, base + end


def _verbatim(index: Index, chars: np.ndarray, piece: np.ndarray, pos: np.ndarray, diag: np.ndarray) -> tuple[list[Region], np.ndarray]:
    """Runs of q-grams one after the other on a diagonal that make up a passage, and which q-grams are in one."""
    order = np.lexsort((pos, diag, piece))
    p, x, d = piece[order], pos[order], diag[order]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1))))
    size = np.diff(np.concatenate((new, [len(p)])))
    long = size >= index.width[p[new]] - Q + 1
    out = []
    for r in np.flatnonzero(long):
        a, k = new[r], int(p[new[r]])
        first, last = int(x[a]), int(x[a]) + int(size[r]) + Q - 1
        if np.array_equal(chars[first + d[a] : last + d[a]], index.pieces[k][2][first:last]):
            out.append((k, first, last, 0, first + int(d[a]), last + int(d[a])))
        else:
            long[r] = False
    covered = np.zeros(len(p), bool)
    covered[order] = np.repeat(long, size)
    return out, covered


def _edited(index: Index, chars: np.ndarray, piece: np.ndarray, pos: np.ndarray, diag: np.ndarray, covered: np.ndarray) -> Iterator[Region]:
    """Regions by count of q-grams in bands, aligned; windows that begin in a verbatim passage are found already."""
    half = 2 * BUDGET
    for offset in (0, half):
        key = piece * np.int64(1 << 32) + (diag + PIECE + offset) // (2 * half)
        # Bands that hold nothing but verbatim passages have no window to begin.
        left = np.flatnonzero(np.isin(key, np.unique(key[~covered])))
        if not len(left):
            continue
        order = left[np.lexsort((pos[left], key[left]))]
        k, x = key[order], pos[order]
        # Each place of the item counts once, however often its q-gram comes in the band.
        one = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (x[1:] != x[:-1]))))
        done = np.logical_or.reduceat(covered[order], one)
        k, x = k[one], x[one]
        group = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
        of = k >> 32
        flat = group * np.int64(4 * PIECE) + x
        count = np.searchsorted(flat, flat + index.width[of] - Q, "right") - np.arange(len(flat))
        full = np.flatnonzero((count >= index.need[of]) & ~done)
        if not len(full):
            continue
        # Passages begin at or before their first shared q-gram, and hold as many as they need.
        begin = np.maximum(x[full + index.need[of[full]] - 1] - (index.width[of[full]] - Q), 0)
        for g in np.unique(group[full]):
            own = full[group[full] == g]
            here = group[full] == g
            number = int(of[own[0]])
            width, budget, (_, _, body) = int(index.width[number]), int(index.budget[number]), index.pieces[number]
            starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(begin[here], x[own])]))
            starts = starts[starts <= len(body) - width]
            if not len(starts):
                continue
            low = int(k[own[0]] & 0xFFFFFFFF) * 2 * half - PIECE - offset
            band = 2 * half + 2 * budget
            for part in range(0, len(starts), 4096):
                s = starts[part : part + 4096]
                places = (s + low - budget)[:, None] + np.arange(width + band)
                inside = (places >= 0) & (places < len(chars))
                texts = np.where(inside, chars[np.clip(places, 0, len(chars) - 1)].astype(np.int64) + 1, 0)
                edits, ends = banded(body[s[:, None] + np.arange(width)].astype(np.int64) + 1, texts, budget)
                for i in np.flatnonzero(edits <= budget):
                    end = int(min(places[i, 0] + ends[i], len(chars)))
                    yield number, int(s[i]), int(s[i]) + width, int(edits[i]), max(0, end - width), end


def find(index: Index, text: str | None) -> list[tuple[int | None, int, int, int, int, int]]:
    """(item, edits, start and end in the item, start and end in the normalised text): what overlaps in the text is one
    region, with the least edits of a passage in it."""
    plain = normalise(text)
    found = [(item, 0, 0, end - start, start, end) for item, start, end in index.words(plain)]
    if len(index.code):
        for base in range(0, max(1, len(plain)), WINDOW):
            first = max(0, base - 2 * WIDTH)
            found += regions(index, _chars(plain[first : base + WINDOW]), first)
    out: list[tuple] = []
    for r in sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[4], r[5])):
        if out and out[-1][0] == r[0] and r[4] <= out[-1][5]:
            a = out[-1]
            out[-1] = (r[0], min(a[1], r[1]), min(a[2], r[2]), max(a[3], r[3]), a[4], max(a[5], r[5]))
        else:
            out.append(r)
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets in the text as given of stretches of its normalised form, in one walk over the words."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    sizes = np.array([len(text[a:b].lower()) for a, b in words], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(sizes)]
    out = []
    for start, end in spans:
        i, j = (max(0, int(np.searchsorted(begin, x, "right")) - 1) for x in (start, max(start, end - 1)))
        (a, b), (c, d) = words[i], words[j]
        out.append((min(b, a + start - int(begin[i])), min(d, c + end - int(begin[j]))))
    return out


_SCHEMA = "doc_id long, item_id long, edits int, item_start int, item_end int, start long, end long"


def _indexes(benchmark: DataFrame, pass_chars: int) -> Iterator[tuple[Index, bool]]:
    """The index of each pass, and whether it is the last; made when it is asked for, of at most ``pass_chars`` characters and an overlap.

    Items come to the driver by and by, dealt by id and text, so that neither a null id nor one that many items share
    makes a large pass; an item longer than a pass is cut into parts that overlap by two passages.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    held, size = [], 0
    for r in items.repartition(max(1, -(-2 * total // pass_chars)), "item_id", "text").toLocalIterator():
        plain = normalise(r.text)
        for at in range(0, max(1, len(plain) - 2 * WIDTH), pass_chars):
            part = plain[at : at + pass_chars + 2 * WIDTH]
            if held and size + len(part) > pass_chars:
                yield Index.of_parts(sorted(held, key=lambda x: (x[0] is not None, x))), False
                held, size = [], 0
            held.append((r.item_id, at, part))
            size += len(part)
    yield Index.of_parts(sorted(held, key=lambda x: (x[0] is not None, x))), True


def _passes(benchmark: DataFrame, pass_chars: int, work: Callable[[Broadcast[Index]], DataFrame]) -> Iterator[tuple[DataFrame, str | None]]:
    """What ``work`` makes of each pass, and the path of its table. A single pass is not worked off here; of several, one is
    written and its index released before the next is made."""
    alone = True
    for index, last in _indexes(benchmark, pass_chars):
        sent = benchmark.sparkSession.sparkContext.broadcast(index)
        if alone and last:
            yield work(sent), None
            return
        alone = False
        yield written(work(sent))
        sent.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """A row for each region of a document that holds a passage of a benchmark item: doc_id, item_id, edits
    (least of any passage in it), item_start, item_end (code points of the normalised item), start, end (code points
    of the text as given). A passage that comes twice is two regions.

    The benchmark is sent to the executors in passes of at most about ``pass_chars`` characters; a
    usual benchmark is one pass, others are written pass by pass. What crosses the cut of an item longer than a pass is
    two regions. Null or empty texts and items match nothing. Items shorter than WIDTH are
    one passage each, with fewer edits; those under 20 characters are found verbatim, as words of their own. Repeated
    items count once; repeated documents give repeated rows. An empty table gives no rows.
    """
    def search(index: Broadcast[Index]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    t = t.as_py()
                    if got := find(index.value, t):
                        rows += [(i, *r[:4], *span) for r, span in zip(got, original_spans(t, [r[4:] for r in got]))]
                kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)

    return reduce(DataFrame.unionByName, (found for found, _ in _passes(benchmark, pass_chars, search)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage, as contaminated() finds them.

    Each row is judged by its own text, without a shuffle: rows that share a doc_id, or have none, don't
    take each other along. Null and empty texts stay; an empty benchmark keeps every row.
    """
    at, left = docs.columns.index("text"), docs

    def keep(index: Broadcast[Index]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not find(index.value, t.as_py()) for t in b.column(at)], pa.bool_()))

        return left.mapInArrow(run, docs.schema)

    before = None
    for left, path in _passes(benchmark, pass_chars, keep):
        if before:
            forget(docs.sparkSession, before)
        before = path
    return left
