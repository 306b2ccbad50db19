"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, homoglyphs and digit substitutions become plain letters, invisible
signs go, everything else becomes one blank, and three or more single letters in a row become one word. The lexicon (words and word beginnings, each with cautious log odds of its
rate among words) and the three numbers that turn matches into a probability are fitted on a bounded
sample of labelled rows. Matches inside exception phrases don't count; the sum of weights is
normalised by the text's length in words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut

#: At most about so many labelled rows are read for fitting; a pattern counts at most BURST times in one document, so that
#: repetitive texts don't rule. Both are parameters of fit().
SAMPLE_ROWS, BURST = 20_000, 8
#: Letters of other scripts and signs that look like Latin letters.
HOMOGLYPHS = dict(zip("авеіјкмнорстухѕԁɡօαβεηικνορτυχ@$€£", "abeijkmhopctyxsdgoabenikvoptuxasel", strict=True))
HOMOGLYPHS |= dict(zip("ıɩɪłøđħƒɑʋѵԛԝӏոսհց", "iiilodhfauvqwlnuhg", strict=True))
HOMOGLYPHS |= dict(zip("ᴀʙᴄᴅᴇɢʜᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢ", "abcdeghjklmnoprtuvwyz", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bag", "clown fish", "clown nose", "pathetic fallacy", "pond scum", "sore loser rule", "village idiot pub")
#: Used with weight 3 if no labels can be learnt from.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting")
MIN_PREFIX, MAX_PREFIX = 3, 8


class Fold(dict):
    """For str.translate: a character's folded form, found once and kept."""

    def __missing__(self, code: int) -> str:
        out = ""
        if unicodedata.category(chr(code)) != "Cf":
            bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
            for c in unicodedata.normalize("NFC", bare).lower():
                c = HOMOGLYPHS.get(c, DIGITS.get(c, c))
                out += c if c.isalpha() else " "
        self[code] = out
        return out


_FOLD = Fold()
#: Three or more letters that stand alone.
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    words = " ".join(unicodedata.normalize("NFC", text or "").translate(_FOLD).split())
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), words).split()


@dataclass
class Model:
    """words and prefixes: weight by pattern. bias, slopes: of the logistic of features()."""

    words: dict[str, float]
    prefixes: dict[str, float]
    bias: float = -4.0
    slopes: tuple[float, ...] = (1.5, 1.5, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for pattern, weight, kind in (*((f" {w} ", x, 0) for w, x in self.words.items()), *((f" {p}", x, 0) for p, x in self.prefixes.items()), *((f" {' '.join(fold(e))} ", 0.0, 1) for e in self.exceptions)):
                a.add_word(pattern, (weight, kind, len(pattern)))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, words: list[str]) -> dict[int, float]:
        """The largest weight by place of the word that begins there, without those inside exception phrases."""
        found: dict[int, float] = {}
        spans = []
        a = self.automaton
        if not len(a):
            return found
        for end, (weight, kind, n) in a.iter(f" {' '.join(words)} "):
            at = end - n + 1
            if kind:
                spans.append((at, end))
            elif weight > found.get(at, 0.0):
                found[at] = weight
        for lo, hi in spans:
            for at in [x for x in found if lo <= x < hi]:
                del found[at]
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Matched weight (log), matched weight a word (root), matches a hundred words (log)."""
        words = fold(text)
        got = self.matches(words)
        total = sum(got.values())
        n = max(len(words), 1)
        return float(np.log1p(total)), float(np.sqrt(total / n)), float(np.log1p(100 * len(got) / n))

    def score(self, text: str | None) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.slopes, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _evidence(words: list[str]) -> Counter:
    """How often each whole word (as ``word ``) and each beginning of a word comes; under "", all words."""
    out = Counter({"": len(words)})
    for w, n in Counter(words).items():
        out[f"{w} "] += n
        for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1):
            out[w[:k]] += n
    return out


def _toxic_counts(texts: DataFrame, burst: int) -> DataFrame:
    """(pattern, docs, n): documents and occurrences of every pattern of the toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(docs: Counter, n: Counter) -> pa.RecordBatch:
            keys = list(docs)
            return pa.record_batch([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (docs, n))], names=["pattern", "docs", "n"])

        docs, n = Counter(), Counter()
        for b in batches:
            for t in b.column(0):
                own = _evidence(fold(t.as_py()))
                docs.update(own.keys())
                n.update({k: min(c, burst) if k else c for k, c in own.items()})
                if len(docs) > 300_000:
                    yield made(docs, n)
                    docs, n = Counter(), Counter()
        yield made(docs, n)

    return texts.select("text").mapInArrow(run, "pattern string, docs long, n long").groupBy("pattern").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _other_counts(texts: DataFrame, patterns: list[str], burst: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and occurrences of the given patterns in the other texts: a task counts in two arrays and hands on sums."""
    places = texts.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(patterns)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        docs, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for b in batches:
            for t in b.column(0):
                for k, c in _evidence(fold(t.as_py())).items():
                    if (i := at.get(k)) is not None:
                        docs[i] += 1
                        n[i] += min(c, burst) if k else c
        own = np.flatnonzero(docs)
        yield pa.record_batch([pa.array(own), pa.array(docs[own]), pa.array(n[own])], names=["i", "docs", "n"])

    sums = texts.select("text").mapInArrow(run, "i long, docs long, n long").groupBy("i").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).toArrow()
    docs, n = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
    at = sums.column("i").to_numpy()
    docs[at], n[at] = sums.column("docs").to_numpy(), sums.column("n").to_numpy()
    return docs, n


def _choose(rows: list[tuple[str, int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their weights, from (pattern, occurrences, weight).

    The heaviest come first. What begins with a chosen beginning adds nothing; a beginning gives way if
    chosen patterns already make up half of its occurrences, or if it is nearly always one and the same word.
    """
    words, prefixes, covered, top = {}, {}, Counter(), Counter()
    for p, n, _ in rows:
        if p.endswith(" "):
            for k in range(MIN_PREFIX, min(MAX_PREFIX, len(p) - 1) + 1):
                top[p[:k]] = max(top[p[:k]], n)
    for p, n, weight in sorted(rows, key=lambda r: (-r[2], r[0].endswith(" "), len(r[0]), r[0])):
        stem = p.rstrip()
        if any(stem[:k] in prefixes for k in range(MIN_PREFIX, len(stem) + 1)) or not p.endswith(" ") and (covered[p] >= n / 2 or top[p] >= 0.9 * n):
            continue
        (words if p.endswith(" ") else prefixes)[stem] = weight
        for k in range(MIN_PREFIX, len(stem) + 1):
            covered[stem[:k]] += n
    return words, prefixes


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, burst: int = BURST) -> Model:
    """A model from labels (doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0.

    Of several labels of a document the largest counts; null labels and documents without text are
    left out. About ``sample_rows`` labelled rows at most are used, chosen by hash of doc_id; that
    bound also bounds what reaches the driver (three numbers a row, and the patterns that three or more toxic documents of
    the sample share) and what is sent to the tasks. A pattern
    counts at most ``burst`` times in one document; no word is too long to be one.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 != 0))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < int(share * (1 << 62)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    sample = cut(texts.join(F.broadcast(chosen), "doc_id").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")))
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        return Model({w: 3.0 for w in SEED}, {})
    # Patterns of fewer than three toxic documents can't be chosen, so the other texts are searched for the rest alone.
    toxic = _toxic_counts(sample.where("toxic = 1"), burst).where("docs >= 3 or pattern = ''").orderBy("pattern").toArrow()
    patterns, docs1, n1 = toxic.column("pattern").to_pylist(), toxic.column("docs").to_numpy(), toxic.column("n").to_numpy()
    docs0, n0 = _other_counts(sample.where("toxic = 0"), patterns, burst)
    all1, all0 = int(n1[0]), int(n0[0])
    odds = np.log((n1 + 0.5) / (all1 + 1) / ((n0 + 0.5) / (all0 + 1)))
    # The log odds less two standard errors, which go by documents: words come in bursts.
    weight = odds - 2 * np.sqrt(1 / (docs1 + 0.5) + 1 / (docs0 + 0.5))
    found = sorted((i for i in range(1, len(patterns)) if docs1[i] >= 3 and weight[i] > 1), key=lambda i: (-weight[i], patterns[i]))
    model = Model(*_choose([(patterns[i], int(n1[i]), float(weight[i])) for i in found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([model.features(t.as_py()) for t in b.column(0)], np.float64).reshape(-1, 3)
            yield pa.record_batch([*(pa.array(x[:, k]) for k in range(3)), b.column(1)], names=["x0", "x1", "x2", "y"])

    data = sample.select("text", "toxic").mapInArrow(run, "x0 double, x1 double, x2 double, y int").groupBy("x0", "x1", "x2", "y").count().collect()
    data = np.array(sorted(tuple(r) for r in data), np.float64)
    x, y, n = np.column_stack([np.ones(len(data)), data[:, :3]]), data[:, 3], data[:, 4]
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2])
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slopes = float(beta[0]), tuple(map(float, beta[1:]))
    return model


def score(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """docs with the column ``out`` (0 to 1), row for row, from the whole text of each.

    Null and empty texts score as texts without a match. A column that is already named so is replaced.
    """
    docs = docs.drop(out)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([model.score(t.as_py()) for t in b.column(names.index("text"))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
