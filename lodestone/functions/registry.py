"""Functions that users bring: embedding models, table functions, equality, readers, sub-questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

_MODELS: dict[str, Callable[[Sequence[str]], Sequence[Sequence[float]]]] = {}


def register_model(name: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]]) -> None:
    """One provider for each model."""
    if name in _MODELS:
        raise ValueError(f"model {name} is registered")
    _MODELS[name] = embed


def unregister_model(name: str) -> None:
    _MODELS.pop(name, None)


def embedding(name: str):
    """A pandas UDF: a vector for each text, batch by batch; a provider that returns another number of vectors fails."""
    embed = _MODELS[name]

    @F.pandas_udf(ArrayType(FloatType()))
    def run(text: pd.Series) -> pd.Series:
        out = list(embed(text.tolist()))
        if len(out) != len(text):
            raise ValueError(f"{len(out)} vectors for {len(text)} texts")
        return pd.Series([[float(x) for x in v] for v in out])

    return run


def first_answer(providers: Sequence[Callable], texts: Sequence[str], seconds: float = 10):
    """The first provider's answer within the time."""
    from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

    pool = ThreadPoolExecutor(max(1, len(providers)))
    try:
        done, _ = wait([pool.submit(p, texts) for p in providers], seconds, FIRST_COMPLETED)
        if not done:
            raise TimeoutError("no provider answered")
        return next(iter(done)).result()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


_TIMELINES: dict[str, Callable[[str], DataFrame]] = {}


def register_timeline(scheme: str, provider: Callable[[str], DataFrame]) -> None:
    _TIMELINES[scheme] = provider


def timeline(uri: str) -> DataFrame:
    """Items of the provider for the URI's scheme (``*`` fits any)."""
    scheme = uri.split(":", 1)[0]
    return (_TIMELINES.get(scheme) or _TIMELINES["*"])(uri)


def equal_by(compare: Callable[[Column, Column], Column], a: str, b: str) -> Column:
    """An equality of one's own, null-safe: both null are equal, one null is not."""
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.col(a).isNull() & F.col(b).isNull()).otherwise(compare(F.col(a), F.col(b)))


def once_per_key(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that ``compute`` gives for its distinct keys (key): each key is worked out once, however often it comes."""
    found = compute(df.select(key).distinct())
    same = df[key].eqNullSafe(found[key])
    return df.join(found, same, "left").select(df["*"], *(found[c] for c in found.columns if c != key))


def read_lines(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, start, end, text): lines of files (file, text), from 1, both ends included."""
    got = wanted.join(files, "file")
    return got.select("file", "start", "end", F.array_join(F.slice(F.split("text", "\n"), F.col("start"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))), "\n").alias("text"))


def sub_questions_with(ask: Callable[[str], list[str]] | None, query: str, fallback: Callable[[str], list[str]]) -> list[str]:
    """A model's sub-questions; without a model, or if it fails or says nothing, the fallback's."""
    if ask:
        try:
            if got := [q for q in ask(query) if q.strip()]:
                return got
        except Exception:  # noqa: BLE001 - whatever a user's callback raises
            pass
    return fallback(query)
