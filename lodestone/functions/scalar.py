"""Small scalar functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import pandas_function


def clamp(v: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def rotate(i: Column, modulo: int) -> Column:
    """Positive modulo."""
    return F.pmod(i, F.lit(modulo))


def random_int(lo: int, hi: int, seed: int) -> Column:
    """lo to hi, both included."""
    if lo > hi:
        raise ValueError("lo is above hi")
    return (F.floor(F.rand(seed) * (hi - lo + 1)) + lo).cast("long")


def random_chance(p: float, seed: int) -> Column:
    if not 0 <= p <= 1:
        raise ValueError("p is not a probability")
    return F.rand(seed) < p


def in_triangle(px: Column, py: Column, *corners: Column | float) -> Column:
    """Whether a point lies in the triangle of six coordinates, edges included."""
    ax, ay, bx, by, cx, cy = (c if isinstance(c, Column) else F.lit(float(c)) for c in corners)

    def side(x1, y1, x2, y2):
        return (px - x2) * (y1 - y2) - (x1 - x2) * (py - y2)

    s = (side(ax, ay, bx, by), side(bx, by, cx, cy), side(cx, cy, ax, ay))
    return ~(((s[0] < 0) | (s[1] < 0) | (s[2] < 0)) & ((s[0] > 0) | (s[1] > 0) | (s[2] > 0)))


def coverage(covered: Column, total: Column) -> Column:
    """Covered share; nothing to cover counts as all covered."""
    return F.when(total == 0, 1.0).otherwise(covered / F.when(total != 0, total))


def percent_label(share: Column, digits: int = 0) -> Column:
    """A percentage that shows 100 only if all is covered (rounding never reaches it at 0 digits)."""
    shown = F.format_string(f"%.{digits}f", share * 100)
    return F.concat(F.when((share < 1) & (shown == "100"), "99").otherwise(shown), F.lit("%"))


def bucket(value: Column, thresholds: dict[str, float]) -> Column:
    """The name of the largest threshold that is at most the value; null below all."""
    out = F.lit(None).cast("string")
    for name, least in sorted(thresholds.items(), key=lambda x: x[1]):
        out = F.when(value >= least, name).otherwise(out)
    return out


#: Largest context window and the number of reads that stay active.
READ_STEPS = ((8192, 2), (16384, 4), (32768, 6), (65536, 8), (131072, 12))


def active_reads(context_window: Column) -> Column:
    out = F.lit(16)
    for most, n in reversed(READ_STEPS):
        out = F.when(context_window <= most, n).otherwise(out)
    return out


def saturate(v: Column, bits: int) -> Column:
    """To an unsigned integer of so many bits; 32-bit results stay positive."""
    return clamp(v.cast("double"), 0, 2**bits - 1).cast("long")


def retrieve_k(k: Column, route: Column, routed: Column, times: int = 4, most: int = 64) -> Column:
    """Fetch more when a route filter will drop some."""
    return F.when(routed & (route != "all"), F.least(k * times, F.lit(most))).otherwise(k)


def kind_contains(kind: Column, other: Column) -> Column:
    """Dotted kinds: equal, or other lies below."""
    return (kind == other) | other.startswith(F.concat(kind, F.lit(".")))


def stable_key(text: Column) -> Column:
    """First 8 bytes of SHA-256, little-endian, unsigned: decimal(20,0)."""
    pairs = F.regexp_extract_all(F.substring(F.sha2(text, 256), 1, 16), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")


#: What kinds of values are hashed as.
NULL_HASH, TRUE_HASH, FALSE_HASH, STRING_HASH, ARRAY_HASH, OBJECT_HASH = 349, 433, 863, 149417, 104579, 181387


def _hash_of(x: object, h: int) -> int:
    def step(value: int) -> int:
        return (h * 31 + value) & 0xFFFFFFFF

    if isinstance(x, bool):
        return step(TRUE_HASH if x else FALSE_HASH)
    if x is None:
        return step(NULL_HASH)
    if isinstance(x, int | float):
        return step(int(x))
    if isinstance(x, str):
        h = step(STRING_HASH)
        units = x.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(units), 2):
            h = step(units[i] | units[i + 1] << 8)
        return h
    if isinstance(x, list):
        h = step(ARRAY_HASH)
        for v in x:
            h = _hash_of(v, h)
        return h
    h = step(OBJECT_HASH)
    for k in sorted(x):
        h = _hash_of(x[k], _hash_of(k, h))
    return h


@pandas_function("int")
def structural_hash(text: pd.Series) -> pd.Series:
    """The hash of a JSON value as signed 32 bits: kinds are told apart, keys count in order. Broken JSON gives null."""

    def one(t: str | None) -> int | None:
        try:
            h = None if t is None else _hash_of(json.loads(t), 0)
        except ValueError:
            return None
        return h if h is None or h < 1 << 31 else h - (1 << 32)

    return text.map(one).astype("Int32")


def string_hash(text: Column, start: int = 0) -> Column:
    """h = h * 31 + c over characters, as signed 32 bits."""
    two32 = 1 << 32
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(start).cast("long"), lambda s, c: F.pmod(s * 31 + F.ascii(c), F.lit(two32)))
    return F.when(h >= 1 << 31, h - two32).otherwise(h).cast("int")


def age_label(then: Column, now: Column) -> Column:
    """now, N secs, mins, hrs, days, wks, mos, yrs ago (in for the future); now is passed explicitly."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    size = F.abs(seconds)
    out = None
    for least, unit, per in ((31_536_000, "yr", 31_536_000), (2_592_000, "mo", 2_592_000), (604_800, "wk", 604_800), (86_400, "day", 86_400), (3_600, "hr", 3_600), (60, "min", 60), (30, "sec", 1)):
        n = F.floor(size / per)
        label = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
        label = F.when(seconds < 0, F.concat(F.lit("in "), label)).otherwise(F.concat(label, F.lit(" ago")))
        out = F.when(size >= least, label) if out is None else out.when(size >= least, label)
    return out.otherwise("now")


def duration_label(ms: Column) -> Column:
    s = ms / 1000
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%.1fm", s / 60)).otherwise(F.format_string("%.1fh", s / 3600))
