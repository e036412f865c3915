"""Scalar functions of the query builder's vocabulary that Spark spells differently.

Functions that Spark has under the same name and meaning are not wrapped."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F


def log(x: Column) -> Column:
    """Base-10 logarithm (the meaning of log in the vocabulary; Spark's log is natural)."""
    return F.log10(x)


def bitand(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def remainder(x: Column, y: Column) -> Column:
    """x minus y times the nearest whole quotient (mod uses the floor)."""
    return x - y * F.rint(x / y)


def lnnvl(p: Column) -> Column:
    """True when a condition is false or unknown."""
    return ~F.coalesce(p, F.lit(False))


def nanvl(a: Column, b: Column) -> Column:
    return F.nanvl(a, b)


def decode(value: Column, *pairs) -> Column:
    """decode(value, search1, result1, ..., default); NULL matches NULL."""
    default = pairs[-1] if len(pairs) % 2 else None
    out = None
    for search, result in zip(pairs[0::2], pairs[1::2]):
        cond = value.eqNullSafe(F.lit(search))
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out.otherwise(default)


def julianday(ts: Column) -> Column:
    """Days since noon of 24 November 4714 BC."""
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + 2440587.5


# Strftime letters and the matching Spark patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def strftime(fmt: str, ts: Column) -> Column:
    """Text of a time; what belongs to no code stands for itself, unknown codes are refused."""
    out, plain = "", ""
    for piece in [*re.findall(r"%.?|[^%]+", fmt, re.S), None]:
        if piece is not None and (piece == "%%" or piece[0] != "%"):
            plain += piece.replace("%%", "%")
            continue
        if plain:
            out, plain = out + "'" + plain.replace("'", "''") + "'", ""
        if piece is not None:
            if piece not in STRFTIME:
                raise ValueError(f"unknown time code {piece!r}")
            out += STRFTIME[piece]
    return F.date_format(ts, out)


def clamp(lo, x: Column, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def scale_linear(x: Column, d0: float, d1: float, r0: float, r1: float) -> Column:
    """Map a domain to a range, held at the ends."""
    return r0 + (clamp(float(d0), x, float(d1)) - d0) * ((r1 - r0) / (d1 - d0))


def scale_exp(x: Column, d0: float, d1: float, r0: float, r1: float, exponent: float) -> Column:
    t = (clamp(float(d0), x, float(d1)) - d0) / (d1 - d0)
    return r0 + F.pow(t, F.lit(float(exponent))) * (r1 - r0)


def to_int(c: Column) -> Column:
    return F.round(c.try_cast("double")).cast("long")


def to_real(c: Column) -> Column:
    return c.try_cast("double")


def to_text(c: Column) -> Column:
    return c.cast("string")


def regexp_match(c: Column, pattern: str) -> Column:
    """1-based place of the first match, 0 when there is none."""
    return F.regexp_instr(c, F.lit(pattern))


def age_days(a: Column, b: Column) -> Column:
    """Days from b to a, with fractions."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86400e6


def day_of_week(ts: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(ts) - 1


def title(c: Column) -> Column:
    return F.initcap(c)


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing places of two texts of one length, NULL otherwise."""
    chars = lambda s: F.filter(F.split(s, ""), lambda ch: ch != "")
    diff = F.aggregate(F.zip_with(chars(a), chars(b), lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(F.length(a) == F.length(b), diff)


def strpos(c: Column, needle: str) -> Column:
    return F.instr(c, needle)


def format_date(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def _common(x: str | None, y: str | None) -> str | None:
    if x is None or y is None:
        return None
    best, end, prev = 0, 0, [0] * (len(y) + 1)
    for i, ch in enumerate(x, 1):
        row = [0] * (len(y) + 1)
        for j, other in enumerate(y, 1):
            if ch == other:
                row[j] = prev[j - 1] + 1
                if row[j] > best:
                    best, end = row[j], i
        prev = row
    return x[end - best:end]


def longest_common_substring(a: Column, b: Column) -> Column:
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([_common(x, y) for x, y in zip(p, q)])

    return F.pandas_udf(run, "string")(a, b)


def wordwrap(c: Column, width: int, delimiter: str = " ") -> Column:
    """Break a text into lines of at most ``width`` characters at the delimiter."""
    words = F.split(c, F.lit("\\Q" + delimiter + "\\E"))
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def step(s, w):
        fits = F.length(s["line"]) + F.length(w) + len(delimiter) <= width
        empty = s["line"] == ""
        line = F.when(empty, w).when(fits, F.concat(s["line"], F.lit(delimiter), w)).otherwise(w)
        done = F.when(empty | fits, s["done"]).otherwise(F.concat(s["done"], s["line"], F.lit("\n")))
        return F.struct(done.alias("done"), line.alias("line"))

    return F.aggregate(words, zero, step, lambda s: F.concat(s["done"], s["line"]))
