"""A keyed permutation of 0 .. n-1 as column arithmetic: no sort, no shuffle, invertible.

A Feistel network over pairs (left, right) of numbers below a = ceil(sqrt(n)) permutes 0 .. a*a-1 for every
round function; numbers that leave 0 .. n-1 are sent through again (cycle walking) until they are back,
which keeps the map one-to-one.  At most a*a - n <= 2 sqrt(n) numbers lie outside, so few rows walk and the
walk has a known end.  ``tweak`` picks another permutation per value (an epoch, a group).  n may be a column.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647                  # 2^31 - 1: squares of residues stay below 2^62
FACTOR = 48271
ROUNDS = 4


def _keys(seed) -> list[tuple[int, int]]:
    """(offset, tweak factor) of each round, from md5 of the seed."""
    digests = [hashlib.md5(f"{seed}#{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [(int(d[:7], 16), int(d[8:15], 16) | 1) for d in digests]


def _side(n: Column) -> Column:
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    return F.when(a * a < n, a + 1).otherwise(a)


def _mix(half, offset, factor, tweak):
    """Round function: the square of the shifted half in the prime field."""
    t = (half + offset + factor * tweak) % P
    return ((t * t) % P) * FACTOR % P


def _network(x: Column, a: Column, tweak: Column, seed, inverse: bool) -> Column:
    keys = _keys(seed)[::-1] if inverse else _keys(seed)
    rounds = F.array(*[F.struct(F.lit(o).cast("bigint").alias("o"), F.lit(f).cast("bigint").alias("f")) for o, f in keys])
    start = F.struct(((x - x % a) / a).cast("bigint").alias("l"), (x % a).alias("r"))

    def forward(s, k):
        return F.struct(s["r"].alias("l"), ((s["l"] + _mix(s["r"], k["o"], k["f"], tweak)) % a).alias("r"))

    def back(s, k):
        return F.struct(F.pmod(s["r"] - _mix(s["l"], k["o"], k["f"], tweak), a).alias("l"), s["l"].alias("r"))

    return F.aggregate(rounds, start, back if inverse else forward, lambda s: s["l"] * a + s["r"])


def permute(x, n, seed=0, tweak=0, inverse: bool = False) -> Column:
    """Image of ``x`` (0 <= x < n < 2^53) under the permutation of (seed, tweak >= 0); ``inverse`` gives the preimage.

    Null x or n gives null; an x outside 0 .. n-1 raises.
    """
    x, n = _long(x), _long(n)
    tweak = F.lit(tweak).cast("bigint") if isinstance(tweak, int) else _long(tweak)
    given = F.array(F.struct(x.alias("x"), n.alias("n"), _side(n).alias("a"), tweak.alias("t")))

    def walk(g):
        once = F.transform(F.array(_network(g["x"], g["a"], g["t"], seed, inverse)), lambda y: F.when(y < g["n"], y).otherwise(
            F.aggregate(F.sequence(F.lit(1).cast("bigint"), g["a"] * g["a"] - g["n"]), y,
                        lambda v, _: F.when(v < g["n"], v).otherwise(_network(v, g["a"], g["t"], seed, inverse)))))[0]
        return (F.when(g["x"].isNull() | g["n"].isNull(), F.lit(None).cast("bigint"))
                .when((g["x"] < 0) | (g["x"] >= g["n"]), F.raise_error(F.lit("permute: x is not in 0 .. n-1")).cast("bigint"))
                .otherwise(once))

    return F.transform(given, walk)[0]


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, int) else c).cast("bigint")


def sql_permuted(name: str, source: str, x: str, n: str, out: str, seed=0, tweak: str = "0") -> str:
    """DuckDB twin as CTEs (the statement needs WITH RECURSIVE): ``name`` = rows of ``source`` with the image as ``out``."""
    def once(src, at):
        q = f"SELECT *, ({at}) // a_ AS l_, ({at}) % a_ AS r_ FROM {src}"
        for o, f in _keys(seed):
            t = f"((r_ + {o} + {f} * t_) % {P})"
            q = f"SELECT * REPLACE (r_ AS l_, (l_ + ({t} * {t}) % {P} * {FACTOR} % {P}) % a_ AS r_) FROM ({q})"
        return f"SELECT * EXCLUDE (l_, r_) REPLACE (l_ * a_ + r_ AS y_) FROM ({q})"
    start = (f"(SELECT *, ceil(sqrt(n_::DOUBLE))::BIGINT AS a_, ({tweak})::BIGINT AS t_, 0::BIGINT AS y_ "
             f"FROM (SELECT *, ({x})::BIGINT AS x_, ({n})::BIGINT AS n_ FROM {source}))")
    return f"""{name}_walk AS (
  {once(start, 'x_')}
  UNION ALL
  {once(f"(SELECT * FROM {name}_walk WHERE y_ >= n_)", 'y_')}),
{name} AS (SELECT * EXCLUDE (x_, n_, a_, t_, y_), y_ AS {out} FROM {name}_walk WHERE y_ < n_)"""
