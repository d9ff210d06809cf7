"""Hash-based randomness: reproducible, partition-independent and SQL-checkable.

``h(key, salt)``  = first 8 hex digits of md5(key '#' salt) as an integer in [0, 2^32)
``uniform``       = h / 2^32 in [0, 1)
``normal``        = Box-Muller on the two 32-bit halves of one md5
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(*parts) -> Column:
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit("#"))
        cols.append((F.col(p) if isinstance(p, str) and not p.startswith("=") else
                     F.lit(p[1:]) if isinstance(p, str) else
                     F.lit(str(p)) if isinstance(p, (int, float)) else p).cast("string"))
    return F.concat(*cols)


def hash32(*parts, offset: int = 0) -> Column:
    """Integer in [0, 2^32) from hex digits [offset, offset+8) of md5(parts joined by '#').

    Parts are column names, Columns, numbers, or ``'=literal'`` strings.
    """
    return F.conv(F.substring(F.md5(_key(*parts)), offset + 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    return hash32(*parts).cast("double") / F.lit(TWO32)


def normal(*parts) -> Column:
    """Standard normal via Box-Muller; u1 in (0, 1] so log() is finite."""
    u1 = (hash32(*parts).cast("double") + 1.0) / F.lit(TWO32 + 1.0)
    u2 = hash32(*parts, offset=8).cast("double") / F.lit(TWO32)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def random_base(*parts) -> Column:
    """Uniform base from A/C/G/T."""
    return F.substring(F.lit("ACGT"), (hash32(*parts) % 4 + 1).cast("int"), F.lit(1))


# DuckDB twins used by the oracle SQL (KEY is an SQL string expression).
def sql_hash32(key: str, offset: int = 0) -> str:
    return f"('0x' || substr(md5({key}), {offset + 1}, 8))::BIGINT"


def sql_uniform(key: str) -> str:
    return f"({sql_hash32(key)}::DOUBLE / 4294967296.0)"


def sql_normal(key: str) -> str:
    return (f"(sqrt(-2.0 * ln(({sql_hash32(key)}::DOUBLE + 1.0) / 4294967297.0))"
            f" * cos(2.0 * pi() * {sql_hash32(key, 8)}::DOUBLE / 4294967296.0))")


def sql_random_base(key: str) -> str:
    return f"substr('ACGT', ({sql_hash32(key)} % 4 + 1)::INTEGER, 1)"
