"""Dense, exact, ordered row index without a single-partition window.

``row_number() over (order by k)`` with no PARTITION BY moves every row into
one task.  Instead the rows are range-partitioned on the sort keys (so a hot
group is split across tasks), sorted inside each partition and fixed by a
reliable checkpoint.  One pass per partition numbers the runs of equal group
keys; only the first run of a partition can go on from an earlier one, so
the numbers carried in are at most one row per partition, which is the bound
of the one broadcast.  There is one path for every size, and group keys are
compared null-safely.  ``cumulative`` applies the same plan to running sums /
maxima / minima.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from seqspark.session import ensure_checkpoint_dir


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in (xs or [])]


def _range(df: DataFrame, keys, num_partitions: int | None) -> DataFrame:
    """Range partitioning on ``keys``.  Without an explicit count the session's
    shuffle partitions apply and AQE may merge adjacent (still ordered) ranges."""
    if num_partitions:
        return df.repartitionByRange(num_partitions, *keys)
    return df.repartitionByRange(*keys)


def _ordered(df: DataFrame, order_by: Sequence, partition_by: Sequence, num_partitions: int | None):
    """(checkpointed rows ordered by group and key with ``_pid``, names of the group columns).

    Spark's range partitioner seeds its sample with the RDD id, so two jobs over the same plan would
    get different bounds; the checkpoint fixes them for the offsets and the numbering.
    """
    group = _cols(partition_by)
    keys = group + _cols(order_by)
    gnames = [f"_g{i}" for i in range(len(group))]
    staged = df.withColumns(dict(zip(gnames, group))) if group else df
    base = _range(staged, keys, num_partitions).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id())
    ensure_checkpoint_dir(df.sparkSession)
    return base.checkpoint(eager=True), gnames


def _changes(col: pa.Array) -> np.ndarray:
    """Whether each element but the first differs from the one before (null = null, NaN = NaN)."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    if pa.types.is_nested(col.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    differs = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(col.type):
        nan = pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))
        differs = pc.and_(differs, pc.invert(nan))
    return np.asarray(pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False), bool)


def _runs(batches, gnames: list[str]):
    """(batch, starts a run?, lies in the partition's first run?) for batches sorted by the group columns."""
    last, first_run = None, True
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for i, g in enumerate(gnames):
            col = b.column(b.schema.get_field_index(g))
            new |= _changes(pa.concat_arrays([last[i] if last else col.slice(0, 1), col]))
        last = [b.column(b.schema.get_field_index(g)).slice(b.num_rows - 1) for g in gnames]
        inside = np.zeros(b.num_rows, bool)
        if first_run:
            inside[:int(np.argmax(new)) if new.any() else b.num_rows] = True
            first_run = not new.any()
        yield b, new, inside


def with_row_index(df: DataFrame, order_by: Sequence, partition_by: Sequence = (),
                   name: str = "row_idx", start: int = 0,
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start + rank of the row inside its ``partition_by`` group by ``order_by``.

    ``order_by`` must be a total order (unique per group) for the index to be
    reproducible.  Null is a group like any other.
    """
    if not order_by:
        raise ValueError("with_row_index needs order_by (row order is never implicit)")
    base, gnames = _ordered(df, order_by, partition_by, num_partitions)
    schema = StructType([*base.schema.fields, StructField("_local", LongType()), StructField("_first", BooleanType())])

    def run(batches):
        held = 0                                                # rows of the open run so far
        for b, new, inside in _runs(batches, gnames):
            at = np.arange(b.num_rows)
            begin = np.maximum.accumulate(np.where(new, at, -held))
            local = at - begin
            held = int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local.astype(np.int64)), pa.array(inside)],
                                             [*b.schema.names, "_local", "_first"])

    w = Window.partitionBy(*gnames).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = base.groupBy("_pid", *gnames).agg(F.count(F.lit(1)).alias("_n"))
    carried = sizes.select("_pid", F.sum("_n").over(w).alias("_off")).where("_off > 0")   # <= one row per partition
    out = base.mapInArrow(run, schema).join(F.broadcast(carried), "_pid", "left")
    idx = F.col("_local") + F.when(F.col("_first"), F.coalesce("_off", F.lit(0))).otherwise(F.lit(0)) + F.lit(start)
    return out.withColumn(name, idx.cast("bigint")).drop("_pid", "_off", "_local", "_first", *gnames)


def sql_row_index(order_by: str, partition_by: str | None = None, start: int = 0) -> str:
    """Equivalent SQL expression (oracle side)."""
    part = f"PARTITION BY {partition_by} " if partition_by else ""
    return f"(row_number() OVER ({part}ORDER BY {order_by}) - 1 + {start})"


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def cumulative(df: DataFrame, value_col: str, order_by: Sequence, partition_by: Sequence = (),
               name: str = "cum", fn: str = "sum", exclusive: bool = False,
               num_partitions: int | None = None) -> DataFrame:
    """Running ``fn`` (sum / max / min) of ``value_col`` in ``order_by`` order per group.

    Same plan as ``with_row_index``: a hot group is split over many tasks, one
    vectorised pass per partition, and at most one value carried into each
    partition.  NULLs are skipped (the result is NULL until a value was seen),
    NaN is skipped by max and min; null group keys form a group.  Integers are
    added and compared as 64-bit integers, float and double as double; other
    types are refused.  ``exclusive`` excludes the current row (NULL before
    the first row of a group, like a frame ending at 1 PRECEDING).
    ``order_by`` must be unique inside a group.
    """
    agg = _AGG[fn]
    in_type = dict(df.dtypes)[value_col]
    if in_type not in (*_INTEGERS, "float", "double"):
        raise ValueError(f"cumulative needs an integer, float or double column, not {in_type}")
    whole = in_type in _INTEGERS
    out_type = in_type if fn != "sum" else "bigint" if whole else "double"
    base, gnames = _ordered(df.withColumn("_v", F.col(value_col).cast("bigint" if whole else "double")),
                            order_by, partition_by, num_partitions)
    value = F.col("_v") if whole or fn == "sum" else F.when(~F.isnan("_v"), F.col("_v"))
    part = base.groupBy("_pid", *gnames).agg(agg(value).alias("_t"))
    w = Window.partitionBy(*gnames).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = part.select("_pid", agg("_t").over(w).alias("_carry")).where("_carry is not null")   # <= one row per partition
    out = _local_running(base, gnames, fn, exclusive, whole).join(F.broadcast(carried), "_pid", "left")
    carry = F.when(F.col("_first"), F.col("_carry"))
    if fn == "sum":
        zero = F.lit(0).cast("bigint" if whole else "double")
        val = F.when(carry.isNull() & F.col("_loc").isNull(), F.lit(None)).otherwise(
            F.coalesce(carry, zero) + F.coalesce(F.col("_loc"), zero))
    else:
        val = (F.greatest if fn == "max" else F.least)(carry, F.col("_loc"))   # both skip NULLs
    return out.withColumn(name, val.cast(out_type)).drop("_pid", "_v", "_carry", "_loc", "_first", *gnames)


def _local_running(base: DataFrame, gnames: list[str], fn: str, exclusive: bool, whole: bool) -> DataFrame:
    """Running ``fn`` of ``_v`` per run of equal group keys inside each partition (``_loc``), and ``_first``."""
    import pandas as pd
    kind, number = (np.int64, LongType()) if whole else (np.float64, DoubleType())
    schema = StructType([*base.schema.fields, StructField("_loc", number), StructField("_first", BooleanType())])
    if fn == "sum":
        neutral, combine = kind(0), np.add
    else:
        low, high = (np.iinfo(np.int64).min, np.iinfo(np.int64).max) if whole else (-np.inf, np.inf)
        neutral, combine = (kind(low), np.maximum) if fn == "max" else (kind(high), np.minimum)

    def run(batches):
        held, seen_held = neutral, False                        # running value of the open run
        for b, new, inside in _runs(batches, gnames):
            col = b.column(b.schema.get_field_index("_v"))
            null = np.asarray(col.is_null().to_numpy(zero_copy_only=False), bool)
            v = np.asarray(col.fill_null(neutral.item()).to_numpy(zero_copy_only=False), kind).copy()
            if fn != "sum" and not whole:
                null |= np.isnan(v)
            v[null] = neutral
            runs = np.cumsum(new)
            groups = pd.Series(v).groupby(runs)
            inc = (groups.cumsum() if fn == "sum" else groups.cummax() if fn == "max" else groups.cummin()).to_numpy().copy()
            seen = pd.Series(~null).astype("int64").groupby(runs).cumsum().to_numpy() > 0
            on = runs == 0                                      # rows that continue the open run
            if seen_held:
                inc[on] = combine(inc[on], held)
                seen[on] = True
            if exclusive:
                prev, prev_seen = np.empty_like(inc), np.empty(len(inc), bool)
                prev[0], prev_seen[0] = held, seen_held
                prev[1:], prev_seen[1:] = inc[:-1], seen[:-1]
                loc, ok = prev, prev_seen & ~new
            else:
                loc, ok = inc, seen
            held, seen_held = kind(inc[-1]), bool(seen[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(loc, mask=~ok), pa.array(inside)],
                                             [*b.schema.names, "_loc", "_first"])

    return base.mapInArrow(run, schema)


def cumulative_sum(df: DataFrame, value_col: str, order_by: Sequence, partition_by: Sequence = (),
                   name: str = "cum", exclusive: bool = False,
                   num_partitions: int | None = None) -> DataFrame:
    """Running sum; exclusive sums start at 0 (not NULL)."""
    out = cumulative(df, value_col, order_by, partition_by, name, "sum", exclusive, num_partitions)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
