"""Training-series operators over (run, epoch, batch, loss) tables.

Per-run windows would put a run's whole history into one task; the operators
here use aggregations with partial aggregation, the exact distributed
running min/max of ``rowindex.cumulative``, sliding windows over range
partitions with a halo, and (for the EMA recurrence) a distributed affine scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from seqspark.operators.delivery import first_row_only
from seqspark.operators.rowindex import _changes, _cols, _ordered, _range, _runs, cumulative
from seqspark.session import ensure_checkpoint_dir, materialize

# Fixed values (reference defaults).
EARLY_STOP_WINDOW = 10
EARLY_STOP_TOL = 0.05
LR0 = 1e-3
LR_STEP = 50
LR_GAMMA = 0.5
CHECKPOINT_RATE = 50
EMA_DECAY = 0.9999
EMA_START = 2000
EMA_RATE = 1


def epoch_loss(df: DataFrame, run: str = "run", epoch: str = "epoch", batch: str = "batch",
               loss: str = "loss") -> DataFrame:
    """Epoch loss = unweighted mean of batch means (a short last batch counts fully)."""
    b = df.groupBy(run, epoch, batch).agg(F.avg(loss).alias("_bm"))
    return b.groupBy(run, epoch).agg(F.avg("_bm").alias("val_loss"), F.count(F.lit(1)).alias("n_batches"))


def best_checkpoints(df: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """Epochs whose loss is strictly below every earlier epoch's loss (first epoch: True)."""
    c = cumulative(df, loss, [epoch], [run], name="_prev_min", fn="min", exclusive=True)
    is_best = F.col("_prev_min").isNull() | (F.col(loss) < F.col("_prev_min"))
    return c.withColumn("is_best", is_best).drop("_prev_min")


def sliding_stats(df: DataFrame, window: int = EARLY_STOP_WINDOW, run: str = "run", epoch: str = "epoch",
                  loss: str = "val_loss", num_partitions: int | None = None) -> DataFrame:
    """(run, epoch, win_min, win_max, win_n): min, max and number of rows over a run's last ``window`` rows by epoch.

    The rows are range-partitioned by (run, epoch), so a long run lies in many tasks; every partition is given
    the ``window - 1`` rows before it as a halo (at most that many per partition, attached to its first row) and
    makes one vectorised pass.  Epochs need not be dense.  Null losses are skipped (null if a window has no
    other); NaN counts as the largest value, as in Spark's min and max.
    """
    rows = df.select(F.col(run).alias(run), F.col(epoch).alias(epoch), F.col(loss).cast("double").alias("_v"))
    base, (gname,) = _ordered(rows, [epoch], [run], num_partitions)
    tail_schema = StructType([base.schema["_pid"], base.schema[gname], base.schema["_v"], StructField("_at", LongType())])

    def ends(batches):
        held = None
        for b in batches:
            if b.num_rows < window - 1 and held is not None and b.num_rows:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if b.num_rows:
                held = b.slice(max(0, b.num_rows - window + 1))
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(np.arange(held.num_rows))], names=tail_schema.names)

    tails = base.select("_pid", gname, "_v").mapInArrow(ends, tail_schema)
    order = Window.partitionBy(F.lit(0)).orderBy("_pid", "_at")                  # < window rows per partition
    tails = materialize(tails.withColumn("_no", F.row_number().over(order)))
    seen = tails.groupBy("_pid").agg(F.max("_no").alias("_upto"))
    needs = seen.select((F.lead("_pid").over(Window.partitionBy(F.lit(0)).orderBy("_pid"))).alias("_for"), "_upto").where("_for is not null")
    needs = needs.withColumn("_no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_upto") - (window - 2)), F.col("_upto"))))
    halo = needs.join(tails, "_no").groupBy("_for").agg(
        F.array_sort(F.collect_list(F.struct("_no", F.col(gname).alias("g"), F.col("_v").alias("v")))).alias("_halo"))
    given = first_row_only(base.join(F.broadcast(halo), base["_pid"] == halo["_for"], "left"), "_halo").select(
        run, epoch, "_v", gname, "_halo")
    schema = StructType([base.schema[run], base.schema[epoch], StructField("win_min", DoubleType()),
                         StructField("win_max", DoubleType()), StructField("win_n", LongType())])

    def scan(batches):
        held = None                                                             # the last window - 1 rows: groups and values
        for b in batches:
            if not b.num_rows:
                continue
            g, v = b.column(3), b.column(2)
            if held is None:
                before = b.column(4)[0].as_py() or []
                held = (pa.array([x["g"] for x in before], g.type), pa.array([x["v"] for x in before], pa.float64()))
            n_held = len(held[0])
            g, v = pa.concat_arrays([held[0], g]), pa.concat_arrays([held[1], v])
            lo, hi, n = window_stats(_changes(g), v, window)
            held = (g.slice(max(0, len(g) - window + 1)), v.slice(max(0, len(v) - window + 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lo.slice(n_held), hi.slice(n_held), n.slice(n_held)],
                                             names=schema.names)

    return given.mapInArrow(scan, schema)


def window_stats(changes: np.ndarray, values: pa.Array, window: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(min, max, rows) over the last ``window`` rows of each row's run; ``changes``: rows but the first that start a run.

    Minima over the last 2^j rows come from two of the last 2^(j-1); a window is covered by two such spans.
    """
    size = len(values)
    new = np.concatenate([[True], changes])[:size]
    at = np.arange(size)
    pos = at - np.maximum.accumulate(np.where(new, at, 0))
    n = np.minimum(pos + 1, window)
    null = np.asarray(values.is_null().to_numpy(zero_copy_only=False), bool)
    v = np.asarray(values.fill_null(0.0).to_numpy(zero_copy_only=False), float)
    nan = np.isnan(v) & ~null
    low, high = np.where(null | nan, np.inf, v), np.where(null, -np.inf, np.where(nan, np.inf, v))
    level = np.floor(np.log2(n)).astype(np.int64) if size else n
    mins, maxs, span = np.full(size, np.inf), np.full(size, -np.inf), 1
    for j in range(int(level.max(initial=0)) + 1):
        here = level == j
        back = at[here] - (n[here] - span)
        mins[here], maxs[here] = np.minimum(low[here], low[back]), np.maximum(high[here], high[back])
        full = np.flatnonzero(pos >= span)
        low, high = low.copy(), high.copy()
        low[full], high[full] = np.minimum(low[full], low[full - span]), np.maximum(high[full], high[full - span])
        span *= 2

    def inside(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at + 1] - total[at + 1 - n]

    some, nans = inside(~null), inside(nan)
    mins, maxs = np.where((some > 0) & (nans == some), np.nan, mins), np.where(nans > 0, np.nan, maxs)
    return pa.array(mins, mask=some == 0), pa.array(maxs, mask=some == 0), pa.array(n.astype(np.int64))


def early_stop(df: DataFrame, window: int = EARLY_STOP_WINDOW, tol: float = EARLY_STOP_TOL,
               run: str = "run", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """First epoch with >= window epochs seen and (max-min)/max < tol over the last ``window``.

    One row per run: stop_epoch (NULL if never), n_epochs, epochs_trained.
    (max-min)/max is a try_divide, so all-zero losses never stop (H13).
    """
    s = sliding_stats(df, window, run, epoch, loss)
    rel = F.try_divide(F.col("win_max") - F.col("win_min"), F.col("win_max"))
    hit = (F.col("win_n") >= window) & (rel < tol)
    r = s.groupBy(run).agg(F.min(F.when(hit, F.col(epoch))).alias("stop_epoch"),
                           F.count(F.lit(1)).alias("n_epochs"))
    return r.withColumn("epochs_trained", F.coalesce("stop_epoch", "n_epochs"))


def lr_at_epoch(epoch, lr0: float = LR0, step: int = LR_STEP, gamma: float = LR_GAMMA):
    """Learning rate used during 1-based ``epoch`` under a step-decay schedule."""
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.lit(lr0) * F.pow(F.lit(gamma), F.floor((e - 1) / step))


def checkpoint_epochs(df: DataFrame, rate: int = CHECKPOINT_RATE, epoch: str = "epoch") -> DataFrame:
    """Epochs at which a checkpoint is written (epoch % rate == 0)."""
    return df.where(F.col(epoch) % rate == 0)


# ------------------------------------------------------------------ EMA
BLOCK = 64


def affine_scan(a: np.ndarray, b: np.ndarray, copied: np.ndarray, new: np.ndarray, held=(False, 1.0, 0.0)):
    """Running composition of the maps y -> a*y + b inside runs (``new``: a run starts), after the map ``held``.

    Rows stand in columns of blocks; one pass over the ``BLOCK`` rows of all blocks at once composes inside the
    blocks, one over the blocks carries on, so that Python runs BLOCK + n / BLOCK steps for n rows.
    """
    n = len(a)
    if not n:
        return copied, a, b
    width = -(-n // BLOCK)
    pad = lambda x, fill: np.concatenate([x, np.full(width * BLOCK - n, fill, x.dtype)]).reshape(width, BLOCK).T.copy()
    A, B, C, R = pad(a, 1.0), pad(b, 0.0), pad(copied, False), pad(new, False)
    for i in range(1, BLOCK):
        go = ~R[i]
        B[i] = np.where(go, np.where(A[i] == 0, 0.0, A[i] * B[i - 1]) + B[i], B[i])      # a copy forgets NaN as well
        A[i] = np.where(go, A[i] * A[i - 1], A[i])
        C[i] |= go & C[i - 1]
        R[i] |= R[i - 1]
    ca, cb, cc = np.empty(width), np.empty(width), np.empty(width, bool)
    cc_, ca_, cb_ = held
    for k, (la, lb, lc, lr) in enumerate(zip(A[-1].tolist(), B[-1].tolist(), C[-1].tolist(), R[-1].tolist())):
        cc[k], ca[k], cb[k] = cc_, ca_, cb_
        if lr:
            cc_, ca_, cb_ = lc, la, lb
        else:
            cc_, ca_, cb_ = cc_ or lc, la * ca_, (la * cb_ if la else 0.0) + lb
    go = ~R
    B = np.where(go, np.where(A == 0, 0.0, A * cb) + B, B)
    C |= go & cc
    A = np.where(go, A * ca, A)
    flat = lambda x: x.T.reshape(-1)[:n]
    return flat(C), flat(A), flat(B)


def ema_series(df: DataFrame, value: str, order_by: str, partition_by=(), name: str = "ema",
               decay: float = EMA_DECAY, rate: int = EMA_RATE, start: int = EMA_START,
               num_partitions: int | None = None) -> DataFrame:
    """EMA of a metric series, re-aimed from model weights.

    Step n (1-based integer ``order_by``) updates when n % rate == 0: before
    ``start`` (or on the first update) the EMA copies the value, later it
    becomes old*decay + (1-decay)*new; other steps keep the EMA.  NULL before
    the first update.

    Distributed affine scan: rows are range-partitioned by (group, step) and
    checkpointed; each partition scans its rows' maps y -> a*y + b in blocks
    (``affine_scan``, the open run's map carried across Arrow batches), giving
    per row y = B if a copy happened else A*y_in + B.  Only groups spanning
    several partitions need a carried-in y_in, composed from the earlier
    partitions' last maps (an applyInPandas over fewer than 2 x #partitions
    rows) and applied with a broadcast join.  No group is ever gathered into one task.
    """
    spark = df.sparkSession
    group = _cols(partition_by)
    gnames = [f"_g{i}" for i in range(len(group))] or ["_g0"]
    staged = (df.withColumns({g: c for g, c in zip(gnames, group)}) if group
              else df.withColumn("_g0", F.lit(0)))
    staged = staged.withColumn("_n", F.col(order_by).cast("long")).withColumn("_x", F.col(value).cast("double"))
    base = (_range(staged, [F.col(g) for g in gnames] + [F.col("_n")], num_partitions)
            .sortWithinPartitions(*gnames, "_n")
            .withColumn("_pid", F.spark_partition_id()))
    ensure_checkpoint_dir(spark)
    base = base.checkpoint(eager=True)
    out_schema = StructType(list(base.schema.fields) + [StructField("_copied", BooleanType()),
                                                        StructField("_a", DoubleType()),
                                                        StructField("_b", DoubleType())])

    def local(batches):
        held = (False, 1.0, 0.0)                        # map of the open run so far
        for batch, new, _ in _runs(batches, gnames):
            n = batch.column(batch.schema.get_field_index("_n")).to_numpy(zero_copy_only=False)
            x = batch.column(batch.schema.get_field_index("_x")).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            keep, copy = n % rate != 0, (n < start) | (n == rate)     # a copy: before ``start`` or the first update
            a = np.where(keep, 1.0, np.where(copy, 0.0, decay))
            m = np.where(keep, 0.0, np.where(copy, x, (1.0 - decay) * x))
            copied, aa, bb = affine_scan(a, m, copy & ~keep, new, held)
            held = (bool(copied[-1]), float(aa[-1]), float(bb[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copied), pa.array(aa), pa.array(bb)], names=out_schema.names)

    # every column rides through the scan, so no join back to the input is needed
    rows = base.mapInArrow(local, out_schema)
    seg = rows.groupBy("_pid", *gnames).agg(F.max_by(F.struct("_copied", "_a", "_b"), "_n").alias("_m"))
    seg = seg.select("_pid", *gnames, "_m._copied", "_m._a", "_m._b")
    types = dict(base.dtypes)
    gschema = ", ".join(f"{g} {types[g]}" for g in gnames)

    def carry(pdf):
        pdf = pdf.sort_values("_pid")
        has, y, hs, ys = False, 0.0, [], []
        for c, a, b in zip(pdf["_copied"], pdf["_a"], pdf["_b"]):
            hs.append(has)
            ys.append(y)
            if c:
                has, y = True, b
            elif has:
                y = a * y + b
        out = pdf[["_pid", *gnames]].copy()
        out["_has"], out["_y"] = hs, ys
        return out

    # only groups spanning several partitions receive a carried-in value: fewer than #partitions
    # such groups, so the composed table has at most 2 x #partitions rows and is broadcast
    spanning = seg.groupBy(*gnames).agg(F.count(F.lit(1)).alias("_np")).where(F.col("_np") > 1).select(*gnames)
    spanning = spanning.select(*[F.col(g).alias(f"_s{g}") for g in gnames])
    same = [F.col(g).eqNullSafe(F.col(f"_s{g}")) for g in gnames]
    carries = (seg.join(spanning, same, "left_semi").groupBy(*gnames)
               .applyInPandas(carry, f"_pid int, {gschema}, _has boolean, _y double")
               .where(F.col("_has")).select(F.col("_pid").alias("_cpid"), *[F.col(g).alias(f"_c{g}") for g in gnames], "_has", "_y"))
    j = rows.join(F.broadcast(carries), [F.col("_pid") == F.col("_cpid"),
                                         *[F.col(g).eqNullSafe(F.col(f"_c{g}")) for g in gnames]], "left")
    ema = F.when(F.col("_copied"), F.col("_b")).when(F.col("_has").isNotNull(), F.col("_a") * F.col("_y") + F.col("_b"))
    return j.withColumn(name, ema).drop("_pid", "_n", "_x", "_copied", "_a", "_b", "_has", "_y", "_cpid",
                                      *gnames, *[f"_c{g}" for g in gnames])
