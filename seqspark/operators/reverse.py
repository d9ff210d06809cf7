"""The reverse chain of conditional sampling (F13, F14 over all steps) and a fitted denoiser.

A chain is a T-step recurrence per row; rows are independent, so it is one Arrow kernel over NumPy matrices
without a shuffle.  It starts from noise everywhere but in the core, where it has the template's value; the core
is not clamped again (as in the reference's loop), so it drifts with the rest and the drift is reported.

Noise is a counter-based hash of (row key, step, cell), made of squares modulo 2^31 - 1, with an SQL twin.

Predictors of the noise: ``mean`` (one x0 estimate per cell; for sequences, shares of the letters per position,
of which the posterior is taken), several checkpoints at once, and ``weights`` (a linear map of the noised row per
timestep bucket, fitted by least squares on Gram matrices).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions.dna import BASES
from seqspark.functions.rand import hash32, sql_hash32
from seqspark.operators.delivery import with_model
from seqspark.operators.diffusion import random_timestep
from seqspark.operators.kernels import position_counts
from seqspark.operators.regions import ACTIVE_REGIONS, Regions

P = 2147483647
ROW_SHIFT, STEP, STEP_SHIFT, CELL, CELL_SHIFT = 1013904223, 40503, 69069, 7919, 362437
FACTOR, U1_SHIFT, U2_SHIFT = 48271, 11, 521288629
ROWS = 1024                     # rows of a matrix worked on at a time
_COEFS = ["remove_noise_coeff", "reciprocal_sqrt_alpha", "sigma", "sqrt_alpha_bar", "sqrt_one_minus_alpha_bar"]


# ---------------------------------------------------------------- noise
def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime P, for 0 <= x < 2^62."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


def _square(x: np.ndarray) -> np.ndarray:
    x = _mod(x)
    return _mod(x * x)


def _fold(x: np.ndarray) -> np.ndarray:
    """A number congruent to x modulo P, at most P + 2^(bits of x - 31); x is overwritten."""
    high = x >> 31
    x &= P
    x += high
    return x


def counter_normals(keys: np.ndarray, step: int, cells: np.ndarray) -> np.ndarray:
    """Standard normals (len(keys), len(cells)) of a step; ``keys`` are integers below 2^32."""
    row = _square(keys.astype(np.int64) + ROW_SHIFT)
    h = _square(row + STEP * step + STEP_SHIFT)[:, None] + (CELL * cells.astype(np.int64) + CELL_SHIFT)[None, :]
    _fold(h)
    h *= h
    _fold(_fold(h))
    h *= FACTOR                                                 # below 2^48: one fold leaves less than 2^31.1
    h += U1_SHIFT
    _fold(h)
    h *= h
    a = _fold(_fold(h))
    a[a >= P] -= P
    b = a + U2_SHIFT
    _fold(b)
    b *= b
    _fold(_fold(b))
    b[b >= P] -= P
    return np.sqrt(-2.0 * np.log((a + 1) / (P + 1.0))) * np.cos(2.0 * math.pi * (b / float(P)))


def chain_key(*parts):
    """Integer key of a row's noise."""
    return hash32(*parts, "=chain")


def sql_chain_key(key: str) -> str:
    return sql_hash32(f"concat({key}, '#chain')")


def sql_counter_normal(table: str, key: str, step: str, cell: str, out: str) -> str:
    """DuckDB twin: a subquery with the rows of ``table`` and the normal as ``out``."""
    q = f"SELECT *, ({key} + {ROW_SHIFT}) % {P} AS h_ FROM {table}"
    for last in (f"h_ * h_ % {P} + {STEP}::BIGINT * {step} + {STEP_SHIFT}", f"h_ * h_ % {P} + {CELL}::BIGINT * {cell} + {CELL_SHIFT}",
                 f"(h_ * h_ % {P}) * {FACTOR} + {U1_SHIFT}"):
        q = f"SELECT * REPLACE (({last}) % {P} AS h_) FROM ({q})"
    q = f"SELECT *, h_ * h_ % {P} AS a_ FROM ({q})"
    q = f"SELECT * REPLACE ((a_ + {U2_SHIFT}) % {P} AS h_) FROM ({q})"
    return (f"(SELECT * EXCLUDE (h_, a_), sqrt(-2.0 * ln((a_ + 1) / {P + 1}::DOUBLE)) * cos(2.0 * pi() * ((h_ * h_ % {P}) / {P}::DOUBLE)) "
            f"AS {out} FROM ({q}))")


# ---------------------------------------------------------------- chain
def core_cells(width: int, regions: Regions = ACTIVE_REGIONS, channels: int = 1) -> np.ndarray:
    """Mask over ``width`` cells (position-major, ``channels`` cells a position) that is true in the core."""
    pos = np.arange(width) // channels
    mask = np.zeros(width, bool)
    for a, b in regions:
        mask |= (pos >= a) & (pos < b)
    return mask


def run_chains(template: np.ndarray, keys: np.ndarray, coefs: list[dict], predictors: list, core: np.ndarray) -> list[np.ndarray]:
    """x_0 of every row per predictor (``predict(x, t)`` estimates the noise): all T reverse steps on the same noise."""
    cells = np.arange(template.shape[1])
    T = len(coefs)
    begin = np.where(core[None, :], template, counter_normals(keys, T, cells))
    xs = [begin] * len(predictors)
    for t in range(T - 1, -1, -1):
        c = coefs[t]
        xs = [(x - c["remove_noise_coeff"] * predict(x, t)) * c["reciprocal_sqrt_alpha"] for x, predict in zip(xs, predictors)]
        if t > 0:
            noise = c["sigma"] * counter_normals(keys, t, cells)
            xs = [x + noise for x in xs]
    return xs


def sample_letters(text: np.ndarray, keys: np.ndarray, coefs: list[dict], priors: list[np.ndarray], core: np.ndarray,
                   channels: int = 4, rows: int = 64) -> list[np.ndarray]:
    """Letter numbers (len(text), length) per prior: ``run_chains`` with ``categorical_predictor_of`` and the first largest cell.

    ``text``: letter numbers of the templates (``channels`` and more: no cell set); ``core``: mask of positions; ``priors``:
    position-major shares.  ``rows`` templates at a time stay in the processor's cache, one matrix per letter.
    """
    n, length = text.shape
    T, shares = len(coefs), [np.ascontiguousarray(p.reshape(length, channels).T)[:, None, :] for p in priors]
    steps = []
    for c in coefs:
        sab, s1m, scale = c["sqrt_alpha_bar"], c["sqrt_one_minus_alpha_bar"], c["reciprocal_sqrt_alpha"]
        noise = c["remove_noise_coeff"] / s1m
        steps.append((sab / (s1m * s1m), (1.0 - noise) * scale, noise * sab * scale, c["sigma"]))
    cells = np.arange(length * channels).reshape(length, channels).T.ravel()
    out = [np.empty((n, length), np.uint8) for _ in priors]
    for at in range(0, n, rows):
        part, key = text[at:at + rows], keys[at:at + rows]
        normals = lambda t: np.ascontiguousarray(
            counter_normals(key, t, cells).reshape(len(key), channels, length).transpose(1, 0, 2))
        begin = np.where(core[None, None, :], part[None] == np.arange(channels)[:, None, None], normals(T))
        xs = [begin.copy() for _ in priors]
        w = np.empty_like(begin)
        for t in range(T - 1, -1, -1):
            k, own, of_x0, sigma = steps[t]
            noise = normals(t) * sigma if t > 0 else None
            for x, share in zip(xs, shares):
                if t < T - 1 or x is xs[0]:                     # the first step is from the same numbers
                    np.multiply(x, k, out=w)
                    if max(float(w.max(initial=0.0)), -float(w.min(initial=0.0))) > 300.0:     # exp would leave the range
                        w -= w.max(axis=0)
                    np.exp(w, out=w)
                    weights = w.copy() if t == T - 1 else w
                np.multiply(weights, share, out=w)
                total = w.sum(axis=0)
                w *= of_x0 / np.where(total > 0, total, 1.0)
                x *= own
                x += w
                if noise is not None:
                    x += noise
        for x, made in zip(xs, out):
            top, best = x[0], np.zeros(x.shape[1:], np.uint8)
            for c in range(1, channels):
                np.copyto(best, c, where=x[c] > top)
                top = np.maximum(top, x[c])
            made[at:at + rows] = best
    return out


def mean_predictor_of(mean: np.ndarray, coefs: list[dict]):
    return lambda x, t: (x - coefs[t]["sqrt_alpha_bar"] * mean) / coefs[t]["sqrt_one_minus_alpha_bar"]


def categorical_predictor_of(prior: np.ndarray, coefs: list[dict], channels: int = 4):
    """Noise estimate from the posterior mean of independent one-hot positions with the given shares of their letters.

    A letter's posterior weight is share x exp(sqrt_alpha_bar x / (1 - alpha_bar)); a position without any share has none.
    """
    def predict(x, t):
        sab, s1m = coefs[t]["sqrt_alpha_bar"], coefs[t]["sqrt_one_minus_alpha_bar"]
        z = (sab / (s1m * s1m)) * x.reshape(len(x), -1, channels)
        w = prior.reshape(1, -1, channels) * np.exp(z - z.max(axis=2, keepdims=True))
        total = w.sum(axis=2, keepdims=True)
        x0 = (w / np.where(total > 0, total, 1.0)).reshape(len(x), -1)
        return (x - sab * x0) / s1m
    return predict


def linear_predictor_of(weights: np.ndarray, T: int):
    """``weights`` (buckets, width + 1, width), the last input being 1; a step's bucket is floor(t * buckets / T)."""
    def predict(x, t):
        w = weights[t * len(weights) // T]
        return x @ w[:-1] + w[-1]
    return predict


def schedule_row(schedule: DataFrame) -> DataFrame:
    """The schedule's T rows as one array, in order of t (bounded by T)."""
    return schedule.agg(F.array_sort(F.collect_list(F.struct("t", *_COEFS))).alias("coefs"))


def models_row(models: DataFrame) -> DataFrame:
    """All models as one array of (model, mean) or (model, weights), in order of model (bounded by checkpoints x width)."""
    value = "mean" if "mean" in models.columns else "weights"
    return models.agg(F.array_sort(F.collect_list(F.struct("model", F.col(value).alias("value")))).alias("models"))


def _batches(batches, of_mean):
    """(rows, coefs, [(model, predict)]) of at most ROWS rows; the models come with the first row."""
    coefs = predictors = None
    for b in batches:
        if not b.num_rows:
            continue
        if coefs is None:
            coefs = b.column(b.schema.get_field_index("_coefs"))[0].as_py() or []
            predictors = []
            for m in b.column(b.schema.get_field_index("_models"))[0].as_py() or []:
                v = np.array(m["value"], float)
                linear = v.ndim == 2
                predictors.append((m["model"], linear_predictor_of(v.reshape(len(v), -1, _width(v)), len(coefs)) if linear
                                   else of_mean(v, coefs)))
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS), coefs, predictors


def _width(v: np.ndarray) -> int:
    """Cells of flat (width + 1) x width matrices."""
    return (math.isqrt(4 * v.shape[1] + 1) - 1) // 2


def reverse_chain(templates: DataFrame, schedule: DataFrame, models: DataFrame, key: str = "id", x: str = "x",
                  regions: Regions = ACTIVE_REGIONS) -> DataFrame:
    """F13 + F14 x T: (key, model, x_0 array) for every row and model.

    ``models(model, mean)`` or ``models(model, weights)``; rows without an array are dropped, one of another
    width than the models' raises.  A null key hashes as ''; rows of one key get the same noise.
    """
    rows = templates.where(F.col(x).isNotNull()).select(
        F.col(key).alias("key"), chain_key(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_key"),
        F.col(x).cast("array<double>").alias("x"))
    rows = with_model(rows, _coefs=schedule_row(schedule), _models=models_row(models))
    key_type = templates.schema[key].dataType.simpleString()

    def run(batches):
        for b, coefs, predictors in _batches(batches, mean_predictor_of):
            n = b.num_rows
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            if len(set(lengths.tolist())) != 1:
                raise ValueError("reverse_chain: rows of different widths")
            m = flat.reshape(n, -1)
            outs = run_chains(m, b.column(1).to_numpy(), coefs, [p for _, p in predictors], core_cells(m.shape[1], regions))
            for (name, _), out in zip(predictors, outs):
                offsets = pa.array(np.arange(0, out.size + 1, m.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * n, pa.int64()),
                                                  pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["key", "model", "x_0"])

    return rows.mapInArrow(run, f"key {key_type}, model long, x_0 array<double>").withColumnRenamed("key", key)


def generate_sequences(df: DataFrame, schedule: DataFrame, models: DataFrame, id_col: str = "id", sequence_col: str = "sequence",
                       regions: Regions = ACTIVE_REGIONS) -> DataFrame:
    """Sequences sampled by the chain from every row's own core: (id, model, sequence, core_changed).

    A row's one-hot (A, C, G, T per position; another letter has no cell set) is the template; the result is
    decoded by the first largest cell.  ``models(model, mean)`` hold the letters' shares per position.  ``core_changed``: core positions whose letter differs from the template's.
    Null and empty sequences are dropped; sequences of another length than the models' raise.
    """
    rows = df.where(F.length(sequence_col) > 0).select(
        F.col(id_col).alias("id"), chain_key(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_key"),
        F.col(sequence_col).alias("s"))
    rows = with_model(rows, _coefs=schedule_row(schedule), _models=models_row(models))
    id_type = df.schema[id_col].dataType.simpleString()
    letters = np.frombuffer("".join(BASES).encode(), np.uint8)
    number = np.full(256, len(letters), np.uint8)
    number[letters] = np.arange(len(letters))

    def run(batches):
        for b, coefs, priors in _batches(batches, lambda prior, _: prior):
            seqs = [s.encode() for s in b.column(2).to_pylist()]
            n, length = len(seqs), len(seqs[0])
            if any(len(s) != length for s in seqs):
                raise ValueError("generate_sequences: sequences of different lengths")
            text = np.frombuffer(b"".join(seqs), np.uint8).reshape(n, length)
            core = core_cells(length, regions)
            outs = sample_letters(number[text], b.column(1).to_numpy(), coefs, [p for _, p in priors], core, len(letters))
            offsets = pa.py_buffer(np.arange(0, (n + 1) * length, length, dtype=np.int32).tobytes())
            for (name, _), out in zip(priors, outs):
                made = letters[out]
                changed = (made != text)[:, core].sum(axis=1)
                strings = pa.StringArray.from_buffers(n, offsets, pa.py_buffer(made.tobytes()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * n, pa.int64()), strings,
                                                  pa.array(changed.astype(np.int64))], names=["id", "model", "sequence", "core_changed"])

    return rows.mapInArrow(run, f"id {id_type}, model long, sequence string, core_changed long").withColumnRenamed("id", id_col)


def cell_means(df: DataFrame, x: str = "x") -> DataFrame:
    """(mean array): the average of every cell; one row, as wide as the matrix."""
    cells = df.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("mean"))


def base_means(df: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    """(mean array): share of each base at each position, position-major; tasks pass on L x 4 counts."""
    per = position_counts(df, sequence_col).select("pos", F.array(*[F.col(f"n_{b}") / F.col("n") for b in BASES]).alias("v"))
    return per.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"])).alias("mean"))


def mean_checkpoints(means: DataFrame, epochs: Sequence[int], start: float, rate: float) -> DataFrame:
    """(model, mean): the x0 estimate after ``model`` epochs of full-batch gradient descent on its squared error.

    One epoch moves every cell by ``rate`` of its distance to the mean, from ``start``.
    """
    e = means.select(F.explode(F.array(*[F.lit(int(x)).cast("long") for x in epochs])).alias("model"), "mean")
    done = F.lit(1.0) - F.pow(F.lit(1.0 - rate), F.col("model").cast("double"))
    return e.select("model", F.transform("mean", lambda m: F.lit(start) + (m - F.lit(start)) * done).alias("mean"))


# ---------------------------------------------------------------- fitted denoiser
def noised_rows(matrix: DataFrame, schedule: DataFrame, T: int, key: str = "id", x: str = "x") -> DataFrame:
    """(key, t, _key, x, sab, s1m): every row with its random timestep and the coefficients that noise it."""
    rows = matrix.where(F.col(x).isNotNull()).select(
        F.col(key).alias("key"), chain_key(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_key"),
        random_timestep(key, T).alias("t"), F.col(x).cast("array<double>").alias("x"))
    coefs = schedule.select("t", F.col("sqrt_alpha_bar").alias("sab"), F.col("sqrt_one_minus_alpha_bar").alias("s1m"))
    return rows.join(F.broadcast(coefs), "t").select("key", "t", "_key", "x", "sab", "s1m")      # T rows


def _noised(b, regions):
    """(t, x_t with a column of ones, eps) of a batch: eps and x_t keep the core as the training step does."""
    n = b.num_rows
    x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    core = core_cells(x.shape[1], regions)
    eps = np.where(core[None, :], 0.0, counter_normals(b.column(2).to_numpy(), 0, np.arange(x.shape[1])))
    sab, s1m = (b.column(i).to_numpy()[:, None] for i in (4, 5))
    xt = np.where(core[None, :], x, sab * x + s1m * eps)
    return b.column(1).to_numpy(), np.hstack([xt, np.ones((n, 1))]), eps


def gram_blocks(noised: DataFrame, T: int, buckets: int, regions: Regions = ACTIVE_REGIONS) -> DataFrame:
    """(bucket, i, j, v): entries of Z'Z (j <= width) and Z'E (j > width) per timestep bucket, Z = [x_t, 1].

    Each task adds up its batches' matrix products and passes on one (width + 1) x (2 width + 1) block per
    bucket; Spark sums the blocks' entries.  Nothing grows with the rows.
    """
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            t, z, e = _noised(b, regions)
            both = np.hstack([z, e])
            bucket = t.astype(np.int64) * buckets // T
            for k in np.unique(bucket):
                m = bucket == k
                part = z[m].T @ both[m]
                sums[int(k)] = sums[int(k)] + part if int(k) in sums else part
        for k, g in sums.items():
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, k, np.int32)), pa.array(i.ravel().astype(np.int32)),
                                              pa.array(j.ravel().astype(np.int32)), pa.array(g.ravel())], names=["bucket", "i", "j", "v"])

    parts = noised.mapInArrow(run, "bucket int, i int, j int, v double")
    return parts.groupBy("bucket", "i", "j").agg(F.sum("v").alias("v"))


def solve_denoiser(gram: DataFrame, ridge: float = 1.0) -> DataFrame:
    """(bucket, weights flat (width + 1) x width, residual): (Z'Z + ridge I) W = Z'E, one small solve per bucket.

    ``residual`` is the largest entry of the normal equations' difference relative to the largest of Z'E.
    """
    def solve(pdf):
        import pandas as pd
        w = int(pdf["i"].max())
        g = np.zeros((w + 1, 2 * w + 1))
        g[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["v"].to_numpy()
        a, c = g[:, :w + 1] + ridge * np.eye(w + 1), g[:, w + 1:]
        sol = np.linalg.solve(a, c)
        residual = float(np.abs(a @ sol - c).max() / max(1.0, np.abs(c).max()))
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "weights": [sol.ravel().tolist()], "residual": [residual]})

    return gram.groupBy("bucket").applyInPandas(solve, "bucket int, weights array<double>, residual double")


def denoiser_row(solved: DataFrame, buckets: int, model: int = 0) -> DataFrame:
    """(model, weights array per bucket) for ``reverse_chain``; a bucket without rows gets the nearest lower (or first) one's."""
    per = solved.agg(F.array_sort(F.collect_list(F.struct("bucket", "weights"))).alias("w"))
    at = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.coalesce(
        F.try_element_at(F.filter("w", lambda s: s["bucket"] <= k), F.lit(-1)), F.col("w")[0])["weights"])
    return per.select(F.lit(model).cast("long").alias("model"), at.alias("weights"))


def denoiser_losses(noised: DataFrame, solved: DataFrame, means: DataFrame, T: int, buckets: int,
                    regions: Regions = ACTIVE_REGIONS) -> DataFrame:
    """(bucket, n_rows, l2, l2_mean): mean squared noise error over all cells, of the fitted weights and of the cell means."""
    rows = with_model(noised, _weights=denoiser_row(solved, buckets).select("weights"), _mean=means)

    def run(batches):
        w = mean = None
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            if w is None:
                w, mean = np.array(b.column(6)[0].as_py()), np.array(b.column(7)[0].as_py())
            t, z, e = _noised(b, regions)
            sab, s1m = (b.column(i).to_numpy()[:, None] for i in (4, 5))
            by_mean = (((z[:, :-1] - sab * mean) / s1m - e) ** 2).mean(axis=1)
            bucket = t.astype(np.int64) * buckets // T
            for k in np.unique(bucket):
                m = bucket == k
                fitted = ((z[m] @ w[k].reshape(z.shape[1], -1) - e[m]) ** 2).mean(axis=1)
                sums[int(k)] = sums.get(int(k), 0) + np.array([m.sum(), fitted.sum(), by_mean[m].sum()])
        if sums:
            cols = list(zip(*sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(np.array(cols[0]).astype(np.int64)),
                                              pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=["bucket", "n", "s", "m"])

    parts = rows.mapInArrow(run, "bucket int, n long, s double, m double")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n_rows"), (F.sum("s") / F.sum("n")).alias("l2"),
                                       (F.sum("m") / F.sum("n")).alias("l2_mean"))
