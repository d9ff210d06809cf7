"""Diffusion data side: noise schedules, coefficient gather, forward noising, reverse step, loss
(F9-F15, W5, J5, A12).

Matrices are handled in long form ``(id, pos, x)`` (one row per cell) so the
arithmetic runs in whole-stage codegen; the schedule has T rows (fixed by
the model, not by the data) and is broadcast to the cells.  The network that
predicts noise is not part of this library: ``eps_hat`` is an input column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.functions.rand import normal, uniform
from seqspark.operators.regions import ACTIVE_REGIONS, in_core

# Reference defaults.
T_STEPS = 1000
LINEAR_LOW = 1e-4
LINEAR_HIGH = 0.02
COSINE_S = 0.008
COSINE_MAX_BETA = 0.999


def linear_betas(spark: SparkSession, T: int = T_STEPS, low: float = LINEAR_LOW,
                 high: float = LINEAR_HIGH) -> DataFrame:
    """linspace(low*1000/T, high*1000/T, T) as (t, beta), t = 0..T-1."""
    lo, hi = low * 1000.0 / T, high * 1000.0 / T
    step = (hi - lo) / (T - 1) if T > 1 else 0.0
    t = F.col("id")
    beta = F.when(t == T - 1, F.lit(hi)).otherwise(F.lit(lo) + t.cast("double") * F.lit(step))
    return spark.range(T).select(t.cast("int").alias("t"), beta.alias("beta"))


def cosine_betas(spark: SparkSession, T: int = T_STEPS, s: float = COSINE_S,
                 max_beta: float = COSINE_MAX_BETA) -> DataFrame:
    """beta_t = min(1 - f(t+1)/f(t), max_beta), f(t) = cos((t/T + s)/(1+s) * pi/2)^2."""
    def f(x):
        return F.pow(F.cos((x / F.lit(float(T)) + F.lit(s)) / F.lit(1.0 + s) * F.lit(math.pi / 2)), 2)
    t = F.col("id").cast("double")
    f0 = f(F.lit(0.0))
    beta = F.least(F.lit(1.0) - (f(t + 1) / f0) / (f(t) / f0), F.lit(max_beta))
    return spark.range(T).select(F.col("id").cast("int").alias("t"), beta.alias("beta"))


def schedule_table(betas: DataFrame) -> DataFrame:
    """Alpha, alpha_bar = cumulative product, and the five derived coefficient vectors.

    The running product is a window over the T schedule rows (bounded by the
    model's T, independent of the data).
    """
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = betas.withColumn("alpha", F.lit(1.0) - F.col("beta"))
    s = s.withColumn("alpha_bar", F.product("alpha").over(w))
    return s.select("t", "beta", "alpha", "alpha_bar",
                    F.sqrt("alpha_bar").alias("sqrt_alpha_bar"),
                    F.sqrt(F.lit(1.0) - F.col("alpha_bar")).alias("sqrt_one_minus_alpha_bar"),
                    F.sqrt(F.lit(1.0) / F.col("alpha")).alias("reciprocal_sqrt_alpha"),
                    (F.col("beta") / F.sqrt(F.lit(1.0) - F.col("alpha_bar"))).alias("remove_noise_coeff"),
                    F.sqrt("beta").alias("sigma"))


def random_timestep(key: str, T: int = T_STEPS, salt: str = "t"):
    """uniform integer timestep in [0, T) per key."""
    return F.floor(uniform(key, f"={salt}") * T).cast("int")


def gather(df: DataFrame, schedule: DataFrame, t: str = "t") -> DataFrame:
    """Attach the coefficients of each row's timestep (schedule has T rows -> broadcast)."""
    return df.join(F.broadcast(schedule), t)


def to_long(df: DataFrame, key: str, arr: str, value: str = "x") -> DataFrame:
    """(key, array) -> (key, pos, value) with 0-based positions."""
    return df.select(key, F.posexplode(arr).alias("pos", value)).withColumn("pos", F.col("pos").cast("int"))


def forward_noise(cells: DataFrame, schedule: DataFrame, key: str = "id", x: str = "x",
                  regions: Sequence[tuple[int, int]] = ACTIVE_REGIONS, T: int = T_STEPS) -> DataFrame:
    """F11 (+F12, J5): x_t = sqrt(ab_t) x + sqrt(1-ab_t) eps with eps = 0 and x kept in the core.

    eps is a hash-seeded standard normal per (key, pos); t per key.
    """
    c = cells.withColumn("t", random_timestep(key, T))
    c = gather(c, schedule.select("t", "sqrt_alpha_bar", "sqrt_one_minus_alpha_bar"))
    core = in_core(F.col("pos"), regions)
    eps = F.when(core, F.lit(0.0)).otherwise(normal(key, "pos", "=eps"))
    c = c.withColumn("eps", eps)
    xt = F.when(core, F.col(x)).otherwise(
        F.col("sqrt_alpha_bar") * F.col(x) + F.col("sqrt_one_minus_alpha_bar") * F.col("eps"))
    return c.withColumn("x_t", xt).drop("sqrt_alpha_bar", "sqrt_one_minus_alpha_bar")


def conditional_start(cells: DataFrame, key: str = "id", x: str = "x",
                      regions: Sequence[tuple[int, int]] = ACTIVE_REGIONS) -> DataFrame:
    """x_T ~ N(0, 1) everywhere except the core, which keeps the template value."""
    z = normal(key, "pos", "=init")
    return cells.withColumn("x_T", F.when(in_core(F.col("pos"), regions), F.col(x)).otherwise(z))


def mean_predictor(cells: DataFrame, x: str = "x") -> DataFrame:
    """Baseline x0 estimate per position (one row per position; bounded by the matrix width)."""
    return cells.groupBy("pos").agg(F.avg(x).alias("x0_hat"))


def eps_from_x0(xt: str = "x_t", x0: str = "x0_hat"):
    """Noise implied by an x0 estimate: (x_t - sqrt(ab) x0) / sqrt(1 - ab)."""
    return (F.col(xt) - F.col("sqrt_alpha_bar") * F.col(x0)) / F.col("sqrt_one_minus_alpha_bar")


def reverse_step(cells: DataFrame, schedule: DataFrame, key: str = "id", xt: str = "x_t",
                 eps_hat: str = "eps_hat") -> DataFrame:
    """x_{t-1} = (x_t - beta/sqrt(1-ab) eps_hat) sqrt(1/alpha) + [t > 0] sqrt(beta) z.

    The core is not re-clamped (as in the reference's sampling loop).
    """
    c = gather(cells, schedule.select("t", "remove_noise_coeff", "reciprocal_sqrt_alpha", "sigma"))
    mean = (F.col(xt) - F.col("remove_noise_coeff") * F.col(eps_hat)) * F.col("reciprocal_sqrt_alpha")
    z = normal(key, "pos", "t", "=z")
    prev = F.when(F.col("t") > 0, mean + F.col("sigma") * z).otherwise(mean)
    return c.withColumn("x_prev", prev).drop("remove_noise_coeff", "reciprocal_sqrt_alpha", "sigma")


def noise_loss(cells: DataFrame, eps: str = "eps", eps_hat: str = "eps_hat",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """L1 = mean |eps_hat - eps| and L2 = mean (eps_hat - eps)^2 over all cells (core included)."""
    d = F.col(eps_hat) - F.col(eps)
    return cells.groupBy(*group_cols).agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("l2"),
                                          F.count(F.lit(1)).alias("n_cells"))


def rescale(x: str = "x"):
    """map [0, 1] channels to [-1, 1]."""
    return F.lit(2.0) * F.col(x) - F.lit(1.0)
