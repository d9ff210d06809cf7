"""Experiment tracking: search space, trials, fold bests, trial ranking.

Input is an evaluation-event table ``(trial_id, fold, epoch, acc, ...)``; event
order is (trial_id, fold, epoch).  Every "best" is an aggregate with
map-side partial aggregation; running bests are distributed running maxima.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions.rand import hash32
from seqspark.operators.rowindex import cumulative, with_row_index

# The reference's hyper-parameter search space (choice lists, in order).
SEARCH_SPACE = {
    "lr": [1e-5, 2e-5, 5e-5, 1e-4, 2e-4],
    "lora_r": [2, 4, 8],
    "lora_alpha_multiplier": [2, 4],
    "lora_dropout": [0.2, 0.3, 0.4, 0.5, 0.6],
    "weight_decay": [0.01, 0.03, 0.05, 0.1],
    "batch_size": [8, 16, 32],
    "gradient_accumulation_steps": [1, 2, 4],
}
INT_PARAMS = {"lora_r", "lora_alpha_multiplier", "batch_size", "gradient_accumulation_steps", "lora_alpha"}
# The prompt experiments search the same lists with one batch size.
PROMPT_SEARCH_SPACE = {**SEARCH_SPACE, "batch_size": [128]}
# Accuracy keys tried in order by get_acc_from_metrics.
ACC_KEYS = ["eval_accuracy", "eval_acc", "test_accuracy", "test_acc"]


def space_size(space: dict = SEARCH_SPACE) -> int:
    return reduce(lambda a, b: a * b, (len(v) for v in space.values()), 1)


def decode_point(point: Column, space: dict = SEARCH_SPACE) -> list[Column]:
    """Mixed-radix decode of a point id (0 .. size-1) into one column per parameter."""
    out, stride = [], 1
    for name, values in space.items():
        idx = F.floor(point / stride) % len(values)
        typ = "int" if name in INT_PARAMS else "double"
        arr = F.array(*[F.lit(v).cast(typ) for v in values])
        out.append(F.element_at(arr, (idx + 1).cast("int")).alias(name))
        stride *= len(values)
    return out


def search_space(spark: SparkSession, space: dict = SEARCH_SPACE) -> DataFrame:
    """Every point of the grid (point_id, params...) as rows, generated from a range."""
    return spark.range(space_size(space)).select(F.col("id").alias("point_id"), *decode_point(F.col("id"), space))


def sample_trials(trials: DataFrame, seed: int = 42, space: dict = SEARCH_SPACE,
                  trial_col: str = "trial_id") -> DataFrame:
    """Random search: each trial draws point md5(trial, seed) mod |space| (with replacement)."""
    pt = (hash32(trial_col, seed) % space_size(space)).cast("bigint")
    return trials.select(trial_col, pt.alias("point_id")).select(
        trial_col, "point_id", *decode_point(F.col("point_id"), space))


def normalize_hparams(df: DataFrame) -> DataFrame:
    """E5: casts and lora_alpha = lora_r * lora_alpha_multiplier."""
    return df.select(
        "*", (F.col("lora_r").cast("int") * F.col("lora_alpha_multiplier").cast("int")).alias("lora_alpha"))


def flatten_params(df: DataFrame, params: Sequence[str], prefix: str = "param_") -> DataFrame:
    """Rename hyper-parameter columns to ``param_<name>``."""
    return df.withColumnsRenamed({p: prefix + p for p in params})


def trial_folds(trials: DataFrame, n_splits: int = 5, seed: int = 42, trial_col: str = "trial_id") -> DataFrame:
    """J3 + E6: trial x fold rows (explode, no join) with fold_seed = seed + trial*1000 + fold."""
    t = trials.select(trial_col, F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold"))
    return t.withColumn("fold_seed", F.lit(seed).cast("bigint") + F.col(trial_col).cast("bigint") * 1000 + F.col("fold"))


def _valid(acc: str = "acc") -> Column:
    return F.col(acc).isNotNull() & ~F.isnan(F.col(acc))


def global_best(events: DataFrame, acc: str = "acc",
                order: Sequence[str] = ("trial_id", "fold", "epoch")) -> DataFrame:
    """W1 top-1: highest accuracy, first event on ties; NULL/NaN ignored."""
    packed = F.struct(F.negative(F.col(acc)).alias("_neg"), *[F.col(c) for c in order])
    best = events.where(_valid(acc)).agg(F.min(packed).alias("_b"))
    return best.select(F.negative(F.col("_b._neg")).alias("best_metric_value"),
                       *[F.col(f"_b.{c}").alias(c) for c in order])


def running_best(events: DataFrame, acc: str = "acc",
                 order: Sequence[str] = ("trial_id", "fold", "epoch")) -> DataFrame:
    """W1 running: best so far after each event and whether the event improved it (strictly)."""
    ev = events.withColumn("_a", F.when(_valid(acc), F.col(acc)))
    prev = cumulative(ev, "_a", list(order), name="_prev", fn="max", exclusive=True)
    best = F.greatest("_prev", "_a")
    improved = F.col("_a").isNotNull() & (F.col("_prev").isNull() | (F.col("_a") > F.col("_prev")))
    return prev.select(*events.columns, best.alias("running_best"), improved.alias("improved")).drop("_a")


def fold_best(events: DataFrame, acc: str = "acc", keys: Sequence[str] = ("trial_id", "fold"),
              epoch: str = "epoch") -> DataFrame:
    """fold_best_test_acc = max acc over epochs, else the final (last-epoch) accuracy."""
    g = events.groupBy(*keys).agg(F.max(F.when(_valid(acc), F.col(acc))).alias("_mx"),
                                  F.max_by(F.col(acc), F.col(epoch)).alias("final_test_acc"),
                                  F.count(F.lit(1)).alias("n_evals"))
    return g.select(*keys, F.coalesce("_mx", "final_test_acc").alias("fold_best_test_acc"),
                    "final_test_acc", "n_evals")


def trial_summary(folds: DataFrame, trial_col: str = "trial_id", value: str = "fold_best_test_acc") -> DataFrame:
    """A11 + W8: mean/std(ddof=1)/max over folds, loss = -mean, and the global best after each trial."""
    t = folds.groupBy(trial_col).agg(F.count(F.lit(1)).alias("n_folds"),
                                     F.avg(value).alias("mean_best_test_acc"),
                                     F.stddev_samp(value).alias("std_best_test_acc"),
                                     F.max(value).alias("max_best_test_acc"))
    t = t.withColumn("loss", F.negative("mean_best_test_acc"))
    return cumulative(t, "max_best_test_acc", [trial_col], name="global_best_test_acc_after_trial", fn="max")


def rank_trials(summary: DataFrame, trial_col: str = "trial_id", metric: str = "mean_best_test_acc") -> DataFrame:
    """O1: rank 1.. by metric descending, ties by trial id (exact distributed index)."""
    s = summary.withColumn("_k", F.negative(F.col(metric)))
    return with_row_index(s, ["_k", trial_col], name="rank", start=1).drop("_k")


def best_trial(summary: DataFrame, trial_col: str = "trial_id", loss: str = "loss") -> DataFrame:
    """O2: the minimum-loss trial (ties -> smallest id): a top-1 (TakeOrderedAndProject)."""
    return summary.where(F.col(loss).isNotNull()).orderBy(F.col(loss).asc(), F.col(trial_col).asc()).limit(1)


def acc_from_metrics(metrics: Column) -> Column:
    """P10: first of eval_accuracy, eval_acc, test_accuracy, test_acc; else the first key
    containing '_test_' and ending in '_accuracy' or '_acc'; else NULL."""
    direct = [F.try_element_at(metrics, F.lit(k)) for k in ACC_KEYS]
    pattern = F.filter(F.map_entries(metrics), lambda e: e["key"].contains("_test_") & (
        e["key"].endswith("_accuracy") | e["key"].endswith("_acc")))
    return F.coalesce(*direct, F.get(pattern, 0)["value"])
