"""Prediction tables and classification metrics.

Every metric is a grouped aggregate (per model / trial / fold), so one job
evaluates any number of models; no Python UDAF is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions.dna import label_name
from seqspark.functions.numeric import argmax2, softmax2
from seqspark.operators.rowindex import cumulative_sum

# The four evaluated models (key, display name, token length, batch size,
# padding side, prompt on/off) as configured by the reference's validation defaults.
MODEL_REGISTRY = [
    ("gemma", "Gemma2-9B-NoPrompt", 384, 1, "right", False),
    ("gemma_prompt", "Gemma2-9B-Prompt", 384, 8, "right", True),
    ("genomeocean", "GenomeOcean", 128, 64, "left", False),
    ("nt", "NT-v2-50M", 128, 64, "right", False),
]
MODEL_ALIASES = {"gemma_no_prompt": "gemma"}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MODEL_REGISTRY,
        "key string, name string, max_length int, batch_size int, padding_side string, use_prompt boolean")


def select_models(reg: DataFrame, run_model: str = "all") -> DataFrame:
    """P12: 'all' -> every model, an alias -> its target, otherwise one key."""
    if run_model == "all":
        return reg
    return reg.where(F.col("key") == MODEL_ALIASES.get(run_model, run_model))


def prediction_table(df: DataFrame, z0: str = "z0", z1: str = "z1") -> DataFrame:
    """Input columns + 2 logits + 2 probabilities + predicted label (ties -> weak) + name."""
    p0, p1 = softmax2(z0, z1)
    out = df.withColumns({"prob_weak_promoter": p0, "prob_strong_promoter": p1,
                          "predicted_label": argmax2(z0, z1).cast("int")})
    out = out.withColumn("predicted_name", label_name(F.col("predicted_label")))
    return out.withColumnsRenamed({z0: "logit_weak_promoter", z1: "logit_strong_promoter"})


def confusion(df: DataFrame, label: str = "label", pred: str = "predicted_label",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Tn, fp, fn, tp with labels fixed to {0, 1} (zero counts kept)."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*group_cols).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics_from_confusion(c: DataFrame) -> DataFrame:
    """Accuracy (and its ``acc`` alias), precision, recall (=sn), sp, f1, mcc; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        "*", _ratio(tp + tn, n).alias("accuracy"), _ratio(tp + tn, n).alias("acc"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(tp, tp + fn).alias("sn"), _ratio(tn, tn + fp).alias("sp"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp * tn - fp * fn, den).alias("mcc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            group_cols: Sequence[str] = ()) -> DataFrame:
    """A10: exact ROC AUC with ties counted 1/2 (Mann-Whitney); NULL with one class only.

    Rows are first collapsed to distinct (group, score) with pos/neg counts;
    the count of negatives below each score is an exact distributed running
    sum (range-partitioned), never a single-partition window.
    """
    s = df.groupBy(*group_cols, score).agg(F.count_if(F.col(label) == 1).alias("_pos"),
                                           F.count_if(F.col(label) == 0).alias("_neg"))
    c = cumulative_sum(s, "_neg", [score], group_cols, name="_below", exclusive=True)
    g = c.groupBy(*group_cols).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    return g.select(*group_cols, auc.alias("auc"), "n_pos", "n_neg")


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "predicted_label",
                   score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """A8-A10 together (the reference's compute_binary_metrics), one row per group."""
    m = metrics_from_confusion(confusion(df, label, pred, group_cols))
    a = roc_auc(df, label, score, group_cols).select(*group_cols, "auc")
    if group_cols:
        return m.join(a, list(group_cols), "left")
    return m.withColumn("auc", a.select("auc").scalar())


def model_accuracy(df: DataFrame, label: str = "label", pred: str = "predicted_label",
                   group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy and sample count per model."""
    return df.groupBy(*group_cols).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc"),
                                       F.count(F.lit(1)).alias("n"))


def model_summary(reg: DataFrame, results: DataFrame) -> DataFrame:
    """Every selected model gets a row; a model without results is FAILED with NULL acc/n."""
    r = results.withColumnRenamed("model", "key").withColumn("_ok", F.lit(True))
    out = reg.join(r, "key", "left")
    return out.select("key", "name", "acc", "n",
                      F.when(F.col("_ok"), F.lit("OK")).otherwise(F.lit("FAILED")).alias("status"))
