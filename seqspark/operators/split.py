"""Splits and experiment design over rows.

Membership is an md5 hash of (key, seed), order a keyed permutation of the row index: both are reproducible,
independent of partitioning, and checkable in SQL.  Ordered numbering uses
``with_row_index`` (range partitioning), never a global single-partition window.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions.permute import permute
from seqspark.functions.rand import hash32
from seqspark.operators.rowindex import with_row_index


def sequential_split(df: DataFrame, order_by: list[str], train_fraction: float = 0.8) -> DataFrame:
    """First floor(fraction * n) rows by ``order_by`` are train, the rest validation.

    Adds row_idx (0-based) and split; n is a scalar subquery (no driver round trip).
    """
    idx = with_row_index(df, order_by)
    n = df.select(F.count(F.lit(1))).scalar()
    cut = F.floor(F.lit(train_fraction) * n)
    return idx.withColumn("split", F.when(F.col("row_idx") < cut, "train").otherwise("validation"))


def stratified_kfold(df: DataFrame, n_splits: int = 5, seed: int = 42, label_col: str = "label",
                     id_col: str = "id") -> DataFrame:
    """Fold in 1..n_splits, balanced inside every class (sizes differ by at most 1).

    Rows of each class are ordered by md5(id, seed) (ties by id) and dealt
    round-robin: fold = (rank inside class) % n_splits + 1.  The rank is an
    exact range-partitioned index, so a class holding most rows is still spread
    over all tasks.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    if n_splits != 5:
        warnings.warn("the reference experiments use 5 folds", stacklevel=2)
    h = df.withColumn("_h", hash32(id_col, seed))
    idx = with_row_index(h, ["_h", id_col], partition_by=[label_col], name="_rk")
    return idx.withColumn("fold", (F.col("_rk") % n_splits + 1).cast("int")).drop("_h", "_rk")


def check_folds(df: DataFrame, n_splits: int, label_col: str = "label") -> None:
    """sklearn's checks: error when n_splits exceeds the largest class, warning when it
    exceeds the smallest one.  One small aggregation (class counts)."""
    c = df.groupBy(label_col).count().agg(F.min("count").alias("lo"), F.max("count").alias("hi")).first()
    if c is None or c["hi"] is None or c["hi"] < n_splits:
        raise ValueError(f"n_splits={n_splits} cannot be greater than the number of members in each class")
    if c["lo"] < n_splits:
        warnings.warn(f"the least populated class has only {c['lo']} members, less than n_splits={n_splits}",
                      stacklevel=2)


def fold_membership(df: DataFrame, n_splits: int = 5, fold_col: str = "fold") -> DataFrame:
    """One row per (row, split) with role 'test' where fold = split, else 'train'.

    Expressed as an explode of 1..k per row (rows x k output, no join).
    """
    out = df.withColumn("split_id", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    return out.withColumn("role", F.when(F.col(fold_col) == F.col("split_id"), "test").otherwise("train"))


def write_folds(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                max_records_per_file: int = 5_000_000) -> None:
    """E3 + S5: materialise every fold's train/test rows as a split_id=/role= folder tree.

    No repartition by (split, role): a train role holds ~80% of all rows, so
    every task writes its own rows into the tree; file size is bounded by
    ``maxRecordsPerFile``.
    """
    (df.write.mode(mode).format(fmt).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("split_id", "role").save(path))


def shuffle_epochs(df: DataFrame, epochs: int, seed: int = 0, id_col: str = "id",
                   index_col: str | None = None) -> DataFrame:
    """O3: (epoch, position, ...): every epoch is another permutation of the rows.

    The rows are numbered once by ``id_col`` (or bring a dense 0-based ``index_col``); an epoch's position is
    the keyed permutation of that number, so no epoch is sorted or shuffled.  Rows that repeat an id need an
    ``index_col`` to be reproducible; a null id is an id like any other.
    """
    idx = df if index_col else with_row_index(df, [id_col], name="_idx")
    n = df.select(F.count(F.lit(1))).scalar()
    e = idx.withColumn("_n", n).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    out = e.withColumn("position", permute(index_col or "_idx", F.col("_n"), seed, F.col("epoch")))
    return out.drop("_idx", "_n")


def batches(df: DataFrame, batch_size: int, order_by: list[str]) -> DataFrame:
    """Fixed-size batches in ``order_by`` order; the last batch may be short."""
    idx = with_row_index(df, order_by)
    return idx.withColumn("batch_id", F.floor(F.col("row_idx") / batch_size).cast("bigint"))

