"""Split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions.permute import sql_permuted
from seqspark.functions.rand import sql_hash32
from seqspark.operators import split as S
from seqspark.operators.rowindex import with_row_index
from seqspark.plans.catalog import register
from seqspark.plans.q_clean import pipeline
from seqspark.plans.q_kmers import PIPE
from seqspark.sources import driver_tables as V

K = 5
SEED = 42
EPOCHS = 3
BATCH = 512

SQL_FOLDS = f"""folds AS (
  SELECT id, label, ((row_number() OVER (PARTITION BY label
                       ORDER BY {sql_hash32(f"concat(id, '#', '{SEED}')")}, id) - 1) % {K} + 1)::INTEGER AS fold
  FROM pipeline)"""

SQL_SEQ_SPLIT = """seqsplit AS (
  SELECT id, row_idx, CASE WHEN row_idx < floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split
  FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_idx, count(*) OVER () AS n FROM promoters))"""


def seq_split(spark, sf):
    return S.sequential_split(V.promoters(spark, sf).select("id"), ["id"])


def folds(spark, sf, data=None):
    """Fold of every row of ``data`` (default: the cleaned corpus; its other columns are kept)."""
    return S.stratified_kfold(data if data is not None else pipeline(spark, sf).select("id", "label"), K, SEED)


@register("row_index", V.with_views("""
SELECT id, row_number() OVER (ORDER BY doc_id, tile) - 1 AS row_idx FROM promoters""", "promoters"))
def q_row_index(spark, sf):
    return with_row_index(V.promoters(spark, sf).select("id", "doc_id", "tile"), ["doc_id", "tile"]) \
        .select("id", "row_idx")


@register("seq_split", V.with_views(f"WITH {SQL_SEQ_SPLIT} SELECT * FROM seqsplit", "promoters"))
def q_seq_split(spark, sf):
    return seq_split(spark, sf).select("id", "row_idx", "split")


@register("strat_kfold", V.with_views(f"WITH {PIPE}, {SQL_FOLDS} SELECT * FROM folds", "promoters"))
def q_strat_kfold(spark, sf):
    return folds(spark, sf).select("id", "label", "fold")


@register("fold_sizes", V.with_views(f"""WITH {PIPE}, {SQL_FOLDS}
SELECT label, fold, count(*) AS n FROM folds GROUP BY label, fold""", "promoters"))
def q_fold_sizes(spark, sf):
    return folds(spark, sf).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("fold_membership", V.with_views(f"""WITH {PIPE}, {SQL_FOLDS}
SELECT id, label, fold, s.split_id::INTEGER AS split_id,
       CASE WHEN fold = s.split_id THEN 'test' ELSE 'train' END AS role
FROM folds, (SELECT unnest(range(1, {K} + 1)) AS split_id) s""", "promoters"))
def q_fold_membership(spark, sf):
    m = S.fold_membership(folds(spark, sf), K)
    return m.select("id", "label", "fold", F.col("split_id").cast("int").alias("split_id"), "role")


SQL_EPOCHS = f"""train AS (SELECT id, row_idx, count(*) OVER () AS n_train, unnest(range(1, {EPOCHS} + 1)) AS epoch
           FROM seqsplit WHERE split = 'train'),
{sql_permuted("shuffled", "train", "row_idx", "n_train", "position", seed=0, tweak="epoch")}"""


@register("shuffle_epoch", V.with_views(f"""WITH RECURSIVE {SQL_SEQ_SPLIT}, {SQL_EPOCHS}
SELECT epoch::INTEGER AS epoch, id, position FROM shuffled""", "promoters"))
def q_shuffle_epoch(spark, sf):
    """The train rows come first in the split's own index, which therefore numbers them without gaps."""
    tr = seq_split(spark, sf).where("split = 'train'").select("id", "row_idx")
    out = S.shuffle_epochs(tr, EPOCHS, seed=0, index_col="row_idx")
    return out.select(F.col("epoch").cast("int").alias("epoch"), "id", "position")


@register("batches", V.with_views(f"""WITH {SQL_SEQ_SPLIT}
SELECT id, row_idx, row_idx // {BATCH} AS batch_id
FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_idx FROM seqsplit WHERE split = 'train')""",
                                  "promoters"))
def q_batches(spark, sf):
    tr = seq_split(spark, sf).where("split = 'train'").select("id")
    return S.batches(tr, BATCH, ["id"]).select("id", "row_idx", "batch_id")


@register("fold_files", V.with_views(f"""WITH {PIPE}, {SQL_FOLDS}
SELECT s.split_id::INTEGER AS split_id, CASE WHEN fold = s.split_id THEN 'test' ELSE 'train' END AS role,
       count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_strong
FROM folds, (SELECT unnest(range(1, {K} + 1)) AS split_id) s GROUP BY ALL""", "promoters"))
def q_fold_files(spark, sf):
    """E3 + S5: every fold's train/test rows written as a split_id=/role= tree, read back and counted."""
    from seqspark.sources.files import scratch_path
    path = scratch_path(spark, "folds")
    S.write_folds(S.fold_membership(folds(spark, sf), K), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("split_id").cast("int").alias("split_id"), "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_strong"))
