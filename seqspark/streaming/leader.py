"""Evaluation events as a stream -> append log + global-best leader table.

Each micro-batch is written to the event log (one ``batch_id=`` folder per
batch, so a retried batch replaces itself) and its best event is merged
into a one-row leader table that is written as a new ``version=`` folder and
never overwritten, so a stop at any moment leaves the last whole version: a new event replaces the leader only when it is
strictly better, or equal and earlier in event order, so the final leader
does not depend on how events were grouped into batches (and equals the
first occurrence of the maximum, as in the reference's callback).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import DoubleType, StructField, StructType

ORDER = ("trial_id", "fold", "epoch")


def _batch_best(df: DataFrame, acc: str, order: Sequence[str]) -> DataFrame:
    valid = df.where(F.col(acc).isNotNull() & ~F.isnan(F.col(acc)))
    packed = F.struct(F.negative(F.col(acc)).alias("_neg"), *[F.col(c) for c in order])
    b = valid.agg(F.min(packed).alias("_b")).where(F.col("_b").isNotNull())
    return b.select(F.negative(F.col("_b._neg")).alias("best_metric_value"),
                    *[F.col(f"_b.{c}").alias(c) for c in order])


def run_leader_stream(spark: SparkSession, source_dir: str, schema: StructType | str, log_dir: str,
                      leader_dir: str, checkpoint_dir: str, acc: str = "acc",
                      order: Sequence[str] = ORDER, max_files_per_trigger: int = 100) -> DataFrame:
    """Process every file in ``source_dir`` (availableNow) and return the leader table."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    leader_schema = StructType([StructField("best_metric_value", DoubleType()),
                                *[StructField(c, fields[c].dataType) for c in order]])
    key = lambda r: (-r["best_metric_value"], *[r[o] for o in order])
    state = {"leader": min((r for r in _versions(spark, leader_dir, leader_schema).collect()), key=key, default=None)}

    def merge(batch: DataFrame, batch_id: int) -> None:
        # idempotent: a retried micro-batch overwrites its own folder instead of appending twice
        batch.write.mode("overwrite").parquet(f"{log_dir}/batch_id={batch_id}")
        cand = _batch_best(batch, acc, order).collect()          # at most one row
        if not cand:
            return
        c = cand[0]
        cur = state["leader"]
        if cur is None or key(c) < key(cur):
            spark.createDataFrame([tuple(c)], leader_schema).coalesce(1).write.mode("overwrite").parquet(
                f"{leader_dir}/version={batch_id}")
            state["leader"] = c

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    best = state["leader"]
    return spark.createDataFrame([tuple(best)] if best else [], leader_schema)


def _versions(spark: SparkSession, leader_dir: str, schema: StructType) -> DataFrame:
    """All whole versions of the leader (one row each, one per improvement); none before the first."""
    try:
        return spark.read.schema(schema).parquet(f"{leader_dir}/version=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
