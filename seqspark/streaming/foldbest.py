"""X5 keyed: the running best of every (trial, fold) as state of a stream, one small record per key.

Events may come in any order and any batches, late ones included: the state holds the best accuracy, the first
epoch that reached it, and counts, all of which merge commutatively, so the last version of a key does not
depend on how its events were split.  The state is kept in RocksDB under the stream's checkpoint and the results
go to Spark's transactional Parquet sink, so a stop between any two batches neither loses nor repeats an event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = StructType([StructField("best", DoubleType()), StructField("epoch", LongType()), StructField("n_events", LongType()),
                     StructField("n_valid", LongType()), StructField("n_late", LongType()), StructField("last_epoch", LongType()),
                     StructField("version", LongType())])

_VERSION = Row("_key", *_STATE.names)


class FoldBest(StatefulProcessor):
    """Merges a batch's events of one key into its record and emits the record as a new version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        best = epoch = last = newest = None
        n = valid = late = version = 0
        if (held := self.state.get()) is not None:              # one call: an absent record is None
            best, epoch, n, valid, late, last, version = held
        for _, at, acc in rows:                                 # plain rows: a frame for every key costs more than its events
            n += 1
            if last is not None and at < last:                  # behind an epoch of an earlier batch
                late += 1
            if newest is None or at > newest:
                newest = at
            if acc is not None:
                valid += 1
                if best is None or acc > best or (acc == best and at < epoch):
                    best, epoch = acc, at
        last = max((x for x in (last, newest) if x is not None), default=None)
        record = (best, epoch, n, valid, late, last, version + 1)
        self.state.update(record)
        yield _VERSION(*key, *record)

    def close(self) -> None:
        pass


def run_fold_best_stream(spark: SparkSession, source_dir: str, schema: StructType | str, out_dir: str, checkpoint_dir: str,
                         keys: Sequence[str] = ("trial_id", "fold"), epoch: str = "epoch", acc: str = "acc",
                         max_files_per_trigger: int = 100) -> None:
    """Process what is new in ``source_dir`` since the last run with this checkpoint (availableNow), then stop.

    Versions of the keys' records are appended to ``out_dir``.  NaN and null accuracies are counted, never best.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    key_schema = StructType([fields[k] for k in keys])
    out_schema = StructType([StructField("_key", StringType()), *_STATE.fields])
    events = (spark.readStream.schema(fields).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
              .select(F.to_json(F.struct(*keys)).alias("_key"), F.col(epoch).cast("long").alias("epoch"),
                      F.when(~F.isnan(F.col(acc).cast("double")), F.col(acc).cast("double")).alias("acc")))
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        versions = events.groupBy("_key").transformWithState(      # as text, a null key is a key like others
            statefulProcessor=FoldBest(), outputStructType=out_schema, outputMode="Append", timeMode="None")
        versions = versions.select(F.from_json("_key", key_schema).alias("_k"), *_STATE.names).select("_k.*", *_STATE.names)
        query = (versions.writeStream.format("parquet").outputMode("append").option("path", out_dir)
                 .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def latest(spark: SparkSession, out_dir: str, keys: Sequence[str] = ("trial_id", "fold")) -> DataFrame:
    """The last version of every key's record."""
    rows = spark.read.parquet(out_dir)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*_STATE.names), "version").alias("_r"))
    return newest.select(*keys, "_r.*")
