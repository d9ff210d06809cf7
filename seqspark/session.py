"""Session helpers: a tuned SparkSession for tests/bench and checkpoint-dir lookup."""

from __future__ import annotations

import os
import shlex
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "seqspark",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and Arrow enabled.

    A running session is used as it is, and settings given on submit (command
    line, ``PYSPARK_SUBMIT_ARGS``, defaults file) win: the values here are set
    only where none is given.  ``master`` and ``shuffle_partitions`` as
    arguments are the caller's own and are always set.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    given = _given_settings()
    wanted = {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SEQSPARK_DRIVER_MEMORY", "16g"),
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    master = master or given.get("spark.master") or os.environ.get("SEQSPARK_MASTER", "local[8]")
    cpus = master[6:-1] if master.startswith("local[") else ""
    if cpus.isdigit():
        wanted["spark.sql.shuffle.partitions"] = cpus
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in wanted.items():
        if key not in given:
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _given_settings() -> dict[str, str]:
    """Settings of the submit command: from its JVM, if it started this program, else from PYSPARK_SUBMIT_ARGS."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        from pyspark import SparkConf, SparkContext
        SparkContext._ensure_initialized()
        return dict(SparkConf(_jvm=SparkContext._jvm).getAll())
    words = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    out = {}
    for flag, value in zip(words, words[1:]):
        if flag in ("--conf", "-c") and "=" in value:
            key, _, val = value.partition("=")
            out[key] = val
        elif flag in ("--master", "--driver-memory"):
            out[{"--master": "spark.master", "--driver-memory": "spark.driver.memory"}[flag]] = value
    return out


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder; only a local-mode session (tests,
    bench) without one gets a fresh private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on this cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqspark-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df):
    """Write ``df`` once as a reliable checkpoint (shared folder) and return the re-readable copy.

    Used when one cleaned table feeds several passes (fit + apply, two
    indexes): each pass then reads the written table instead of recomputing
    the raw-text cleaning, and a lost executor does not trigger recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
