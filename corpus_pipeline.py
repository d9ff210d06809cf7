"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
under the shared checkpoint folder and rereads it as the next stage's input.  All stages but the last
return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.common import save, table, without
from seqspark.llm.op02_jaccard import jaccard_components
from seqspark.llm.op04_pack import pack
from seqspark.llm.op07_winnow import contamination
from seqspark.llm.op08_langid import fit, predict, remainder

TOKENIZER = "byte_bpe_50k.json"
CACHE_WORDS = 100_000           # workers still hold what earlier stages left in them
BATCH_ROWS = 1000               # whole texts that an executor and its Python worker pass on at once


def _bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows (Spark's default is 10,000, which long texts make large)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text or no letter) go; the rest is kept as it is.

    The classifier learns from the stage's own input as ``op8`` does.  Rows that share an id go together.
    """
    _bounded_batches(spark)
    shared: list = []
    model = fit(docs.where(remainder("doc_id", 5) != 0))
    unknown = save(predict(docs, model, shared=shared).where("lang_pred = 'und'").select("doc_id"), "unknown-language")
    for sent in shared:                                         # the workers of later stages need not hold it
        sent.destroy()
    return without(docs, unknown)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (5-word shingles, similarity of at least 0.75) the smallest id stays.

    Rows that repeat an id and its text count once; rows without an id stay where their group has no id.
    """
    _bounded_batches(spark)
    found = save(jaccard_components(docs).select("doc_id", F.expr("doc_id <=> component_id").alias("first")), "groups")
    first = found.where("first").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    gone = found.where("not first").select("doc_id").join(
        first.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    kept = without(docs, gone)
    repeated = first.where("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept      # the texts are shuffled only if they must be


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside a benchmark window go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    _bounded_batches(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER), cache_words=CACHE_WORDS)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("packing", packing)]

ORACLE_SQL = None               # cross-parsing and packing are not SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
