"""File sources and sinks: FASTA, CSV, JSON, append logs.

FASTA is read with Spark's text source split on ``\\n>`` (splittable, so a
large file is read by many tasks); record order is (file path, split start,
position inside the split), which is the file order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqspark.functions.dna import WHITESPACE_CLASS
from seqspark.operators.rowindex import with_row_index
from seqspark.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/seqspark-out/{name}-{uuid.uuid4().hex}"


def read_fasta(spark: SparkSession, path: str, indexed: bool = True) -> DataFrame:
    """(row_idx, id, sequence) per record in file order; ``indexed=False`` skips row_idx where no order is needed.

    Multi-line records are joined, whitespace (incl. CR of CRLF files) is
    removed from the sequence, case is kept, the first word of the header is the id.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("_f"),
                     F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_m"))
    rec = raw.select("_f", "_b", "_m", F.regexp_replace("value", "^>", "").alias("v"))
    rec = rec.where(F.length(F.regexp_replace("v", WHITESPACE_CLASS, "")) > 0)
    parts = F.split("v", "\n", 2)
    rec = rec.select("_f", "_b", "_m",
                     F.regexp_extract(parts[0], f"{WHITESPACE_CLASS}*([^{WHITESPACE_CLASS[1:]}*)", 1).alias("id"),
                     F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), WHITESPACE_CLASS, "").alias("sequence"))
    if not indexed:
        return rec.select("id", "sequence")
    return with_row_index(rec, ["_f", "_b", "_m"]).select("row_idx", "id", "sequence")


def fasta_records(df: DataFrame, order_by: list[str], sequence_col: str = "sequence", indexed: bool = False) -> DataFrame:
    """S2 body: one text row '>Sequence_<i>\\n<UPPER SEQ>' per row, i 1-based in ``order_by`` order.

    ``indexed``: ``df`` already has the 0-based ``row_idx`` of that order.
    """
    idx = df if indexed else with_row_index(df.select(*order_by, sequence_col), order_by)
    return idx.select("row_idx", F.concat(F.lit(">Sequence_"), (F.col("row_idx") + 1).cast("string"), F.lit("\n"),
                                          F.upper(sequence_col)).alias("value"))


def write_fasta(df: DataFrame, path: str, order_by: list[str], sequence_col: str = "sequence",
                num_files: int | None = None) -> None:
    """Overwrite ``path`` with FASTA text; part files follow record order.

    Numbering leaves the rows ordered over the partitions, so they are written as they lie; only input
    that brings its own ``row_idx`` (``order_by = ["row_idx"]``), or an asked number of files, is dealt out again.
    """
    indexed = list(order_by) == ["row_idx"]
    rec = fasta_records(df, order_by, sequence_col, indexed)
    if num_files:
        rec = rec.repartitionByRange(num_files, "row_idx").sortWithinPartitions("row_idx")
    elif indexed:
        rec = rec.repartitionByRange("row_idx").sortWithinPartitions("row_idx")
    rec.select("value").write.mode("overwrite").text(path)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str,
                     required: list[str]) -> DataFrame:
    """CSV with header, columns taken by their header names and cast to the declared types.

    Columns may stand in any order and others may be present; a declared column that is missing is NULL
    unless it is required: the error lists every missing required column.  A cell that does not fit its
    type is NULL.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns
                         else F.lit(None).cast(f.dataType)).alias(f.name) for f in declared.fields])


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with header, optionally one folder per partition value (fold / trial trees)."""
    w = df.write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (nested structs kept)."""
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet log (schema from the first write; new columns merge on read)."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def training_view(df: DataFrame, sequence_col: str = "sequence", label_col: str = "label") -> DataFrame:
    """The (sequence, label) projection handed to a trainer."""
    return df.select(F.col(sequence_col).cast("string").alias("sequence"), F.col(label_col).cast("int").alias("label"))
