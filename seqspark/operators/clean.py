"""Cleaning stage: labelled load, clean_dna, empty/length filters, conflicts, dedup, reports.

Skew notes: a single sequence may hold a large share of all rows (exact
copies).  Conflict detection and dedup therefore use grouped aggregation with
map-side partial aggregation (one row per sequence per map task) instead of
windows partitioned by sequence, which would put the whole hot group into one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions.dna import clean_dna

# Default sheet names of the labelled workbook (stored as source_sheet).
STRONG_SHEET = "Strong promoters"
WEAK_SHEET = "Weak promoters"


def load_labeled(strong: DataFrame, weak: DataFrame, sequence_col: str = "sequence",
                 id_col: str = "id", order_col: str | None = None,
                 strong_sheet: str = STRONG_SHEET, weak_sheet: str = WEAK_SHEET) -> DataFrame:
    """S3 + U1: stack strong (label 1) before weak (label 0).

    Output: id, sequence, label, source_sheet, source_rank (0 strong, 1 weak), row_order.
    ``row_order`` is the row's order inside its sheet (``order_col``, default the id).
    """
    order_col = order_col or id_col

    def tag(df, label, sheet, rank):
        return df.select(F.col(id_col).cast("string").alias("id"),
                         F.col(sequence_col).cast("string").alias("sequence"),
                         F.lit(label).cast("int").alias("label"),
                         F.lit(sheet).alias("source_sheet"),
                         F.lit(rank).cast("int").alias("source_rank"),
                         F.col(order_col).alias("row_order"))
    return tag(strong, 1, strong_sheet, 0).unionByName(tag(weak, 0, weak_sheet, 1))


def clean_column(df: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    """P1 + P2: apply clean_dna and drop NULL / empty results."""
    out = df.withColumn(sequence_col, clean_dna(sequence_col))
    return out.where(F.length(sequence_col) > 0)


def length_filter(df: DataFrame, required_length: int = 81, sequence_col: str = "sequence") -> DataFrame:
    """Add seq_len; keep rows of exactly ``required_length`` (no filter when <= 0)."""
    out = df.withColumn("seq_len", F.length(sequence_col).cast("int"))
    if required_length > 0:
        out = out.where(F.col("seq_len") == required_length)
    return out


def conflicting_sequences(df: DataFrame, sequence_col: str = "sequence",
                          label_col: str = "label") -> DataFrame:
    """A1: sequences seen with more than one distinct label (one row each)."""
    g = df.groupBy(sequence_col).agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi"))
    return g.where(F.col("_lo") != F.col("_hi")).select(sequence_col)


def remove_conflicts(df: DataFrame, sequence_col: str = "sequence", label_col: str = "label") -> DataFrame:
    """Every row of a sequence that carries two different labels is removed.

    min/max per sequence uses partial aggregation (skew-safe); the anti join
    is broadcast by AQE when the conflict set is small, and split by AQE's
    skew-join handling otherwise.
    """
    bad = conflicting_sequences(df, sequence_col, label_col)
    return df.join(bad, sequence_col, "left_anti")


def dedup_first(df: DataFrame, order_cols: list[str], sequence_col: str = "sequence") -> DataFrame:
    """A2: one row per sequence, the first by ``order_cols`` (e.g. source_rank, row_order).

    ``min(struct(order..., rest...))`` per sequence is an aggregate with map-side
    partial aggregation, so a sequence repeated millions of times never lands
    in one task as raw rows.
    """
    rest = [c for c in df.columns if c not in order_cols and c != sequence_col]
    packed = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in rest])
    g = df.groupBy(sequence_col).agg(F.min(packed).alias("_first"))
    return g.select(*[F.col(f"_first.{c}").alias(c) for c in order_cols + rest],
                    F.col(sequence_col))


def resolve_sequences(df: DataFrame, order_cols: list[str], sequence_col: str = "sequence",
                      label_col: str = "label") -> DataFrame:
    """J1 + A2 fused: drop sequences with conflicting labels, keep the first row of the others.

    One aggregation on the sequence key (one shuffle, map-side partial
    aggregation) computes min/max label and the first row at once -- the
    same result as the anti join followed by dedup, with a single scan.
    """
    rest = [c for c in df.columns if c not in order_cols and c != sequence_col]
    packed = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in rest])
    g = df.groupBy(sequence_col).agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi"),
                                     F.min(packed).alias("_first"))
    g = g.where(F.col("_lo") == F.col("_hi"))
    return g.select(*[F.col(f"_first.{c}").alias(c) for c in order_cols + rest], F.col(sequence_col))


def clean_pipeline(df: DataFrame, required_length: int = 81, order_cols: list[str] | None = None,
                   sequence_col: str = "sequence", label_col: str = "label") -> DataFrame:
    """P1-P3, J1, A2 as one lazy plan: narrow cleaning, then one shuffle on the sequence key."""
    order_cols = order_cols or ["source_rank", "row_order"]
    out = clean_column(df, sequence_col)
    out = length_filter(out, required_length, sequence_col)
    return resolve_sequences(out, order_cols, sequence_col, label_col)


def tag_labeled(df: DataFrame, sequence_col: str = "sequence", id_col: str = "id",
                label_col: str = "label", order_col: str | None = None,
                strong_sheet: str = STRONG_SHEET, weak_sheet: str = WEAK_SHEET) -> DataFrame:
    """S3 for one already-labelled source: same columns as ``load_labeled`` in a single scan."""
    order_col = order_col or id_col
    lab = F.col(label_col).cast("int")
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(sequence_col).cast("string").alias("sequence"),
                     lab.alias("label"),
                     F.when(lab == 1, strong_sheet).when(lab == 0, weak_sheet).alias("source_sheet"),
                     F.when(lab == 1, 0).when(lab == 0, 1).cast("int").alias("source_rank"),
                     F.col(order_col).alias("row_order")).where(lab.isin(0, 1))


def clean_report(df: DataFrame, required_length: int = 81, sequence_col: str = "sequence",
                 label_col: str = "label") -> DataFrame:
    """Counts the reference prints at each stage, as one row (two aggregations)."""
    c = df.select(clean_dna(sequence_col).alias("s"), F.col(label_col).alias("y"))
    rows = c.agg(F.count(F.lit(1)).alias("n_input"),
                 F.count_if(F.coalesce(F.length("s"), F.lit(0)) == 0).alias("n_empty"),
                 F.count_if(F.length("s") > 0).alias("n_nonempty"),
                 F.count_if((F.length("s") > 0) & ((F.length("s") == required_length)
                                                   | F.lit(required_length <= 0))).alias("n_length_ok"))
    kept = c.where((F.length("s") > 0) & ((F.length("s") == required_length) | F.lit(required_length <= 0)))
    per_seq = kept.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"),
                                    F.max("y").alias("hi"))
    seqs = per_seq.agg(
        F.count_if(F.col("lo") != F.col("hi")).alias("n_conflict_sequences"),
        F.coalesce(F.sum(F.when(F.col("lo") != F.col("hi"), F.col("n"))), F.lit(0)).alias("n_conflict_rows"),
        F.coalesce(F.sum(F.when(F.col("lo") == F.col("hi"), F.col("n") - 1)), F.lit(0)).alias("n_duplicates"),
        F.count_if(F.col("lo") == F.col("hi")).alias("n_output"))
    # the per-sequence counts are one row: attach them as ONE struct-valued scalar subquery
    names = ("n_conflict_sequences", "n_conflict_rows", "n_duplicates", "n_output")
    sq = seqs.select(F.struct(*names).alias("s")).scalar()
    return rows.select("n_input", "n_empty", (F.col("n_nonempty") - F.col("n_length_ok")).alias("n_length_removed"),
                       *[sq[c].alias(c) for c in names])


def ensure_not_empty(df: DataFrame, what: str = "cleaned data") -> DataFrame:
    """Fail when nothing remains (one cheap ``isEmpty`` job)."""
    if df.isEmpty():
        raise ValueError(f"no rows left in {what}")
    return df


def length_report(df: DataFrame, required_length: int = 81, sequence_col: str = "sequence",
                  group_cols: list[str] | None = None) -> DataFrame:
    """P5: count rows whose length differs from ``required_length`` without removing them."""
    g = df.groupBy(*(group_cols or []))
    return g.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.length(sequence_col) != required_length).alias("n_wrong_length"))


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A3: value_counts of labels (NULL excluded), most frequent first."""
    return (df.where(F.col(label_col).isNotNull()).groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label_col))


def length_describe(df: DataFrame, col: str = "seq_len", group_cols: list[str] | None = None) -> DataFrame:
    """A4: pandas-style describe (std ddof=1, linear-interpolated quartiles).

    ``percentile`` keeps a value->count map, bounded by the number of distinct lengths.
    """
    x = F.col(col).cast("double")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*(group_cols or [])).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), q.alias("_q"), F.max(x).alias("max"))
    return g.select(*(group_cols or []), "count", "mean", "std", "min",
                    F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                    F.col("_q")[2].alias("p75"), "max")
