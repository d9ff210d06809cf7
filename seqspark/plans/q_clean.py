"""Cleaning queries: clean_dna, filters, conflicts, dedup, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions.dna import WHITESPACE_CLASS, clean_dna
from seqspark.operators import clean as C
from seqspark.plans.catalog import register
from seqspark.session import materialize as _materialize
from seqspark.sources import driver_tables as V

L = 81


def sql_clean(x: str) -> str:
    # DuckDB keeps 'ß' as one character in upper(); Python/Java give 'SS'.
    return (f"regexp_replace(regexp_replace(upper(replace({x}, 'ß', 'ss')), '{WHITESPACE_CLASS}', '', 'g'),"
            f" '[^ACGTN]', 'N', 'g')")


def labeled(spark, sf):
    """Strong rows then weak rows, tagged in one scan of the promoter tiles."""
    return C.tag_labeled(V.promoters(spark, sf), order_col="id")


SQL_LABELED = """labeled AS (
  SELECT id::VARCHAR AS id, sequence, 1 AS label, 'Strong promoters' AS source_sheet, 0 AS source_rank, id AS row_order
  FROM promoters WHERE label = 1
  UNION ALL
  SELECT id::VARCHAR AS id, sequence, 0 AS label, 'Weak promoters' AS source_sheet, 1 AS source_rank, id AS row_order
  FROM promoters WHERE label = 0)"""

SQL_CLEANED = f"""cleaned AS (
  SELECT id, s AS sequence, label, source_sheet, source_rank, row_order, length(s)::INTEGER AS seq_len
  FROM (SELECT *, {sql_clean('sequence')} AS s FROM labeled)
  WHERE length(s) = {L})"""

SQL_NOCONFLICT = """noconflict AS (
  SELECT * FROM cleaned WHERE sequence NOT IN (
    SELECT sequence FROM cleaned GROUP BY sequence HAVING min(label) <> max(label)))"""

SQL_PIPELINE = """pipeline AS (
  SELECT id, sequence, label, source_sheet, source_rank, row_order, seq_len FROM (
    SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY source_rank, row_order) AS rn
    FROM noconflict) WHERE rn = 1)"""


def pipeline(spark, sf, materialize: bool = False):
    """Cleaned labelled tiles; ``materialize`` writes them once for multi-pass consumers."""
    p = C.clean_pipeline(labeled(spark, sf), L)
    return _materialize(p) if materialize else p


OUT_COLS = ["id", "sequence", "label", "source_sheet", "source_rank", "row_order", "seq_len"]


@register("clean_dna", V.with_views(f"""
SELECT id, s AS sequence, length(s)::BIGINT AS seq_len
FROM (SELECT id, {sql_clean('sequence')} AS s FROM promoters_raw) WHERE length(s) > 0""", "promoters_raw"))
def q_clean_dna(spark, sf):
    d = C.clean_column(V.promoters_raw(spark, sf))
    return d.select("id", "sequence", F.length("sequence").cast("bigint").alias("seq_len"))


@register("load_labeled_union", V.with_views(f"""WITH {SQL_LABELED}
SELECT * FROM labeled""", "promoters"))
def q_load_labeled_union(spark, sf):
    """S3 + U1 with two sources (strong / weak sheets) stacked by unionByName."""
    p = V.promoters(spark, sf)
    return C.load_labeled(p.where("label = 1"), p.where("label = 0"), order_col="id")


@register("length_filter", V.with_views(f"""WITH {SQL_LABELED}, {SQL_CLEANED}
SELECT id, sequence, label, seq_len FROM cleaned""", "promoters"))
def q_length_filter(spark, sf):
    d = C.length_filter(C.clean_column(labeled(spark, sf)), L)
    return d.select("id", "sequence", "label", "seq_len")


@register("length_report", V.with_views(f"""
SELECT label, count(*) AS n_rows, count(*) FILTER (WHERE length(sequence) <> {L}) AS n_wrong_length
FROM promoters GROUP BY label""", "promoters"))
def q_length_report(spark, sf):
    return C.length_report(V.promoters(spark, sf), L, group_cols=["label"])


@register("length_describe", f"""
SELECT lang, count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min,
       quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75,
       max(n) AS max
FROM (SELECT lang, length({sql_clean('text')})::DOUBLE AS n FROM documents
      WHERE length({sql_clean('text')}) > 0) GROUP BY lang""")
def q_length_describe(spark, sf):
    d = V.table(spark, sf, "documents").select("lang", clean_dna("text").alias("s"))
    d = d.where(F.length("s") > 0).withColumn("n", F.length("s"))
    out = C.length_describe(d, "n", ["lang"])
    return out.select("lang", "count", *[F.round(c, 6).alias(c) if c in ("mean", "std") else F.col(c)
                                         for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@register("conflict_removal", V.with_views(f"""WITH {SQL_LABELED}, {SQL_CLEANED}, {SQL_NOCONFLICT}
SELECT * FROM noconflict""", "promoters"))
def q_conflict_removal(spark, sf):
    d = _materialize(C.length_filter(C.clean_column(labeled(spark, sf)), L))     # both join sides read the cleaned rows
    return C.remove_conflicts(d).select(*OUT_COLS)


# Query parameter: line ends and blanks appended to the tiles in turn.
LINE_ENDS = ["", "\n", "\r\n", "\r", "\u2028", " \t"]


@register("clean_line_ends", V.with_views(f"""WITH {SQL_LABELED}, {SQL_CLEANED}, {SQL_NOCONFLICT}, {SQL_PIPELINE}
SELECT id, sequence, label FROM pipeline""", "promoters"))
def q_clean_line_ends(spark, sf):
    """A sheet whose cells end in any line end or blank cleans to the same rows as one without."""
    ends = F.array(*[F.lit(e) for e in LINE_ENDS])
    tail = F.element_at(ends, (F.pmod(F.xxhash64("id"), F.lit(len(LINE_ENDS))) + 1).cast("int"))
    return C.clean_pipeline(labeled(spark, sf).withColumn("sequence", F.concat("sequence", tail)), L).select(
        "id", "sequence", "label")


@register("conflict_sequences", V.with_views(f"""WITH {SQL_LABELED}, {SQL_CLEANED}
SELECT sequence FROM cleaned GROUP BY sequence HAVING count(DISTINCT label) > 1""", "promoters"))
def q_conflict_sequences(spark, sf):
    d = C.length_filter(C.clean_column(labeled(spark, sf)), L)
    return C.conflicting_sequences(d)


@register("dedup_first", V.with_views(f"""WITH {SQL_LABELED}, {SQL_CLEANED}
SELECT id, sequence, label, source_sheet, source_rank, row_order, seq_len FROM (
  SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY source_rank, row_order) AS rn FROM cleaned)
WHERE rn = 1""", "promoters"))
def q_dedup_first(spark, sf):
    d = C.length_filter(C.clean_column(labeled(spark, sf)), L)
    return C.dedup_first(d, ["source_rank", "row_order"]).select(*OUT_COLS)


@register("clean_pipeline", V.with_views(f"""WITH {SQL_LABELED}, {SQL_CLEANED}, {SQL_NOCONFLICT}, {SQL_PIPELINE}
SELECT * FROM pipeline""", "promoters"))
def q_clean_pipeline(spark, sf):
    return pipeline(spark, sf).select(*OUT_COLS)


@register("label_counts", V.with_views(f"""WITH {SQL_LABELED}, {SQL_CLEANED}, {SQL_NOCONFLICT}, {SQL_PIPELINE}
SELECT label, count(*) AS n FROM pipeline WHERE label IS NOT NULL GROUP BY label""", "promoters"))
def q_label_counts(spark, sf):
    return C.label_counts(pipeline(spark, sf))


@register("clean_report", V.with_views(f"""WITH {SQL_LABELED},
c AS (SELECT {sql_clean('sequence')} AS s, label AS y FROM labeled),
k AS (SELECT s, count(*) AS n, min(y) AS lo, max(y) AS hi FROM c WHERE length(s) = {L} GROUP BY s)
SELECT (SELECT count(*) FROM c) AS n_input,
       (SELECT count(*) FROM c WHERE coalesce(length(s), 0) = 0) AS n_empty,
       (SELECT count(*) FROM c WHERE length(s) > 0 AND length(s) <> {L}) AS n_length_removed,
       (SELECT count(*) FROM k WHERE lo <> hi) AS n_conflict_sequences,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM k WHERE lo <> hi) AS n_conflict_rows,
       (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM k WHERE lo = hi) AS n_duplicates,
       (SELECT count(*) FROM k WHERE lo = hi) AS n_output""", "promoters"))
def q_clean_report(spark, sf):
    return C.clean_report(labeled(spark, sf), L)


@register("recode_tiles", V.with_views("""
SELECT id, doc_id, tile, sequence, label, length(sequence)::BIGINT AS n FROM promoters""", "promoters"))
def q_recode_tiles(spark, sf):
    return V.promoters(spark, sf).withColumn("n", F.length("sequence").cast("bigint"))

