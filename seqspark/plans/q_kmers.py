"""k-mer queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqspark.operators import kmers as K
from seqspark.plans.catalog import register
from seqspark.plans.q_clean import (SQL_CLEANED, SQL_LABELED, SQL_NOCONFLICT, SQL_PIPELINE,
                                    pipeline)
from seqspark.sources import driver_tables as V

K6 = 6
PIPE = f"{SQL_LABELED}, {SQL_CLEANED}, {SQL_NOCONFLICT}, {SQL_PIPELINE}"


def sql_kmers(table: str, k: int, cols: str = "") -> str:
    """(cols..., kmer) rows for every overlapping k-mer of table.sequence."""
    sel = f"{cols}, " if cols else ""
    return (f"SELECT {sel}substr(sequence, i::BIGINT, {k}) AS kmer FROM "
            f"(SELECT {sel}sequence, unnest(range(1, length(sequence) - {k} + 2)) AS i FROM {table})")


@register("kmer_counts", V.with_views(f"""WITH {PIPE}
SELECT kmer, count(*) AS n FROM ({sql_kmers('pipeline', K6)}) GROUP BY kmer""", "promoters"))
def q_kmer_counts(spark, sf):
    return K.kmer_counts(pipeline(spark, sf), K6)


@register("kmer_freq", V.with_views(f"""WITH {PIPE},
c AS (SELECT label, kmer, count(*) AS n FROM ({sql_kmers('pipeline', K6, 'label')}) GROUP BY label, kmer)
SELECT label, kmer, n, round(n / sum(n) OVER (PARTITION BY label), 12) AS freq FROM c""", "promoters"))
def q_kmer_freq(spark, sf):
    f = K.kmer_freq(pipeline(spark, sf), K6, group_cols=["label"])
    return f.withColumn("freq", F.round("freq", 12))


LARGE_K = 15


@register("kmer_spectrum", V.with_views(f"""WITH {PIPE},
c AS (SELECT label, kmer, count(*) AS n FROM ({sql_kmers('pipeline', LARGE_K, 'label')}) GROUP BY label, kmer)
SELECT label, n, count(*) AS n_kmers, min(kmer) AS first_kmer, max(kmer) AS last_kmer,
       round(n * count(*) / any_value(t), 12) AS share
FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS t FROM c) GROUP BY label, n""", "promoters"))
def q_kmer_spectrum(spark, sf):
    """A5 + A6 for k = 15: how many 15-mers of each class occur n times, and the share of all positions they hold."""
    c = K.kmer_counts(pipeline(spark, sf, materialize=True), LARGE_K, group_cols=["label"])
    s = c.groupBy("label", "n").agg(F.count(F.lit(1)).alias("n_kmers"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"))
    s = s.withColumn("_t", F.sum(F.col("n") * F.col("n_kmers")).over(Window.partitionBy("label")))    # one row per count
    return s.select("label", "n", "n_kmers", "first_kmer", "last_kmer", F.round(F.col("n") * F.col("n_kmers") / F.col("_t"), 12).alias("share"))


SQL_CORR = f"""WITH {PIPE},
c AS (SELECT kmer, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n2
      FROM ({sql_kmers('pipeline', K6, 'label')}) GROUP BY kmer),
f AS (SELECT kmer, n1 / sum(n1) OVER () AS f1, n2 / sum(n2) OVER () AS f2 FROM c)
SELECT CASE WHEN count(*) > 1 AND min(f1) <> max(f1) AND min(f2) <> max(f2)
            THEN round(corr(f1, f2), 9) END AS r, count(*) AS n_kmers FROM f"""


def strong_weak_corr(spark, sf, k=K6):
    r = K.kmer_correlation_by(pipeline(spark, sf), "label", 1, 0, k)
    return r.select(F.round("r", 9).alias("r"), "n_kmers")


@register("kmer_corr", V.with_views(SQL_CORR, "promoters"))
def q_kmer_corr(spark, sf):
    return strong_weak_corr(spark, sf)


@register("kmer_aligned", V.with_views(f"""WITH {PIPE},
c AS (SELECT kmer, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n2
      FROM ({sql_kmers('pipeline', K6, 'label')}) GROUP BY kmer)
SELECT kmer, n1, n2, round(n1 / sum(n1) OVER (), 12) AS f1, round(n2 / sum(n2) OVER (), 12) AS f2 FROM c""",
                                       "promoters"))
def q_kmer_aligned(spark, sf):
    a = K.aligned_by_tag(pipeline(spark, sf), "label", 1, 0, K6)
    return a.select("kmer", "n1", "n2", F.round("f1", 12).alias("f1"), F.round("f2", 12).alias("f2"))


def corpora(spark, sf):
    """natural (cleaned pipeline), strong, weak, generated (benchmark), random (hashdna)."""
    # the cleaned tiles are written once: every row is in 'natural' and in its class corpus,
    # and the random corpus is keyed by the same ids (no second pass over the documents)
    clean = pipeline(spark, sf, materialize=True)
    p = clean.select(
        "sequence", F.explode(F.array(F.lit("natural"), F.when(F.col("label") == 1, "strong")
                                      .otherwise("weak"))).alias("corpus"))
    return (p.select("corpus", "sequence")
            .unionByName(V.generated(spark, sf, indexed=False).select(F.lit("generated").alias("corpus"), "sequence"))
            .unionByName(V.hashdna(spark, sf, clean.select("id")).select(F.lit("random").alias("corpus"), "sequence")))


OTHERS = ["strong", "weak", "generated", "random"]
KS = [3, 4, 6]


def _sql_corpus_compare() -> str:
    parts = []
    for k in KS:
        parts.append(f"SELECT corpus, {k} AS k, kmer FROM ({sql_kmers('corpora', k, 'corpus')})")
    ex = " UNION ALL ".join(parts)
    return f"""WITH {PIPE},
corpora AS (SELECT 'natural' AS corpus, sequence FROM pipeline
  UNION ALL SELECT 'strong', sequence FROM pipeline WHERE label = 1
  UNION ALL SELECT 'weak', sequence FROM pipeline WHERE label = 0
  UNION ALL SELECT 'generated', sequence FROM generated
  UNION ALL SELECT 'random', substr(concat(translate(md5(concat(id, '#0')), '0123456789abcdef', 'ACGTACGTACGTACGT'),
                                           translate(md5(concat(id, '#1')), '0123456789abcdef', 'ACGTACGTACGTACGT'),
                                           translate(md5(concat(id, '#2')), '0123456789abcdef', 'ACGTACGTACGTACGT')), 1, 81)
            FROM pipeline),
ex AS ({ex}),
cnt AS (SELECT corpus, k, kmer, count(*) AS n FROM ex GROUP BY ALL),
fr AS (SELECT corpus, k, kmer, n / sum(n) OVER (PARTITION BY corpus, k) AS f FROM cnt),
nat AS (SELECT k, kmer, f FROM fr WHERE corpus = 'natural'),
pairs AS (
  SELECT o.corpus, k, kmer, coalesce(n.f, 0) AS x, coalesce(o.f, 0) AS y
  FROM (SELECT * FROM fr WHERE corpus <> 'natural') o
  FULL JOIN nat n USING (k, kmer)
  WHERE o.corpus IS NOT NULL
  UNION ALL
  SELECT c.corpus, n.k, n.kmer, n.f AS x, 0.0 AS y
  FROM nat n, (SELECT DISTINCT corpus FROM fr WHERE corpus <> 'natural') c
  WHERE NOT EXISTS (SELECT 1 FROM fr o WHERE o.corpus = c.corpus AND o.k = n.k AND o.kmer = n.kmer))
SELECT corpus, k, CASE WHEN count(*) > 1 AND min(x) <> max(x) AND min(y) <> max(y)
                       THEN round(corr(x, y), 9) END AS r, count(*) AS n_kmers
FROM pairs GROUP BY corpus, k"""


@register("corpus_compare", V.with_views(_sql_corpus_compare(), "promoters", "generated"))
def q_corpus_compare(spark, sf):
    out = K.corpus_comparison(corpora(spark, sf), "natural", OTHERS, KS)
    return out.select("corpus", F.col("k").cast("int").alias("k"), F.round("r", 9).alias("r"), "n_kmers")
