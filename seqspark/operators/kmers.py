"""k-mer counting, frequencies and corpus correlation.

Counting explodes each sequence into its L-k+1 k-mers and aggregates; the
partial (map-side) aggregation collapses each task's rows to at most 5^k
keys before the shuffle, so the shuffle volume is bounded by
``#tasks x 5^k`` regardless of the corpus size or of hot k-mers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions.dna import kmers
from seqspark.operators.kernels import kmer_sums
from seqspark.operators.superkmers import kmer_counts_by_minimizer
from seqspark.session import materialize

COMBINE_K = 11                  # 5^11 possible k-mers: beyond, a task's k-mers are mostly distinct


def kmer_counts(df: DataFrame, k: int, sequence_col: str = "sequence",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """A5: (group..., kmer, n) over all overlapping k-mers.

    Up to ``COMBINE_K`` map-side combining keeps the shuffle small; above, super-k-mers are shuffled instead.
    """
    if k > COMBINE_K:
        return kmer_counts_by_minimizer(df, k, sequence_col, group_cols)
    ex = df.select(*group_cols, F.explode(kmers(sequence_col, k)).alias("kmer"))
    return ex.groupBy(*group_cols, "kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_freq(df: DataFrame, k: int, sequence_col: str = "sequence",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., kmer, n, freq = n / sum n); an empty corpus gives no rows."""
    c = kmer_counts(df, k, sequence_col, group_cols)
    if not group_cols:
        return c.withColumn("freq", F.try_divide(F.col("n"), c.agg(F.sum("n")).scalar()))
    tot = c.groupBy(*group_cols).agg(F.sum("n").alias("_tot"))
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group_cols]
    return c.alias("c").join(tot.alias("t"), reduce(lambda a, b: a & b, same)).select(
        "c.*", F.try_divide(F.col("n"), F.col("_tot")).alias("freq"))


def pearson(df: DataFrame, x: str, y: str, group_cols: Sequence[str] = (), name: str = "r") -> DataFrame:
    """Two-pass Pearson r per group; NULL when undefined (n < 2 or a constant vector).

    The group means are aggregated and joined back (scalars without groups), so that no group's rows meet in
    one task.
    """
    if group_cols:
        means = df.groupBy(*group_cols).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
        same = [F.col(f"d.{g}").eqNullSafe(F.col(f"m.{g}")) for g in group_cols]
        c = df.alias("d").join(means.alias("m"), reduce(lambda a, b: a & b, same)).select(
            *[F.col(f"d.{g}").alias(g) for g in group_cols], (F.col(x) - F.col("_mx")).alias("_dx"), (F.col(y) - F.col("_my")).alias("_dy"))
    else:
        mx, my = df.agg(F.avg(x)).scalar(), df.agg(F.avg(y)).scalar()
        c = df.select((F.col(x) - mx).alias("_dx"), (F.col(y) - my).alias("_dy"))
    g = c.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_kmers"),
                                   F.sum(F.col("_dx") * F.col("_dy")).alias("_sxy"),
                                   F.sum(F.col("_dx") * F.col("_dx")).alias("_sxx"),
                                   F.sum(F.col("_dy") * F.col("_dy")).alias("_syy"))
    ok = (F.col("n_kmers") > 1) & (F.col("_sxx") > 0) & (F.col("_syy") > 0)
    r = F.when(ok, F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy"))))
    return g.select(*group_cols, r.alias(name), "n_kmers")


def aligned_kmer_freqs(a: DataFrame, b: DataFrame, k: int, sequence_col: str = "sequence") -> DataFrame:
    """J2 + U2: (kmer, n1, n2, f1, f2) over the union of observed k-mers, missing -> 0.

    Single shuffle: both corpora are tagged, unioned and aggregated once.
    """
    tagged = (a.select(F.lit(1).alias("_src"), sequence_col)
              .unionByName(b.select(F.lit(2).alias("_src"), sequence_col)))
    return aligned_by_tag(tagged, "_src", 1, 2, k, sequence_col)


def aligned_by_tag(df: DataFrame, tag_col: str, tag_a, tag_b, k: int, sequence_col: str = "sequence") -> DataFrame:
    """J2 for two corpora stored in one table (rows tagged ``tag_a`` / ``tag_b``): one scan, one shuffle."""
    ex = df.where(F.col(tag_col).isin(tag_a, tag_b)).select(
        tag_col, F.explode(kmers(sequence_col, k)).alias("kmer"))
    c = ex.groupBy("kmer").agg(F.count_if(F.col(tag_col) == tag_a).alias("n1"),
                               F.count_if(F.col(tag_col) == tag_b).alias("n2"))
    return c.select("kmer", "n1", "n2", F.try_divide(F.col("n1"), c.agg(F.sum("n1")).scalar()).alias("f1"),
                    F.try_divide(F.col("n2"), c.agg(F.sum("n2")).scalar()).alias("f2"))


def kmer_correlation(a: DataFrame, b: DataFrame, k: int = 6, sequence_col: str = "sequence",
                     with_vectors: bool = False) -> DataFrame:
    """Pearson r of the two k-mer frequency vectors (one row; ``with_vectors`` adds them)."""
    return correlation_of(aligned_kmer_freqs(a, b, k, sequence_col), with_vectors)


def kmer_correlation_by(df: DataFrame, tag_col: str, tag_a, tag_b, k: int = 6,
                        sequence_col: str = "sequence", with_vectors: bool = False) -> DataFrame:
    """A7 for two corpora tagged inside one table (single scan of the source)."""
    return correlation_of(aligned_by_tag(df, tag_col, tag_a, tag_b, k, sequence_col), with_vectors)


def correlation_of(al: DataFrame, with_vectors: bool = False) -> DataFrame:
    r = pearson(al, "f1", "f2")
    if with_vectors:   # r as a scalar subquery next to every aligned row
        return al.withColumn("r", r.select("r").scalar())
    return r


def corpus_comparison(corpora: DataFrame, reference: str, others: Sequence[str],
                      ks: Iterable[int] = (3, 4, 6), corpus_col: str = "corpus",
                      sequence_col: str = "sequence") -> DataFrame:
    """r(k) of every corpus in ``others`` against ``reference``, for several k, in one job.

    ``corpora`` is a long table (corpus, sequence).  Each task counts its
    k-mers as numbers (see ``kmer_sums``), one aggregation over (k, kmer) adds them
    up per corpus (single shuffle, at most 5^k rows per k afterwards, written once); then each pair is restricted to the union of
    its two observed k-mer sets (missing -> 0) and correlated.
    """
    ks, names = list(ks), [reference, *others]
    counted = kmer_sums(corpora.where(F.col(corpus_col).isin(names)), ks, corpus_col, sequence_col)
    counts = counted.groupBy("k", "kmer").agg(*[F.sum(F.when(F.col(corpus_col) == n, F.col("n")).otherwise(F.lit(0))).alias(f"_n{i}")
                                               for i, n in enumerate(names)])
    counts = materialize(counts)   # <= 5^k rows per k; read for the totals, the means and the sums
    totals = counts.groupBy(F.col("k").alias("_k")).agg(*[F.sum(f"_n{i}").alias(f"_t{i}") for i in range(len(names))])
    freqs = counts.join(totals, F.col("k") == F.col("_k")).select(
        "k", *[F.col(f"_n{i}") for i in range(len(names))],
        *[F.try_divide(F.col(f"_n{i}"), F.col(f"_t{i}")).alias(f"_f{i}") for i in range(len(names))])
    pairs = freqs.select("k", F.explode(F.array(*[
        F.struct(F.lit(n).alias(corpus_col), F.col("_f0").alias("x"), F.col(f"_f{i}").alias("y"),
                 ((F.col("_n0") > 0) | (F.col(f"_n{i}") > 0)).alias("_in"))
        for i, n in enumerate(names) if i > 0])).alias("p"))
    pairs = pairs.where("p._in").select(F.col(f"p.{corpus_col}").alias(corpus_col), "k", "p.x", "p.y")
    return pearson(pairs, "x", "y", [corpus_col, "k"])
