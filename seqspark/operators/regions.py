"""Core regions, templates, random infill, retention QA and mutation scans.

Regions are half-open, 0-based ``[start, end)`` position intervals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.dna import BASES, chars
from seqspark.functions.permute import permute
from seqspark.functions.rand import random_base, uniform
from seqspark.operators.rowindex import with_row_index

# Core regions of the 81-base promoter.
# Active in the reference's diffusion code:
ACTIVE_REGIONS = [(24, 28), (29, 32), (46, 56), (58, 61)]
# Used to make the shipped generated files (commented out in the reference code):
SHIPPED_REGIONS = [(25, 35), (48, 56), (59, 62)]
MASK = "M"

Regions = Sequence[tuple[int, int]]


def in_core(pos: Column, regions: Regions = ACTIVE_REGIONS) -> Column:
    """True when the 0-based position lies in one of the regions."""
    cond = F.lit(False)
    for s, e in regions:
        cond = cond | ((pos >= s) & (pos < e))
    return cond


def core_slice(seq, regions: Regions = ACTIVE_REGIONS) -> Column:
    """F8 on strings: the core cells concatenated in region order."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.concat(*[F.substring(s, a + 1, b - a) for a, b in regions])


def overlay_core(target, template, regions: Regions = ACTIVE_REGIONS) -> Column:
    """F8 clamp on strings: target with its core cells replaced by the template's."""
    t = F.col(target) if isinstance(target, str) else target
    m = F.col(template) if isinstance(template, str) else template
    return F.array_join(F.transform(chars(t), lambda c, i: F.when(
        in_core(i, regions) & (i < F.length(m)), F.substring(m, i + 1, F.lit(1))).otherwise(c)), "")


def mask_template(seq, regions: Regions = ACTIVE_REGIONS) -> Column:
    """Backbone template: core cells kept, every other cell becomes ``M``."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.array_join(F.transform(chars(s), lambda c, i: F.when(in_core(i, regions), c)
                                    .otherwise(F.lit(MASK))), "")


def masked_one_hot_long(df: DataFrame, id_col: str = "id", template_col: str = "template") -> DataFrame:
    """F3 in long form: (id, pos, base, value).

    ``M`` cells get four hash-uniform values, A/C/G/T cells their one-hot,
    any other letter raises (the reference's KeyError).  No upper-casing.
    """
    c = df.select(id_col, F.posexplode(chars(template_col)).alias("pos", "ch"))
    c = c.select(id_col, "pos", "ch", F.explode(F.array(*[F.lit(b) for b in BASES])).alias("base"))
    legal = F.col("ch").isin(*BASES, MASK)
    val = (F.when(~legal, F.raise_error(F.concat(F.lit("masked_one_hot: illegal base "), F.col("ch"))))
           .when(F.col("ch") == MASK, uniform(id_col, "pos", "base"))
           .otherwise((F.col("ch") == F.col("base")).cast("double")))
    return c.select(id_col, F.col("pos").cast("bigint").alias("pos"), "base", val.cast("double").alias("value"))


def random_infill(df: DataFrame, seed: int = 0, regions: Regions = ACTIVE_REGIONS,
                  id_col: str = "id", sequence_col: str = "sequence",
                  order_by: Sequence[str] | None = None) -> DataFrame:
    """Model-free generator.

    Row i (in ``order_by`` order) receives the core cells of row perm(i), perm being the keyed permutation of
    the row index; every non-core cell is an i.i.d. uniform base from md5(id, pos, seed).  One exact index,
    joined with itself on the donor's index (no broadcast of data-sized tables).  Every row gets one donor:
    rows that repeat an id are ordered by sequence, a null id hashes as ''.
    """
    order_by = list(order_by or [id_col])
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # the sequences go with the numbered rows: an id need not be unique
    cols = list(dict.fromkeys([id_col, *order_by, sequence_col]))
    rows = with_row_index(df.select(*cols), list(dict.fromkeys([*order_by, id_col, sequence_col]))).select(
        id_col, sequence_col, "row_idx")
    n = df.select(F.count(F.lit(1))).scalar()
    donors = rows.select(F.col("row_idx").alias("_at"), F.col(id_col).alias("_did"), F.col(sequence_col).alias("_donor"))
    paired = rows.withColumn("_n", n).withColumn("_at", permute("row_idx", F.col("_n"), seed)).join(donors, "_at")
    seqc = F.col(sequence_col)
    new = F.array_join(F.transform(chars(seqc), lambda c, i: F.when(
        in_core(i, regions) & (i < F.length("_donor")), F.substring("_donor", i + 1, F.lit(1)))
        .otherwise(random_base(key, i, seed))), "")
    return paired.select("row_idx", id_col, F.col("_did").alias("donor_id"), new.alias(sequence_col))


def pair_by_index(generated: DataFrame, natural: DataFrame, index_col: str = "row_idx") -> DataFrame:
    """generated[i] <-> natural[i] (equi join on the positional index)."""
    g = generated.select(index_col, F.col("sequence").alias("gen"))
    n = natural.select(index_col, F.col("sequence").alias("nat"))
    return g.join(n, index_col)


def core_retention(pairs: DataFrame, regions: Regions = ACTIVE_REGIONS) -> DataFrame:
    """Per-position match rate of gen vs nat over all pairs (positions present in both)."""
    p = pairs.select(F.posexplode(chars("gen")).alias("pos", "g"), "nat")
    p = p.where(F.col("pos") < F.length("nat"))
    p = p.withColumn("m", (F.col("g") == F.substring("nat", F.col("pos") + 1, F.lit(1))).cast("int"))
    out = p.groupBy("pos").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("m").alias("n_match"))
    return out.select(F.col("pos").cast("bigint").alias("pos"), in_core(F.col("pos"), regions).alias("in_core"),
                      "n_pairs", F.col("n_match").cast("bigint").alias("n_match"),
                      (F.col("n_match") / F.col("n_pairs")).alias("match_rate"))


def core_kept_rows(pairs: DataFrame, regions: Regions = ACTIVE_REGIONS) -> DataFrame:
    """Number of pairs whose core cells are all equal."""
    same = core_slice("gen", regions) == core_slice("nat", regions)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(same).alias("n_core_kept"))


def mutation_variants(df: DataFrame, id_col: str = "id", sequence_col: str = "sequence",
                      window: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Every single-base substitution (3 per position), plus optional ``M``-window masks.

    Output (id, pos, ref, alt, variant).  Rows grow x3L; callers aggregate or
    score them and should not cache the exploded set.
    """
    s = F.col(sequence_col)
    keep = list(keep)
    p = df.select(id_col, *keep, sequence_col, F.posexplode(chars(s)).alias("pos", "ref"))
    p = p.select(id_col, *keep, sequence_col, "pos", "ref",
                 F.explode(F.array(*[F.lit(b) for b in BASES])).alias("alt"))
    p = p.where(F.col("alt") != F.col("ref"))
    var = F.overlay(s, F.col("alt"), F.col("pos") + 1, F.lit(1))
    out = p.select(id_col, *keep, F.col("pos").cast("int").alias("pos"), "ref", "alt", var.alias("variant"))
    if window > 0:
        w = df.select(id_col, *keep, sequence_col, F.explode(F.sequence(
            F.lit(0), F.greatest(F.length(s) - window, F.lit(-1)))).alias("pos"))
        w = w.where(F.col("pos") >= 0)
        mv = F.overlay(s, F.lit(MASK * window), F.col("pos") + 1, F.lit(window))
        out = out.unionByName(w.select(id_col, *keep, F.col("pos").cast("int").alias("pos"),
                                       F.substring(s, F.col("pos") + 1, F.lit(window)).alias("ref"),
                                       F.lit(MASK * window).alias("alt"), mv.alias("variant")))
    return out


def merge_positions(pos_df: DataFrame, pos_col: str = "pos", group_cols: Sequence[str] = ()) -> DataFrame:
    """Gaps-and-islands: consecutive positions -> half-open [start, end) intervals."""
    from pyspark.sql import Window
    w = Window.partitionBy(*group_cols).orderBy(pos_col)
    g = pos_df.withColumn("_grp", F.col(pos_col) - F.row_number().over(w))
    return (g.groupBy(*group_cols, "_grp").agg(F.min(pos_col).alias("start"),
                                              (F.max(pos_col) + 1).alias("end"))
            .drop("_grp"))
