"""Encoder and region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import dna as D
from seqspark.functions.permute import sql_permuted
from seqspark.functions.rand import sql_random_base, sql_uniform
from seqspark.operators import regions as R
from seqspark.operators.rowindex import with_row_index
from seqspark.plans.catalog import register
from seqspark.plans.q_clean import pipeline
from seqspark.plans.q_kmers import PIPE
from seqspark.sources import driver_tables as V

# Fixed value: the reference's default classification prompt.
PROMPT = "Determine the strength of Escherichia coli promoters."
REG = R.ACTIVE_REGIONS
INFILL_SEED = 7


def sql_in_core(pos: str, regions=REG) -> str:
    return "(" + " OR ".join(f"({pos} >= {a} AND {pos} < {b})" for a, b in regions) + ")"


def sql_onehot_row(s: str, b: str) -> str:
    return f"regexp_replace(regexp_replace(upper({s}), '[^{b}]', '0', 'g'), '{b}', '1', 'g')"


@register("one_hot", V.with_views(f"""WITH {PIPE}
SELECT id, {', '.join(f"{sql_onehot_row('sequence', b)} AS onehot_{b.lower()}" for b in D.BASES)}
FROM pipeline""", "promoters"))
def q_one_hot(spark, sf):
    p = pipeline(spark, sf)
    return p.select("id", *D.matrix_to_strings(D.one_hot("sequence")))


@register("decode_roundtrip", V.with_views(f"""WITH {PIPE}
SELECT id, regexp_replace(upper(sequence), '[^ACGT]', 'A', 'g') AS decoded,
       regexp_replace(upper(sequence), '[^ACGT]', 'A', 'g') = sequence AS same FROM pipeline""", "promoters"))
def q_decode_roundtrip(spark, sf):
    p = pipeline(spark, sf).select("id", "sequence", D.one_hot("sequence").alias("m"))
    p = p.select("id", "sequence", D.decode_one_hot("m").alias("decoded"))
    return p.select("id", "decoded", (F.col("decoded") == F.col("sequence")).alias("same"))


def sql_template(s: str) -> str:
    return (f"array_to_string(list_transform(string_split({s}, ''), lambda c, i: "
            f"CASE WHEN {sql_in_core('(i - 1)')} THEN c ELSE 'M' END), '')")


@register("masked_one_hot", V.with_views(f"""
SELECT id, pos, base,
       CASE WHEN ch = 'M' THEN {sql_uniform("concat(id::VARCHAR, '#', pos::VARCHAR, '#', base)")}
            WHEN ch = base THEN 1.0 ELSE 0.0 END AS value
FROM (SELECT id, pos, substr(template, (pos + 1)::BIGINT, 1) AS ch
      FROM (SELECT id, template, unnest(range(0, length(template))) AS pos
            FROM (SELECT id, {sql_template('sequence')} AS template FROM generated))),
     (SELECT unnest(['A', 'C', 'G', 'T']) AS base)""", "generated"))
def q_masked_one_hot(spark, sf):
    g = V.generated(spark, sf, indexed=False).select("id", R.mask_template("sequence").alias("template"))
    return R.masked_one_hot_long(g)


@register("pad_truncate", V.with_views(f"""WITH {PIPE},
tok AS (SELECT id, list_transform(range(1, length(sequence) - 6 + 2), lambda i: substr(sequence, i, 6)) AS t
        FROM pipeline)
SELECT id, 'right' AS side,
       array_to_string(list_concat(t[1:128], list_transform(range(greatest(128 - len(t[1:128]), 0)), lambda x: '<pad>')), ' ') AS tokens,
       array_to_string(list_concat(list_transform(t[1:128], lambda x: '1'), list_transform(range(greatest(128 - len(t[1:128]), 0)), lambda x: '0')), '') AS mask
FROM tok
UNION ALL
SELECT id, 'left' AS side,
       array_to_string(list_concat(list_transform(range(greatest(64 - len(t[1:64]), 0)), lambda x: '<pad>'), t[1:64]), ' ') AS tokens,
       array_to_string(list_concat(list_transform(range(greatest(64 - len(t[1:64]), 0)), lambda x: '0'), list_transform(t[1:64], lambda x: '1')), '') AS mask
FROM tok""", "promoters"))
def q_pad_truncate(spark, sf):
    p = pipeline(spark, sf).select("id", D.kmers("sequence", 6).alias("t"))
    out = []
    for side, n in (("right", 128), ("left", 64)):
        toks, mask = D.pad_truncate("t", n, side=side)
        out.append(p.select("id", F.lit(side).alias("side"), F.array_join(toks, " ").alias("tokens"),
                            F.array_join(F.transform(mask, lambda v: v.cast("string")), "").alias("mask")))
    return out[0].unionByName(out[1])


@register("prompt_text", V.with_views(f"""WITH {PIPE}
SELECT id, '{PROMPT}' || ' ' || sequence AS text FROM pipeline""", "promoters"))
def q_prompt_text(spark, sf):
    return pipeline(spark, sf).select("id", D.prompt_text("sequence", PROMPT).alias("text"))


@register("core_slice", V.with_views(f"""WITH {PIPE}
SELECT id, {' || '.join(f'substr(sequence, {a + 1}, {b - a})' for a, b in REG)} AS core FROM pipeline""",
                                     "promoters"))
def q_core_slice(spark, sf):
    return pipeline(spark, sf).select("id", R.core_slice("sequence").alias("core"))


def generated_and_natural(spark, sf):
    """Random infill of the cleaned corpus, and the cleaned corpus with its positional index (order of the source rows)."""
    p = pipeline(spark, sf, materialize=True)
    natural = with_row_index(p.select("row_order", "sequence"), ["row_order"])
    return R.random_infill(p.select("id", "sequence"), seed=INFILL_SEED), natural


SQL_NATIDX = """natidx AS (SELECT row_number() OVER (ORDER BY row_order) - 1 AS row_idx, sequence FROM pipeline)"""


SQL_INFILL = f"""numbered AS (SELECT row_number() OVER (ORDER BY id) - 1 AS row_idx, count(*) OVER () AS n_rows, id, sequence
             FROM pipeline),
{sql_permuted("given", "numbered", "row_idx", "n_rows", "donor_idx", seed=INFILL_SEED)},
infill AS (
  SELECT row_idx, id, donor_id, donor,
         array_to_string(list_transform(string_split(sequence, ''), lambda c, i:
           CASE WHEN {sql_in_core('(i - 1)')} AND i - 1 < length(donor) THEN substr(donor, i, 1)
                ELSE {sql_random_base(f"concat(id, '#', (i - 1)::VARCHAR, '#', '{INFILL_SEED}')")} END), '') AS sequence
  FROM (SELECT row_idx, id, sequence, donor_idx FROM given) r
  JOIN (SELECT row_idx AS donor_idx, id AS donor_id, sequence AS donor FROM numbered) d USING (donor_idx))"""


@register("core_clamp", V.with_views(f"""WITH RECURSIVE {PIPE}, {SQL_NATIDX}, {SQL_INFILL}
SELECT g.row_idx, array_to_string(list_transform(string_split(g.sequence, ''), lambda c, i:
         CASE WHEN {sql_in_core('(i - 1)')} AND i - 1 < length(n.sequence) THEN substr(n.sequence, i, 1) ELSE c END), '')
       AS clamped
FROM infill g JOIN natidx n USING (row_idx)""", "promoters"))
def q_core_clamp(spark, sf):
    """Every natural row is paired with the generated row of its index."""
    pairs = R.pair_by_index(*generated_and_natural(spark, sf))
    return pairs.select("row_idx", R.overlay_core("gen", "nat").alias("clamped"))


@register("random_infill", V.with_views(f"""WITH RECURSIVE {PIPE}, {SQL_INFILL}
SELECT row_idx, id, donor_id, sequence FROM infill""", "promoters"))
def q_random_infill(spark, sf):
    p = pipeline(spark, sf, materialize=True).select("id", "sequence")
    return R.random_infill(p, seed=INFILL_SEED)


@register("core_retention", V.with_views(f"""WITH RECURSIVE {PIPE}, {SQL_NATIDX}, {SQL_INFILL},
p AS (SELECT g.sequence AS gen, n.sequence AS nat FROM infill g JOIN natidx n USING (row_idx)),
c AS (SELECT pos, (substr(gen, (pos + 1)::BIGINT, 1) = substr(nat, (pos + 1)::BIGINT, 1))::INTEGER AS m
      FROM (SELECT gen, nat, unnest(range(0, length(gen))) AS pos FROM p) WHERE pos < length(nat))
SELECT pos, {sql_in_core('pos')} AS in_core, count(*) AS n_pairs, sum(m)::BIGINT AS n_match,
       sum(m) / count(*) AS match_rate FROM c GROUP BY pos""", "promoters"))
def q_core_retention(spark, sf):
    pairs = R.pair_by_index(*generated_and_natural(spark, sf))
    return R.core_retention(pairs)


@register("core_kept", V.with_views(f"""WITH RECURSIVE {PIPE}, {SQL_INFILL}
SELECT count(*) AS n_pairs,
       count(*) FILTER (WHERE {' || '.join(f'substr(sequence, {a + 1}, {b - a})' for a, b in REG)}
                            = {' || '.join(f'substr(donor, {a + 1}, {b - a})' for a, b in REG)}) AS n_core_kept
FROM infill""", "promoters"))
def q_core_kept(spark, sf):
    """Random infill keeps every donor core: n_core_kept must equal n_pairs."""
    p = pipeline(spark, sf, materialize=True)
    inf = R.random_infill(p.select("id", "sequence"), seed=INFILL_SEED)
    donors = p.select(F.col("id").alias("donor_id"), F.col("sequence").alias("nat"))
    pairs = inf.join(donors, "donor_id").select(F.col("sequence").alias("gen"), "nat")
    return R.core_kept_rows(pairs)

