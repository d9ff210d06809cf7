"""Queries of the reverse chain, the checkpoint comparison and the fitted denoiser."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqspark.operators import diffusion as D
from seqspark.operators import kmers as K
from seqspark.operators import reverse as R
from seqspark.plans.catalog import register
from seqspark.plans.q_clean import pipeline
from seqspark.plans.q_diffusion import SQL_CELLS, SQL_LIN, SQL_TS, lin
from seqspark.plans.q_encode import REG, sql_in_core
from seqspark.plans.q_kmers import PIPE, sql_kmers
from seqspark.session import materialize
from seqspark.sources import driver_tables as V

STEPS = 20                                  # steps of the chains here; the cosine schedule is defined for every T
EPOCHS = list(range(50, 500, 50))           # fixed values: the checkpoints that generation visits
START, RATE = 0.25, 0.01                    # share of a letter before training, step of one epoch
BUCKETS = 10
RIDGE = 1.0


def cosine(spark, T=STEPS):
    return D.schedule_table(D.cosine_betas(spark, T))


def _sql_steps(T: int) -> str:
    """steps(t, the five coefficients, a, b): x' = a x + b mean + sigma z."""
    def f(x):
        return f"pow(cos(({x} / {float(T)!r}::DOUBLE + {D.COSINE_S!r}::DOUBLE) / {1.0 + D.COSINE_S!r}::DOUBLE * {math.pi / 2!r}::DOUBLE), 2)"
    return f"""steps AS (
  SELECT t, sqrt(beta) AS sigma, beta / sqrt(1 - alpha_bar) AS noise, sqrt(1 / alpha) AS scale, sqrt(alpha_bar) AS sab, sqrt(1 - alpha_bar) AS s1m
  FROM (SELECT t, beta, 1 - beta AS alpha, product(1 - beta) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alpha_bar
        FROM (SELECT t, least(1.0 - ({f('(t::DOUBLE + 1)')} / {f('0.0::DOUBLE')}) / ({f('t::DOUBLE')} / {f('0.0::DOUBLE')}),
                              {D.COSINE_MAX_BETA!r}::DOUBLE) AS beta FROM range(0, {T}) r(t))))"""


SQL_CHAIN = f"""{_sql_steps(STEPS)}, {SQL_CELLS},
means AS (SELECT pos, avg(x) AS m FROM cells GROUP BY pos),
start AS (SELECT * FROM {R.sql_counter_normal(f"(SELECT c.vec_id, c.pos, c.x AS template, m, {R.sql_chain_key('vec_id::VARCHAR')} AS k FROM cells c JOIN means USING (pos))", 'k', str(STEPS), 'pos', 'z')}),
chain AS (
  SELECT vec_id, pos, template, m, k, {STEPS}::BIGINT AS t, CASE WHEN {sql_in_core('pos')} THEN template ELSE z END AS x FROM start
  UNION ALL
  SELECT vec_id, pos, template, m, k, t, (x - noise * ((x - sab * m) / s1m)) * scale + CASE WHEN t > 0 THEN sigma * z ELSE 0 END
  FROM {R.sql_counter_normal("(SELECT c.vec_id, c.pos, c.template, c.m, c.k, c.x, s.* FROM chain c JOIN steps s ON s.t = c.t - 1)", 'k', 't', 'pos', 'z')})"""


@register("reverse_chain", V.with_views(f"""WITH RECURSIVE {SQL_CHAIN}
SELECT vec_id, pos, round(x, 9) AS x_0, CASE WHEN {sql_in_core('pos')} THEN round(abs(x - template), 9) END AS core_drift
FROM chain WHERE t = 0""", "matrix"))
def q_reverse_chain(spark, sf):
    """All reverse steps from every vector's core with the cell means as x0; the core drifts, as it is not clamped again."""
    m = V.matrix(spark, sf)
    model = R.cell_means(m).select(F.lit(0).cast("long").alias("model"), "mean")
    out = R.reverse_chain(m, cosine(spark), model, key="vec_id").join(m, "vec_id")
    cells = out.select("vec_id", F.posexplode(F.arrays_zip("x_0", "x")).alias("pos", "c"))
    drift = F.when(D.in_core(F.col("pos"), REG), F.round(F.abs(F.col("c.x_0") - F.col("c.x")), 9))
    return cells.select("vec_id", F.col("pos").cast("int").alias("pos"), F.round("c.x_0", 9).alias("x_0"), drift.alias("core_drift"))


def checkpoints(spark, sf):
    """(natural corpus, generated rows of all checkpoints), both written."""
    p = materialize(pipeline(spark, sf).select("id", "sequence"))
    models = R.mean_checkpoints(R.base_means(p), EPOCHS, START, RATE)
    return p, materialize(R.generate_sequences(p, cosine(spark, SAMPLE_STEPS), models))


SAMPLE_STEPS = 10


def _sql_samples() -> str:
    """drawn(id, pos, sequence, e<epoch>): letters of every checkpoint's chain, the steps unrolled as nested selects."""
    q = f"""(SELECT h.*, {", ".join(f"m{i}" for i in range(4))} FROM
      (SELECT id, sequence, pos, {R.sql_chain_key('id')} AS k FROM (SELECT id, sequence, unnest(range(0, length(sequence))) AS pos FROM pipeline)) h
      JOIN means USING (pos))"""
    for i in range(4):
        q = R.sql_counter_normal(q, "k", str(SAMPLE_STEPS), f"(pos * 4 + {i})", f"z{i}")
    start = ", ".join(f"CASE WHEN {sql_in_core('pos')} THEN (substr(sequence, pos + 1, 1) = '{b}')::INTEGER ELSE z{i} END AS x{i}"
                      for i, b in enumerate("ACGT"))
    q = f"(SELECT * EXCLUDE (z0, z1, z2, z3), {start} FROM {q})"
    q = f"(SELECT * EXCLUDE (x0, x1, x2, x3), {', '.join(f'x{i} AS x{e}_{i}' for e in EPOCHS for i in range(4))} FROM {q})"
    for t in range(SAMPLE_STEPS - 1, -1, -1):
        for i in range(4):
            q = R.sql_counter_normal(q, "k", str(t), f"(pos * 4 + {i})", f"z{i}")
        c = {n: f"(SELECT {n} FROM steps WHERE t = {t})" for n in ("sigma", "noise", "scale", "sab", "s1m")}
        q = f"(SELECT q.*, {', '.join(f'{v} AS {n}_' for n, v in c.items())} FROM {q} q)"
        share = lambda e, i: f"({START} + (m{i} - {START}) * (1 - pow(1 - {RATE}, {e})))"
        w = ", ".join(f"{share(e, i)} * exp(sab_ / (s1m_ * s1m_) * (x{e}_{i} - greatest(x{e}_0, x{e}_1, x{e}_2, x{e}_3))) AS w{e}_{i}"
                      for e in EPOCHS for i in range(4))
        x = ", ".join(f"(x{e}_{i} - noise_ * ((x{e}_{i} - sab_ * (w{e}_{i} / (w{e}_0 + w{e}_1 + w{e}_2 + w{e}_3))) / s1m_)) * scale_"
                      + (f" + sigma_ * z{i}" if t else "") + f" AS x{e}_{i}" for e in EPOCHS for i in range(4))
        q = f"(SELECT id, sequence, pos, k, m0, m1, m2, m3, {x} FROM (SELECT *, {w} FROM {q}))"

    def letter(e):
        best = lambda i: " AND ".join(f"x{e}_{i} {'>=' if j > i else '>'} x{e}_{j}" for j in range(4) if j != i)
        return "CASE " + " ".join(f"WHEN {best(i)} THEN '{b}'" for i, b in enumerate("ACG")) + " ELSE 'T' END"
    return f"drawn AS (SELECT id, pos, sequence, {', '.join(f'{letter(e)} AS e{e}' for e in EPOCHS)} FROM {q})"


SQL_CHECKPOINTS = f"""{_sql_steps(SAMPLE_STEPS)},
means AS (SELECT pos, {", ".join(f"avg((substr(sequence, pos + 1, 1) = '{b}')::INTEGER::DOUBLE) AS m{i}" for i, b in enumerate("ACGT"))}
          FROM (SELECT sequence, unnest(range(0, length(sequence))) AS pos FROM pipeline) GROUP BY pos),
{_sql_samples()},
made AS ({" UNION ALL ".join(f"SELECT id, pos, sequence, {e} AS epoch, e{e} AS letter FROM drawn" for e in EPOCHS)}),
gen AS (SELECT id, epoch, string_agg(letter, '' ORDER BY pos) AS sequence FROM made GROUP BY id, epoch)"""


@register("checkpoint_compare", V.with_views(f"""WITH {PIPE}, {SQL_CHECKPOINTS},
nat AS (SELECT kmer, count(*) AS n FROM ({sql_kmers('pipeline', 6)}) GROUP BY kmer),
km AS (SELECT epoch, kmer, count(*) AS n FROM ({sql_kmers('gen', 6, 'epoch')}) GROUP BY epoch, kmer),
al AS (
  SELECT epoch, kmer, coalesce(n.n, 0) AS x, coalesce(k.n, 0) AS y
  FROM (SELECT epoch, kmer FROM km UNION SELECT e.epoch, n.kmer FROM nat n, (SELECT unnest({EPOCHS}) AS epoch) e)
  LEFT JOIN nat n USING (kmer) LEFT JOIN km k USING (epoch, kmer)),
r AS (SELECT epoch, CASE WHEN count(*) > 1 AND min(x) <> max(x) AND min(y) <> max(y) THEN round(corr(x, y), 9) END AS r, count(*) AS n_kmers
      FROM al GROUP BY epoch),
c AS (SELECT epoch, count(DISTINCT id) AS n_generated, count(*) FILTER (WHERE letter <> substr(sequence, pos + 1, 1) AND {sql_in_core('pos')}) AS core_changed
      FROM made GROUP BY epoch)
SELECT epoch::INTEGER AS epoch, n_generated, core_changed::BIGINT AS core_changed, r, n_kmers FROM c JOIN r USING (epoch)""", "promoters"))
def q_checkpoint_compare(spark, sf):
    """L2 per checkpoint 50, 100, .. 450: sample by the chain, decode, core drift in letters, 6-mer r against the natural corpus."""
    p, made = checkpoints(spark, sf)
    name = F.format_string("epoch-%d", F.col("model"))
    both = p.select(F.lit("natural").alias("corpus"), "sequence").unionByName(made.select(name.alias("corpus"), "sequence"))
    r = K.corpus_comparison(both, "natural", [f"epoch-{e}" for e in EPOCHS], [6])
    counted = made.groupBy("model").agg(F.count(F.lit(1)).alias("n_generated"), F.sum("core_changed").alias("core_changed"))
    return counted.withColumn("corpus", name).join(r, "corpus").select(
        F.col("model").cast("int").alias("epoch"), "n_generated", "core_changed", F.round("r", 9).alias("r"), "n_kmers")


SQL_NOISED = f"""{SQL_LIN}, {SQL_TS}, {SQL_CELLS},
noised AS (
  SELECT vec_id, pos, bucket, x, sab, s1m, CASE WHEN {sql_in_core('pos')} THEN 0 ELSE z END AS eps,
         CASE WHEN {sql_in_core('pos')} THEN x ELSE sab * x + s1m * z END AS xt
  FROM {R.sql_counter_normal(f"(SELECT c.*, t * {BUCKETS} // {D.T_STEPS} AS bucket, sqrt_alpha_bar AS sab, sqrt_one_minus_alpha_bar AS s1m, {R.sql_chain_key('vec_id::VARCHAR')} AS k FROM cells c JOIN ts USING (vec_id) JOIN lin USING (t))", 'k', '0', 'pos', 'z')})"""


def noised(spark, sf):
    return R.noised_rows(V.matrix(spark, sf), lin(spark), D.T_STEPS, key="vec_id")


@register("denoiser_gram", V.with_views(f"""WITH {SQL_NOISED},
z AS (SELECT vec_id, bucket, pos AS i, xt AS v FROM noised
      UNION ALL SELECT vec_id, any_value(bucket), count(*), 1.0 FROM noised GROUP BY vec_id),
w AS (SELECT max(i) AS w FROM z),
b AS (SELECT * FROM z UNION ALL SELECT vec_id, bucket, pos + 1 + w, eps FROM noised, w)
SELECT z.bucket::INTEGER AS bucket, z.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(z.v * b.v), 6) AS v
FROM z JOIN b USING (vec_id) GROUP BY ALL""", "matrix"))
def q_denoiser_gram(spark, sf):
    """The normal equations of the fitted denoiser: Gram matrix and right side per timestep bucket."""
    g = R.gram_blocks(noised(spark, sf), D.T_STEPS, BUCKETS)
    return g.select("bucket", "i", "j", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@register("denoiser_loss", V.with_views(f"""WITH {SQL_NOISED},
m AS (SELECT pos, avg(x) AS m FROM cells GROUP BY pos)
SELECT bucket::INTEGER AS bucket, count(DISTINCT vec_id) AS n_rows, round(avg(pow((xt - sab * m) / s1m - eps, 2)), 6) AS l2_mean,
       true AS solves_normal_equations, true AS below_mean
FROM noised JOIN m USING (pos) GROUP BY bucket""", "matrix"))
def q_denoiser_loss(spark, sf):
    """A12 with a fitted predictor: one least-squares denoiser per timestep bucket against the cell means."""
    rows = materialize(noised(spark, sf))
    solved = materialize(R.solve_denoiser(R.gram_blocks(rows, D.T_STEPS, BUCKETS), RIDGE))
    loss = R.denoiser_losses(rows, solved, R.cell_means(V.matrix(spark, sf)), D.T_STEPS, BUCKETS)
    return loss.join(solved.select("bucket", "residual"), "bucket").select(
        "bucket", "n_rows", F.round("l2_mean", 6).alias("l2_mean"), (F.col("residual") < 1e-9).alias("solves_normal_equations"),
        (F.col("l2") < F.col("l2_mean")).alias("below_mean"))
