"""Diffusion queries over the embeddings matrix.

Each embedding vector is one data matrix row ``x`` (64 cells); the core
regions are positions of that vector.  Schedules are gathered per row (the
row's random timestep), so every query reads the table.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqspark.functions.rand import sql_normal, sql_uniform
from seqspark.operators import diffusion as D
from seqspark.plans.catalog import register
from seqspark.plans.q_encode import sql_in_core
from seqspark.sources import driver_tables as V

T = D.T_STEPS
COEFS = ["beta", "alpha", "alpha_bar", "sqrt_alpha_bar", "sqrt_one_minus_alpha_bar",
         "reciprocal_sqrt_alpha", "remove_noise_coeff", "sigma"]


def _lin_sql() -> str:
    lo, hi = D.LINEAR_LOW * 1000.0 / T, D.LINEAR_HIGH * 1000.0 / T
    step = (hi - lo) / (T - 1)
    return (f"SELECT t::INTEGER AS t, CASE WHEN t = {T - 1} THEN {hi!r}::DOUBLE "
            f"ELSE {lo!r}::DOUBLE + t::DOUBLE * {step!r}::DOUBLE END AS beta FROM range(0, {T}) r(t)")


def _cos_sql() -> str:
    s = D.COSINE_S

    def f(x):
        return (f"pow(cos(({x} / {float(T)!r}::DOUBLE + {s!r}::DOUBLE) / {1.0 + s!r}::DOUBLE"
                f" * {math.pi / 2!r}::DOUBLE), 2)")
    return (f"SELECT t::INTEGER AS t, least(1.0 - ({f('(t::DOUBLE + 1)')} / {f('0.0::DOUBLE')}) / "
            f"({f('t::DOUBLE')} / {f('0.0::DOUBLE')}), {D.COSINE_MAX_BETA!r}::DOUBLE) AS beta FROM range(0, {T}) r(t)")


def _sched_sql(name: str, betas: str) -> str:
    return f"""{name} AS (
  SELECT t, beta, alpha, alpha_bar, sqrt(alpha_bar) AS sqrt_alpha_bar, sqrt(1.0 - alpha_bar) AS sqrt_one_minus_alpha_bar,
         sqrt(1.0 / alpha) AS reciprocal_sqrt_alpha, beta / sqrt(1.0 - alpha_bar) AS remove_noise_coeff, sqrt(beta) AS sigma
  FROM (SELECT t, beta, 1.0 - beta AS alpha,
               product(1.0 - beta) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alpha_bar
        FROM ({betas})))"""


SQL_LIN = _sched_sql("lin", _lin_sql())
SQL_COS = _sched_sql("cosi", _cos_sql())
SQL_TS = f"""ts AS (SELECT vec_id, floor({sql_uniform("concat(vec_id::VARCHAR, '#', 't')")} * {T})::INTEGER AS t
                FROM matrix)"""
SQL_CELLS = """cells AS (SELECT vec_id, (pos - 1)::INTEGER AS pos, x[pos] AS x
                   FROM (SELECT vec_id, x, unnest(range(1, len(x) + 1)) AS pos FROM matrix))"""
SQL_NOISE = f"""{SQL_LIN}, {SQL_TS}, {SQL_CELLS},
fwd AS (SELECT c.vec_id, c.pos, ts.t, c.x,
               CASE WHEN {sql_in_core('c.pos')} THEN 0.0
                    ELSE {sql_normal("concat(c.vec_id::VARCHAR, '#', c.pos::VARCHAR, '#', 'eps')")} END AS eps,
               lin.sqrt_alpha_bar, lin.sqrt_one_minus_alpha_bar
        FROM cells c JOIN ts USING (vec_id) JOIN lin ON lin.t = ts.t),
fwd2 AS (SELECT *, CASE WHEN {sql_in_core('pos')} THEN x ELSE sqrt_alpha_bar * x + sqrt_one_minus_alpha_bar * eps END
                   AS x_t FROM fwd),
x0 AS (SELECT pos, avg(x) AS x0_hat FROM cells GROUP BY pos),
pred AS (SELECT f.*, (x_t - sqrt_alpha_bar * x0_hat) / sqrt_one_minus_alpha_bar AS eps_hat
         FROM fwd2 f JOIN x0 USING (pos))"""


def _r(c, d=9):
    return F.round(c, d).alias(c)


def cells(spark, sf):
    return D.to_long(V.matrix(spark, sf), "vec_id", "x")


def lin(spark):
    return D.schedule_table(D.linear_betas(spark))


def noised(spark, sf):
    return D.forward_noise(cells(spark, sf), lin(spark), key="vec_id")


def predicted(spark, sf):
    c = cells(spark, sf)
    f = D.forward_noise(c, lin(spark), key="vec_id")
    f = D.gather(f, lin(spark).select("t", "sqrt_alpha_bar", "sqrt_one_minus_alpha_bar"))
    # one row per position: bounded by the matrix width, so broadcast (a join on the
    # 64-valued pos key would otherwise shuffle every cell into 64 hot partitions)
    f = f.join(F.broadcast(D.mean_predictor(c)), "pos")
    return f.withColumn("eps_hat", D.eps_from_x0())


@register("random_timestep", V.with_views(f"WITH {SQL_TS} SELECT * FROM ts", "matrix"))
def q_random_timestep(spark, sf):
    return V.matrix(spark, sf).select("vec_id", D.random_timestep("vec_id").alias("t"))


def _gathered(spark, sf, sched):
    ts = V.matrix(spark, sf).select("vec_id", D.random_timestep("vec_id").alias("t"))
    g = D.gather(ts, sched)
    return g.select("vec_id", "t", *[_r(c, 9) for c in COEFS])


_GATHER_SQL = "SELECT vec_id, t, " + ", ".join(f"round({c}, 9) AS {c}" for c in COEFS)


@register("linear_schedule", V.with_views(f"WITH {SQL_LIN}, {SQL_TS} {_GATHER_SQL} FROM ts JOIN lin USING (t)",
                                          "matrix"))
def q_linear_schedule(spark, sf):
    return _gathered(spark, sf, lin(spark))


@register("cosine_schedule", V.with_views(f"WITH {SQL_COS}, {SQL_TS} {_GATHER_SQL} FROM ts JOIN cosi USING (t)",
                                          "matrix"))
def q_cosine_schedule(spark, sf):
    return _gathered(spark, sf, D.schedule_table(D.cosine_betas(spark)))


@register("alpha_bar", V.with_views(f"""WITH {SQL_LIN}, {SQL_COS}, {SQL_TS}
SELECT t, count(*) AS n_rows, round(any_value(lin.alpha_bar), 9) AS alpha_bar_linear,
       round(any_value(cosi.alpha_bar), 9) AS alpha_bar_cosine
FROM ts JOIN lin USING (t) JOIN cosi USING (t) GROUP BY t""", "matrix"))
def q_alpha_bar(spark, sf):
    ts = V.matrix(spark, sf).select("vec_id", D.random_timestep("vec_id").alias("t"))
    used = ts.groupBy("t").agg(F.count(F.lit(1)).alias("n_rows"))
    la = lin(spark).select("t", F.round("alpha_bar", 9).alias("alpha_bar_linear"))
    ca = D.schedule_table(D.cosine_betas(spark)).select("t", F.round("alpha_bar", 9).alias("alpha_bar_cosine"))
    return used.join(F.broadcast(la), "t").join(F.broadcast(ca), "t")


@register("forward_noise", V.with_views(f"""WITH {SQL_NOISE}
SELECT vec_id, pos, t, round(x, 9) AS x, round(eps, 9) AS eps, round(x_t, 9) AS x_t FROM fwd2""", "matrix"))
def q_forward_noise(spark, sf):
    f = noised(spark, sf)
    return f.select("vec_id", "pos", "t", _r("x"), _r("eps"), _r("x_t"))


@register("conditional_start", V.with_views(f"""WITH {SQL_CELLS}
SELECT vec_id, pos, round(CASE WHEN {sql_in_core('pos')} THEN x
       ELSE {sql_normal("concat(vec_id::VARCHAR, '#', pos::VARCHAR, '#', 'init')")} END, 9) AS x_T FROM cells""",
                                            "matrix"))
def q_conditional_start(spark, sf):
    c = D.conditional_start(cells(spark, sf), key="vec_id")
    return c.select("vec_id", "pos", _r("x_T"))


@register("reverse_step", V.with_views(f"""WITH {SQL_NOISE}
SELECT p.vec_id, p.pos, p.t,
       round(CASE WHEN p.t > 0 THEN (x_t - lin.remove_noise_coeff * eps_hat) * lin.reciprocal_sqrt_alpha
                    + lin.sigma * {sql_normal("concat(p.vec_id::VARCHAR, '#', p.pos::VARCHAR, '#', p.t::VARCHAR, '#', 'z')")}
                  ELSE (x_t - lin.remove_noise_coeff * eps_hat) * lin.reciprocal_sqrt_alpha END, 9) AS x_prev
FROM pred p JOIN lin ON lin.t = p.t""", "matrix"))
def q_reverse_step(spark, sf):
    r = D.reverse_step(predicted(spark, sf), lin(spark), key="vec_id")
    return r.select("vec_id", "pos", "t", _r("x_prev"))


@register("noise_loss", V.with_views(f"""WITH {SQL_NOISE}
SELECT round(avg(abs(eps_hat - eps)), 9) AS l1, round(avg((eps_hat - eps) * (eps_hat - eps)), 9) AS l2,
       count(*) AS n_cells FROM pred""", "matrix"))
def q_noise_loss(spark, sf):
    n = D.noise_loss(predicted(spark, sf))
    return n.select(_r("l1"), _r("l2"), "n_cells")


@register("rescale", V.with_views(f"""WITH {SQL_CELLS}
SELECT vec_id, pos, round(2.0 * x - 1.0, 9) AS y FROM cells""", "matrix"))
def q_rescale(spark, sf):
    return cells(spark, sf).select("vec_id", "pos", F.round(D.rescale("x"), 9).alias("y"))
