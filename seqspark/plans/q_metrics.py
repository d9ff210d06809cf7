"""Prediction and metric queries.

``model_logits`` reads the embeddings table as the score output of the four
registered models: the 64 cells of a row are cut into 4 models x 2 classes x 8
cells, a logit is the sum of its 8 cells, and ``label % 2`` is the truth.  The
AUC ranks by the probability of strong, rounded to 12 digits so that any two
engines see the same ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from seqspark.operators import metrics as M
from seqspark.plans.catalog import register
from seqspark.sources import driver_tables as V

MODELS = [k for k, *_ in M.MODEL_REGISTRY]


CELLS = 8   # cells per model and class


def _logit(block: int):
    cells = [F.element_at("embedding", CELLS * block + j + 1).cast("double") for j in range(CELLS)]
    return reduce(lambda a, b: a + b, cells)


def _sql_logit(block: int) -> str:
    return "(" + " + ".join(f"embedding[{CELLS * block + j + 1}]::DOUBLE" for j in range(CELLS)) + ")"


def model_logits(spark, sf):
    e = V.table(spark, sf, "embeddings")
    arr = F.array(*[F.struct(F.lit(m).alias("model"), _logit(2 * i).alias("z0"), _logit(2 * i + 1).alias("z1"))
                    for i, m in enumerate(MODELS)])
    x = e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("label"),
                 F.explode(arr).alias("m"))
    return x.select("m.model", "id", "label", "m.z0", "m.z1")


def predictions(spark, sf):
    p = M.prediction_table(model_logits(spark, sf))
    return p.withColumn("score", F.round("prob_strong_promoter", 12))


SQL_ML = "model_logits AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, vec_id AS id, (label % 2)::INTEGER AS label, {_sql_logit(2 * i)} AS z0, "
    f"{_sql_logit(2 * i + 1)} AS z1 FROM embeddings" for i, m in enumerate(MODELS)) + ")"

SQL_PRED = f"""{SQL_ML},
pred AS (SELECT model, id, label, z0, z1,
                round(exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))), 12) AS score,
                CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS predicted_label FROM model_logits)"""

SQL_CONF = f"""{SQL_PRED},
conf AS (SELECT model, count(*) FILTER (WHERE label = 0 AND predicted_label = 0) AS tn,
                count(*) FILTER (WHERE label = 0 AND predicted_label = 1) AS fp,
                count(*) FILTER (WHERE label = 1 AND predicted_label = 0) AS fn,
                count(*) FILTER (WHERE label = 1 AND predicted_label = 1) AS tp FROM pred GROUP BY model)"""

SQL_AUC = f"""{SQL_PRED},
s AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
      FROM pred GROUP BY model, score),
c AS (SELECT model, pos, neg, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
auc AS (SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                      THEN sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) END AS auc,
               sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM c GROUP BY model)"""


def _r(c, d=9):
    return F.round(c, d).alias(c)


@register("softmax_predictions", f"""WITH {SQL_ML}
SELECT model, id, label, z0 AS logit_weak_promoter, z1 AS logit_strong_promoter,
       round(exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))), 9) AS prob_weak_promoter,
       round(exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))), 9) AS prob_strong_promoter,
       CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS predicted_label,
       CASE WHEN z1 > z0 THEN 'strong_promoter' ELSE 'weak_promoter' END AS predicted_name
FROM model_logits""")
def q_softmax_predictions(spark, sf):
    p = M.prediction_table(model_logits(spark, sf))
    return p.select("model", "id", "label", "logit_weak_promoter", "logit_strong_promoter",
                    _r("prob_weak_promoter"), _r("prob_strong_promoter"), "predicted_label", "predicted_name")


@register("confusion", f"WITH {SQL_CONF} SELECT * FROM conf")
def q_confusion(spark, sf):
    return M.confusion(predictions(spark, sf), group_cols=["model"])


def _sql_metrics_cols() -> str:
    def ratio(a, b):
        return f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END, 9)"
    return ", ".join([
        f"{ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy", f"{ratio('tp + tn', 'tn + fp + fn + tp')} AS acc",
        f"{ratio('tp', 'tp + fp')} AS precision",
        f"{ratio('tp', 'tp + fn')} AS recall", f"{ratio('tp', 'tp + fn')} AS sn",
        f"{ratio('tn', 'tn + fp')} AS sp", f"{ratio('2 * tp', '2 * tp + fp + fn')} AS f1",
        f"{ratio('tp::DOUBLE * tn - fp::DOUBLE * fn', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc"])


METRIC_COLS = ["accuracy", "acc", "precision", "recall", "sn", "sp", "f1", "mcc"]


@register("binary_metrics", f"""WITH {SQL_CONF}, {SQL_AUC[len(SQL_PRED) + 2:]}
SELECT c.model, tn, fp, fn, tp, {_sql_metrics_cols()}, round(a.auc, 9) AS auc
FROM conf c LEFT JOIN auc a USING (model)""")
def q_binary_metrics(spark, sf):
    m = M.binary_metrics(predictions(spark, sf), group_cols=["model"])
    return m.select("model", "tn", "fp", "fn", "tp", *[_r(c) for c in METRIC_COLS], _r("auc"))


@register("roc_auc", f"WITH {SQL_AUC} SELECT model, round(auc, 9) AS auc, n_pos, n_neg FROM auc")
def q_roc_auc(spark, sf):
    a = M.roc_auc(predictions(spark, sf), group_cols=["model"])
    return a.select("model", _r("auc"), "n_pos", "n_neg")


@register("model_accuracy", f"""WITH {SQL_PRED}
SELECT model, round(avg((label = predicted_label)::INTEGER::DOUBLE), 9) AS acc, count(*) AS n
FROM pred GROUP BY model""")
def q_model_accuracy(spark, sf):
    a = M.model_accuracy(predictions(spark, sf))
    return a.select("model", _r("acc"), "n")


REG_SQL = "reg AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{n}')" for k, n, *_ in M.MODEL_REGISTRY) + ") t(key, name))"


@register("model_summary", f"""WITH {SQL_PRED}, {REG_SQL},
res AS (SELECT model AS key, round(avg((label = predicted_label)::INTEGER::DOUBLE), 9) AS acc, count(*) AS n
        FROM pred GROUP BY model)
SELECT key, name, acc, n, CASE WHEN res.key IS NULL THEN 'FAILED' ELSE 'OK' END AS status
FROM reg LEFT JOIN res USING (key)""")
def q_model_summary(spark, sf):
    reg = M.select_models(M.registry(spark), "all")
    res = M.model_accuracy(predictions(spark, sf)).select("model", _r("acc"), "n")
    return M.model_summary(reg, res)
