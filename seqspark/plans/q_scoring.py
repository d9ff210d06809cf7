"""Scoring queries: PWM model, batch scorer, mutation scan, core identification, k-mer classifier
(X1, X2, X4, R1, R2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import logistic as L
from seqspark.operators import scoring as Sc
from seqspark.operators.metrics import MODEL_REGISTRY
from seqspark.plans.catalog import register
from seqspark.plans.q_clean import pipeline
from seqspark.plans.q_kmers import PIPE
from seqspark.plans.q_split import SQL_FOLDS, folds
from seqspark.sources import driver_tables as V

CORE_QUANTILE = 0.75

SQL_PWM = """cells AS (
  SELECT y, pos, substr(sequence, (pos + 1)::BIGINT, 1) AS base
  FROM (SELECT label AS y, sequence, unnest(range(0, length(sequence))) AS pos FROM pipeline)),
cnt AS (SELECT pos, base, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0
        FROM cells WHERE base IN ('A', 'C', 'G', 'T') GROUP BY pos, base),
grid AS (SELECT p.pos, b.base FROM (SELECT DISTINCT pos FROM cnt) p, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) b),
full_cnt AS (SELECT g.pos, g.base, coalesce(c.n1, 0) AS n1, coalesce(c.n0, 0) AS n0
             FROM grid g LEFT JOIN cnt c USING (pos, base)),
pwm AS (SELECT pos::INTEGER AS pos, base,
               ln((n1 + 1.0) / (sum(n1) OVER (PARTITION BY pos) + 4.0))
             - ln((n0 + 1.0) / (sum(n0) OVER (PARTITION BY pos) + 4.0)) AS w FROM full_cnt)"""

SQL_WT = """wt AS (
  SELECT id, coalesce(sum(w), 0.0) AS score
  FROM (SELECT id, pos, substr(sequence, (pos + 1)::BIGINT, 1) AS base
        FROM (SELECT id, sequence, unnest(range(0, length(sequence))) AS pos FROM pipeline)) c
  LEFT JOIN pwm USING (pos, base) GROUP BY id)"""

SQL_EFFECTS = """eff AS (
  SELECT v.pos, v.alt, coalesce(wa.w, 0.0) - coalesce(wr.w, 0.0) AS delta,
         abs(1.0 / (1.0 + exp(-(wt.score + coalesce(wa.w, 0.0) - coalesce(wr.w, 0.0)))) - 1.0 / (1.0 + exp(-wt.score))) AS dp
  FROM (SELECT id, pos::INTEGER AS pos, ref, alt
        FROM (SELECT id, pos, substr(sequence, (pos + 1)::BIGINT, 1) AS ref
              FROM (SELECT id, sequence, unnest(range(0, length(sequence))) AS pos FROM pipeline)),
             (SELECT unnest(['A', 'C', 'G', 'T']) AS alt)
        WHERE alt <> ref) v
  JOIN wt USING (id)
  LEFT JOIN pwm wr ON wr.pos = v.pos AND wr.base = v.ref
  LEFT JOIN pwm wa ON wa.pos = v.pos AND wa.base = v.alt)"""


def promoters_clean(spark, sf):
    # one column set for every use, so the pipeline's shuffle can be shared
    # written once: the model is fitted on it and then applied to it (two passes)
    return pipeline(spark, sf, materialize=True).select("id", "sequence", "label")


def weights(spark, sf, data=None):
    return Sc.pwm_weights(data if data is not None else promoters_clean(spark, sf))


@register("pwm_weights", V.with_views(f"WITH {PIPE}, {SQL_PWM} SELECT pos, base, round(w, 9) AS w FROM pwm",
                                      "promoters"))
def q_pwm_weights(spark, sf):
    return weights(spark, sf).select("pos", "base", F.round("w", 9).alias("w"))


@register("pwm_score", V.with_views(f"""WITH {PIPE}, {SQL_PWM}, {SQL_WT}
SELECT id, round(score, 9) AS score FROM wt""", "promoters"))
def q_pwm_score(spark, sf):
    d = promoters_clean(spark, sf)
    s = Sc.pwm_score(d, weights(spark, sf, d))
    return s.select("id", F.round("score", 9).alias("score"))


@register("batch_score", V.with_views(f"""WITH {PIPE}, {SQL_PWM}, {SQL_WT}
SELECT id, round(score, 9) AS score, round(1.0 / (1.0 + exp(-score)), 9) AS prob_strong_promoter,
       CASE WHEN score > 0 THEN 1 ELSE 0 END AS predicted_label FROM wt""", "promoters"))
def q_batch_score(spark, sf):
    # the model (<= L x 4 weights, bounded by sequence length) comes with every partition's first row
    d = promoters_clean(spark, sf)
    s = Sc.batch_score(d, Sc.PWMScorer.from_array, model=Sc.weight_row(weights(spark, sf, d)))
    return s.select("id", F.round("score", 9).alias("score"),
                    F.round(Sc.sigmoid("score"), 9).alias("prob_strong_promoter"),
                    F.when(F.col("score") > 0, 1).otherwise(0).alias("predicted_label"))


@register("mutation_scan", V.with_views(f"""WITH {PIPE}, {SQL_PWM}, {SQL_WT}, {SQL_EFFECTS}
SELECT pos, alt, count(*) AS n_variants, round(avg(delta), 9) AS mean_delta, round(avg(dp), 9) AS mean_dp
FROM eff GROUP BY pos, alt""", "promoters"))
def q_mutation_scan(spark, sf):
    d = promoters_clean(spark, sf)
    g = Sc.mutation_summary(d, weights(spark, sf, d))
    return g.select("pos", "alt", "n_variants", F.round("mean_delta", 9).alias("mean_delta"),
                    F.round("mean_dp", 9).alias("mean_dp"))


@register("core_identify", V.with_views(f"""WITH {PIPE}, {SQL_PWM}, {SQL_WT}, {SQL_EFFECTS},
imp AS (SELECT pos, round(avg(dp), 9) AS importance, avg(dp) AS raw FROM eff GROUP BY pos),
core AS (SELECT pos, raw FROM imp
         WHERE importance >= (SELECT quantile_cont(importance, {CORE_QUANTILE}) FROM imp)),
isl AS (SELECT pos, raw, pos - row_number() OVER (ORDER BY pos) AS grp FROM core)
SELECT min(pos) AS start, max(pos) + 1 AS "end", round(avg(raw), 9) AS mean_importance
FROM isl GROUP BY grp""", "promoters"))
def q_core_identify(spark, sf):
    d = promoters_clean(spark, sf)
    e = Sc.mutation_summary(d, weights(spark, sf, d)).groupBy("pos").agg(
        (F.sum("sum_dp") / F.sum("n_variants")).alias("importance"))
    # rounded importance picks the positions (same threshold in any engine); the region mean
    # averages the unrounded values
    imp = e.select("pos", F.round("importance", 9).alias("importance"),
                                           F.col("importance").alias("raw"))
    r = Sc.core_regions(imp, CORE_QUANTILE, mean_col="raw")
    return r.select(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                    F.round("mean_importance", 9).alias("mean_importance"))


REG_PARAMS = [0.01, 0.1]
CLASSIFIER_K = 4


def labelled_folds(spark, sf):
    return folds(spark, sf, pipeline(spark, sf).select("id", "label", "sequence"))


@register("kmer_classifier")
def q_kmer_classifier(spark, sf):
    """K-mer logistic regression, regParam grid x the stratified folds, all models fitted together
    (no SQL twin: iterative fitting; tests compare with Spark ML)."""
    return L.kmer_classifier_search(labelled_folds(spark, sf), REG_PARAMS, k=CLASSIFIER_K)


@register("kmer_classifier_models", V.with_views(f"""WITH {PIPE}, {SQL_FOLDS},
t AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, {r!r}::DOUBLE)" for i, r in enumerate(REG_PARAMS))}) t(trial_id, reg_param)),
f AS (SELECT fold, count(*) AS n_test, count(*) FILTER (WHERE label = 1) AS p FROM folds GROUP BY fold)
SELECT trial_id, fold, reg_param, (sum(n_test) OVER (PARTITION BY trial_id) - n_test)::BIGINT AS n_train,
       (sum(p) OVER (PARTITION BY trial_id) - p)::BIGINT AS n_pos, n_test, 4 ** {CLASSIFIER_K} AS n_features, true AS stationary,
       true AS has_auc
FROM t, f""".replace(f"4 ** {CLASSIFIER_K}", f"{4 ** CLASSIFIER_K}::INTEGER"), "promoters"))
def q_kmer_classifier_models(spark, sf):
    """X4 per model: sizes of its training and test rows, and whether its mean gradient vanishes at the coefficients."""
    models, auc = L.kmer_models(labelled_folds(spark, sf), REG_PARAMS, CLASSIFIER_K)
    return models.join(auc, ["trial_id", "fold"]).select(
        "trial_id", "fold", "reg_param", "n_train", "n_pos", "n_test", F.size("coefficients").alias("n_features"),
        (F.col("gradient") < 1e-8).alias("stationary"), F.col("auc").between(0.0, 1.0).alias("has_auc"))


def _sql_cv() -> str:
    bases = ["A", "C", "G", "T"]
    ncols = [f"n{y}_{b}" for y in (1, 0) for b in bases]
    cnt = ", ".join(f"count(*) FILTER (WHERE y = {y} AND base = '{b}') AS n{y}_{b}" for y in (1, 0) for b in bases)
    tr = ", ".join(f"sum({c}) OVER (PARTITION BY pos) - {c} AS {c}" for c in ncols)
    pick = lambda y: "CASE b.base " + " ".join(f"WHEN '{b}' THEN n{y}_{b}" for b in bases) + " END"
    t = lambda y: " + ".join(f"n{y}_{b}" for b in bases)
    return f"""WITH {PIPE}, {SQL_FOLDS},
d AS (SELECT p.id, f.fold, p.label, p.sequence FROM pipeline p JOIN folds f USING (id)),
cells AS (SELECT id, fold, label AS y, pos, substr(sequence, (pos + 1)::BIGINT, 1) AS base
          FROM (SELECT id, fold, label, sequence, unnest(range(0, length(sequence))) AS pos FROM d)),
fpc AS (SELECT fold, pos, {cnt} FROM cells GROUP BY fold, pos),
tr AS (SELECT fold, pos, {tr} FROM fpc),
w AS (SELECT fold, pos, b.base,
             ln(({pick(1)} + 1.0) / ({t(1)} + 4.0)) - ln(({pick(0)} + 1.0) / ({t(0)} + 4.0)) AS w
      FROM tr, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) b),
sc AS (SELECT c.id, c.fold, c.y AS label, round(coalesce(sum(w.w), 0.0), 9) AS score
       FROM cells c LEFT JOIN w ON w.fold = c.fold AND w.pos = c.pos AND w.base = c.base
       GROUP BY c.id, c.fold, c.y),
pr AS (SELECT *, CASE WHEN score > 0 THEN 1 ELSE 0 END AS predicted_label FROM sc),
conf AS (SELECT fold, count(*) AS n,
                count(*) FILTER (WHERE label = 0 AND predicted_label = 0) AS tn,
                count(*) FILTER (WHERE label = 0 AND predicted_label = 1) AS fp,
                count(*) FILTER (WHERE label = 1 AND predicted_label = 0) AS fn,
                count(*) FILTER (WHERE label = 1 AND predicted_label = 1) AS tp FROM pr GROUP BY fold),
s AS (SELECT fold, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
      FROM pr GROUP BY fold, score),
c AS (SELECT fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
auc AS (SELECT fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                     THEN sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) END AS auc FROM c GROUP BY fold)
SELECT fold, n, tn, fp, fn, tp,
       round(CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn)::DOUBLE / n END, 9) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END, 9) AS f1,
       round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
                  ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 9) AS mcc,
       round(auc, 9) AS auc
FROM conf JOIN auc USING (fold)"""


@register("cv_metrics", V.with_views(_sql_cv(), "promoters"))
def q_cv_metrics(spark, sf):
    """X3 + E2/E3: 5-fold cross-validated evaluation of the PWM classifier, all folds in one job."""
    from seqspark.operators import metrics as M
    pred = Sc.cv_pwm_predictions(folds(spark, sf, promoters_clean(spark, sf))).withColumn("score", F.round("score", 9))
    pred = pred.withColumn("predicted_label", F.when(F.col("score") > 0, 1).otherwise(0))
    m = M.binary_metrics(pred, group_cols=["fold"])
    n = pred.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return m.join(n, "fold").select("fold", "n", "tn", "fp", "fn", "tp",
                                    *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "mcc", "auc")])


# Query parameter: the searched pseudo-counts (one trial each).
PSEUDOS = [0.1, 0.5, 1.0, 2.0, 5.0]


def _sql_search() -> str:
    bases = ["A", "C", "G", "T"]
    ncols = [f"n{y}_{b}" for y in (1, 0) for b in bases]
    cnt = ", ".join(f"count(*) FILTER (WHERE y = {y} AND base = '{b}') AS n{y}_{b}" for y in (1, 0) for b in bases)
    tr = ", ".join(f"sum({c}) OVER (PARTITION BY pos) - {c} AS {c}" for c in ncols)
    pick = lambda y: "CASE b.base " + " ".join(f"WHEN '{b}' THEN n{y}_{b}" for b in bases) + " END"
    t = lambda y: " + ".join(f"n{y}_{b}" for b in bases)
    tri = ", ".join(f"({i + 1}, {p!r}::DOUBLE)" for i, p in enumerate(PSEUDOS))
    return f"""WITH {PIPE}, {SQL_FOLDS},
d AS (SELECT p.id, f.fold, p.label, p.sequence FROM pipeline p JOIN folds f USING (id)),
cells AS (SELECT id, fold, label AS y, pos, substr(sequence, (pos + 1)::BIGINT, 1) AS base
          FROM (SELECT id, fold, label, sequence, unnest(range(0, length(sequence))) AS pos FROM d)),
fpc AS (SELECT fold, pos, {cnt} FROM cells GROUP BY fold, pos),
tr AS (SELECT fold, pos, {tr} FROM fpc),
tri AS (SELECT * FROM (VALUES {tri}) t(trial_id, pseudo)),
w AS (SELECT tri.trial_id, fold, pos, b.base,
             ln(({pick(1)} + pseudo) / ({t(1)} + 4 * pseudo)) - ln(({pick(0)} + pseudo) / ({t(0)} + 4 * pseudo)) AS w
      FROM tr, tri, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) b),
sc AS (SELECT tri.trial_id, c.id, c.fold, c.y AS label, round(coalesce(sum(w.w), 0.0), 9) AS score
       FROM cells c CROSS JOIN tri
       LEFT JOIN w ON w.trial_id = tri.trial_id AND w.fold = c.fold AND w.pos = c.pos AND w.base = c.base
       GROUP BY tri.trial_id, c.id, c.fold, c.y),
fa AS (SELECT trial_id, fold, avg(((CASE WHEN score > 0 THEN 1 ELSE 0 END) = label)::INTEGER::DOUBLE) AS acc
       FROM sc GROUP BY trial_id, fold),
ts AS (SELECT trial_id, count(*) AS n_folds, avg(acc) AS mean_best_test_acc, stddev_samp(acc) AS std_best_test_acc,
              max(acc) AS max_best_test_acc, -avg(acc) AS loss FROM fa GROUP BY trial_id),
summary AS (SELECT *, max(max_best_test_acc) OVER (ORDER BY trial_id ROWS UNBOUNDED PRECEDING)
                      AS global_best_test_acc_after_trial FROM ts)
SELECT trial_id, pseudo AS param_pseudo, n_folds, round(mean_best_test_acc, 9) AS mean_best_test_acc,
       round(std_best_test_acc, 9) AS std_best_test_acc, round(max_best_test_acc, 9) AS max_best_test_acc,
       round(loss, 9) AS loss, round(global_best_test_acc_after_trial, 9) AS global_best_test_acc_after_trial,
       row_number() OVER (ORDER BY round(mean_best_test_acc, 9) DESC, trial_id) AS rank
FROM summary JOIN tri USING (trial_id)"""


@register("pwm_search", V.with_views(_sql_search(), "promoters"))
def q_pwm_search(spark, sf):
    """L1 lifecycle: hyper-parameter trials x 5 folds of the PWM classifier in one job, then the
    reference's fold -> trial -> ranking chain (A11, W8, O1)."""
    from seqspark.operators import experiments as X
    pred = Sc.cv_pwm_search(folds(spark, sf, promoters_clean(spark, sf)), PSEUDOS).withColumn("score", F.round("score", 9))
    pred = pred.withColumn("predicted_label", F.when(F.col("score") > 0, 1).otherwise(0))
    fold_rows = pred.groupBy("trial_id", "fold").agg(
        F.avg((F.col("label") == F.col("predicted_label")).cast("double")).alias("fold_best_test_acc"))
    s = X.trial_summary(fold_rows)
    r = ["mean_best_test_acc", "std_best_test_acc", "max_best_test_acc", "loss", "global_best_test_acc_after_trial"]
    s = s.select("trial_id", "n_folds", *[F.round(c, 9).alias(c) for c in r])
    ranked = X.rank_trials(s)
    params = spark.createDataFrame([(i + 1, float(p)) for i, p in enumerate(PSEUDOS)], "trial_id int, param_pseudo double")
    return ranked.join(F.broadcast(params), "trial_id").select(
        F.col("trial_id").cast("int").alias("trial_id"), "param_pseudo", "n_folds", *r, "rank")


# Query parameters: a registered model whose sheet lacks its label column, and one whose scorer raises on one row.
BROKEN_SHEET, RAISING = "nt", "genomeocean"
VALIDATION_REG = "(VALUES " + ", ".join(f"('{k}', '{n}')" for k, n, *_ in MODEL_REGISTRY) + ") t(key, name)"
_FAILED = f"key IN ('{BROKEN_SHEET}', '{RAISING}')"


@register("validation_lifecycle", V.with_views(f"""WITH {PIPE}, {SQL_PWM}, {SQL_WT},
res AS (SELECT round(avg(((CASE WHEN wt.score > 0 THEN 1 ELSE 0 END) = p.label)::INTEGER::DOUBLE), 9) AS acc, count(*) AS n
        FROM wt JOIN pipeline p USING (id))
SELECT key, name, CASE WHEN NOT {_FAILED} THEN acc END AS acc, CASE WHEN NOT {_FAILED} THEN n END AS n,
       CASE WHEN {_FAILED} THEN 'FAILED' ELSE 'OK' END AS status
FROM {VALIDATION_REG}, res""", "promoters"))
def q_validation_lifecycle(spark, sf):
    """L3: every registered model checks its sheet, fits on and scores the text it is given (the prompt included where
    it has one) in its batch size, each in its own job group; one whose sheet is broken and one whose scorer raises
    on a single row give FAILED rows, and the others go on."""
    from seqspark.functions.dna import prompt_text
    from seqspark.operators import metrics as M
    from seqspark.operators.validation import validate_models
    from seqspark.plans.q_encode import PROMPT
    from seqspark.sources import files as IO
    d = promoters_clean(spark, sf)
    whole, broken = IO.scratch_path(spark, "sheet"), IO.scratch_path(spark, "sheet-broken")
    IO.write_csv(d, whole)
    IO.write_csv(d.drop("label"), broken)
    bad_row = d.agg(F.max("id").alias("id"))

    def job(key, batch_size, use_prompt):
        rows = IO.read_csv_checked(spark, broken if key == BROKEN_SHEET else whole, "id string, sequence string, label int",
                                   ["sequence", "label"])
        text = rows.select("id", "label", prompt_text("sequence", PROMPT if use_prompt else None).alias("text"))
        if key == RAISING:
            text = text.join(F.broadcast(bad_row.select("id", F.lit(True).alias("bad"))), "id", "left").select(     # one row
                "id", "label", F.when(F.col("bad"), F.concat(F.lit("\0"), "text")).otherwise(F.col("text")).alias("text"))
        model = Sc.weight_row(Sc.pwm_weights(text, "text"))
        scored = Sc.batch_score(text, _strict, "text", keep=("label",), batch_size=batch_size, model=model)
        pred = scored.select("label", F.when(F.col("score") > 0, 1).otherwise(0).alias("predicted_label"))
        return M.model_accuracy(pred, group_cols=[]).select(F.round("acc", 9).alias("acc"), "n")

    jobs = {key: (lambda k=key, b=batch, p=prompt: job(k, b, p)) for key, _, _, batch, _, prompt in MODEL_REGISTRY}
    results = validate_models(spark, jobs)
    return M.model_summary(M.select_models(M.registry(spark), "all"), results.where("error is null").drop("error"))


def _strict(weights):
    """A PWM scorer that refuses texts with a NUL, as a tokenizer may."""
    scorer = Sc.PWMScorer.from_array(weights)

    def score(texts):
        if texts.str.contains("\0", regex=False).any():
            raise ValueError("text with a NUL")
        return scorer(texts)

    return score


MASK_W = 5


@register("mask_scan", V.with_views(f"""WITH {PIPE}, {SQL_PWM}, {SQL_WT},
cw AS (SELECT id, pos, coalesce(pwm.w, 0.0) AS w, length(sequence) AS n
       FROM (SELECT id, sequence, pos, substr(sequence, (pos + 1)::BIGINT, 1) AS base
             FROM (SELECT id, sequence, unnest(range(0, length(sequence))) AS pos FROM pipeline)) c
       LEFT JOIN pwm USING (pos, base)),
win AS (SELECT id, pos, n, sum(w) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {MASK_W - 1} FOLLOWING)
               AS masked FROM cw),
eff AS (SELECT win.pos, -masked AS delta,
               abs(1.0 / (1.0 + exp(-(wt.score - masked))) - 1.0 / (1.0 + exp(-wt.score))) AS dp
        FROM win JOIN wt USING (id) WHERE win.pos <= n - {MASK_W})
SELECT pos::INTEGER AS pos, count(*) AS n_variants, round(avg(delta), 9) AS mean_delta, round(avg(dp), 9) AS mean_dp
FROM eff GROUP BY pos""", "promoters"))
def q_mask_scan(spark, sf):
    """R1 window masks: every window of MASK_W cells replaced by M and scored."""
    d = promoters_clean(spark, sf)
    v = Sc.window_mask_effects(d, weights(spark, sf, d), MASK_W)
    return v.groupBy("pos").agg(F.count(F.lit(1)).alias("n_variants"), F.round(F.avg("delta"), 9).alias("mean_delta"),
                                F.round(F.avg("dp"), 9).alias("mean_dp"))
