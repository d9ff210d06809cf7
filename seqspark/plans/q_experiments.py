"""Experiment-tracking queries over the ``eval_log`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions.rand import sql_hash32
from seqspark.operators import experiments as X
from seqspark.plans.catalog import register
from seqspark.sources import driver_tables as V

SEED = 42
SIZE = X.space_size()
PARAMS = list(X.SEARCH_SPACE)


def _sql_decode(point: str, space: dict = X.SEARCH_SPACE) -> str:
    out, stride = [], 1
    for name, values in space.items():
        typ = "INTEGER" if name in X.INT_PARAMS else "DOUBLE"
        lst = "[" + ", ".join(f"{v}::{typ}" for v in values) + "]"
        out.append(f"{lst}[(({point} // {stride}) % {len(values)} + 1)::INTEGER] AS {name}")
        stride *= len(values)
    return ", ".join(out)


SQL_TRIALS = f"""trials AS (
  SELECT trial_id, point_id, {_sql_decode('point_id')}
  FROM (SELECT trial_id, ({sql_hash32(f"concat(trial_id::VARCHAR, '#', '{SEED}')")} % {SIZE}) AS point_id
        FROM (SELECT DISTINCT trial_id FROM eval_log)))"""

SQL_FOLD_BEST = """fb AS (
  SELECT trial_id, fold, coalesce(max(acc) FILTER (WHERE acc IS NOT NULL AND NOT isnan(acc)), arg_max(acc, epoch))
         AS fold_best_test_acc, arg_max(acc, epoch) AS final_test_acc, count(*) AS n_evals
  FROM eval_log GROUP BY trial_id, fold)"""

SQL_SUMMARY = f"""{SQL_FOLD_BEST},
ts AS (SELECT trial_id, count(*) AS n_folds, avg(fold_best_test_acc) AS mean_best_test_acc,
              stddev_samp(fold_best_test_acc) AS std_best_test_acc, max(fold_best_test_acc) AS max_best_test_acc,
              -avg(fold_best_test_acc) AS loss
       FROM fb GROUP BY trial_id),
summary AS (SELECT *, max(max_best_test_acc) OVER (ORDER BY trial_id ROWS UNBOUNDED PRECEDING)
                      AS global_best_test_acc_after_trial FROM ts)"""

SUMMARY_COLS = ["trial_id", "n_folds", "mean_best_test_acc", "std_best_test_acc", "max_best_test_acc",
                "loss", "global_best_test_acc_after_trial"]
ROUNDED = {"mean_best_test_acc", "std_best_test_acc", "loss"}


def _rsql(cols):
    return ", ".join(f"round({c}, 9) AS {c}" if c in ROUNDED else c for c in cols)


def _rspark(cols):
    return [F.round(c, 9).alias(c) if c in ROUNDED else F.col(c) for c in cols]


def trials(spark, sf):
    return X.sample_trials(V.trial_ids(spark, sf), SEED)


def summary(spark, sf):
    return X.trial_summary(X.fold_best(V.eval_events(spark, sf), epoch="at"))


@register("search_space", V.with_views(f"""WITH {SQL_TRIALS},
pts AS (SELECT p AS point_id, {_sql_decode('p')} FROM (SELECT unnest(range(0, {SIZE})) AS p))
SELECT pts.*, coalesce(c.n, 0) AS n_trials FROM pts
LEFT JOIN (SELECT point_id, count(*) AS n FROM trials GROUP BY point_id) c USING (point_id)""", "eval_log"))
def q_search_space(spark, sf):
    used = trials(spark, sf).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))
    s = X.search_space(spark).join(used, "point_id", "left")
    return s.select("point_id", *PARAMS, F.coalesce("n", F.lit(0)).alias("n_trials"))


PROMPT_SIZE = X.space_size(X.PROMPT_SEARCH_SPACE)


@register("prompt_search_space", V.with_views(f"""WITH used AS (
  SELECT ({sql_hash32(f"concat(trial_id::VARCHAR, '#', '{SEED}')")} % {PROMPT_SIZE}) AS point_id, count(*) AS n
  FROM (SELECT DISTINCT trial_id FROM eval_log) GROUP BY 1)
SELECT pts.*, coalesce(used.n, 0) AS n_trials
FROM (SELECT p AS point_id, {_sql_decode('p', X.PROMPT_SEARCH_SPACE)} FROM (SELECT unnest(range(0, {PROMPT_SIZE})) AS p)) pts
LEFT JOIN used USING (point_id)""", "eval_log"))
def q_prompt_search_space(spark, sf):
    """E4 for the prompt experiments: batch size fixed, 1,800 points, and how many trials drew each."""
    used = X.sample_trials(V.trial_ids(spark, sf), SEED, X.PROMPT_SEARCH_SPACE).groupBy("point_id").agg(
        F.count(F.lit(1)).alias("n"))
    s = X.search_space(spark, X.PROMPT_SEARCH_SPACE).join(used, "point_id", "left")
    return s.select("point_id", *PARAMS, F.coalesce("n", F.lit(0)).alias("n_trials"))


@register("fold_rows", V.with_views(f"""WITH {SQL_TRIALS}, {SQL_FOLD_BEST}
SELECT fb.*, {SEED} + trial_id * 1000 + fold AS fold_seed, {', '.join(f'{p} AS param_{p}' for p in PARAMS)},
       lora_r * lora_alpha_multiplier AS param_lora_alpha
FROM fb JOIN trials USING (trial_id)""", "eval_log"))
def q_fold_rows(spark, sf):
    """The complete row of a fold: its best and final accuracy, its seed and the trial's ``param_*``."""
    fb = X.fold_best(V.eval_events(spark, sf), epoch="at")
    hp = X.flatten_params(X.normalize_hparams(trials(spark, sf)).drop("point_id"), PARAMS + ["lora_alpha"])
    return fb.withColumn("fold_seed", (F.lit(SEED) + F.col("trial_id") * 1000 + F.col("fold")).cast("bigint")).join(hp, "trial_id")


@register("global_best_checkpoint", V.with_views(f"""WITH {SQL_TRIALS},
g AS (SELECT acc AS best_metric_value, trial_id, fold, epoch AS global_step FROM eval_log
      WHERE acc IS NOT NULL AND NOT isnan(acc) ORDER BY acc DESC, trial_id, fold, epoch LIMIT 1)
SELECT best_metric_value, trial_id, fold, global_step, {', '.join(f'{p} AS param_{p}' for p in PARAMS)}
FROM g JOIN trials USING (trial_id)""", "eval_log"))
def q_global_best_checkpoint(spark, sf):
    """The best single checkpoint with its step and its trial's hyper-parameters."""
    best = X.global_best(V.eval_log(spark, sf)).withColumnRenamed("epoch", "global_step")
    return best.join(X.flatten_params(trials(spark, sf).drop("point_id"), PARAMS), "trial_id")


@register("random_trials", V.with_views(f"WITH {SQL_TRIALS} SELECT * FROM trials", "eval_log"))
def q_random_trials(spark, sf):
    return trials(spark, sf)


@register("hparam_normalize", V.with_views(f"""WITH {SQL_TRIALS}
SELECT *, lora_r * lora_alpha_multiplier AS lora_alpha FROM trials""", "eval_log"))
def q_hparam_normalize(spark, sf):
    return X.normalize_hparams(trials(spark, sf))


@register("fold_seeds", V.with_views(f"""
SELECT trial_id, fold::INTEGER AS fold, ({SEED} + trial_id * 1000 + fold)::BIGINT AS fold_seed
FROM (SELECT trial_id, unnest(range(1, 6)) AS fold FROM (SELECT DISTINCT trial_id FROM eval_log))""", "eval_log"))
def q_fold_seeds(spark, sf):
    t = X.trial_folds(V.trial_ids(spark, sf), 5, SEED)
    return t.select("trial_id", F.col("fold").cast("int").alias("fold"), "fold_seed")


@register("global_best", V.with_views("""
SELECT acc AS best_metric_value, trial_id, fold, epoch FROM eval_log
WHERE acc IS NOT NULL AND NOT isnan(acc)
ORDER BY acc DESC, trial_id, fold, epoch LIMIT 1""", "eval_log"))
def q_global_best(spark, sf):
    return X.global_best(V.eval_log(spark, sf))


@register("running_best", V.with_views("""
SELECT trial_id, fold, epoch, acc,
       max(acc) OVER (ORDER BY trial_id, fold, epoch ROWS UNBOUNDED PRECEDING) AS running_best,
       acc > coalesce(max(acc) OVER (ORDER BY trial_id, fold, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      -'inf'::DOUBLE) AS improved
FROM eval_log""", "eval_log"))
def q_running_best(spark, sf):
    return X.running_best(V.eval_log(spark, sf))


@register("fold_best", V.with_views(f"WITH {SQL_FOLD_BEST} SELECT * FROM fb", "eval_log"))
def q_fold_best(spark, sf):
    return X.fold_best(V.eval_events(spark, sf), epoch="at")


@register("trial_summary", V.with_views(f"WITH {SQL_SUMMARY} SELECT {_rsql(SUMMARY_COLS)} FROM summary",
                                        "eval_log"))
def q_trial_summary(spark, sf):
    return summary(spark, sf).select(*_rspark(SUMMARY_COLS))


@register("param_flatten", V.with_views(f"""WITH {SQL_TRIALS}, {SQL_SUMMARY}
SELECT {_rsql(SUMMARY_COLS)}, {', '.join(f'{p} AS param_{p}' for p in PARAMS)}, lora_r * lora_alpha_multiplier AS param_lora_alpha
FROM summary JOIN trials USING (trial_id)""", "eval_log"))
def q_param_flatten(spark, sf):
    hp = X.normalize_hparams(trials(spark, sf)).drop("point_id")
    s = summary(spark, sf).select(*_rspark(SUMMARY_COLS)).join(hp, "trial_id")
    return X.flatten_params(s, PARAMS + ["lora_alpha"])


@register("trial_rank", V.with_views(f"""WITH {SQL_SUMMARY}
SELECT trial_id, round(mean_best_test_acc, 9) AS mean_best_test_acc,
       row_number() OVER (ORDER BY round(mean_best_test_acc, 9) DESC, trial_id) AS rank
FROM summary""", "eval_log"))
def q_trial_rank(spark, sf):
    s = summary(spark, sf).select("trial_id", F.round("mean_best_test_acc", 9).alias("mean_best_test_acc"))
    return X.rank_trials(s)


@register("best_trial", V.with_views(f"""WITH {SQL_TRIALS}, {SQL_SUMMARY}
SELECT trial_id, round(loss, 9) AS loss, round(mean_best_test_acc, 9) AS mean_best_test_acc,
       {', '.join(f'{p} AS param_{p}' for p in PARAMS)}
FROM summary JOIN trials USING (trial_id)
ORDER BY round(loss, 9), trial_id LIMIT 1""", "eval_log"))
def q_best_trial(spark, sf):
    s = summary(spark, sf).select("trial_id", F.round("loss", 9).alias("loss"),
                                  F.round("mean_best_test_acc", 9).alias("mean_best_test_acc"))
    b = X.best_trial(s)
    hp = X.flatten_params(trials(spark, sf).drop("point_id"), PARAMS)
    return b.join(hp, "trial_id")


# Metric keys that the folds' events carry in turn (the fourth is no accuracy key -> NULL; the fifth matches the pattern).
FOLD_KEYS = ["eval_accuracy", "eval_acc", "test_accuracy", "train_loss", "final_test_acc"]


def _key_expr_spark():
    return F.element_at(F.array(*[F.lit(k) for k in FOLD_KEYS]), ((F.col("fold") - 1) % len(FOLD_KEYS) + 1).cast("int"))


@register("acc_from_metrics", V.with_views(f"""
SELECT trial_id, fold, epoch,
       coalesce(m['eval_accuracy'], m['eval_acc'], m['test_accuracy'], m['test_acc'],
                list_filter(map_entries(m), lambda e: contains(e.key, '_test_')
                            AND (ends_with(e.key, '_accuracy') OR ends_with(e.key, '_acc')))[1].value) AS test_acc
FROM (SELECT trial_id, fold, epoch,
             map(['eval_steps', {FOLD_KEYS}[((fold - 1) % {len(FOLD_KEYS)} + 1)::INTEGER]],
                 [epoch::DOUBLE, acc]) AS m FROM eval_log)""", "eval_log"))
def q_acc_from_metrics(spark, sf):
    ev = V.eval_log(spark, sf)
    m = F.map_from_arrays(F.array(F.lit("eval_steps"), _key_expr_spark()),
                          F.array(F.col("epoch").cast("double"), F.col("acc")))
    return ev.select("trial_id", "fold", "epoch", X.acc_from_metrics(m).alias("test_acc"))
