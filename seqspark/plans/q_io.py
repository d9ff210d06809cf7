"""Source/sink queries: FASTA round trip, CSV / JSON (incl. the nested best summary) sinks, append log,
streaming leader, empty guard, and the generate -> FASTA -> compare lifecycle (S1-S8, P4, X5, L2).
Files go to a fresh folder under the shared checkpoint directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import experiments as X
from seqspark.plans.catalog import register
from seqspark.plans.q_clean import pipeline
from seqspark.plans.q_encode import INFILL_SEED, SQL_INFILL
from seqspark.plans.q_experiments import SQL_SUMMARY, SQL_TRIALS, SUMMARY_COLS, _rspark, _rsql
from seqspark.plans.q_kmers import PIPE
from seqspark.sources import driver_tables as V
from seqspark.sources import files as IO
from seqspark.session import materialize
from seqspark.streaming.foldbest import latest, run_fold_best_stream
from seqspark.streaming.leader import run_leader_stream


@register("fasta_roundtrip", V.with_views(f"""WITH {PIPE}
SELECT row_number() OVER (ORDER BY row_order) - 1 AS row_idx,
       'Sequence_' || row_number() OVER (ORDER BY row_order) AS id, upper(sequence) AS sequence
FROM pipeline""", "promoters"))
def q_fasta_roundtrip(spark, sf):
    path = IO.scratch_path(spark, "fasta")
    IO.write_fasta(pipeline(spark, sf), path, ["row_order"])
    return IO.read_fasta(spark, path)


@register("csv_roundtrip", V.with_views(f"""WITH {PIPE}
SELECT id, sequence, label FROM pipeline""", "promoters"))
def q_csv_roundtrip(spark, sf):
    path = IO.scratch_path(spark, "csv")
    IO.write_csv(pipeline(spark, sf).select("id", "sequence", "label"), path, partition_by=["label"])
    back = IO.read_csv_checked(spark, path, "id string, sequence string, label int", ["id", "sequence"])
    return back.select("id", "sequence", "label")


@register("training_view", V.with_views(f"WITH {PIPE} SELECT sequence, label FROM pipeline", "promoters"))
def q_training_view(spark, sf):
    return IO.training_view(pipeline(spark, sf))


@register("json_summary", V.with_views(f"WITH {SQL_SUMMARY} SELECT {_rsql(SUMMARY_COLS)} FROM summary", "eval_log"))
def q_json_summary(spark, sf):
    s = X.trial_summary(X.fold_best(V.eval_events(spark, sf), epoch="at")).select(*_rspark(SUMMARY_COLS))
    path = IO.scratch_path(spark, "json")
    IO.write_json(s, path)
    schema = "trial_id long, n_folds long, mean_best_test_acc double, std_best_test_acc double, " \
             "max_best_test_acc double, loss double, global_best_test_acc_after_trial double"
    return spark.read.schema(schema).json(path).select(*SUMMARY_COLS)


@register("append_log", V.with_views("SELECT trial_id, fold, epoch, acc FROM eval_log", "eval_log"))
def q_append_log(spark, sf):
    ev = materialize(V.eval_log(spark, sf))      # written once, appended in two arrivals
    path = IO.scratch_path(spark, "log")
    for odd in (1, 0):           # every event is in one of them, whatever its fold
        IO.append_log(ev.where(F.col("epoch") % 2 == odd), path)
    return IO.read_log(spark, path).select("trial_id", "fold", "epoch", "acc")


@register("ragged_log", V.with_views("""
SELECT trial_id, fold, epoch, 'train' AS phase, 1.0 - acc AS train_loss, NULL::DOUBLE AS test_accuracy, trial_id % 7 AS param_seed
FROM eval_log
UNION ALL
SELECT trial_id, fold, epoch, 'test' AS phase, NULL::DOUBLE AS train_loss, acc AS test_accuracy, trial_id % 7 AS param_seed
FROM eval_log""", "eval_log"))
def q_ragged_log(spark, sf):
    """Train and test events carry different metric columns; the log holds both and its schema is merged on read."""
    ev = materialize(V.eval_log(spark, sf)).withColumn("param_seed", F.col("trial_id") % 7)
    path = IO.scratch_path(spark, "ragged")
    common = ["trial_id", "fold", "epoch", "param_seed"]
    IO.append_log(ev.select(*common, F.lit("train").alias("phase"), (F.lit(1.0) - F.col("acc")).alias("train_loss")), path)
    IO.append_log(ev.select(*common, F.lit("test").alias("phase"), F.col("acc").alias("test_accuracy")), path)
    return IO.read_log(spark, path).select("trial_id", "fold", "epoch", "phase", "train_loss", "test_accuracy", "param_seed")


@register("csv_by_name", V.with_views(f"""WITH {PIPE}
SELECT id, sequence, label FROM pipeline""", "promoters"))
def q_csv_by_name(spark, sf):
    """Columns in another order and a column that nobody asked for; cells are found by the header."""
    path = IO.scratch_path(spark, "csv_named")
    IO.write_csv(pipeline(spark, sf).select("label", F.lit("x").alias("note"), "sequence", "id"), path)
    return IO.read_csv_checked(spark, path, "id string, sequence string, label int", ["id", "sequence"])


@register("empty_guard", V.with_views(f"WITH {PIPE} SELECT count(*) AS n FROM pipeline", "promoters"))
def q_empty_guard(spark, sf):
    n = F.count(F.lit(1))        # the guard and the count are one aggregate
    return pipeline(spark, sf).agg(n.alias("n")).select(
        F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no rows left in cleaned promoters"))).alias("n"))


@register("stream_best", V.with_views("""
SELECT acc AS best_metric_value, trial_id, fold, epoch FROM eval_log
WHERE acc IS NOT NULL AND NOT isnan(acc)
ORDER BY acc DESC, trial_id, fold, epoch LIMIT 1""", "eval_log"))
def q_stream_best(spark, sf):
    src = IO.scratch_path(spark, "events")
    ev = V.eval_log(spark, sf)
    ev.write.mode("overwrite").parquet(src)   # event files to replay (one per task)
    root = IO.scratch_path(spark, "stream")
    return run_leader_stream(spark, src, ev.schema, f"{root}/log", f"{root}/leader", f"{root}/_checkpoint")


EVENT_FILES = 12                            # event files of a half: two batches of six


@register("stream_fold_best", V.with_views("""
SELECT trial_id, fold, max(acc) AS best, min(epoch) FILTER (WHERE acc = top) AS epoch, count(*) AS n_events,
       max(epoch) AS last_epoch
FROM (SELECT *, max(acc) OVER (PARTITION BY trial_id, fold) AS top FROM eval_log) GROUP BY trial_id, fold""", "eval_log"))
def q_stream_fold_best(spark, sf):
    """X5 keyed: the later half of the events (by a hash, so most are late) arrives after a stop and restart."""
    src, out, ckpt = (IO.scratch_path(spark, n) for n in ("fold-events", "fold-best", "fold-checkpoint"))
    ev = materialize(V.eval_log(spark, sf))
    half = F.pmod(F.xxhash64("trial_id", "fold", "epoch"), F.lit(2))
    for part in (1, 0):
        # A batch meets nearly every key, so batches must not grow in number with the events: the files grow instead.
        ev.where(half == part).coalesce(EVENT_FILES).write.mode("append").parquet(src)
        run_fold_best_stream(spark, src, ev.schema, out, ckpt, max_files_per_trigger=6)
    return latest(spark, out).select("trial_id", "fold", "best", "epoch", "n_events", "last_epoch")


HP_OUT = ["lr", "lora_r", "lora_alpha_multiplier", "lora_alpha", "lora_dropout", "weight_decay", "batch_size",
          "gradient_accumulation_steps"]


@register("best_summary", V.with_views(f"""WITH {SQL_TRIALS}, {SQL_SUMMARY},
b AS (SELECT *, lora_r * lora_alpha_multiplier AS lora_alpha FROM summary JOIN trials USING (trial_id)
      ORDER BY round(mean_best_test_acc, 9) DESC, trial_id LIMIT 1),
g AS (SELECT acc AS best_metric_value, trial_id, fold, epoch FROM eval_log
      WHERE acc IS NOT NULL AND NOT isnan(acc) ORDER BY acc DESC, trial_id, fold, epoch LIMIT 1)
SELECT 'mean_of_fold_best_test_acc' AS selection_metric, b.trial_id AS best_trial_id,
       round(b.mean_best_test_acc, 9) AS best_mean_best_test_acc, round(b.loss, 9) AS best_loss,
       {', '.join(f'b.{h} AS best_{h}' for h in HP_OUT)},
       g.best_metric_value AS global_best_metric_value, g.trial_id AS global_best_trial_id,
       g.fold AS global_best_fold, g.epoch AS global_best_epoch
FROM b, g""", "eval_log"))
def q_best_summary(spark, sf):
    """S6 with the reference's nested layout: selection metric, best hyper-parameters, best trial
    record and the global best single checkpoint, written as JSON and read back."""
    ev = V.eval_log(spark, sf)
    s = X.trial_summary(X.fold_best(ev)).withColumn("mean_best_test_acc", F.round("mean_best_test_acc", 9)) \
        .withColumn("loss", F.round("loss", 9))
    hp = X.normalize_hparams(X.sample_trials(V.trial_ids(spark, sf), 42)).drop("point_id")
    ranked = s.join(hp, "trial_id")
    top = ranked.orderBy(F.desc("mean_best_test_acc"), F.asc("trial_id")).limit(1)
    glob = X.global_best(ev).select(F.struct("*").alias("g")).scalar()
    nested = top.select(F.lit("mean_of_fold_best_test_acc").alias("selection_metric"),
                        F.struct(*HP_OUT).alias("best_hparams"),
                        F.struct("trial_id", "mean_best_test_acc", "std_best_test_acc", "max_best_test_acc",
                                 "loss", "global_best_test_acc_after_trial").alias("best_trial"),
                        glob.alias("global_best_single_checkpoint"))
    path = IO.scratch_path(spark, "best_summary")
    IO.write_json(nested.coalesce(1), path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select("selection_metric", F.col("best_trial.trial_id").alias("best_trial_id"),
                       F.col("best_trial.mean_best_test_acc").alias("best_mean_best_test_acc"),
                       F.col("best_trial.loss").alias("best_loss"),
                       *[F.col(f"best_hparams.{h}").alias(f"best_{h}") for h in HP_OUT],
                       *[F.col(f"global_best_single_checkpoint.{c}").alias(f"global_best_{c}" if c != "best_metric_value"
                                                                          else "global_best_metric_value")
                         for c in ("best_metric_value", "trial_id", "fold", "epoch")])


@register("generate_compare", V.with_views(f"""WITH RECURSIVE {PIPE}, {SQL_INFILL},
c AS (SELECT kmer, count(*) FILTER (WHERE src = 1) AS n1, count(*) FILTER (WHERE src = 2) AS n2
      FROM (SELECT 1 AS src, substr(sequence, i::BIGINT, 6) AS kmer
            FROM (SELECT sequence, unnest(range(1, length(sequence) - 6 + 2)) AS i FROM infill)
            UNION ALL
            SELECT 2 AS src, substr(sequence, i::BIGINT, 6) AS kmer
            FROM (SELECT sequence, unnest(range(1, length(sequence) - 6 + 2)) AS i FROM pipeline))
      GROUP BY kmer),
f AS (SELECT kmer, n1 / sum(n1) OVER () AS f1, n2 / sum(n2) OVER () AS f2 FROM c)
SELECT (SELECT count(*) FROM infill) AS n_generated,
       CASE WHEN count(*) > 1 AND min(f1) <> max(f1) AND min(f2) <> max(f2)
            THEN round(corr(f1, f2), 9) END AS r, count(*) AS n_kmers FROM f""", "promoters"))
def q_generate_compare(spark, sf):
    """L2 lifecycle: generate (random infill) -> FASTA sink -> FASTA scan -> 6-mer r vs the natural corpus."""
    from seqspark.operators import kmers as K
    from seqspark.operators import regions as R
    p = pipeline(spark, sf, materialize=True)
    gen = R.random_infill(p.select("id", "sequence"), seed=INFILL_SEED)
    path = IO.scratch_path(spark, "generated")
    IO.write_fasta(gen, path, ["row_idx"])
    back = IO.read_fasta(spark, path, indexed=False)            # k-mer frequencies need no order
    r = K.kmer_correlation(back, p, 6).select(F.round("r", 9).alias("r"), "n_kmers")
    return r.select(back.select(F.count(F.lit(1))).scalar().alias("n_generated"), "r", "n_kmers")
