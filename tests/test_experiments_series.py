"""Experiment tracking (bests, ties, NaN, fallbacks) and training series."""
import math
import random

import pytest
from pyspark.sql import functions as F

from seqspark.operators import experiments as X
from seqspark.operators import series as S

EV = "trial_id long, fold long, epoch long, acc double"


def test_global_best_first_occurrence_and_nan(spark):
    rows = [(1, 1, 1, 0.5), (1, 2, 1, 0.9), (2, 1, 1, 0.9), (2, 1, 2, float("nan")), (3, 1, 1, None)]
    b = X.global_best(spark.createDataFrame(rows, EV)).first()
    assert (b["best_metric_value"], b["trial_id"], b["fold"], b["epoch"]) == (0.9, 1, 2, 1)


def test_running_best_and_improved(spark):
    rows = [(1, 1, 1, 0.5), (1, 1, 2, 0.4), (1, 2, 1, 0.5), (2, 1, 1, 0.7), (2, 1, 2, float("nan"))]
    out = X.running_best(spark.createDataFrame(rows, EV)).orderBy("trial_id", "fold", "epoch").collect()
    assert [r["running_best"] for r in out] == [0.5, 0.5, 0.5, 0.7, 0.7]
    assert [r["improved"] for r in out] == [True, False, False, True, False]


def test_fold_best_fallback_and_trial_summary(spark):
    rows = [(1, 1, 1, 0.5), (1, 1, 2, 0.6), (1, 2, 1, float("nan")), (1, 2, 2, 0.3), (2, 1, 1, 0.8)]
    fb = X.fold_best(spark.createDataFrame(rows, EV))
    d = {(r["trial_id"], r["fold"]): (r["fold_best_test_acc"], r["final_test_acc"]) for r in fb.collect()}
    assert d[(1, 1)] == (0.6, 0.6) and d[(1, 2)] == (0.3, 0.3) and d[(2, 1)] == (0.8, 0.8)
    s = {r["trial_id"]: r for r in X.trial_summary(fb).collect()}
    assert s[1]["mean_best_test_acc"] == pytest.approx(0.45) and s[1]["loss"] == pytest.approx(-0.45)
    assert s[2]["std_best_test_acc"] is None                      # one fold only
    assert s[2]["global_best_test_acc_after_trial"] == 0.8
    ranked = X.rank_trials(X.trial_summary(fb)).orderBy("rank").collect()
    assert [r["trial_id"] for r in ranked] == [2, 1]
    assert X.best_trial(X.trial_summary(fb)).first()["trial_id"] == 2


def test_search_space_and_trials(spark):
    sp = X.search_space(spark)
    assert sp.count() == 5400 and sp.distinct().count() == 5400
    t = X.normalize_hparams(X.sample_trials(spark.createDataFrame([(i,) for i in range(20)], "trial_id long")))
    for r in t.collect():
        assert r["lora_alpha"] == r["lora_r"] * r["lora_alpha_multiplier"]
        assert r["lr"] in X.SEARCH_SPACE["lr"]
    tf = X.trial_folds(spark.createDataFrame([(3,)], "trial_id long"), 5, 42).collect()
    assert [r["fold_seed"] for r in tf] == [42 + 3000 + f for f in range(1, 6)]


def test_acc_from_metrics(spark):
    df = spark.createDataFrame([({"eval_loss": 1.0, "eval_acc": 0.7},), ({"x_test_y_acc": 0.2, "a": 0.1},),
                                ({"train_loss": 0.3},), ({"test_acc": 0.4, "eval_accuracy": 0.9},)],
                               "m map<string,double>")
    assert [r[0] for r in df.select(X.acc_from_metrics(F.col("m"))).collect()] == [0.7, 0.2, None, 0.9]


def test_epoch_loss_mean_of_batch_means(spark):
    rows = [(1, 1, 0, 1.0), (1, 1, 0, 3.0), (1, 1, 1, 5.0)]       # batch means 2 and 5 -> 3.5 (row mean 3)
    e = S.epoch_loss(spark.createDataFrame(rows, "run long, epoch long, batch long, loss double")).first()
    assert e["val_loss"] == pytest.approx(3.5)


def _epochs(spark, losses):
    return spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(losses)], "run long, epoch long, val_loss double")


@pytest.mark.parametrize("n,stop", [(9, None), (10, 10), (11, 10)])
def test_early_stop_window(spark, n, stop):
    r = S.early_stop(_epochs(spark, [1.0] * n)).first()
    assert r["stop_epoch"] == stop and r["epochs_trained"] == (stop or n)


def test_early_stop_zero_losses_never_stop(spark):
    assert S.early_stop(_epochs(spark, [0.0] * 12)).first()["stop_epoch"] is None


def test_best_checkpoints(spark):
    out = S.best_checkpoints(_epochs(spark, [3.0, 2.0, 2.0, 2.5, 1.0])).orderBy("epoch").collect()
    assert [r["is_best"] for r in out] == [True, True, False, False, True]


def py_ema(xs, decay, rate, start):
    ema, out = None, []
    for n, x in enumerate(xs, 1):
        if n % rate == 0:
            ema = x if (n < start or ema is None) else ema * decay + (1 - decay) * x
        out.append(ema)
    return out


@pytest.mark.parametrize("decay,rate,start", [(0.9, 1, 5), (0.8, 2, 4), (0.5, 3, 1)])
def test_ema_distributed_scan_matches_loop(spark, decay, rate, start):
    rnd = random.Random(1)
    rows = [(g, n, rnd.random()) for g in range(3) for n in range(1, 1 + (400 if g == 0 else 37))]
    df = spark.createDataFrame(rows, "run long, epoch long, val_loss double")
    out = S.ema_series(df, "val_loss", "epoch", ["run"], decay=decay, rate=rate, start=start,
                       num_partitions=6).toPandas()
    for g in range(3):
        part = out[out.run == g].sort_values("epoch")
        exp = py_ema(part["val_loss"].tolist(), decay, rate, start)
        for a, b in zip(part["ema"].tolist(), exp):
            assert (b is None and (a is None or math.isnan(a))) or a == pytest.approx(b, rel=1e-12)


def test_lr_and_checkpoint_epochs(spark):
    df = spark.createDataFrame([(e,) for e in (1, 50, 51, 100, 101)], "epoch long")
    assert [r[0] for r in df.select(S.lr_at_epoch("epoch")).collect()] == [1e-3, 1e-3, 5e-4, 5e-4, 2.5e-4]
    assert [r[0] for r in S.checkpoint_epochs(df).collect()] == [50, 100]


def test_series_operators_treat_a_null_run_as_a_run(spark):
    rows = [(None if r == 0 else r, n, float((n * 7 + r) % 11)) for r in range(3) for n in range(1, 41)]
    df = spark.createDataFrame(rows, "run long, n long, x double")
    got = {(r["run"], r["n"]): r["e"] for r in S.ema_series(df, "x", "n", ["run"], name="e", decay=0.9, start=5,
                                                            num_partitions=6).collect()}
    assert len(got) == len(rows)
    for run in (None, 1, 2):
        y = None
        for n in range(1, 41):
            x = float((n * 7 + (run or 0)) % 11)
            y = x if n < 5 or y is None else y * 0.9 + 0.1 * x
            assert got[(run, n)] == pytest.approx(y, abs=1e-12)
    best = {(r["run"], r["n"]): r["is_best"] for r in S.best_checkpoints(df, "run", "n", "x").collect()}
    for run in (None, 1, 2):
        low = math.inf
        for n in range(1, 41):
            x = float((n * 7 + (run or 0)) % 11)
            assert best[(run, n)] == (x < low)
            low = min(low, x)


def brute_windows(rows, window):
    out = {}
    for run in {r for r, _, _ in rows}:
        mine = sorted((e, v) for r, e, v in rows if r == run)
        for i, (e, _) in enumerate(mine):
            seen = [v for _, v in mine[max(0, i - window + 1):i + 1]]
            some = [v for v in seen if v is not None]
            real = [v for v in some if v == v]
            lo = None if not some else min(real) if real else math.nan
            hi = None if not some else math.nan if len(real) < len(some) else max(real)
            out[(run, e)] = (lo, hi, len(seen))
    return out


@pytest.mark.parametrize("window,parts", [(1, 3), (2, 7), (10, 1), (10, 9), (25, 40)])
def test_sliding_windows_over_a_hot_sparse_run(spark, window, parts):
    """One run holds most rows and lies in many partitions, epochs have gaps, values are null or NaN now and then."""
    rnd = random.Random(window)
    rows = []
    for run, n in ((None, 30), (1, 900), (2, 5), (3, 1)):
        epochs = sorted(rnd.sample(range(5 * n), n))
        rows += [(run, e, rnd.choice([None, math.nan, rnd.random(), rnd.random(), rnd.random()])) for e in epochs]
    df = spark.createDataFrame(rows, "run long, epoch long, val_loss double").repartition(5)
    got = S.sliding_stats(df, window, num_partitions=parts).collect()
    want = brute_windows(rows, window)
    key = lambda v: tuple("nan" if x is not None and x != x else x for x in v)
    assert len(got) == len(rows)
    assert {(r["run"], r["epoch"]): key((r["win_min"], r["win_max"], r["win_n"])) for r in got} == {k: key(v) for k, v in want.items()}
    assert S.sliding_stats(df.limit(0), window).count() == 0


def test_sliding_windows_run_in_many_tasks(spark):
    df = spark.range(4000).selectExpr("1L as run", "id as epoch", "cast(id % 17 as double) as val_loss")
    out = S.sliding_stats(df, 10, num_partitions=8)
    assert out.rdd.getNumPartitions() == 8
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1000


def test_affine_scan_equals_loop():
    import numpy as np
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        a = rng.choice([1.0, 0.0, 0.9], n)
        copied = a == 0
        b = np.where(a == 1.0, 0.0, rng.normal(size=n))
        new = rng.random(n) < 0.02
        c, A, B = S.affine_scan(a, b, copied, new, (True, 0.5, 2.0))
        st = (True, 0.5, 2.0)
        for i in range(n):
            st = (False, 1.0, 0.0) if new[i] else st
            st = (st[0] or bool(copied[i]), a[i] * st[1], a[i] * st[2] + b[i])
            assert (c[i], A[i]) == (st[0], pytest.approx(st[1], rel=1e-12)) and B[i] == pytest.approx(st[2], abs=1e-12)


def test_affine_scan_is_much_faster_than_a_loop():
    import time

    import numpy as np
    n, decay = 400_000, 0.99
    x = np.random.default_rng(1).normal(size=n)
    t = time.process_time()
    S.affine_scan(np.full(n, decay), (1 - decay) * x, np.zeros(n, bool), np.zeros(n, bool))
    ours = time.process_time() - t
    t = time.process_time()
    st, out = (False, 1.0, 0.0), []
    for k, v in zip([2] * n, x.tolist()):
        if k == 2:
            st = (st[0], st[1] * decay, st[2] * decay + (1.0 - decay) * v)
        out.append(st[1])
        out.append(st[2])
    loop = time.process_time() - t
    assert ours * 3 < loop, (ours, loop)
