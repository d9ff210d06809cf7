"""Reverse chain and fitted denoiser: NumPy twins, noise statistics, edge rows, one-task freedom."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import diffusion as D
from seqspark.operators import reverse as R


def steps(spark, T):
    return D.schedule_table(D.cosine_betas(spark, T))


def test_counter_normals_are_normal_and_differ():
    keys = np.arange(3000, dtype=np.int64) * 977
    z = np.stack([R.counter_normals(keys, s, np.arange(40)) for s in range(3)])
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    assert abs((z ** 3).mean()) < 0.03 and abs((z ** 4).mean() - 3) < 0.06
    for a, b in ((z[0], z[1]), (z[:, :-1], z[:, 1:]), (z[:, :, :-1], z[:, :, 1:]), (z[:, :, :-2], z[:, :, 2:])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.01
    assert (R.counter_normals(keys[::-1], 1, np.arange(40))[::-1] == z[1]).all()


def test_chain_equals_plain_recurrence(spark):
    T, width = 7, 62
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=width).tolist()) for i in range(2500)] + [(None, [0.5] * width), (9000, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>").withColumn("model", F.lit(3)).repartition(3)
    means = [rng.normal(size=width).tolist() for _ in range(2)]
    models = spark.createDataFrame([(50, means[0]), (100, means[1])], "model long, mean array<double>")
    got = {(r["id"], r["model"]): np.array(r["x_0"]) for r in R.reverse_chain(df, steps(spark, T), models).collect()}
    assert len(got) == 2 * 2501
    keys = {r["id"]: r["k"] for r in df.select("id", R.chain_key(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("k")).collect()}
    coefs = [r.asDict() for r in steps(spark, T).orderBy("t").collect()]
    core = [any(a <= p < b for a, b in R.ACTIVE_REGIONS) for p in range(width)]
    for i, x in (rows[0], rows[1234], rows[2500]):
        for name, mean in zip((50, 100), means):
            z = [R.counter_normals(np.array([keys[i]]), t, np.arange(width))[0] for t in range(T + 1)]
            cur = [x[p] if core[p] else z[T][p] for p in range(width)]
            for t in reversed(range(T)):
                c = coefs[t]
                for p in range(width):
                    eps = (cur[p] - math.sqrt(c["alpha_bar"]) * mean[p]) / math.sqrt(1 - c["alpha_bar"])
                    cur[p] = (cur[p] - c["beta"] / math.sqrt(1 - c["alpha_bar"]) * eps) / math.sqrt(c["alpha"])
                    cur[p] += math.sqrt(c["beta"]) * z[t][p] if t else 0
            assert np.allclose(got[i, name], cur, atol=1e-9)


def test_chain_edges(spark):
    models = spark.createDataFrame([(1, [0.0] * 4)], "model long, mean array<double>")
    empty = spark.createDataFrame([], "id long, x array<double>")
    assert R.reverse_chain(empty, steps(spark, 3), models).count() == 0
    mixed = spark.createDataFrame([(1, [0.0] * 4), (2, [0.0] * 3)], "id long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="widths"):
        R.reverse_chain(mixed, steps(spark, 3), models).collect()
    plan = R.reverse_chain(empty, steps(spark, 3), models)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_generated_sequences_keep_a_sharp_model(spark):
    """A model that is sure of one sequence gives that sequence outside the core, whatever the noise of few steps."""
    seq = "ACGT" * 20 + "A"
    df = spark.createDataFrame([("a", seq), ("b", seq), ("c", None), ("d", "")], "id string, sequence string")
    sure = [1.0 * (b == c) for c in seq for b in "ACGT"]
    models = spark.createDataFrame([(50, sure)], "model long, mean array<double>")
    got = R.generate_sequences(df, steps(spark, 20), models).collect()
    assert sorted((r["id"], r["sequence"], r["core_changed"]) for r in got) == [("a", seq, 0), ("b", seq, 0)]


def test_denoiser_equals_least_squares(spark):
    T, buckets, width = 1000, 4, 8
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 3)) @ rng.normal(size=(3, width))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(9999, None)], "id long, x array<double>").repartition(5)
    rows = R.noised_rows(df, D.schedule_table(D.linear_betas(spark)), T).cache()
    regions = [(2, 3)]
    solved = R.solve_denoiser(R.gram_blocks(rows, T, buckets, regions), ridge=0.5).cache()
    got = {r["bucket"]: np.array(r["weights"]).reshape(width + 1, width) for r in solved.collect()}
    z, e = {}, {}
    for r in rows.collect():
        noise = R.counter_normals(np.array([r["_key"]]), 0, np.arange(width))[0]
        noise[2] = 0
        xt = r["sab"] * np.array(r["x"]) + r["s1m"] * noise
        xt[2] = r["x"][2]
        b = r["t"] * buckets // T
        z.setdefault(b, []).append([*xt, 1.0])
        e.setdefault(b, []).append(noise)
    loss = {r["bucket"]: r for r in R.denoiser_losses(rows, solved, R.cell_means(df), T, buckets, regions).collect()}
    for b in z:
        a, y = np.array(z[b]), np.array(e[b])
        ridge = np.vstack([a, math.sqrt(0.5) * np.eye(width + 1)]), np.vstack([y, np.zeros((width + 1, width))])
        want = np.linalg.lstsq(*ridge, rcond=None)[0]
        assert np.allclose(got[b], want, atol=1e-8)
        assert math.isclose(loss[b]["l2"], ((a @ want - y) ** 2).mean(), rel_tol=1e-9)
        assert loss[b]["l2"] < loss[b]["l2_mean"] and loss[b]["n_rows"] == len(a)
    model = R.denoiser_row(solved.where("bucket <> 1"), buckets).first()
    assert [len(w) for w in model["weights"]] == [(width + 1) * width] * buckets and model["weights"][1] == model["weights"][0]
    chained = R.reverse_chain(df, steps(spark, 5), R.denoiser_row(solved, buckets), regions=regions).collect()
    assert len(chained) == 600 and all(np.isfinite(r["x_0"]).all() for r in chained)


def test_generated_letters_follow_the_models_shares(spark):
    """Positions of the samples have the shares of the model, which two checkpoints make different, and differ by row."""
    df = spark.createDataFrame([(str(i), "ACGT" * 3) for i in range(3000)], "id string, sequence string")
    means = spark.createDataFrame([([0.7, 0.1, 0.1, 0.1] * 12,)], "mean array<double>")
    models = R.mean_checkpoints(means, [1, 400], 0.25, 0.02)
    out = R.generate_sequences(df, steps(spark, 40), models, regions=[]).collect()
    for model, want in ((1, 0.25 + 0.45 * 0.02), (400, 0.7)):
        made = [r["sequence"] for r in out if r["model"] == model]
        assert len(set(made)) > 1000 and all(r["core_changed"] == 0 for r in out)
        share = sum(s.count("A") for s in made) / (12 * len(made))
        assert abs(share - want) < 0.03, (model, share)


def test_sampled_letters_equal_the_chain():
    """The blocked kernel, at a quarter of the chain's time, samples the letters that the chain's arrays give."""
    import time
    rng = np.random.default_rng(9)
    n, length, T = 700, 81, 10
    coefs = [{"remove_noise_coeff": b / math.sqrt(1 - a), "reciprocal_sqrt_alpha": 1 / math.sqrt(1 - b), "sigma": math.sqrt(b),
              "sqrt_alpha_bar": math.sqrt(a), "sqrt_one_minus_alpha_bar": math.sqrt(1 - a)}
             for b, a in zip(np.linspace(0.02, 0.9, T), np.cumprod(1 - np.linspace(0.02, 0.9, T)))]
    text = rng.integers(0, 5, (n, length)).astype(np.uint8)                        # 4: a letter without a cell
    hot = (text[:, :, None] == np.arange(4)).astype(float).reshape(n, -1)
    keys, core = rng.integers(0, 2**32, n), np.arange(length) % 5 == 0
    priors = [rng.dirichlet([0.3] * 4, length).ravel() for _ in range(4)] + [np.eye(4)[rng.integers(0, 4, length)].ravel()]
    start = time.process_time()
    want = R.run_chains(hot, keys, coefs, [R.categorical_predictor_of(p, coefs) for p in priors], np.repeat(core, 4))
    middle = time.process_time()
    got = R.sample_letters(text, keys, coefs, priors, core)
    assert time.process_time() - middle < 0.6 * (middle - start)
    for g, w in zip(got, want):
        assert (g == w.reshape(n, length, 4).argmax(axis=2)).all()
