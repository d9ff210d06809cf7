"""Core regions, infill, mutation scan, schedules and noising."""
import math

import numpy as np
from pyspark.sql import functions as F
import pytest


from seqspark.operators import diffusion as Df
from seqspark.operators import regions as R
from seqspark.operators import scoring as Sc

SEQ = "".join("ACGT"[(i * 7) % 4] for i in range(81))


def core_of(s, regions=R.ACTIVE_REGIONS):
    return "".join(s[a:b] for a, b in regions)


def test_core_slice_and_template(spark):
    df = spark.createDataFrame([(SEQ,)], "sequence string")
    r = df.select(R.core_slice("sequence").alias("c"), R.mask_template("sequence").alias("t")).first()
    assert r["c"] == core_of(SEQ) and len(r["c"]) == 20
    assert r["t"].count("M") == 61 and core_of(r["t"]) == core_of(SEQ)


def test_random_infill_repeated_and_null_ids(spark):
    rows = [("a", "A" * 81), ("a", "C" * 81), ("a", "C" * 81), (None, "G" * 81), (None, "T" * 81), ("b", "AC" * 40 + "A")]
    out = R.random_infill(spark.createDataFrame(rows, "id string, sequence string"), seed=3).collect()
    assert sorted(r["row_idx"] for r in out) == list(range(len(rows)))
    assert sorted(map(str, (r["id"] for r in out))) == sorted(str(i) for i, _ in rows)
    assert all(len(r["sequence"]) == 81 for r in out)
    core = lambda s: "".join(s[a:b] for a, b in R.ACTIVE_REGIONS)
    assert sorted((str(r["donor_id"]), core(r["sequence"])) for r in out) == sorted((str(i), core(s)) for i, s in rows)


def test_random_infill_keeps_donor_cores(spark):
    rows = [(f"r{i}", "".join("ACGT"[(i * j + j // 3) % 4] for j in range(81))) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, sequence string")
    out = R.random_infill(df, seed=3).toPandas()
    src = dict(rows)
    assert sorted(out["donor_id"]) == sorted(src)                 # a permutation
    for _, r in out.iterrows():
        assert core_of(r["sequence"]) == core_of(src[r["donor_id"]]) and len(r["sequence"]) == 81


def test_mutation_variants_count(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "ACGTNA")], "id string, sequence string")
    v = R.mutation_variants(df).toPandas()
    assert len(v[v.id == "a"]) == 12 and len(v[v.id == "b"]) == 3 * 5 + 4   # N gets 4 alternatives
    assert set(v[(v.id == "a") & (v.pos == 0)]["variant"]) == {"CCGT", "GCGT", "TCGT"}


def test_merge_positions(spark):
    df = spark.createDataFrame([(p,) for p in (0, 1, 2, 5, 7, 8, 80)], "pos int")
    out = sorted(tuple(r) for r in R.merge_positions(df).collect())
    assert out == [(0, 3), (5, 6), (7, 9), (80, 81)]


def test_pwm_scoring_paths_agree(spark):
    rows = [(f"i{i}", "".join("ACGT"[(i + j * j) % 4] for j in range(20)), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, sequence string, label int")
    w = Sc.pwm_weights(df)
    jvm = {r["id"]: r["score"] for r in Sc.pwm_score(df, w).collect()}
    wd = {(r["pos"], r["base"]): r["w"] for r in w.collect()}
    py = {r["id"]: r["score"] for r in Sc.batch_score(df, lambda: Sc.PWMScorer(wd)).collect()}
    for k in jvm:
        assert jvm[k] == pytest.approx(py[k], abs=1e-9)
    eff = Sc.mutation_effects(df, w).toPandas()
    assert len(eff) == 30 * 20 * 3
    exp = eff.groupby(["pos", "alt"]).agg(n=("dp", "size"), d=("delta", "mean"), p=("dp", "mean"))
    got = {(r["pos"], r["alt"]): r for r in Sc.mutation_summary(df, w).collect()}
    assert len(got) == len(exp)
    for (pos, alt), e in exp.iterrows():
        g = got[(pos, alt)]
        assert g["n_variants"] == e["n"] and g["mean_delta"] == pytest.approx(e["d"]) and g["mean_dp"] == pytest.approx(e["p"])


def test_linear_schedule_endpoints(spark):
    s = {r["t"]: r for r in Df.schedule_table(Df.linear_betas(spark)).collect()}
    assert s[0]["beta"] == pytest.approx(1e-4) and s[999]["beta"] == pytest.approx(0.02)
    betas = np.linspace(1e-4, 0.02, 1000)
    assert s[999]["alpha_bar"] == pytest.approx(float(np.cumprod(1 - betas)[-1]), rel=1e-9)
    assert s[999]["alpha_bar"] == pytest.approx(4.0358e-5, rel=1e-3)


def test_cosine_schedule_matches_formula(spark):
    T, s = 1000, 0.008
    f = lambda t: math.cos((t / T + s) / (1 + s) * math.pi / 2) ** 2
    al = [f(t) / f(0) for t in range(T + 1)]
    exp = [min(1 - al[t] / al[t - 1], 0.999) for t in range(1, T + 1)]
    got = {r["t"]: r["beta"] for r in Df.cosine_betas(spark).collect()}
    assert max(abs(got[i] - exp[i]) for i in range(T)) < 1e-12


def test_forward_noise_core_frozen(spark):
    m = spark.createDataFrame([(i, [float(j % 3) for j in range(64)]) for i in range(5)], "id long, x array<double>")
    cells = Df.to_long(m, "id", "x")
    out = Df.forward_noise(cells, Df.schedule_table(Df.linear_betas(spark))).toPandas()
    core = out["pos"].apply(lambda p: any(a <= p < b for a, b in R.ACTIVE_REGIONS))
    assert (out[core]["x_t"] == out[core]["x"]).all() and (out[core]["eps"] == 0).all()
    assert out[~core]["eps"].std() > 0.5
    loss = Df.noise_loss(out.assign(eps_hat=0.0).pipe(spark.createDataFrame)).first()
    assert loss["l2"] == pytest.approx(float((out["eps"] ** 2).mean()))


def test_reverse_step_t0_has_no_noise(spark):
    sched = Df.schedule_table(Df.linear_betas(spark))
    c = spark.createDataFrame([(1, 0, 0, 0.3, 0.1)], "id long, pos int, t int, x_t double, eps_hat double")
    r = Df.reverse_step(c, sched).first()
    s0 = {x["t"]: x for x in sched.collect()}[0]
    assert r["x_prev"] == pytest.approx((0.3 - s0["remove_noise_coeff"] * 0.1) * s0["reciprocal_sqrt_alpha"])



def test_cv_scoring_equals_per_fold_fits(spark):
    rows = [(f"i{i}", "".join("ACGT"[(i * 3 + j * j + (i % 5) * j) % 4] for j in range(12)), i % 2, 1 + i % 3)
            for i in range(45)]
    df = spark.createDataFrame(rows, "id string, sequence string, label int, fold int")
    cv = {r["id"]: r["score"] for r in Sc.cv_pwm_predictions(df).collect()}
    for f in (1, 2, 3):
        train, test = df.where(f"fold <> {f}"), df.where(f"fold = {f}")
        ref = {r["id"]: r["score"] for r in Sc.pwm_score(test, Sc.pwm_weights(train)).collect()}
        for k, v in ref.items():
            assert cv[k] == pytest.approx(v, abs=1e-9)


def test_window_mask_effects_equal_full_rescoring(spark):
    rows = [(f"i{i}", "".join("ACGT"[(i + j * 3 + j * j) % 4] for j in range(15)), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, sequence string, label int")
    w = Sc.pwm_weights(df)
    fast = {(r["id"], r["pos"]): r["delta"] for r in Sc.window_mask_effects(df, w, 4).collect()}
    v = R.mutation_variants(df, window=4).where("alt = 'MMMM'")
    vs = {r["id"]: r["score"] for r in Sc.pwm_score(df, w).collect()}
    full = Sc.pwm_score(v.select(F.concat_ws(":", "id", F.col("pos").cast("string")).alias("k"),
                                 F.col("variant").alias("sequence")).withColumnRenamed("k", "id"), w)
    assert len(fast) == 20 * 12
    for r in full.collect():
        i, p = r["id"].split(":")
        assert fast[(i, int(p))] == pytest.approx(r["score"] - vs[i], abs=1e-9)


def test_masked_one_hot_values_and_illegal_base(spark):
    df = spark.createDataFrame([(1, "AMC")], "id long, template string")
    rows = {(r["pos"], r["base"]): r["value"] for r in R.masked_one_hot_long(df).collect()}
    assert rows[(0, "A")] == 1.0 and rows[(0, "C")] == 0.0 and rows[(2, "C")] == 1.0
    assert all(0.0 <= rows[(1, b)] < 1.0 for b in "ACGT") and len({rows[(1, b)] for b in "ACGT"}) == 4
    bad = spark.createDataFrame([(2, "AXC")], "id long, template string")
    with pytest.raises(Exception, match="illegal base"):
        R.masked_one_hot_long(bad).collect()


def test_kmer_classifier_search_runs_per_trial(spark):
    rows = [(f"i{i}", "".join(("AT" if i % 2 else "GC")[(i * j) % 2] for j in range(20)) + "ACGT", i % 2, 1 + i % 3)
            for i in range(60)]
    df = spark.createDataFrame(rows, "id string, sequence string, label int, fold int")
    from seqspark.operators.logistic import kmer_classifier_search
    out = kmer_classifier_search(df, [0.01, 1.0], k=2).orderBy("trial_id").collect()
    assert [r["trial_id"] for r in out] == [1, 2]
    assert all(0.0 <= r["mean_auc"] <= 1.0 for r in out) and out[0]["mean_auc"] > 0.9
