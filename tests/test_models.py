"""Newton-fitted k-mer models against Spark ML, isolation of failing models, Arrow kernels on awkward rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import kernels as K
from seqspark.operators import logistic as L
from seqspark.operators import scoring as Sc
from seqspark.operators.validation import validate_models


def table(spark, n=240):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        rows.append((f"i{i}", "".join(rng.choice("ACGT" if y else "AACGTN") for _ in range(rng.randint(5, 40))), y, 1 + i % 3))
    rows += [("z1", None, 1, 1), ("z2", "", 0, 2), ("z3", "AC", None, 1), ("z4", "ACGT", 1, None)]
    return rows, spark.createDataFrame(rows, "id string, sequence string, label int, fold int").repartition(3)


def test_newton_equals_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.linalg import Vectors, VectorUDT
    rows, df = table(spark)
    models, auc = L.kmer_models(df, [0.02, 0.5], k=2)
    models, auc = models.collect(), {(r["trial_id"], r["fold"]): r["auc"] for r in auc.collect()}
    assert len(models) == 6 and all(m["gradient"] <= 1e-9 and m["n_train"] + m["n_test"] == 242 for m in models)
    words = [a + b for a in "ACGT" for b in "ACGT"]

    def vector(s):
        return Vectors.dense([sum(s[i:i + 2] == w for i in range(len(s) - 1)) for w in words])
    vec = F.udf(lambda s: vector(s or ""), VectorUDT())
    data = df.where("label is not null and fold is not null").select("fold", F.col("label").cast("double").alias("label"), vec("sequence").alias("features")).cache()
    for m in models[:1] + models[4:5]:
        fit = LogisticRegression(regParam=m["reg_param"], maxIter=500, tol=1e-12).fit(data.where(F.col("fold") != m["fold"]))
        assert np.allclose(fit.coefficients.toArray(), m["coefficients"], atol=1e-5)
        assert abs(fit.intercept - m["intercept"]) < 1e-5
        a = BinaryClassificationEvaluator().evaluate(fit.transform(data.where(F.col("fold") == m["fold"])))
        assert abs(a - auc[m["trial_id"], m["fold"]]) < 2e-3                # the evaluator bins its curve


def test_models_of_edge_tables(spark):
    schema = "id string, sequence string, label int, fold int"
    assert L.kmer_classifier_search(spark.createDataFrame([], schema), [0.1], k=2).count() == 0
    one_class = spark.createDataFrame([("a", "ACGT", 1, 1), ("b", "AACC", 1, 2)], schema)
    assert L.fit_models(L.kmer_features(one_class, 2), [0.1]) == []
    counted = L.kmer_features(spark.createDataFrame([("a", "A" * 70_000, 1, 1), ("b", "ACNGT", 0, 1)], schema), 2).collect()
    got = sorted(np.frombuffer(bytes(r["x"]), "<u4").sum() for r in counted)
    assert got == [2, 69_999]


def test_a_raising_model_fails_alone(spark):
    ok = spark.createDataFrame([(0.5, 2)], "acc double, n long")
    boom = F.udf(lambda x: 1 / (x - 2), "double")

    def broken():
        raise ValueError("no sheet")
    jobs = {"a": lambda: ok, "b": broken, "c": lambda: spark.range(5).select(F.max(boom("id")).alias("acc"), F.count("*").alias("n")),
            "d": lambda: ok.limit(0), "e": lambda: ok}
    got = {r["model"]: r for r in validate_models(spark, jobs, parallelism=3).collect()}
    assert [k for k in got if got[k]["error"] is None] == ["a", "e"] and got["e"]["acc"] == 0.5
    assert "no sheet" in got["b"]["error"] and got["c"]["error"] and "0 result rows" in got["d"]["error"]
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_position_counts_and_scores_of_awkward_rows(spark):
    rows = [("a", "ACGT"), ("a", "AXé"), ("b", None), ("b", ""), (None, "TT"), (None, "TT")]
    df = spark.createDataFrame(rows, "g string, sequence string").repartition(2)
    got = {(r["g"], r["pos"]): tuple(r[c] for c in ("n_A", "n_C", "n_G", "n_T", "n")) for r in K.position_counts(df, group_cols=["g"]).collect()}
    assert got == {("a", 0): (2, 0, 0, 0, 2), ("a", 1): (0, 1, 0, 0, 2), ("a", 2): (0, 0, 1, 0, 2), ("a", 3): (0, 0, 0, 1, 1),
                   (None, 0): (0, 0, 0, 2, 2), (None, 1): (0, 0, 0, 2, 2)}
    w = spark.createDataFrame([(0, "A", 1.0), (0, "C", -1.0), (1, "C", 0.5)], "pos int, base string, w double")
    eff = Sc.mutation_effects(df.where("sequence is not null").withColumn("id", F.monotonically_increasing_id()), w)
    want = {(r["pos"], r["alt"]): r for r in eff.groupBy("pos", "alt").agg(
        F.count("*").alias("n"), F.avg("delta").alias("d"), F.avg("dp").alias("p")).collect()}
    out = Sc.mutation_summary(df, w).collect()
    assert {(r["pos"], r["alt"]) for r in out} == set(want)
    for r in out:
        x = want[r["pos"], r["alt"]]
        assert r["n_variants"] == x["n"] and r["mean_delta"] == pytest.approx(x["d"], abs=1e-12) and r["mean_dp"] == pytest.approx(x["p"], abs=1e-12)
    empty = df.limit(0)
    assert Sc.mutation_summary(empty, w).count() == 0 and K.position_counts(empty).count() == 0
    none = w.limit(0)
    scored = Sc.batch_score(df.withColumn("id", F.lit(1)), Sc.PWMScorer.from_array, model=Sc.weight_row(none)).collect()
    assert [r["score"] for r in scored] == [0.0] * 6
