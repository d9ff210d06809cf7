"""Splits (balance, coverage) and classification metrics vs brute force."""
import random

import pytest

from seqspark.operators import metrics as M
from seqspark.operators import split as S


def test_stratified_kfold_balanced_and_complete(spark):
    rows = [(f"id{i}", 1 if i % 10 else 0) for i in range(503)]
    df = spark.createDataFrame(rows, "id string, label int")
    f = S.stratified_kfold(df, 5, 42).toPandas()
    assert len(f) == 503 and f["id"].is_unique
    sizes = f.groupby(["label", "fold"]).size()
    for lab in (0, 1):
        s = sizes[lab]
        assert s.max() - s.min() <= 1 and len(s) == 5
    m = S.fold_membership(spark.createDataFrame(f), 5).toPandas()
    assert (m[m.role == "test"].groupby("id").size() == 1).all()


def test_sequential_split(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "id long")
    out = {r["id"]: r["split"] for r in S.sequential_split(df, ["id"]).collect()}
    assert [i for i in range(11) if out[i] == "train"] == list(range(8))


def test_batches_last_short(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id long")
    b = S.batches(df, 4, ["id"]).toPandas().groupby("batch_id").size().tolist()
    assert b == [4, 4, 2]


def brute_metrics(y, p, s):
    tp = sum(1 for a, b in zip(y, p) if a == 1 and b == 1)
    tn = sum(1 for a, b in zip(y, p) if a == 0 and b == 0)
    fp = sum(1 for a, b in zip(y, p) if a == 0 and b == 1)
    fn = sum(1 for a, b in zip(y, p) if a == 1 and b == 0)
    pos = [x for x, a in zip(s, y) if a == 1]
    neg = [x for x, a in zip(s, y) if a == 0]
    auc = (sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
           if pos and neg else None)
    return tn, fp, fn, tp, auc


def test_metrics_match_bruteforce(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.gauss(0, 1), 1)) for _ in range(300)]   # ties on purpose
    rows = [(y, s + (0.6 if y else 0.0), 1 if s > 0.2 else 0) for y, s in rows]
    df = spark.createDataFrame(rows, "label int, score double, predicted_label int")
    m = M.binary_metrics(df).first().asDict()
    tn, fp, fn, tp, auc = brute_metrics([r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows])
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (tn, fp, fn, tp)
    assert m["accuracy"] == pytest.approx((tp + tn) / len(rows))
    assert m["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert m["auc"] == pytest.approx(auc, abs=1e-12)
    flipped = df.withColumn("score", -df["score"])
    assert M.roc_auc(flipped).first()["auc"] == pytest.approx(1 - auc, abs=1e-12)


def test_metrics_degenerate(spark):
    df = spark.createDataFrame([(1, 0.3, 0), (1, 0.5, 0)], "label int, score double, predicted_label int")
    m = M.binary_metrics(df).first().asDict()
    assert m["precision"] == 0.0 and m["f1"] == 0.0 and m["mcc"] == 0.0 and m["auc"] is None


def test_model_summary_failed_row(spark):
    reg = M.registry(spark)
    res = spark.createDataFrame([("nt", 0.75, 4)], "model string, acc double, n long")
    out = {r["key"]: r["status"] for r in M.model_summary(reg, res).collect()}
    assert out["nt"] == "OK" and out["gemma"] == "FAILED" and len(out) == 4
    assert M.select_models(reg, "gemma_no_prompt").first()["key"] == "gemma"


def test_check_folds_like_sklearn(spark):
    big = spark.createDataFrame([(1,)] * 7 + [(0,)] * 3, "label int")
    with pytest.warns(UserWarning):
        S.check_folds(big, 5)
    with pytest.raises(ValueError):
        S.check_folds(big, 8)
