"""K-mer logistic regression for all (fold, regParam) models at once, by Newton's method.

The rows become packed k-mer counts, written once.  Every iteration is one pass over them: a task adds up the
gradient and Hessian of all models whose training rows it holds (a model of fold f trains on the other folds),
one block per model is shuffled, and the reducer that has a model's sum solves for its step, so that only the
coefficients (models x (4^k + 1) numbers) reach the driver and go out again with the next pass.

The objective is Spark ML's: mean log loss + regParam / 2 x the squared coefficients of the features divided by
their standard deviation over the training rows; the intercept is free and constant features get 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.operators.kernels import NONE, batches_of, code_matrix
from seqspark.operators.metrics import roc_auc
from seqspark.session import materialize

MAX_ITER = 30
TOLERANCE = 1e-9                # of the mean gradient's largest entry
ROWS = 4096


def kmer_features(df: DataFrame, k: int, fold_col: str = "fold", label_col: str = "label", sequence_col: str = "sequence") -> DataFrame:
    """(fold int, label int, x binary): counts of the 4^k k-mers of A, C, G, T as unsigned 32-bit integers.

    Rows without a fold or a 0/1 label are dropped; a null sequence has no k-mers.
    """
    rows = df.where(F.col(fold_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(fold_col).cast("int").alias("fold"), F.col(label_col).cast("int").alias("label"), F.col(sequence_col).alias("s"))
    size = 4 ** k

    def run(batches):
        for b in batches_of(batches, ROWS):
            codes, _ = code_matrix(b.column(2).to_pylist())
            n, at = len(codes), max(0, codes.shape[1] - k + 1)
            word, ok = np.zeros((n, at), np.int64), np.ones((n, at), bool)
            for i in range(k):
                part = codes[:, i:i + at]
                word, ok = word * 4 + part % 4, ok & (part != NONE)
            row = np.broadcast_to(np.arange(n)[:, None], word.shape)
            x = np.bincount((row * size + word)[ok], minlength=n * size).astype("<u4").reshape(n, size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["fold", "label", "x"])

    return rows.mapInArrow(run, "fold int, label int, x binary")


def _matrix(b) -> np.ndarray:
    """Counts of a batch with a last column of ones."""
    x = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(b.num_rows, -1)
    return np.hstack([x, np.ones((b.num_rows, 1))])


def _summed(parts: DataFrame, key: str, finish, schema: str) -> DataFrame:
    """Add up the packed doubles of ``parts(key, v binary)`` per key; ``finish(key, sum)`` gives the output rows."""
    def run(batches):
        sums: dict = {}
        for b in batches:
            for name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.frombuffer(v)
                sums[name] = sums[name] + a if name in sums else a
        for name, total in sums.items():
            yield finish(name, total)

    return parts.repartition(key).mapInArrow(run, schema)


def fold_moments(features: DataFrame) -> dict[int, np.ndarray]:
    """Per fold: sums, sums of squares (the ones column last: n) and the number of positives."""
    def run(batches):
        sums: dict = {}
        for b in batches_of(batches, ROWS):
            x, fold, y = _matrix(b), b.column(0).to_numpy(), b.column(1).to_numpy()
            for f in np.unique(fold).tolist():
                m = x[fold == f]
                part = np.concatenate([m.sum(axis=0), (m * m).sum(axis=0), [y[fold == f].sum()]])
                sums[f] = sums.get(f, 0) + part
        for f, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([np.asarray(v, float).tobytes()], pa.binary())], names=["k", "v"])

    whole = _summed(features.mapInArrow(run, "k int, v binary"), "k", lambda f, v: pa.RecordBatch.from_arrays(
        [pa.array([f], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "v"]), "k int, v binary")
    return {r["k"]: np.frombuffer(bytes(r["v"])) for r in whole.collect()}          # folds x (2 x 4^k + 3) numbers


def fit_models(features: DataFrame, reg_params: Sequence[float], max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> list[dict]:
    """All (trial, fold) models: trial_id from 1, fold, reg_param, coef, intercept, n_train, n_pos, n_test, gradient, iterations."""
    moments = fold_moments(features)
    if not moments:
        return []
    total = sum(moments.values())
    d = (len(total) - 3) // 2
    models = []
    for trial, reg in enumerate(reg_params, 1):
        for fold in sorted(moments):
            train = total - moments[fold]
            n = train[d]
            mean = train[:d] / max(n, 1)
            var = np.maximum(train[d + 1:2 * d + 1] - n * mean * mean, 0) / max(n - 1, 1)
            var[var < 1e-12] = 0
            models.append({"trial_id": trial, "fold": fold, "reg_param": float(reg), "n_train": int(n), "n_pos": int(train[-1]),
                           "n_test": int(moments[fold][d]), "var": var, "beta": np.zeros(d + 1), "gradient": np.inf, "iterations": 0})
    models = [m for m in models if 0 < m["n_pos"] < m["n_train"]]
    for _ in range(max_iter):
        todo = [i for i, m in enumerate(models) if m["gradient"] > tol]
        if not todo:
            break
        for r in _newton(features, models, todo).collect():                         # models x (4^k + 2) numbers
            m = models[r["model"]]
            step = np.frombuffer(bytes(r["v"]))
            m["gradient"] = float(step[-1])
            if m["gradient"] > tol:
                m["beta"] = m["beta"] - step[:-1]
                m["iterations"] += 1
    return models


def _newton(features: DataFrame, models: list[dict], todo: list[int]) -> DataFrame:
    """(model, step and largest mean-gradient entry) of the models ``todo`` from one pass."""
    now = [(i, models[i]["fold"], models[i]["beta"]) for i in todo]
    ridge = {i: (models[i]["n_train"], models[i]["reg_param"] * models[i]["var"], models[i]["beta"]) for i in todo}

    def run(batches):
        sums: dict = {}
        for b in batches_of(batches, ROWS):
            x, fold, y = _matrix(b), b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, held_out, beta in now:
                mine = fold != held_out
                z, t = x[mine], y[mine]
                p = 1.0 / (1.0 + np.exp(-(z @ beta)))
                part = np.vstack([(z * (p * (1 - p))[:, None]).T @ z, (p - t) @ z])
                sums[i] = sums[i] + part if i in sums else part
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["model", "v"])

    def finish(i, v):
        n, penalty, beta = ridge[i]
        d = len(beta) - 1
        h, g = v.reshape(-1, d + 1)[:-1] / n, v.reshape(-1, d + 1)[-1] / n
        free = np.append(penalty > 0, True) if (penalty > 0).any() else np.append(np.diag(h)[:-1] > 0, True)
        g = np.where(free, g + np.append(penalty, 0.0) * beta, 0.0)
        step = np.zeros(d + 1)
        at = np.flatnonzero(free)
        step[at] = np.linalg.lstsq((h + np.diag(np.append(penalty, 0.0)))[np.ix_(at, at)], g[at], rcond=None)[0]
        out = np.append(step, np.abs(g).max())
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["model", "v"])

    return _summed(features.mapInArrow(run, "model int, v binary"), "model", finish, "model int, v binary")


def held_out_scores(features: DataFrame, models: list[dict]) -> DataFrame:
    """(trial_id, fold, label, score): every row scored by the models that did not train on its fold."""
    by_fold: dict = {}
    for m in models:
        by_fold.setdefault(m["fold"], []).append((m["trial_id"], m["beta"]))

    def run(batches):
        for b in batches_of(batches, ROWS):
            x, fold = _matrix(b), b.column(0).to_numpy()
            for f in np.unique(fold).tolist():
                at = np.flatnonzero(fold == f)
                for trial, beta in by_fold.get(f, []):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), trial, np.int32)), pa.array(np.full(len(at), f, np.int32)),
                         b.column(1).take(pa.array(at)), pa.array(x[at] @ beta)], names=["trial_id", "fold", "label", "score"])

    return features.mapInArrow(run, "trial_id int, fold int, label int, score double")


def kmer_models(df: DataFrame, reg_params: Sequence[float], k: int = 4, fold_col: str = "fold", label_col: str = "label",
                sequence_col: str = "sequence", max_iter: int = MAX_ITER) -> tuple[DataFrame, DataFrame]:
    """(models, held-out AUC per model): trial_id, fold, reg_param, n_train, n_pos, n_test, gradient, intercept, coefficients, auc."""
    spark = df.sparkSession
    features = materialize(kmer_features(df, k, fold_col, label_col, sequence_col))
    models = fit_models(features, reg_params, max_iter)
    rows = [(m["trial_id"], m["fold"], m["reg_param"], m["n_train"], m["n_pos"], m["n_test"], m["gradient"],
             float(m["beta"][-1]), m["beta"][:-1].tolist()) for m in models]
    table = spark.createDataFrame(rows, "trial_id int, fold int, reg_param double, n_train long, n_pos long, n_test long, "
                                        "gradient double, intercept double, coefficients array<double>")
    auc = roc_auc(held_out_scores(features, models), group_cols=["trial_id", "fold"]).select("trial_id", "fold", "auc")
    return table, auc


def kmer_classifier_search(df: DataFrame, reg_params: Sequence[float], k: int = 4, folds_col: str = "fold",
                           label_col: str = "label", sequence_col: str = "sequence", max_iter: int = MAX_ITER) -> DataFrame:
    """X4 search x k-fold: (trial_id, reg_param, mean_auc, std_auc over the folds), one row per trial."""
    models, auc = kmer_models(df, reg_params, k, folds_col, label_col, sequence_col, max_iter)
    per = models.select("trial_id", "fold", "reg_param").join(auc, ["trial_id", "fold"], "left")
    return per.groupBy("trial_id", "reg_param").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))
