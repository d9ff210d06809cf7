"""Sequence scoring: a position-weight-matrix classifier, the batch scorer and mutation importance
(X1, X2, R1, R2).

The model weights (positions x 4 bases) are bounded by the sequence length,
not by the data, so they are safe to broadcast or to ship to Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions.dna import BASES, chars
from seqspark.operators.delivery import with_model
from seqspark.operators.kernels import grouped_scores, position_counts, substitution_sums


def pwm_weights(train: DataFrame, sequence_col: str = "sequence", label_col: str = "label",
                pseudo: float = 1.0) -> DataFrame:
    """Log-odds weight per (pos, base): log P(base | strong, pos) - log P(base | weak, pos), add-``pseudo``.

    Counts per (class, position) by one Arrow pass; the result has at most L x 4 rows.
    """
    return _log_odds(position_counts(train.where(F.col(label_col).isin(0, 1)), sequence_col, [label_col]), label_col, F.lit(float(pseudo)), [])


def _log_odds(counts: DataFrame, label_col: str, pseudo, keys: Sequence[str]) -> DataFrame:
    """(keys..., pos, base, w) from counts per (keys..., class, position)."""
    y = F.col(label_col)
    n = counts.groupBy(*keys, "pos").agg(*[F.coalesce(F.sum(F.when(y == c, F.col(f"n_{b}"))), F.lit(0)).alias(f"n{c}_{b}")
                                           for c in (1, 0) for b in BASES])
    return _weights_of(n, pseudo, keys)


def _weights_of(n: DataFrame, pseudo, keys: Sequence[str]) -> DataFrame:
    t1 = sum((F.col(f"n1_{b}") for b in BASES), F.lit(0))
    t0 = sum((F.col(f"n0_{b}") for b in BASES), F.lit(0))
    rows = F.array(*[F.struct(F.lit(b).alias("base"), (
        F.log((F.col(f"n1_{b}") + pseudo) / (t1 + 4 * pseudo))
        - F.log((F.col(f"n0_{b}") + pseudo) / (t0 + 4 * pseudo))).alias("w")) for b in BASES])
    return n.select(*keys, F.col("pos").cast("int").alias("pos"), F.explode(rows).alias("r")).select(*keys, "pos", "r.base", "r.w")


def _base_idx(c):
    return F.instr(F.lit("ACGT"), c) - 1


def weight_row(weights: DataFrame) -> DataFrame:
    """One row: the model as a dense array<double> (index pos*4 + base); empty without weights."""
    k = (F.col("pos") * 4 + _base_idx(F.col("base"))).cast("int")
    m = F.map_from_entries(F.collect_list(F.struct(k, F.col("w"))))
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(m)) - F.array_max(F.map_keys(m)) % 4 + 3),
                        lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
    return weights.where(_base_idx(F.col("base")) >= 0).select(F.when(F.count(F.lit(1)) > 0, dense).alias("weights"))


def weight_map(weights: DataFrame):
    """The model as one dense array<double> scalar subquery (index pos*4 + base).

    At most L x 4 entries (bounded by the sequence length): computed once,
    inlined into every task; lookups are O(1) array accesses, so scoring
    needs no join and no shuffle.  Positions absent from ``weights`` get 0.
    """
    return weight_row(weights).scalar()


def _w(m, pos, base):
    i = _base_idx(base)
    return F.when(i >= 0, F.coalesce(F.try_element_at(m, (pos * 4 + i + 1).cast("int")), F.lit(0.0))) \
        .otherwise(F.lit(0.0))


def pwm_score_expr(seq, m):
    """Sum of the weights along the sequence (a narrow per-row expression)."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.aggregate(F.transform(chars(s), lambda c, i: _w(m, i, c)), F.lit(0.0), lambda a, x: a + x)


def pwm_score(df: DataFrame, weights: DataFrame, id_col: str = "id", sequence_col: str = "sequence") -> DataFrame:
    """(id, score): per-row scoring with the model array, no join and no shuffle."""
    d = df.select(id_col, sequence_col, weight_map(weights).alias("_m"))
    return d.select(id_col, pwm_score_expr(sequence_col, F.col("_m")).alias("score"))


def sigmoid(x):
    c = F.col(x) if isinstance(x, str) else x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


class PWMScorer:
    """A loaded-once batch model: scores a pandas batch of sequences with numpy."""

    def __init__(self, weights: dict[tuple[int, str], float]):
        self.L = 1 + max((p for p, _ in weights), default=-1)     # positions from 0, letters as keys
        self.table = np.zeros((max(self.L, 1), 256))
        for (p, b), w in weights.items():
            self.table[p, ord(b)] = w

    @classmethod
    def from_array(cls, values) -> PWMScorer:
        """From the dense array of ``weight_row`` (null: a model without weights)."""
        flat = [] if values is None else list(values)
        return cls({(i // 4, BASES[i % 4]): w for i, w in enumerate(flat)})

    def __call__(self, seqs: pd.Series) -> np.ndarray:
        """Vectorised: the batch becomes one (rows x L) byte matrix, scored by one gather + row sum."""
        n, L = len(seqs), self.table.shape[0]
        if n == 0:
            return np.zeros(0)
        text = "".join((s or "")[:L].ljust(L, "\0") for s in seqs.tolist())
        codes = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8).reshape(n, L)
        return self.table[np.arange(L), codes].sum(axis=1)


def batch_score(df: DataFrame, model_factory: Callable, sequence_col: str = "sequence", keep: Sequence[str] = ("id",),
                batch_size: int = 1024, model: DataFrame | None = None) -> DataFrame:
    """Score rows in Arrow batches with a model built once per task.

    ``model_factory`` is called once per partition; its result maps a pandas Series of sequences to logits.
    With ``model`` (one row and one column, bounded by the model's width) it is called with that value, which
    Spark hands to every partition's first row; without, it takes no argument (e.g. to load weights from
    shared storage).  A factory that is called with a model must accept null (an empty model).
    """
    keep = list(keep)
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*keep).dtypes) + ", score double"
    rows = df.select(*keep, F.col(sequence_col).alias("_text"))
    rows = rows if model is None else with_model(rows, _model=model)

    delivered = model is not None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None if delivered else model_factory()
        for pdf in it:
            if not len(pdf):
                continue
            if scorer is None:
                scorer = model_factory(pdf["_model"].iloc[0])
            out = pdf[keep].copy()
            out["score"] = np.concatenate([np.asarray(scorer(pdf["_text"].iloc[at:at + batch_size]), float)
                                           for at in range(0, len(pdf), batch_size)])
            yield out

    return rows.mapInPandas(run, schema)


def mutation_effects(df: DataFrame, weights: DataFrame, id_col: str = "id",
                     sequence_col: str = "sequence") -> DataFrame:
    """R1 + scoring: every substitution variant with its score change under an additive model.

    score(variant) = score(wild type) - w[pos, ref] + w[pos, alt], so each of
    the 3L variants is scored without re-reading the sequence.  The wild-type
    score is computed before the explode and the model is a scalar map, so the
    3L-fold expansion stays inside the task (nothing but the final partial
    aggregates is shuffled).
    """
    cells = _cells(df, weights, sequence_col, [id_col, sequence_col])
    alts = F.array(*[F.struct(F.lit(b).alias("alt"), F.col(f"d_{b}").alias("delta")) for b in BASES])
    v = cells.select(id_col, sequence_col, "score", "pos", "ref", F.explode(alts).alias("_a")).where("_a.alt <> ref")
    variant = F.overlay(F.col(sequence_col), F.col("_a.alt"), F.col("pos") + 1, F.lit(1))
    return v.select(id_col, "score", "pos", "ref", F.col("_a.alt").alias("alt"), variant.alias("variant"),
                    F.col("_a.delta").alias("delta"),
                    F.abs(sigmoid(F.col("score") + F.col("_a.delta")) - sigmoid("score")).alias("dp"))


def _cells(df: DataFrame, weights: DataFrame, sequence_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (sequence, position): keep..., score, pos, ref and the change d_<base> of every base.

    The changes are laid out as one small array per sequence before the explode, so an exploded row
    carries four numbers and not the model.
    """
    m = F.col("_m")   # the model array, projected once (subqueries cannot sit inside lambdas)
    d = df.select(*keep, *([] if sequence_col in keep else [sequence_col]), weight_map(weights).alias("_m"))
    cell = F.transform(chars(sequence_col), lambda c, i: F.struct(
        c.alias("ref"), _w(m, i, c).alias("w"), *[_w(m, i, F.lit(b)).alias(b) for b in BASES]))
    d = d.select(*keep, cell.alias("_c"))
    d = d.select(*keep, "_c", F.aggregate("_c", F.lit(0.0), lambda a, x: a + x["w"]).alias("score"))
    d = d.select(*keep, "score", F.posexplode("_c").alias("pos", "_x"))
    return d.select(*keep, "score", F.col("pos").cast("int").alias("pos"), F.col("_x.ref").alias("ref"),
                    *[(F.col(f"_x.{b}") - F.col("_x.w")).alias(f"d_{b}") for b in BASES])


def window_mask_effects(df: DataFrame, weights: DataFrame, window: int, id_col: str = "id",
                        sequence_col: str = "sequence") -> DataFrame:
    """R1 window masks: for every start p the variant with cells [p, p+window) set to ``M``.

    ``M`` has no weight, so score(variant) = score - (sum of the masked cells'
    weights).  The per-cell weights are computed once per sequence; each
    variant is then a ``window``-long slice sum (no re-scoring of the string).
    Output: id, pos, delta, dp (|p_mut - p_wt|).
    """
    m = F.col("_m")
    s = F.col(sequence_col)
    base = df.select(id_col, sequence_col, weight_map(weights).alias("_m"))
    base = base.withColumn("_cw", F.transform(chars(s), lambda c, i: _w(m, i, c)))
    base = base.withColumn("score", F.aggregate("_cw", F.lit(0.0), lambda a, x: a + x))
    starts = F.when(F.size("_cw") >= window, F.sequence(F.lit(0), F.size("_cw") - window)) \
        .otherwise(F.array().cast("array<int>"))
    v = base.select(id_col, "score", "_cw", F.explode(starts).alias("pos"))
    masked = F.aggregate(F.slice("_cw", F.col("pos") + 1, F.lit(window)), F.lit(0.0), lambda a, x: a + x)
    v = v.withColumn("delta", -masked)
    return v.select(id_col, F.col("pos").cast("int").alias("pos"), "delta",
                    F.abs(sigmoid(F.col("score") + F.col("delta")) - sigmoid("score")).alias("dp"))


def mutation_summary(df: DataFrame, weights: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    """R1 aggregated: per (pos, alt) the number of variants, mean score change and mean |p_mut - p_wt|.

    Same numbers as aggregating ``mutation_effects``.  The score change of a substitution depends on its position
    and letters only, so its mean comes from the letter counts; the probability change is summed in one Arrow pass
    over byte matrices, and nothing is exploded.  Null sequences have no variants.
    """
    sums = substitution_sums(df, weight_row(weights), sequence_col)
    per = weights.groupBy("pos").agg(*[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("w"))), F.lit(0.0)).alias(f"w_{b}") for b in BASES])
    g = sums.join(per, "pos", "left").na.fill(0.0)
    structs = []
    for b in BASES:
        others = [c for c in BASES if c != b]
        n = sum((F.col(f"ref_{c}") for c in others), F.col("ref_other"))
        change = sum((F.col(f"ref_{c}") * (F.col(f"w_{b}") - F.col(f"w_{c}")) for c in others), F.col("ref_other") * F.col(f"w_{b}"))
        structs.append(F.struct(F.lit(b).alias("alt"), n.cast("bigint").alias("n_variants"), F.try_divide(change, n).alias("mean_delta"),
                                F.try_divide(F.col(f"p_{b}"), n).alias("mean_dp"), F.col(f"p_{b}").alias("sum_dp")))
    return g.select("pos", F.explode(F.array(*structs)).alias("r")).select("pos", "r.*").where("n_variants > 0")


def cv_pwm_search(df: DataFrame, pseudos: Sequence[float], fold_col: str = "fold", id_col: str = "id",
                  sequence_col: str = "sequence", label_col: str = "label") -> DataFrame:
    """Hyper-parameter search x k-fold cross-validation of the PWM classifier in one job.

    PWM counts are additive and do not depend on the hyper-parameter (the
    pseudo-count), so one pass by (fold, class) fits every (trial, fold)
    model: the model of fold f is (all counts) - (counts of fold f).  Each
    row is scored by every trial's model of its held-out fold in an Arrow kernel, to which the
    folds x trials x L x 4 weights come with each partition's first row.  Folds are integers from 0.
    Output: trial_id (1-based), pseudo, id, fold, label, score, predicted_label.
    """
    from pyspark.sql import Window
    data = df.select(id_col, fold_col, label_col, sequence_col)
    by = position_counts(data.where(F.col(label_col).isin(0, 1)), sequence_col, [fold_col, label_col])
    y = F.col(label_col)
    names = [f"n{c}_{b}" for c in (1, 0) for b in BASES]
    per_fold = by.groupBy(F.col(fold_col).alias("fold"), "pos").agg(*[
        F.coalesce(F.sum(F.when(y == c, F.col(f"n_{b}"))), F.lit(0)).alias(f"n{c}_{b}") for c in (1, 0) for b in BASES])
    w = Window.partitionBy("pos")    # k rows per position
    train = per_fold.select("fold", "pos", *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in names])
    trials = F.array(*[F.struct(F.lit(i + 1).alias("trial_id"), F.lit(float(p)).alias("pseudo")) for i, p in enumerate(pseudos)])
    train = train.select("*", F.explode(trials).alias("_t")).select("*", "_t.trial_id", "_t.pseudo")
    weights = _weights_of(train, F.col("pseudo"), ["trial_id", "fold"])
    k = (F.col("pos") * 4 + _base_idx(F.col("base"))).cast("int")
    per = weights.groupBy("trial_id", "fold").agg(F.map_from_entries(F.collect_list(F.struct(k, F.col("w")))).alias("_mm"))
    dense = per.select("fold", "trial_id", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_mm"))),
                                                       lambda i: F.coalesce(F.try_element_at("_mm", i), F.lit(0.0))).alias("weights"))
    models = dense.agg(F.sort_array(F.collect_list(F.struct(F.col("fold").cast("int").alias("fold"), "trial_id", "weights"))).alias("models"))
    scored = grouped_scores(data, models, fold_col, [id_col, fold_col, label_col], sequence_col)
    pseudo = F.array(*[F.lit(float(p)) for p in pseudos])
    return scored.select("trial_id", F.element_at(pseudo, F.col("trial_id")).alias("pseudo"), id_col, fold_col, label_col, "score",
                         F.when(F.col("score") > 0, 1).otherwise(0).alias("predicted_label"))


def cv_pwm_predictions(df: DataFrame, fold_col: str = "fold", id_col: str = "id",
                       sequence_col: str = "sequence", label_col: str = "label",
                       pseudo: float = 1.0) -> DataFrame:
    """k-fold cross-validated scoring: every row scored by the model fitted without its fold."""
    out = cv_pwm_search(df, [pseudo], fold_col, id_col, sequence_col, label_col)
    return out.drop("trial_id", "pseudo")


def position_importance(effects: DataFrame) -> DataFrame:
    """R2: importance(pos) = mean |p_mut - p_wt| over all variants at the position."""
    return effects.groupBy("pos").agg(F.avg("dp").alias("importance"), F.count(F.lit(1)).alias("n_variants"))


def core_regions(importance: DataFrame, quantile: float = 0.75, score_col: str = "importance",
                 mean_col: str | None = None) -> DataFrame:
    """R2: positions with ``score_col`` >= its ``quantile`` over all positions, merged to [start, end);
    ``mean_importance`` averages ``mean_col`` (default ``score_col``) over each region."""
    mean_col = mean_col or score_col
    from pyspark.sql import Window
    q = importance.select(F.percentile(score_col, F.lit(quantile)).alias("_thr")).scalar()
    core = importance.where(F.col(score_col) >= q)
    # at most L positions; the sum and the count ride through the aggregate that merges the islands
    island = F.col("pos") - F.row_number().over(Window.orderBy("pos"))
    return core.withColumn("_island", island).groupBy("_island").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.avg(mean_col).alias("mean_importance")).drop("_island")
