"""Cleaning (conflicts, first-row dedup, reports) and k-mer statistics."""
import math

import numpy as np
import pandas as pd
import pytest

from seqspark.operators import clean as C
from seqspark.operators import kmers as K

L = 4


@pytest.fixture()
def labeled(spark):
    strong = spark.createDataFrame([("s1", "acgt"), ("s2", "AAAA"), ("s3", "CCCC"), ("s4", None),
                                    ("s5", "  "), ("s6", "ACG")], "id string, sequence string")
    weak = spark.createDataFrame([("w1", "AAAA"), ("w2", "GGGG"), ("w3", "GGGG"), ("w4", "CCCC "),
                                  ("w5", "TTTTT")], "id string, sequence string")
    return C.load_labeled(strong, weak)


def test_pipeline_semantics(spark, labeled):
    out = {r["sequence"]: (r["id"], r["label"]) for r in C.clean_pipeline(labeled, L).collect()}
    # AAAA and CCCC (after whitespace removal) carry both labels -> all their rows go;
    # GGGG twice with one label -> the first stays
    assert out == {"ACGT": ("s1", 1), "GGGG": ("w2", 0)}


def test_fused_equals_two_step(spark, labeled):
    c = C.length_filter(C.clean_column(labeled), L)
    two = C.dedup_first(C.remove_conflicts(c), ["source_rank", "row_order"])
    one = C.resolve_sequences(c, ["source_rank", "row_order"])
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, one.select(*two.columns).collect()))


def test_clean_report(spark, labeled):
    r = C.clean_report(labeled, L).first().asDict()
    assert r == {"n_input": 11, "n_empty": 2, "n_length_removed": 2, "n_conflict_sequences": 2,
                 "n_conflict_rows": 4, "n_duplicates": 1, "n_output": 2}


def test_empty_guard(spark, labeled):
    with pytest.raises(ValueError):
        C.ensure_not_empty(C.length_filter(C.clean_column(labeled), 99))


def test_label_counts_and_describe(spark):
    df = spark.createDataFrame([(1, 3), (1, 5), (0, 8), (None, 9), (1, 10)], "label int, seq_len int")
    assert [tuple(r) for r in C.label_counts(df).collect()] == [(1, 3), (0, 1)]
    d = C.length_describe(df).first().asDict()
    s = pd.Series([3, 5, 8, 9, 10], dtype=float).describe()
    for k, pk in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                  ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert d[k] == pytest.approx(s[pk])


def pearson_bruteforce(a, b, k):
    def freq(seqs):
        c = {}
        for s in seqs:
            for i in range(len(s) - k + 1):
                c[s[i:i + k]] = c.get(s[i:i + k], 0) + 1
        t = sum(c.values())
        return {x: n / t for x, n in c.items()}
    fa, fb = freq(a), freq(b)
    keys = sorted(set(fa) | set(fb))
    x = np.array([fa.get(q, 0.0) for q in keys])
    y = np.array([fb.get(q, 0.0) for q in keys])
    return float(np.corrcoef(x, y)[0, 1])


def test_kmer_corr_matches_bruteforce(spark):
    a = ["ACGTACGTTA", "TTGACA", "ACG"]
    b = ["ACGTTTGACA", "GGGCCA", "AC"]
    da = spark.createDataFrame([(s,) for s in a], "sequence string")
    db = spark.createDataFrame([(s,) for s in b], "sequence string")
    for k in (1, 2, 3):
        r = K.kmer_correlation(da, db, k).first()["r"]
        assert r == pytest.approx(pearson_bruteforce(a, b, k), abs=1e-12)
    assert K.kmer_correlation(da, da, 3).first()["r"] == pytest.approx(1.0)


def test_kmer_corr_undefined_is_null(spark):
    d = spark.createDataFrame([("AAAA",)], "sequence string")
    assert K.kmer_correlation(d, d, 4).first()["r"] is None     # one k-mer in total


def test_kmer_short_sequences_and_freq(spark):
    d = spark.createDataFrame([("AC",), ("ACGA",)], "sequence string")
    f = {r["kmer"]: (r["n"], r["freq"]) for r in K.kmer_freq(d, 3).collect()}
    assert f == {"ACG": (1, 0.5), "CGA": (1, 0.5)}


def test_corpus_comparison_matches_pairwise(spark):
    rows = [("nat", "ACGTACGTTA"), ("nat", "TTGACA"), ("x", "ACGTTTGACA"), ("y", "GGGCCAAT"), ("y", "CCCC")]
    df = spark.createDataFrame(rows, "corpus string, sequence string")
    out = {(r["corpus"], r["k"]): r["r"] for r in K.corpus_comparison(df, "nat", ["x", "y"], [2, 3]).collect()}
    nat = [s for c, s in rows if c == "nat"]
    for other in ("x", "y"):
        for k in (2, 3):
            exp = pearson_bruteforce(nat, [s for c, s in rows if c == other], k)
            assert out[(other, k)] == pytest.approx(exp, abs=1e-12) or (math.isnan(exp) and out[(other, k)] is None)


def test_length_report_counts_without_filtering(spark):
    df = spark.createDataFrame([("a", "ACGT", 1), ("b", "ACG", 1), ("c", "ACGTA", 0)], "id string, sequence string, g int")
    r = {x["g"]: (x["n_rows"], x["n_wrong_length"]) for x in C.length_report(df, 4, group_cols=["g"]).collect()}
    assert r == {1: (2, 1), 0: (1, 1)}


def test_corpus_counts_explode_nothing(spark):
    """k-mers of any letters are summed inside the tasks: no row per position is made."""
    from collections import Counter

    from seqspark.operators.kernels import kmer_sums
    rows = [("a", "ACGTNACGT"), ("a", "acgtß\U0001F600A"), ("a", None), ("a", ""), ("b", "AC"), ("b", "ACGTACGTACGTACGTACGTACGTACGTACGT"), (None, "TTT")]
    df = spark.createDataFrame(rows, "corpus string, sequence string").repartition(3)
    ks = [1, 2, 6, 12, 28]
    got = kmer_sums(df, ks, "corpus")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    have = Counter()
    for r in got.collect():
        have[r["corpus"], r["k"], r["kmer"]] += r["n"]
    assert have == Counter((c, k, s[i:i + k]) for c, s in rows if s for k in ks for i in range(len(s) - k + 1))
