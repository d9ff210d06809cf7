"""Column functions on hand-made edge rows (FIXTURES C)."""
import math

import pytest

from seqspark.functions import dna as D
from seqspark.functions import numeric as N


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def py_clean(s):
    import re
    s = str(s).upper().strip()
    s = re.sub(r"\s+", "", s)
    return re.sub(r"[^ACGTN]", "N", s)


@pytest.mark.parametrize("raw", ["acgt", " ac\tg\nt ", "ACGU", "aßc", "A C G\x1cT", "xyz", "", "  "])
def test_clean_dna_matches_python(spark, raw):
    assert one(spark, D.clean_dna("s"), raw) == py_clean(raw)


def test_clean_dna_null_stays_null(spark):
    assert one(spark, D.clean_dna("s"), None) is None


@pytest.mark.parametrize("seq,k", [("ACGTAC", 3), ("ACG", 3), ("AC", 3), ("", 2), ("ACGTN", 1)])
def test_kmers(spark, seq, k):
    expected = [seq[i:i + k] for i in range(len(seq) - k + 1)]
    assert one(spark, D.kmers("s", k), seq) == expected


def test_tiles_cover_whole_string(spark):
    s = "A" * 81 + "C" * 81 + "GT"
    assert one(spark, D.tiles("s", 81), s) == ["A" * 81, "C" * 81, "GT"]
    assert one(spark, D.tiles("s", 81), "") == []


def test_one_hot_and_decode(spark):
    m = one(spark, D.one_hot("s"), "acgtN")
    assert m == [[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0]]
    df = spark.createDataFrame([("ACGTTGCA",), ("ANNC",)], "s string")
    out = [r[0] for r in df.select(D.decode_one_hot(D.one_hot("s"))).collect()]
    assert out == ["ACGTTGCA", "AAAC"]      # all-zero column decodes to A


def test_decode_ties_first_row_wins(spark):
    df = spark.createDataFrame([([[0.5, 0.1], [0.5, 0.9], [0.1, 0.9], [0.0, 0.2]],)], "m array<array<double>>")
    assert df.select(D.decode_one_hot("m")).first()[0] == "AC"


def test_pad_truncate(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    r = df.select(*D.pad_truncate("t", 5, side="right")).first()
    assert r[0] == ["a", "b", "c", "<pad>", "<pad>"] and r[1] == [1, 1, 1, 0, 0]
    r = df.select(*D.pad_truncate("t", 5, side="left")).first()
    assert r[0] == ["<pad>", "<pad>", "a", "b", "c"] and r[1] == [0, 0, 1, 1, 1]
    r = df.select(*D.pad_truncate("t", 2)).first()
    assert r[0] == ["a", "b"] and r[1] == [1, 1]


def test_prompt_and_label_name(spark):
    assert one(spark, D.prompt_text("s", "  Hello. "), "ACG") == "Hello. ACG"
    assert one(spark, D.prompt_text("s", None), "ACG") == "ACG"
    df = spark.createDataFrame([(0,), (1,), (2,)], "y int")
    assert [r[0] for r in df.select(D.label_name("y")).collect()] == ["weak_promoter", "strong_promoter", None]


def test_softmax_and_argmax_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 2.0), (1000.0, -1000.0)], "a double, b double")
    rows = df.select(*N.softmax2("a", "b"), N.argmax2("a", "b")).collect()
    assert rows[0][0] == pytest.approx(0.5) and rows[0][2] == 0          # tie -> weak
    assert rows[1][1] == pytest.approx(math.exp(2) / (1 + math.exp(2))) and rows[1][2] == 1
    assert rows[2][0] == pytest.approx(1.0) and not math.isnan(rows[2][1])
    arr = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(N.softmax("x")).first()[0]
    assert sum(arr) == pytest.approx(1.0) and arr[2] > arr[1] > arr[0]
