"""The keyed permutation: one-to-one for every n, invertible, another one per tweak, equal in both engines."""
import pytest
from pyspark.sql import functions as F

from seqspark.functions.permute import permute, sql_permuted


def test_bijection_for_every_n(spark):
    rows = spark.range(1, 70).withColumnRenamed("id", "n").withColumn("x", F.explode(F.expr("sequence(0L, n - 1)")))
    out = rows.withColumn("y", permute("x", "n", seed=5)).withColumn("back", permute("y", "n", seed=5, inverse=True))
    per_n = out.groupBy("n").agg(F.countDistinct("y").alias("d"), F.min("y").alias("lo"), F.max("y").alias("hi"),
                                 F.count_if(F.col("back") != F.col("x")).alias("bad")).collect()
    assert len(per_n) == 69
    assert all(r["d"] == r["n"] and r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["bad"] == 0 for r in per_n)


def test_spread_and_tweak(spark):
    n = 10_007
    got = [r[0] for r in spark.range(n).select(permute("id", n, 1, 0)).collect()]
    other = [r[0] for r in spark.range(n).select(permute("id", n, 1, 1)).collect()]
    assert sorted(got) == sorted(other) == list(range(n))
    assert sum(a == b for a, b in zip(got, other)) < 20 and sum(a == i for i, a in enumerate(got)) < 20
    gaps = [abs(a - b) for a, b in zip(got, got[1:])]
    assert 0.28 < sum(gaps) / len(gaps) / n < 0.39                # neighbours of a random order lie n / 3 apart
    halves = sum(a < n // 2 for a in got[:n // 2]) / (n // 2)
    assert 0.46 < halves < 0.54


def test_large_n_null_and_outside(spark):
    n = (1 << 50) + 12345
    df = spark.createDataFrame([(0,), (n - 1,), (1 << 49,), (None,)], "x long")
    r = df.withColumn("y", permute("x", n, 9)).withColumn("b", permute("y", n, 9, inverse=True)).collect()
    assert all(x["y"] is None if x["x"] is None else 0 <= x["y"] < n and x["b"] == x["x"] for x in r)
    with pytest.raises(Exception, match="permute"):
        spark.range(5).select(permute("id", 4)).collect()


def test_twin(spark):
    import duckdb
    sql = sql_permuted("p", "src", "x", "n", "y", seed=3, tweak="e")
    con = duckdb.connect()
    con.execute("CREATE TABLE src AS SELECT x, n, e FROM (SELECT unnest([1, 2, 3, 7, 100, 1000]) AS n), range(0, 1000) r(x), "
                "(SELECT unnest([0, 1, 4]) AS e) WHERE x < n")
    want = sorted(con.execute(f"WITH RECURSIVE {sql} SELECT n, e, x, y FROM p").fetchall())
    src = spark.createDataFrame(con.execute("SELECT x, n, e FROM src").fetchall(), "x long, n long, e long")
    got = sorted(tuple(r) for r in src.select("n", "e", "x", permute("x", "n", 3, F.col("e"))).collect())
    assert got == want
