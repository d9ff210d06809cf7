"""Exact distributed row index and running aggregates vs brute force (incl. a hot group)."""
import random

import pandas as pd
import pytest

from seqspark.operators.rowindex import cumulative, cumulative_sum, with_row_index


def test_row_index_global(spark):
    data = [(i, random.Random(i).random()) for i in range(500)]
    df = spark.createDataFrame(data, "k long, v double").repartition(7)
    out = with_row_index(df, ["v", "k"], num_partitions=5).toPandas()
    exp = pd.DataFrame(data, columns=["k", "v"]).sort_values(["v", "k"]).reset_index(drop=True)
    exp["row_idx"] = range(len(exp))
    assert out.sort_values("row_idx")[["k", "row_idx"]].values.tolist() == exp[["k", "row_idx"]].values.tolist()


def test_row_index_hot_group_split_over_partitions(spark):
    # group 0 holds ~90% of the rows: it must still be numbered 1..n exactly
    data = [(0 if i % 10 else i % 7, i) for i in range(2000)]
    df = spark.createDataFrame(data, "g long, k long")
    out = with_row_index(df, ["k"], partition_by=["g"], start=1, num_partitions=6).toPandas()
    for g, part in out.groupby("g"):
        assert sorted(part["row_idx"]) == list(range(1, len(part) + 1))
        assert part.sort_values("k")["row_idx"].tolist() == list(range(1, len(part) + 1))


def test_cumulative_matches_pandas(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 2), i, rnd.random()) for i in range(600)]
    df = spark.createDataFrame(data, "g long, k long, v double")
    pdf = pd.DataFrame(data, columns=["g", "k", "v"]).sort_values(["g", "k"])
    for fn, pfn in (("sum", "cumsum"), ("max", "cummax"), ("min", "cummin")):
        out = cumulative(df, "v", ["k"], ["g"], name="c", fn=fn, num_partitions=5).toPandas()
        out = out.sort_values(["g", "k"])
        exp = getattr(pdf.groupby("g")["v"], pfn)()
        assert (out["c"].values - exp.values).__abs__().max() < 1e-9
    ex = cumulative_sum(df, "v", ["k"], ["g"], name="c", exclusive=True, num_partitions=5).toPandas()
    ex = ex.sort_values(["g", "k"])
    exp = pdf.groupby("g")["v"].cumsum() - pdf["v"]
    assert (ex["c"].values - exp.values).__abs__().max() < 1e-9


def small_batches(spark, n, run):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))     # runs cross Arrow batches
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("groups", [1, 3, 200])
@pytest.mark.parametrize("batch", [7, 10000])
def test_null_groups_are_numbered_like_row_number(spark, groups, batch):
    rnd = random.Random(groups)
    rows = [(None if rnd.random() < 0.3 else rnd.randrange(groups), rnd.choice([None, float("nan"), 1.5, 2.5]), i)
            for i in range(900)]
    df = spark.createDataFrame(rows, "g long, h double, k long")
    df.createOrReplaceTempView("null_groups")
    want = sorted(map(tuple, spark.sql(
        "SELECT k, row_number() OVER (PARTITION BY g, h ORDER BY k) - 1 AS i FROM null_groups").collect()))
    got = small_batches(spark, batch, lambda: sorted(
        (r["k"], r["row_idx"]) for r in with_row_index(df, ["k"], ["g", "h"], num_partitions=6).collect()))
    assert got == want
    whole = with_row_index(df, ["k"], num_partitions=6).collect()
    assert sorted(r["row_idx"] for r in whole) == list(range(900))


def test_cumulative_keeps_64_bit_integers_and_null_groups(spark):
    big = 2 ** 53 + 1
    rows = [(None, i, big) for i in range(9)] + [("a", i, 3) for i in range(5)] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r["g"], r["k"]): r["c"] for r in cumulative(df, "v", ["k"], ["g"], name="c", num_partitions=5).collect()}
    assert got == {**{(None, i): big * (i + 1) for i in range(9)}, **{("a", i): 3 * (i + 1) for i in range(5)}, ("b", 0): None}
    with pytest.raises(ValueError):
        cumulative(df.withColumn("d", df["v"].cast("decimal(20,2)")), "d", ["k"])


def test_row_index_over_multifile_scan_is_exact(spark, tmp_path):
    # regression: offsets and numbering run as separate jobs; range bounds must not drift between them
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 40), i, rnd.random()) for i in range(20000)]
    spark.createDataFrame(rows, "g long, k long, v double").repartition(6).write.parquet(str(tmp_path / "src"))
    df = spark.read.parquet(str(tmp_path / "src"))
    out = with_row_index(df, ["v", "k"], partition_by=["g"], start=1, num_partitions=12).toPandas()
    assert len(out) == 20000
    for _, part in out.groupby("g"):
        assert part.sort_values(["v", "k"])["row_idx"].tolist() == list(range(1, len(part) + 1))


@pytest.mark.parametrize("fn", ["sum", "max", "min"])
@pytest.mark.parametrize("exclusive", [False, True])
def test_cumulative_small_batches_and_nulls_match_sql_window(spark, fn, exclusive):
    rnd = random.Random(f"{fn}{exclusive}")
    rows = [(rnd.randint(0, 4), i, None if rnd.random() < 0.2 else round(rnd.uniform(-5, 5), 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, k long, v double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["g"], r["k"]): r["c"] for r in
               cumulative(df, "v", ["k"], ["g"], name="c", fn=fn, exclusive=exclusive, num_partitions=5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND " + ("1 PRECEDING" if exclusive else "CURRENT ROW")
    df.createOrReplaceTempView("cum_src")
    exp = {(r["g"], r["k"]): r["c"] for r in spark.sql(
        f"SELECT g, k, {fn}(v) OVER (PARTITION BY g ORDER BY k {frame}) AS c FROM cum_src").collect()}
    assert set(got) == set(exp)
    for key, e in exp.items():
        assert (e is None and got[key] is None) or got[key] == pytest.approx(e, abs=1e-9)
