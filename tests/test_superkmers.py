"""Minimizer-partitioned k-mer counts: equal to exploding, with hot buckets, and with a smaller shuffle."""
import collections
import random

import pytest
from pyspark.sql import functions as F

from seqspark.functions.dna import kmers
from seqspark.operators import superkmers as S
from seqspark.operators.kmers import kmer_counts


def sequences():
    rng = random.Random(7)
    out = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    out += ["A" * 400, "A" * 401, "ACAC" * 90, "éж" * 20, "AC\nGT" * 9, "", None, "ACGTACGTACGTAC", "ACGTACGTACGTACG"]
    return out + out[:40]


@pytest.mark.parametrize("k,m,buckets,hot", [(15, 7, 4096, 4), (12, 7, 3, 0.01), (20, 20, 64, 4), (13, 1, 5, 0.2), (31, 7, 16, 4), (40, 9, 16, 4)])
def test_equals_explode(spark, k, m, buckets, hot):
    rows = [(i % 3 if i % 7 else None, s) for i, s in enumerate(sequences())]
    df = spark.createDataFrame(rows, "g int, sequence string").withColumn("bucket", F.lit(1)).repartition(3)
    want = collections.Counter((g, s[i:i + k]) for g, s in rows if s for i in range(len(s) - k + 1))
    got = S.kmer_counts_by_minimizer(df, k, group_cols=["g"], m=m, buckets=buckets, hot=hot).collect()
    assert len(got) == len(want) and {(r["g"], r["kmer"]): r["n"] for r in got} == want
    texts = F.concat(F.transform("codes", S.unpack), "texts").alias("pieces")
    pieces = S.super_kmers(df, k, m=m, buckets=buckets).select("n_kmers", texts).collect()
    assert sum(r["n_kmers"] for r in pieces) == sum(want.values())
    assert all(sum(len(p) - k + 1 for p in r["pieces"]) == r["n_kmers"] for r in pieces)
    assert S.kmer_counts_by_minimizer(df.limit(0), k).count() == 0


def shuffled_bytes(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            if name == "Exchange":
                total += p.metrics().apply("shuffleBytesWritten").value()
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_shuffles_at_most_a_third(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(81)),) for _ in range(6000)], "sequence string").repartition(4).cache()
    df.count()
    plain = df.select(F.explode(kmers("sequence", 15)).alias("kmer")).groupBy("kmer").count()
    ours = kmer_counts(df, 15)
    a, b = shuffled_bytes(plain), shuffled_bytes(ours)
    assert 0 < b < a / 3, (a, b)


def test_tasks_grow_with_the_kmers(spark):
    """A task counts about ``load`` k-mers, however few bytes their pieces take in the shuffle."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(81)) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "sequence string")
    counts = S.kmer_counts_by_minimizer(df, 15, load=20_000)
    per_task = [r["n"] for r in counts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).collect()]
    assert sum(per_task) == 4000 * 67 and max(per_task) < 40_000 and len(per_task) > 8, per_task
    assert S.n_buckets(0) == S.BUCKETS and S.n_buckets(10**10) * S.LOAD / 4 >= 10**10
