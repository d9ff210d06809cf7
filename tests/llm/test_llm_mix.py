"""Mixing: targets by resharing, exact quotas down the tree, disjoint draws; the hypergeometric law."""
import collections
import math

import pytest
from pyspark.sql import functions as F


def rows():
    out = [(i, "w " * (i % 37 + 1), f"s{i % 4}") for i in range(400)]
    out += [(1000 + i, "x " * 9, None) for i in range(30)] + [(5, "a b", "s1"), (5, "a b", "s1"), (None, "n u l l", "s2")]
    return out + [(2000, None, "s0"), (2001, "", "s0"), (2002, " \t\n", "s3"), (2003, "long " * 20_000, "s3"), (2004, None, "only null")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").repartition(3)
    for c in ("start", "size", "k", "block", "quota"):
        df = df.withColumn(c, F.lit(7))
    return df.cache()


def resharing(sizes):
    """Targets by the contract's words: weights 3, 1, 2; what lies above twice a size is reshared until none does."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_report(docs, spark):
    from seqspark.llm.op11_mix import LEAST_BLOCKS, mix_report
    got = mix_report(docs).collect()
    assert len(got) == len(rows())
    sizes = collections.Counter()
    for _, t, s in rows():
        sizes[s] += len((t or "").split())
    want = resharing(sizes)
    by_size = {sizes[s]: s for s in sizes}
    taken = collections.Counter()
    for r in got:
        s = by_size[r["source_size"]]
        assert math.isclose(r["target"], want[s], rel_tol=1e-12, abs_tol=1e-9) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(2, 2 * sizes[s] / LEAST_BLOCKS) for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_report(docs.repartition(7)).collect()), key=repr)
    empty = docs.limit(0)
    assert mix_report(empty).count() == 0


def test_pieces_are_disjoint_and_shards_hold_their_quotas(docs):
    from seqspark.llm.op11_mix import draw, mix, mixed_text, plan, sized, split_quotas
    rows_, planned, pieces = mix(docs, shard_blocks=64)
    quota = {r["source"]: r["quota"] for r in planned.collect()}
    got = pieces.collect()
    spans = collections.defaultdict(list)
    for r in got:
        spans[r["source"], r["epoch"]].append((r["start"] + r["first"], r["n_words"]))
    for s in spans.values():
        s.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(s, s[1:]))           # no word twice in one round
    tree = split_quotas(planned.select("k", "quota"), 3).collect()
    assert len({r["shard"] for r in tree}) == 8
    per = collections.Counter()
    for r in tree:
        per[r["k"]] += r["quota"]
    assert [per[r["k"]] for r in planned.orderBy("k").collect()] == [r["quota"] for r in planned.orderBy("k").collect()]
    loads = collections.Counter()
    for r in tree:
        loads[r["shard"]] += r["quota"]
    assert max(loads.values()) - min(loads.values()) <= 3
    drawn = draw(planned, split_quotas(planned.select("k", "quota"), 3)).collect()
    assert len({(r["source"], r["epoch"], r["block"]) for r in drawn}) == len(drawn) == sum(quota.values())
    for shard in loads:
        assert sorted(r["place"] for r in drawn if r["shard"] == shard) == list(range(loads[shard]))
    unique = docs.where("doc_id is not null and doc_id <> 5")
    _, _, p = mix(unique)
    words = mixed_text(unique, p).agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words == p.agg(F.sum("n_words")).first()[0]


def test_hypergeometric(spark):
    from seqspark.llm.op11_mix import hypergeometric
    n = 20_000
    for good, bad, draws in ((7, 5, 6), (1, 400, 200), (3000, 9000, 4000), (0, 5, 3), (5, 0, 5), (0, 0, 0), (2, 3, 0)):
        u = (F.col("id") + 0.5) / n
        got = collections.Counter(r[0] for r in spark.range(n).select(
            hypergeometric(F.lit(good), F.lit(bad), F.lit(draws), u)).collect())
        assert min(got) >= max(0, draws - bad) and max(got) <= min(good, draws)
        for k, c in got.items():
            p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            assert abs(c / n - p) < 1.1 / n + 1e-9
