"""Divergence audit against dense exact sums; the pattern tree against a tree of dictionaries."""
import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rng = random.Random(9)
    words = ["Das", "das", "Ü", "ü", "été", "x1y", "naïve", "a-b", "ﬁ", "日本", "one", "two", "three", "four"]
    out = [(f"{rng.choice(words)} " * rng.randint(0, 3) + " ".join(rng.choices(words, k=rng.randint(0, 30))),
            rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "Z", None])) for _ in range(90)]
    out += [(None, "fr", "s1"), ("", "fr", "s2"), ("lone words here", "es", "s1"), ("word " * 30_000, "en", "s1"), ("1 2 _", None, "s3")]
    return out + out[:4]


def brute(data, min_docs=3, top=200):
    n, df, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in data:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(UPPER))
        groups.add((lang, source))
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (la, t), c in df.items() if la == lang and c >= min_docs)
        sources = sorted(s for la, s in groups if la == lang)

        def shares(count):
            total = sum(map(count, kept)) + len(kept)
            return {t: 1 + 10**9 * (count(t) + 1) // total for t in kept}
        p = {s: shares(lambda t, s=s: n[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(n[lang, s, t] for s in sources))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:limit])]
    return sorted(out)


@pytest.mark.parametrize("held,top", [(200_000, 200), (5, 2)])
def test_divergence(spark, monkeypatch, held, top):
    from seqspark.llm import op13_audit as M
    monkeypatch.setattr(M, "HELD", held)
    df = spark.createDataFrame(rows(), "text string, lang string, source string").repartition(3)
    for c in ("term", "n", "df", "k", "p"):
        df = df.withColumn(c, F.lit(7))
    got = M.divergence(df, top_terms=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows(), top=top)
    assert M.divergence(df.limit(0)).count() == 0


def test_tree_shares_paths():
    from seqspark.llm.op13_audit import build_tree, tree_corrections
    rng = random.Random(1)
    for _ in range(30):
        table = sorted([(s, rng.randint(2, 4)) for s in sorted(rng.sample(range(6), rng.randint(1, 6)))] for _ in range(rng.randint(1, 40)))
        times = [rng.randint(1, 5) for _ in table]
        tree = collections.Counter()
        for row, m in zip(table, times):
            for d in range(len(row)):
                tree[tuple(row[:d + 1])] += m
        starts = np.cumsum([0] + [len(r) for r in table])
        source = np.array([s for r in table for s, _ in r], np.int64)
        share = np.array([p for r in table for _, p in r], np.int64) * 1000
        element, parent, below = build_tree(starts, source, share, np.array(times))

        def path(i):
            return (*(path(parent[i]) if parent[i] >= 0 else ()), (source[element[i]], share[element[i]] // 1000))
        assert {path(i): below[i] for i in range(len(element))} == tree
        none = np.array([700 + 10 * s for s in source], np.int64)
        got = {(a, b): v for a, b, v in zip(*tree_corrections(starts, source, share, none, np.array(times)))}
        want = collections.Counter()
        f = lambda x, y: (x - y) ** 2 // y
        for row, m in zip(table, times):
            for a, pa in row:
                for b, pb in row:
                    if a != b:
                        za, zb = 700 + 10 * a, 700 + 10 * b
                        want[a, b] += m * (f(pa * 1000, pb * 1000) - f(pa * 1000, zb) - f(za, pb * 1000) + f(za, zb))
        assert got == want


def test_shares_beyond_64_bits(spark):
    from seqspark.llm.op13_audit import _share
    r = spark.createDataFrame([(10**17, 3 * 10**17), (0, 1), (0, 0)], "n long, d long").select(_share("n", "d").alias("p")).collect()
    assert [x["p"] for x in r] == [1 + 10**9 * (10**17 + 1) // (3 * 10**17), 1 + 10**9, 1 + 10**9]
