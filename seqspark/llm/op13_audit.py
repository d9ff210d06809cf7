"""Source divergence audit: how far the term shares of a language's sources lie apart, exactly.

For two sources A and B of a language the divergence is a sum over all kept terms of f(p_A, p_B).  Nearly all
terms are missing in nearly all sources, so the sum is taken from what every term would give if it were missing
in both (a constant), corrected per source for the terms it has (from a histogram of its shares), and corrected
per pair for the terms that both have.  The pair corrections come from a frequent-pattern tree: a term's row is
the list of its nonzero (source, share) entries in source order; equal rows are one row with a multiplicity;
rows are inserted in sorted order, so that rows with a common beginning share a path, and every (node, ancestor)
combination gives its correction once, times the number of terms below the node.

Counting runs in Arrow batches with bounded dictionaries; Spark sums their rows, deals the rows of the tree by
range (a common beginning mostly stays together) and adds up the corrections.  A part of a node's terms in
another batch is a node of that batch's tree: corrections add up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import save, sliced

MIN_DOCS = 3                    # a kept term is in so many documents of its language
SCALE = 1_000_000_000
TOP_TERMS = 200
HELD = 200_000                  # (group, term) entries a task counts before it passes them on
# bytes of a term: ASCII letters (lowered) and everything beyond ASCII
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Partial counts (lang, source, term, n, df); an empty term stands for the group itself."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for a, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])

    def run(batches):
        counts: dict = {}

        def out():
            cols: list[list] = [[], [], [], [], []]
            for (lang, source), (n, df) in counts.items():
                cols[0] += [lang] * (len(n) + 1)
                cols[1] += [source] * (len(n) + 1)
                cols[2] += [b"", *n]
                cols[3] += [0, *n.values()]
                cols[4] += [0, *[df[t] for t in n]]
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["lang", "source", "term", "n", "df"])

        for b in sliced(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
                n, df = counts.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(_TERM_BYTES).split()
                n.update(terms)
                df.update(set(terms))
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield out()
        if counts:
            yield out()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(n: str, d: str):
    """1 + floor(SCALE * (n + 1) / d), exact; ``d`` is positive where it counts."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(19,0))) div cast(greatest({d}, 1) as decimal(19,0))")


def _f(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def build_tree(starts, source, share, times):
    """Frequent-pattern tree of sorted rows: (element of each node, its parent node or -1, terms below it).

    Row r has the elements ``starts[r]:starts[r + 1]`` of (source, share) and stands for ``times[r]`` terms.
    """
    n, length = len(starts) - 1, np.diff(starts)
    deepest = int(length.max(initial=0))
    shared, same = np.zeros(n, np.int64), np.arange(n) > 0
    for d in range(deepest):
        has = length > d
        at = np.where(has, starts[:-1] + d, 0)
        s, p = np.where(has, source[at], -1), np.where(has, share[at], -1)
        same[1:] &= has[1:] & (s[1:] == s[:-1]) & (p[1:] == p[:-1])
        if not same.any():
            break
        shared += same
    row = np.repeat(np.arange(n), length)
    depth = np.arange(len(source)) - starts[:-1][row]
    new = depth >= shared[row]
    number = np.cumsum(new) - 1
    element = np.flatnonzero(new)
    parent, below = np.full(len(element), -1, np.int64), np.zeros(len(element), np.int64)
    total = np.concatenate([[0], np.cumsum(times)])
    last = None                                             # node at the depth above on the path of each row
    for d in range(deepest):
        mine = element[depth[element] == d]
        nodes, rows = number[mine], row[mine]
        if d:
            parent[nodes] = last[rows]
        bounds = np.append(np.flatnonzero(shared <= d), n)
        below[nodes] = total[bounds[np.searchsorted(bounds, rows, side="right")]] - total[rows]
        marks = np.full(n, -1, np.int64)
        marks[rows] = nodes
        last = np.maximum.accumulate(marks)
    return element, parent, below


def tree_corrections(starts, source, share, none, times):
    """(source a, source b, sum over terms of both) of f(p_a, p_b) - f(p_a, 0_b) - f(0_a, p_b) + f(0_a, 0_b), a <> b.

    ``none`` is the share of a missing term in the element's source.  Sums are 64-bit integers.
    """
    element, parent, below = build_tree(starts, source, share, times)
    s, p, z = source[element], share[element], none[element]
    width = int(source.max(initial=0)) + 1
    codes, sums = [], []
    node, up = np.arange(len(element)), parent
    while True:
        live = up >= 0
        node, up = node[live], up[live]
        if not len(node):
            break
        for a, b in ((node, up), (up, node)):
            f = lambda x, y: (x - y) ** 2 // y
            c = f(p[a], p[b]) - f(p[a], z[b]) - f(z[a], p[b]) + f(z[a], z[b])
            code, at = np.unique(s[a] * width + s[b], return_inverse=True)
            add = np.zeros(len(code), np.int64)
            np.add.at(add, at, c * below[node])
            codes.append(code)
            sums.append(add)
        up = parent[up]
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    add = np.zeros(len(code), np.int64)
    np.add.at(add, at, np.concatenate(sums))
    return code // width, code % width, add


def pair_corrections(entries: DataFrame) -> DataFrame:
    """(lang, a, b, v): tree corrections of ``entries(lang, term, k, p, p0)``, to be summed per (lang, a, b)."""
    rows = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("k", "p", "p0"))).alias("row"))
    rows = save(rows.where("size(row) > 1").groupBy("lang", "row").agg(F.count(F.lit(1)).alias("m")), "audit-patterns")
    dealt = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")

    def run(batches):
        for b in batches:
            lang = b.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(lang)) if lang[i] != lang[i - 1]], len(lang)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                row = b.column(1).slice(lo, hi - lo)
                flat = row.flatten()
                k, p, p0 = [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
                lengths = row.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                x, y, v = tree_corrections(starts, k, p, p0, b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([lang[lo]] * len(x), pa.string()), pa.array(x.astype(np.int32)),
                                                  pa.array(y.astype(np.int32)), pa.array(v)], names=["lang", "a", "b", "v"])

    return dealt.mapInArrow(run, "lang string, a int, b int, v long")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all other sources) and ``term`` (the ``top_terms`` first).

    Null text, lang and source are empty strings; empty and repeated documents are documents; a language
    without kept terms has pairs of value 0; other columns are ignored; an empty table gives no rows.
    """
    parts = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    per_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = save(per_source.groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "n")).alias("row"), F.sum("n").alias("total"), F.sum("df").alias("df"))
        .where(f"df >= {int(min_docs)} or term = ''"), "audit-terms")
    kept = terms.where("term <> ''")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    mass = kept.select("lang", F.explode("row").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    of_lang = Window.partitionBy("lang").orderBy("source")
    groups = (terms.where("term = ''").select("lang", F.explode("row.source").alias("source"))
              .join(mass, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0))
    groups = save(groups.withColumn("d", F.col("n") + F.col("v")).withColumn("k", F.row_number().over(of_lang))
                  .withColumn("p0", _share("0", "d")).select("lang", "source", "k", "d", "v", (F.col("n_lang") + F.col("v")).alias("d_lang"), "p0"),
                  "audit-groups")
    entries = (kept.select("lang", "term", "total", F.explode("row").alias("x"))
               .select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
               .join(groups, ["lang", "source"]))
    entries = save(entries.select("lang", "source", "k", "term", _share("n", "d").alias("p"), "p0",
                                  _share("total", "d_lang").alias("q")), "audit-entries")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          _f("p", "q").alias("value"))
    above = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    wide = lambda c: c.cast("decimal(38,0)")
    a = groups.select("lang", F.col("k").alias("a"), F.col("p0").alias("a0"), "v")
    b = groups.select("lang", F.col("k").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("a <> b")
    constant = pairs.select("lang", "a", "b", (wide(F.col("v")) * wide(_f("a0", "b0"))).alias("v"))
    shares = entries.groupBy("lang", "k", "p").agg(F.count(F.lit(1)).alias("m"), F.first("p0").alias("p0"))
    others = groups.select("lang", F.col("k").alias("o"), F.col("p0").alias("o0"))
    single = shares.join(others, "lang").where("k <> o")
    both = F.array(
        F.struct(F.col("k").alias("a"), F.col("o").alias("b"), (_f("p", "o0") - _f("p0", "o0")).alias("c")),
        F.struct(F.col("o").alias("a"), F.col("k").alias("b"), (_f("o0", "p") - _f("o0", "p0")).alias("c")))
    single = single.select("lang", "m", F.inline(both)).select("lang", "a", "b", (wide(F.col("m")) * wide(F.col("c"))).alias("v"))
    tree = pair_corrections(entries).select("lang", "a", "b", wide(F.col("v")).alias("v"))
    summed = constant.unionByName(single).unionByName(tree).groupBy("lang", "a", "b").agg(F.sum("v").cast("long").alias("value"))
    name = lambda c, out: groups.select("lang", F.col("k").alias(c), F.col("source").alias(out))
    ranked = (summed.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
              .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return ranked.withColumn("rank", F.row_number().over(best)).unionByName(above)


def op13_pattern_tree(spark, sf_dir):
    from seqspark.llm.common import table
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(m.n, 0) + coalesce(v.v, 0) AS d
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) m USING (lang, source)),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // g.d)::BIGINT AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
whole AS (SELECT lang, term, (1 + ({SCALE}::HUGEINT * (total + 1)) // (n_lang + v))::BIGINT AS q FROM kept JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
