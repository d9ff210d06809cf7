"""Mixing sources to target weights, with DataFrame and SQL functions only.

Every source's words stand in one stream (its documents in hash order), cut into blocks of at most ``block``
words, as packed training data is.  The mix takes an exact quota of blocks from each source: its target words in blocks,
rounded.  A multivariate-hypergeometric splitting tree deals the quotas out: the root holds all quotas; a node
gives half its blocks (as many as its shards hold) to its left child, the number of each source's drawn from
the multivariate hypergeometric law, source by source; the right child keeps the rest.  So the leaves, the
output shards, hold what a full shuffle of all drawn blocks would give them, and the sums stay exact, while
only counts are handled.  Shard j then draws the next quota of each source's permuted blocks: a keyed
permutation of the block numbers, another one for every round through the source, so that draws are disjoint.
Inside a shard the draws are shuffled by hash.

Tables: a row per source (``plan``), a row of per-source counts per tree node, a row per drawn block, a row per
(document, block) overlap.  Nothing is broadcast by hand and no text is shuffled.  The per-source tables are
metadata: a node holds one array of source counts, meant for up to some thousands of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions.permute import permute, sql_permuted
from seqspark.llm.common import save, shuffle_partitions

BLOCK = 256                     # words of a block; a source under BLOCK * LEAST_BLOCKS words has shorter ones
LEAST_BLOCKS = 512              # so a source's quota is exact to a thousandth of it, or to a word
SHARD_BLOCKS = 1024             # blocks of a shard at most (the local shuffle of one group)
WEIGHTS = (3, 1, 2)             # of the sources in order, repeating
SHARE = (3, 2)                  # the mix has 3 / 2 of all words
REPEAT = 2                      # no source is taken more often
BUCKETS = 4096                  # a source's documents are numbered in so many parts
SEED = 11
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORDS)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, start): every row with its place in its source's word stream.

    Documents stand in the order of md5(id), id, size, md5(text); rows equal in all of these can be exchanged.
    A source is numbered in ``BUCKETS`` parts by its md5, so one that holds most rows is spread over all tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                            word_count(text_col).alias("size"), h.alias("_h"), F.md5(text).alias("_t")), "mix-rows")
    dealt = rows.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    parts = dealt.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("_s"), F.col("_b").alias("_k"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = (Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size", "_t")
              .rowsBetween(Window.unboundedPreceding, -1))
    own = dealt.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return save(own.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_k"))).select(
        "doc_id", "source", "size", (F.col("_in") + F.col("_off")).cast("long").alias("start")), "mix-sized")


def plan(rows: DataFrame, weights=WEIGHTS, share=SHARE, repeat: int = REPEAT, block: int = BLOCK) -> DataFrame:
    """(source, k, source_size, target, block, blocks, quota): one row per source, k from 0 by code point, null last.

    Targets are weight times a common level, cut at ``repeat`` times the source's size.  The level is where
    they sum to the share of all words: with the sources sorted by cap / weight, those before it are capped.
    The windows run over one row per source.
    """
    per = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1).cast("int")
    s = per.withColumn("k", k).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("k") % len(weights) + 1).cast("long"))
    s = s.withColumn("cap", (F.col("source_size") * repeat).cast("double"))
    one = Window.partitionBy(F.lit(0))
    first = one.orderBy(F.col("cap") / F.col("weight"), "k")
    s = (s.withColumn("_total", F.sum("source_size").over(one) * share[0] / share[1])
         .withColumn("_capped", F.coalesce(F.sum("cap").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("_weight", F.sum("weight").over(first.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_weight")))
    s = s.withColumn("_free", F.col("cap") > F.col("weight") * F.col("_level"))      # so are all after the first free one
    least = lambda c: F.min(F.when(F.col("_free"), F.struct(F.col("cap") / F.col("weight"), F.col("k"), F.col(c)))).over(one)[c]
    s = s.withColumn("_left", least("_capped")).withColumn("_over", least("_weight"))
    share_of = (F.col("_total") - F.col("_left")) * F.col("weight") / F.col("_over")
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(share_of, F.col("cap"))))
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    quota = F.least(F.col("blocks") * repeat, F.round(F.col("target") / F.col("block")).cast("long"))
    return s.select("source", "k", "source_size", "target", "block", "blocks", quota.alias("quota"))


def _uniform(*parts):
    """In [0, 1), from md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def hypergeometric(good, bad, draws, u):
    """How many of ``draws`` are good, out of ``good + bad``, by inversion of the law at ``u`` (exact support).

    Neighbouring probabilities differ by a rational factor, so they are summed relative to the first of the
    support within ten and more deviations around the mean; what lies beyond weighs less than the step of ``u``.
    """
    given = F.array(F.struct(good.cast("double").alias("a"), bad.cast("double").alias("b"), draws.cast("double").alias("n"), u.alias("u")))

    def inverse(g):
        a, b, n = g["a"], g["b"], g["n"]
        mean = n * a / F.greatest(a + b, F.lit(1.0))
        sd = F.sqrt(mean * b / F.greatest(a + b, F.lit(1.0)) * F.greatest(a + b - n, F.lit(0.0)) / F.greatest(a + b - 1, F.lit(1.0)))
        reach = sd * 10 + 10
        lo = F.greatest(F.lit(0.0), n - b, F.floor(mean - reach).cast("double"))
        hi = F.greatest(lo, F.least(a, n, F.ceil(mean + reach).cast("double")))
        grow = lambda x: (a - x) * (n - x) / ((x + 1) * F.greatest(b - n + x + 1, F.lit(1.0)))
        steps = F.sequence(lo.cast("long"), hi.cast("long"))
        zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("c"))
        total = F.aggregate(steps, zero, lambda s, x: F.struct((s["p"] * grow(x.cast("double"))).alias("p"), (s["c"] + s["p"]).alias("c")),
                            lambda s: s["c"])
        found = lambda t: F.aggregate(
            steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("c"), lo.cast("long").alias("k")),
            lambda s, x: F.struct((s["p"] * grow(x.cast("double"))).alias("p"), (s["c"] + s["p"]).alias("c"),
                                  F.when(s["c"] + s["p"] <= t * g["u"], F.least(x + 1, hi.cast("long"))).otherwise(s["k"]).alias("k")),
            lambda s: s["k"])
        return F.transform(F.array(total), found)[0]

    return F.transform(given, inverse)[0]


def split_quotas(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(shard, k, quota): the splitting tree over ``2 ** levels`` shards.  ``quotas(k, quota)``, a row per source.

    Every shard holds its share of all blocks to within one; a source's quotas sum to what was given.
    """
    counts = F.transform(F.array_sort(F.collect_list(F.struct("k", "quota"))), lambda s: s["quota"])
    nodes = quotas.groupBy().agg(counts.alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
    empty = F.expr("cast(array() as array<bigint>)")
    for level in range(levels):
        start = F.struct(F.col("_total").alias("left"), F.floor((F.col("_total") + F.col("_odd")) / 2).cast("long").alias("draws"),
                         empty.alias("out"))

        u = lambda i: _uniform(F.lit(seed), F.lit(level), F.col("node"), i)  # noqa: B023, E731

        def deal(s, i):
            here = F.element_at("q", i + 1)
            got = hypergeometric(here, s["left"] - here, s["draws"], u(i))  # noqa: B023
            return F.transform(F.array(got), lambda x: F.struct(
                (s["left"] - here).alias("left"), (s["draws"] - x).alias("draws"), F.concat(s["out"], F.array(x)).alias("out")))[0]

        odd = F.floor(_uniform(F.lit(seed), F.lit("odd"), F.lit(level), F.col("node")) * 2).cast("long")
        dealt = nodes.withColumn("_total", total).withColumn("_odd", odd).withColumn("_l", F.when(
            F.size("q") > 0, F.aggregate(F.sequence(F.lit(0), F.size("q") - 1), start, deal, lambda s: s["out"])).otherwise(empty))
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("_l").alias("q")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "_l", lambda a, b: a - b).alias("q")))
        nodes = dealt.select(F.inline(both))
        if level % 4 == 3:
            nodes = save(nodes.repartition("node"), "mix-tree")
    return nodes.select(F.col("node").alias("shard"), F.posexplode("q").alias("k", "quota"))


def draw(plan_: DataFrame, shards: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, place, source, epoch, block): each shard's blocks; ``place`` is their shuffled order inside it.

    The shards' quotas of a source stand one after the other over its draws 0 .. quota - 1; draw r is block
    perm(r mod blocks) of round r div blocks.  A window over the shards of a source gives the starts.
    """
    before = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = shards.withColumn("_first", F.coalesce(F.sum("quota").over(before), F.lit(0).cast("long"))).where("quota > 0")
    spans = spans.repartition(shuffle_partitions(spans.sparkSession), "shard")       # a row becomes many: spread before it does
    drawn = (spans.withColumnRenamed("quota", "_n").join(plan_.select("k", "source", "blocks"), "k")
             .select("shard", "k", "source", "blocks", F.explode(F.expr("sequence(_first, _first + _n - 1)")).alias("_r")))
    epoch = F.floor(F.col("_r") / F.col("blocks")).cast("long")
    tweak = F.col("k").cast("long") * (1 << 16) + epoch
    drawn = drawn.select("shard", "source", epoch.alias("epoch"), permute(F.col("_r") % F.col("blocks"), "blocks", seed, tweak).alias("block"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "source", "epoch", "block"), "source", "epoch", "block")
    return drawn.withColumn("place", (F.row_number().over(local) - 1).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share=SHARE, repeat: int = REPEAT, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED):
    """(rows, plan, pieces): pieces has (doc_id, source, start, size, epoch, first, n_words, shard, place).

    A piece is words ``first .. first + n_words - 1`` of the document at ``start`` of its source's stream,
    taken in round ``epoch`` as (part of) the block at ``place`` of ``shard``.  Documents without words, null
    texts included, have no piece.  A null source is a source of its own; repeated rows are rows of their own;
    null ids stand in the stream like others; other columns are ignored; an empty table gives empty tables.
    """
    rows = sized(docs, id_col, text_col, source_col)
    planned = save(plan(rows, weights, share, repeat, block), "mix-plan")
    total = planned.agg(F.sum("quota")).first()[0] or 0
    levels = max(0, (max(1, -(-total // shard_blocks)) - 1).bit_length())
    shards = save(split_quotas(planned.select("k", "quota"), levels, seed), "mix-shards")
    drawn = draw(planned, shards, seed)
    sizes = planned.select(F.col("source").alias("_p"), "block")
    cut = rows.where("size > 0").join(sizes, F.col("source").eqNullSafe(F.col("_p"))).withColumn("_no", F.explode(F.expr(
        "sequence(start div block, (start + size - 1) div block)")))
    first = F.greatest(F.col("start"), F.col("_no") * F.col("block"))
    cut = cut.select("doc_id", "source", "start", "size", "_no", (first - F.col("start")).alias("first"),
                     (F.least(F.col("start") + F.col("size"), (F.col("_no") + 1) * F.col("block")) - first).alias("n_words"))
    of = drawn.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "epoch", "shard", "place")
    pieces = cut.join(of, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_no") == F.col("_b"))).drop("_s", "_b", "_no")
    return rows, planned, pieces


def mixed_text(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, place, doc_id, first, text): the words of every piece joined by spaces; ids must be unique."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = docs.select(F.col(id_col).alias("_id"), words.alias("_w"))
    return pieces.join(texts, F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        "shard", "place", "start", "doc_id", "first", F.array_join(F.expr("slice(_w, int(first) + 1, int(n_words))"), " ").alias("text"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_pieces): one row per document, summed over the mix's pieces."""
    rows, planned, pieces = mix(docs, **how)
    taken = pieces.groupBy("source", "start").agg(          # a place in the stream is one document with words
        F.sum("n_words").cast("long").alias("taken"), F.count(F.lit(1)).alias("n_pieces"))
    taken = taken.select(F.col("source").alias("_s"), F.col("start").alias("_at"), "taken", "n_pieces")
    of = planned.select(F.col("source").alias("_p"), "source_size", "target")
    zero = F.lit(0).cast("long")
    out = rows.where("size > 0").join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_at")), "left")
    out = out.select("doc_id", "source", "size", *[F.coalesce(c, zero).alias(c) for c in ("taken", "n_pieces")]).unionByName(
        rows.where("size = 0").select("doc_id", "source", "size", *[zero.alias(c) for c in ("taken", "n_pieces")]))
    return out.join(of, F.col("source").eqNullSafe(F.col("_p"))).select(
        "doc_id", "size", "source_size", "target", "taken", "n_pieces")


def op11_splitting_tree(spark, sf_dir):
    from seqspark.llm.common import table
    return mix_report(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS t FROM documents),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size, t
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
sources AS (
  SELECT source, source_size, k, 2.0::DOUBLE * source_size AS cap, [{", ".join(map(str, WEIGHTS))}][k % {len(WEIGHTS)} + 1]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
        FROM d GROUP BY source)),
filled AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 3 / 2 AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over
  FROM sources),
level AS (
  SELECT capped, over FROM filled WHERE cap > weight * ((total - capped) / over) ORDER BY cap / weight, k LIMIT 1),
targets AS (
  SELECT f.source, f.k, f.source_size, least(f.cap, coalesce((f.total - l.capped) * f.weight / l.over, f.cap)) AS target,
         greatest(1, least({BLOCK}, f.source_size // {LEAST_BLOCKS}))::BIGINT AS block
  FROM filled f LEFT JOIN level l ON true),
quotas AS (
  SELECT *, least({REPEAT} * blocks, round(target / block)::BIGINT) AS quota
  FROM (SELECT *, ceil(source_size / block)::BIGINT AS blocks FROM targets)),
turns AS (SELECT source, k, blocks, unnest(range(0, quota)) AS r FROM quotas WHERE quota > 0),
{sql_permuted("drawn", "turns", "r % blocks", "blocks", "no", seed=SEED, tweak="k * 65536 + r // blocks")},
pieces AS (
  SELECT doc_id, p.source, start, size, block, unnest(range(start // block, (start + size - 1) // block + 1)) AS no
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source WHERE size > 0),
taken AS (
  SELECT p.source, start, count(*) AS n_pieces,
         sum(least(start + size, (p.no + 1) * block) - greatest(start, p.no * block))::BIGINT AS taken
  FROM pieces p JOIN drawn d ON p.source IS NOT DISTINCT FROM d.source AND p.no = d.no GROUP BY p.source, start)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken,
       coalesce(k.n_pieces, 0)::BIGINT AS n_pieces
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON p.size > 0 AND p.source IS NOT DISTINCT FROM k.source AND p.start = k.start
"""
