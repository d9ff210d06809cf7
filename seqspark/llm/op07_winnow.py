"""Benchmark decontamination by winnowing, with DataFrame and SQL functions only.

Fingerprints: all k-gram hashes of a text are looked at through a sliding window of ``span - k + 1``
k-grams and the smallest of each window is kept.  Two texts that share ``span`` words share the
window over them and so its smallest hash: no shared span of ``span`` words is missed.  Documents and
benchmark items are joined on fingerprints; a hit is extended to every ``span``-word window around the
shared k-gram, and these windows are joined with the items' windows by their words.  Items shorter than
``span`` are one window of their own length, looked up through all k-grams of that length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import save

SPAN = 13                       # words of a window
K = 5                           # words of a fingerprinted k-gram
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str):
    """Words of a text column: A-Z lowered, runs of ASCII letters, digits and non-ASCII characters; null: none."""
    t = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _UPPER.lower()))
    return F.filter(F.split(lowered, _SEPARATORS), lambda w: w != "")


def kgram_hashes(k: int) -> str:
    return f"if(size(words) >= {k}, transform(sequence(1, size(words) - {k - 1}), i -> xxhash64(slice(words, i, {k}))), array())"


def fingerprints(window: int) -> str:
    """Distinct smallest hashes of every ``window`` consecutive k-grams of column ``h``."""
    return (f"if(size(h) >= {window}, array_distinct(transform(sequence(1, size(h) - {window - 1}), "
            f"i -> array_min(slice(h, i, {window})))), cast(array() as array<bigint>))")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): one row per input row.

    A word is hit if it lies in an occurrence of any window of any item.  Null and empty texts have no
    words and no hits; null, empty and repeated items add nothing; an item without an id can hit but is
    not counted; repeated rows get the same answer; other columns are ignored.
    """
    window = span - k + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    keyed = rows.withColumn("_t", F.xxhash64("_text")).withColumn("words", words("_text"))
    items = save(benchmark.select(F.col(item_col).alias("item_id"), words(item_text_col).alias("words"))
                 .where("size(words) > 0").distinct(), "items")
    hashed = keyed.withColumn("h", F.expr(kgram_hashes(k)))
    printed = save(hashed.select("doc_id", "_t", F.size("words").cast("long").alias("n_words"),
                                 F.expr(fingerprints(window)).alias("prints")), "fingerprints")
    item_prints = (items.withColumn("h", F.expr(kgram_hashes(k)))
                   .select(F.explode(F.expr(fingerprints(window))).alias("_f")).distinct())
    shared = (printed.select("doc_id", "_t", F.explode("prints").alias("_f")).join(item_prints, "_f")
              .groupBy("doc_id", "_t").agg(F.collect_set("_f").alias("_shared")))   # at most a text's own prints
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_t"] == b["_t"])
    again = rows.withColumn("_t", F.xxhash64("_text"))
    matched = again.join(shared, same(again, shared)).select(
        again["doc_id"], again["_t"], words("_text").alias("words"), "_shared").withColumn("h", F.expr(kgram_hashes(k)))
    around = F.expr(                                            # starts of the windows over each shared k-gram
        f"array_distinct(flatten(transform(filter(sequence(1, size(h)), i -> array_contains(_shared, h[i - 1])), "
        f"i -> sequence(greatest(1, i - {window - 1}), greatest(1, least(i, size(words) - {span - 1}))))))")
    opened = matched.select("doc_id", "_t", "words", F.explode(around).alias("start")).select(
        "doc_id", "_t", "start", F.expr(f"array_join(slice(words, start, {span}), ' ')").alias("span_words"))
    item_windows = items.where(f"size(words) >= {span}").select(
        "item_id", "words", F.explode(F.expr(f"sequence(1, size(words) - {span - 1})")).alias("_s")).select(
        "item_id", F.expr(f"array_join(slice(words, _s, {span}), ' ')").alias("span_words")).distinct()
    hits = opened.distinct().join(item_windows, "span_words").select(
        "doc_id", "_t", "start", F.lit(span).alias("size"), "item_id")
    for r in items.where(f"size(words) < {span}").select(F.size("words").alias("n")).distinct().collect():
        n = r["n"]                                              # fewer than ``span`` lengths
        short = items.where(f"size(words) = {n}").select("item_id", F.array_join("words", " ").alias("span_words")).distinct()
        every = keyed.where(f"size(words) >= {n}").select(
            "doc_id", "_t", "words", F.explode(F.expr(f"sequence(1, size(words) - {n - 1})")).alias("start")).select(
            "doc_id", "_t", "start", F.expr(f"array_join(slice(words, start, {n}), ' ')").alias("span_words"))
        hits = hits.unionByName(every.join(short, "span_words").select(
            "doc_id", "_t", "start", F.lit(n).alias("size"), "item_id"))
    covered = F.expr(                                           # words in the union of the windows
        "aggregate(array_sort(spans), struct(0L as n, 0L as last), (a, x) -> struct("
        "a.n + greatest(0L, x.start + x.size - 1 - greatest(a.last, x.start - 1)) as n, "
        "greatest(a.last, x.start + x.size - 1) as last)).n")
    found = hits.groupBy("doc_id", "_t").agg(
        F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))).alias("spans"),
        F.collect_set(F.col("item_id").cast("string")).alias("names"))
    found = found.select("doc_id", "_t", covered.alias("hit"), "names")
    n_hit, names = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("names", F.expr("cast(array() as array<string>)"))
    return printed.join(found, same(printed, found), "left").select(
        printed["doc_id"], "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort(names), ","), "utf-8"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op7_winnowing(spark, sf_dir):
    from seqspark.llm.common import table
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n,
         array_to_string(words[s:s + least(13, len(words)) - 1], ' ') AS span
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS s FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
g AS (
  SELECT doc_id, n, s, array_to_string(words[s:s + n - 1], ' ') AS span
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT g.doc_id, g.n, g.s, w.item_id FROM g JOIN w USING (n, span)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words)) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
