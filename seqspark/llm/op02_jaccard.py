"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles, as 64-bit hashes; equal sets are one class.  Sets A and
B of sizes a >= b link when their Jaccard similarity is at least 0.75, that is when their symmetric
difference holds at most (a + b) / 7 shingles, which also bounds the sizes to b >= 0.75 a.

*Sketch.*  Every shingle falls by its hash into one of K blocks and is XOR-ed into it.  A shingle that
is in both sets cancels out of the XOR of two sketches, so the number of blocks (or of parity bits) in
which they differ is at most the size of the symmetric difference.

*Pigeonhole join per size band.*  Bands grow by (4/3)^2; a set is signed in its own band and, if a
partner of up to 4/3 its size may lie in the next band, there too.  K exceeds the largest difference D
that a pair in the band can have.  A set with ``occ`` non-empty blocks then agrees with each of its
partners in at least ``occ - D`` non-empty blocks, and partners meet on equal blocks.

*Exact keys.*  The shingles of a small set can fall into so few blocks that two partners agree in none.
That takes at most D non-empty blocks on both sides; such sets are also signed by every single shingle,
of which partners share at least one.  These keys have a band of their own, ``EXACT``.

*Frequent blocks* (more than ``max_group`` sets) come from text that many documents share.  A set with
more than D non-frequent, non-empty blocks must meet every partner in one that is not frequent, so its
frequent blocks may be passed over.  Only pairs of sets that both lack that many need them: these sets
are gathered by a star per frequent block (an edge to its smallest member, whatever that one has), which
keeps them together without listing their pairs.

*Verification.*  Pairs with fewer shared blocks than the bound demands are discarded; what is left, with
the stars, is split into connected clusters.  Inside a cluster all pairs are compared, in chunks of
bounded size, first by the Hamming distance of parity sketches, then by exact intersection.  Links
within a chunk are reduced to a spanning forest; their number is counted for every document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import LOWER_ASCII, components, process_cache, release, save, shuffle_partitions, sliced

SHINGLE = 5
MAX_GROUP = 32                  # a block shared by more sets is frequent
CHUNK = 1024                    # sets compared at once with as many others
HELD = 200_000                  # pairs a task holds before it counts them
MET = 200_000                   # sets a task remembers as signed
FILTER_BITS = 1 << 23           # size of the bitmap that preselects rows by id
BAND = (4 / 3) ** 2
EXACT = 63                      # band of the exact keys; no set is large enough for band 63 itself
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    """word -> 64-bit hash, kept for the life of a worker process and emptied at ``LIMIT`` words."""
    LIMIT = 100_000

    def __missing__(self, word):
        import xxhash
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes() -> _WordHashes:
    cache = process_cache("jaccard")
    if "words" not in cache:
        cache["words"] = _WordHashes()
    if len(cache["words"]) > _WordHashes.LIMIT:
        cache["words"].clear()
    return cache["words"]


def shingles(text: str | None, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct uint64 hashes of the ``size``-word shingles (all words as one, if there are fewer)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _M1 + w[i:len(w) - k + 1 + i]
        h ^= h >> np.uint64(32)
    h *= _M2
    return np.unique(h ^ (h >> np.uint64(29)))


def set_hash(s: np.ndarray) -> int:
    import xxhash
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def band_start(level: int) -> int:
    return math.ceil(BAND ** level)


def band_of(size: int) -> int:
    level = int(math.log(size) / math.log(BAND))
    while band_start(level + 1) <= size:
        level += 1
    while band_start(level) > size:
        level -= 1
    return level


def bands(size: int) -> list[int]:
    """Bands in which a set of ``size`` is signed; below 3 shingles only equal sets link."""
    return sorted({band_of(size), band_of(size * 4 // 3)}) if size >= 3 else []


def most_different(level: int) -> int:
    """Largest symmetric difference of a linked pair that meets in the band."""
    return 2 * (band_start(level + 1) - 1) // 7


def bound(size: int, level: int) -> int:
    """Largest symmetric difference of a set of ``size`` and a partner that it meets in the band: at most a third of the
    smaller set and two sevenths of the larger one."""
    return min(most_different(level), size // 3)


def n_blocks(level: int) -> int:
    return math.ceil(1.15 * (most_different(level) + 1)) + 4


def blocks(s: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(block numbers, XOR of the shingles in each) of the non-empty blocks."""
    at = ((s >> np.uint64(24)) % np.uint64(n_blocks(level))).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.bitwise_xor.reduceat(s[order], first)


def block_keys(s: np.ndarray, level: int) -> np.ndarray:
    """int64 keys of the non-empty blocks; the lowest 6 bits are the band."""
    at, value = blocks(s, level)
    k = (value ^ (at.astype(np.uint64) * _M1)) * _M2
    k ^= k >> np.uint64(31)
    return ((k & ~np.uint64(63)) | np.uint64(level)).astype(np.int64)


def exact_keys(s: np.ndarray) -> np.ndarray:
    """int64 keys of the single shingles."""
    k = s * _M1
    k ^= k >> np.uint64(31)
    return ((k & ~np.uint64(63)) | np.uint64(EXACT)).astype(np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    """All keys of a set: its blocks in every band, and its shingles if the blocks of a band are too few to meet every partner."""
    by_band = [(v, block_keys(s, v)) for v in bands(len(s))]
    few = any(len(k) <= bound(len(s), v) for v, k in by_band)
    return np.concatenate([*[k for _, k in by_band], *([exact_keys(s)] if few else [])])


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, sh, signed): set size, hash of the set (null: empty) and (band, non-empty blocks) per band."""
    def run(batches):
        for b in sliced(batches):
            hashes = word_hashes()
            n, sh, signed = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, hashes)
                n.append(len(s))
                sh.append(set_hash(s) if len(s) else None)
                signed.append([{"band": v, "occ": len(blocks(s, v)[0])} for v in bands(len(s))])
            kind = pa.list_(pa.struct([("band", pa.int32()), ("occ", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sh, pa.int64()),
                                              pa.array(signed, kind)], ["doc_id", "n", "sh", "signed"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}`").mapInArrow(
        run, "doc_id long, n long, sh long, signed array<struct<band int, occ int>>")


def signatures(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, sh): one row per key of every distinct set; a set that a task still remembers is not repeated."""
    def run(batches):
        met: set[int] = set()                                   # a set met again after ``MET`` others is signed again
        for b in sliced(batches):
            hashes = word_hashes()
            keys, owners, size = [], [], 0
            if len(met) > MET:
                met.clear()
            for text in b.column(0).to_pylist():
                s = shingles(text, hashes)
                if len(s) < 3 or (sh := set_hash(s)) in met:
                    continue
                met.add(sh)
                k = signature(s)
                keys.append(k)
                owners.append(np.full(len(k), sh))
                size += len(k)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))],
                                                     ["key", "sh"])
                    keys, owners, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))],
                                                 ["key", "sh"])

    return docs.select(text_col).mapInArrow(run, "key long, sh long")


def meetings(keys: DataFrame, max_group: int) -> DataFrame:
    """From (key, sh): pairs (a, b, band, n shared blocks) of small groups; for frequent blocks a row (smallest member as a,
    member as b, n = 0) per member.

    Each task streams its keys in order and holds one group of at most ``max_group`` sets.
    """
    def run(batches):
        key, sh = np.zeros(0, np.int64), np.zeros(0, np.int64)
        frequent = hub = None                                   # key and smallest member of an open frequent group
        pairs: list[tuple] = []
        held = 0

        def out(a, b, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), pa.array(n[0].astype(np.int32)), pa.array(n[1].astype(np.int64))],
                ["a", "b", "band", "n"])

        def reduced():
            a, b, v = (np.concatenate(x) for x in zip(*pairs))
            order = np.lexsort((v, b, a))
            a, b, v = a[order], b[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (v[1:] != v[:-1])]))
            return out(a[first], b[first], (v[first], np.diff(np.append(first, len(a)))))

        def hot(k, h, s):
            return out(h, s, (k & 63, np.zeros(len(k))))

        for b in _with_end(batches):
            if b is not None:
                key = np.concatenate([key, b.column(0).to_numpy()])
                sh = np.concatenate([sh, b.column(1).to_numpy()])
                if not len(key):
                    continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (sh[1:] != sh[:-1])]) if len(key) else np.zeros(0, bool)
            key, sh = key[new], sh[new]
            if frequent is not None and len(key):               # the rest of a frequent group
                same = int(np.searchsorted(key, frequent, side="right")) if key[0] == frequent else 0
                if same:
                    yield hot(key[:same], np.full(same, hub), sh[:same])
                    key, sh = key[same:], sh[same:]
                if len(key):
                    frequent = None
            if not len(key):
                if b is None and pairs:
                    yield reduced()
                    pairs = []
                continue
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            rest = len(key) if b is None else start[-1]         # the last group may go on
            if b is not None and size[-1] > max_group:
                frequent, hub, rest = int(key[-1]), int(sh[start[-1]]), len(key)
            per_row = np.repeat(size, size)
            big = (per_row > max_group) & (np.arange(len(key)) < rest)
            if big.any():
                yield hot(key[big], np.repeat(sh[start], size)[big], sh[big])
            small = np.flatnonzero((per_row > 1) & (per_row <= max_group) & (np.arange(len(key)) < rest))
            k, s = key[small], sh[small]
            for d in range(1, max_group):
                eq = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else np.zeros(0, np.int64)
                if not len(eq):
                    break
                pairs.append((s[eq], s[eq + d], k[eq] & 63))
                held += len(eq)
            key, sh = key[rest:], sh[rest:]
            if pairs and (held > HELD or b is None):
                yield reduced()
                pairs, held = [], 0
        release()

    parts = shuffle_partitions(keys.sparkSession)
    return (keys.repartition(parts, "key").sortWithinPartitions("key", "sh")
            .mapInArrow(run, "a long, b long, band int, n long"))


def _with_end(batches):
    yield from batches
    yield None


def candidate_edges(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): pairs with enough shared blocks or an exact key, and stars of the sets that only frequent keys may link."""
    signed = sets.select("sh", "n", F.explode("signed").alias("_s")).select(
        "sh", F.col("n").alias("size"), F.col("_s.band").alias("band"), F.col("_s.occ").alias("occ"))
    hot = met.where("n = 0").groupBy(F.col("a").alias("hub"), F.col("b").alias("sh"), "band").agg(F.count(F.lit(1)).alias("m"))
    n_hot = hot.groupBy("sh", "band").agg(F.sum("m").alias("hot"))
    signed = signed.join(n_hot, ["sh", "band"], "left").select(
        "sh", "band", "size", (F.col("occ") - F.coalesce("hot", F.lit(0))).alias("free"))
    side = lambda x: signed.select(F.col("sh").alias(x), "band", F.col("size").alias(f"size_{x}"),
                                   F.col("free").alias(f"free_{x}"))
    pairs = (met.where("n > 0").groupBy("a", "b", "band").agg(F.sum("n").alias("n"))
             .join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
             .where("4 * least(size_a, size_b) >= 3 * greatest(size_a, size_b)")
             .where("n >= greatest(free_a, free_b) - (size_a + size_b) div 7")
             .select(F.col("a").alias("u"), F.col("b").alias("v")))
    # A linked pair differs in at most a third of the smaller set and two sevenths of the larger one.
    limits = met.sparkSession.createDataFrame([(v, most_different(v)) for v in range(64)], "band int, d long")
    open_sets = signed.join(F.broadcast(limits), "band").where("free <= least(d, size div 3)")    # 64 bands
    stars = hot.join(open_sets.select("sh", "band"), ["sh", "band"]).select(F.col("hub").alias("u"), F.col("sh").alias("v"))
    exact = met.where(f"band = {EXACT}").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return pairs.unionByName(stars).unionByName(exact).where("u <> v").distinct()


def compare(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Linked pairs (i, j) between two lists of sets (i < j inside one list)."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets], np.int64)
    if not size.any():
        return []
    bits = 1 << max(6, int(2 * size.max() - 1).bit_length())
    sketch = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):                                # parity of the shingles on every bit
        odd = np.packbits((np.bincount(((s >> np.uint64(8)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1)
                          .astype(np.uint8))
        sketch[i] = odd.view(np.uint64)
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    member = np.zeros(len(flat), bool)
    out = []
    begin = len(left) if right is not None else 0
    for i in range(len(left)):
        js = np.arange(max(begin, i + 1), len(sets))
        a, b = size[i], size[js]
        js = js[(4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (a > 0)]
        if not len(js):
            continue
        apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        js = js[apart <= (a + size[js]) // 7]
        if not len(js):
            continue
        mine = ids[ends[i]:ends[i + 1]]
        member[mine] = True
        at = np.repeat(ends[js] - np.concatenate([[0], np.cumsum(size[js])[:-1]]), size[js]) + np.arange(size[js].sum())
        both = np.add.reduceat(member[ids[at]].astype(np.int64), np.concatenate([[0], np.cumsum(size[js])[:-1]]))
        member[mine] = False
        out += [(i, int(j)) for j in js[100 * both >= 75 * (a + size[js] - both)]]
    return out


def cluster_links(members: DataFrame, chunk: int) -> DataFrame:
    """(u, v, n): spanning edges (n null) and numbers of linked documents (v null) from (cluster, sh, copies, text)."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_size"))
    dealt = members.join(sizes, "cluster").withColumn("_parts", F.ceil(F.col("_size") / chunk).cast("int")).withColumn(
        "_part", F.pmod(F.xxhash64("sh"), F.col("_parts")).cast("int"))
    spread = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
        "cluster", "sh", "copies", "text", "_part", F.least("_part", "_other").alias("i"),
        F.greatest("_part", "_other").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        hashes = word_hashes()
        part, i, j = t.column("_part").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        order = np.argsort(part, kind="stable")
        sh = t.column("sh").to_numpy()[order]
        copies = t.column("copies").to_numpy()[order]
        texts = t.column("text").to_pylist()
        sets = [shingles(texts[k], hashes) for k in order]
        cut = int((part == i).sum())
        links = compare(sets, None) if i == j else compare(sets[:cut], sets[cut:])
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        count = np.zeros(len(sets), np.int64)
        edges = []
        for x, y in links:
            count[x] += copies[y]
            count[y] += copies[x]
            if (rx := find(x)) != (ry := find(y)):
                root[ry] = rx
                edges.append((x, y))
        hit = np.flatnonzero(count)
        release()
        u = np.concatenate([sh[[e[0] for e in edges]] if edges else sh[:0], sh[hit]])
        v = [int(sh[e[1]]) for e in edges] + [None] * len(hit)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()),
                         "n": pa.array([None] * len(edges) + count[hit].tolist(), pa.int64())})

    # dealt by the chunk pair: the join on cluster alone would leave all pairs of a cluster in one task
    return spread.repartition(shuffle_partitions(members.sparkSession), "cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(lambda t: run(t), "u long, v long, n long")


def texts_of(docs: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(sh, text) of the rows of ``docs(doc_id, text)`` that have a shingle and whose id may be in ``wanted(doc_id)``.

    A bitmap of fixed size tells which ids may; none is missed.  Filter and hash are one pass, so a task has one Python worker.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select(at.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("b")).collect()        # at most bits / 64 rows
    bitmap = np.zeros(bits // 64, np.int64)
    for r in words:
        bitmap[r["w"]] = r["b"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for b in sliced(batches):
            p = b.column(1).to_numpy()
            keep = (shared.value[p >> 6].view(np.uint64) >> (p & 63).astype(np.uint64)) & np.uint64(1)
            hashes = word_hashes()
            texts = b.column(0).filter(pa.array(keep.astype(bool))).to_pylist()
            sets = [shingles(t, hashes) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(sets[i]) for i in full], pa.int64()),
                                              pa.array([texts[i] for i in full], pa.string())], ["sh", "text"])

    return docs.select("text", at.alias("_p")).mapInArrow(run, "sh long, text string")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP,
                       chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): one row per input row.

    ``n_links``: number of other rows whose set links with this one, equal sets included.  Null and
    wordless texts have no shingles, are a component of their own and have no links.  Repeated rows
    are linked like other equal texts.  A null id never names a component that also has a non-null
    one.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    meta = save(classes(rows, "doc_id", "text"), "jaccard-classes")
    sets = save(meta.where("sh is not null").groupBy("sh").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("signed").alias("signed")), "jaccard-sets")
    met = save(meetings(signatures(rows, "text"), max_group), "jaccard-meetings")
    clusters = components(candidate_edges(met, sets)).select(F.col("node").alias("sh"), F.col("component").alias("cluster"))
    members = save(sets.join(clusters, "sh").select("sh", "doc_id", "copies", "cluster"), "jaccard-members")
    texts = texts_of(rows, members)
    joined = members.join(texts, "sh").dropDuplicates(["sh"]).select("cluster", "sh", "copies", "text")
    found = save(cluster_links(save(joined, "jaccard-texts"), chunk), "jaccard-links")
    links = found.where("v is null").groupBy(F.col("u").alias("sh")).agg(F.sum("n").alias("_links"))
    parts = components(found.where("v is not null").select("u", "v")).select(
        F.col("node").alias("sh"), F.col("component").alias("_part"))
    per_set = sets.select("sh", "copies", F.col("doc_id").alias("_first")).join(parts, "sh", "left").join(
        links, "sh", "left").select("sh", "_first", F.coalesce("_part", "sh").alias("_part"),
                                    (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"))
    smallest = per_set.groupBy("_part").agg(F.min("_first").alias("component_id"))
    per_set = save(per_set.join(smallest, "_part").select("sh", "component_id", "_links"), "jaccard-components")
    return meta.select("doc_id", "n", "sh").join(per_set, "sh", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def op2_parity_sketch_join(spark, sf_dir):
    from seqspark.llm.common import table
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b USING (g)
         WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
          WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u),
k AS (SELECT u AS doc_id, count(*) AS n_links FROM links GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) JOIN c USING (doc_id)
"""
