"""k-mer counting for large k by minimizer partitioning.

Above some k nearly every k-mer is distinct, so map-side combining saves nothing and an explode shuffles k
characters per position.  Here the k-mers are not shuffled: each position's minimizer (the smallest hash of the
m-mers inside the k-mer) names its bucket, consecutive positions of one bucket are one super-k-mer, a substring
that holds them all, and only super-k-mers are shuffled and counted per bucket.  Equal k-mers have equal
minimizers, so a bucket's counts are final.

There is a bucket for every ``LOAD`` / 4 k-mers (at least ``BUCKETS``), so the table of their loads is small.
Consecutive buckets are one task up to about ``LOAD`` k-mers: a task's counters do not grow with the data, which
Spark's own choice by shuffled bytes would let them, as a packed piece is a small part of its k-mers.  A bucket
above ``HOT`` times the mean load is dealt over several salts and its partial counts are added up in a second step;
the others need one step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from seqspark.functions.dna import kmers
from seqspark.session import materialize

M = 7                           # letters of a minimizer (at most k)
BUCKETS = 1024
LETTERS = 31                    # of a piece that is packed into 64 bits
PACKED = "ACGT"
LOAD = 500_000                  # k-mers of a task
HOT = 8                         # times the mean load
ROWS = 10_000                   # sequences worked on at a time
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit integers (wrap-around arithmetic)."""
    x = (x ^ (x >> np.uint64(29))) * _FACTOR
    return x ^ (x >> np.uint64(32))


def minimizer_buckets(letters: np.ndarray, k: int, m: int, buckets: int) -> np.ndarray:
    """Bucket of the k-mer at every position of one run of code points (len - k + 1 values)."""
    h = np.zeros(len(letters) - m + 1, np.uint64)
    for i in range(m):
        h = h * _FACTOR + letters[i:len(letters) - m + 1 + i].astype(np.uint64)
    h = _mix(h)
    low, span = h, 1
    while span * 2 <= k - m + 1:                    # minimum over windows of k - m + 1 by doubling
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = k - m + 1 - span
    low = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
    return (_mix(low) % np.uint64(buckets)).astype(np.int32)


def _pack(whole: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, packable): pieces of A/C/G/T as base-4 digits behind a leading 1."""
    digit = np.full(128, 4, np.int64)
    digit[[ord(c) for c in PACKED]] = range(4)
    d = np.where(whole < 128, digit[np.minimum(whole, 127)], 4)
    bad = np.concatenate([[0], np.cumsum(d == 4)])
    code = np.ones(len(first), np.int64)
    for j in range(int(length.max(initial=0))):
        inside = j < length
        code = np.where(inside, code * 4 + d[np.where(inside, first + j, 0)] % 4, code)
    return code, bad[first + length] == bad[first]


def unpack(code):
    """Letters of a packed piece."""
    return F.translate(F.substr(F.conv(code.cast("string"), 10, 4), F.lit(2)), "0123", PACKED)


def _lists(values: pa.Array, row: np.ndarray, n_rows: int) -> pa.ListArray:
    """Lists of ``values`` (sorted by row) for rows 0 .. n_rows - 1."""
    offsets = np.searchsorted(row, np.arange(n_rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def super_kmers(df: DataFrame, k: int, sequence_col: str = "sequence", group_cols: Sequence[str] = (), m: int = M,
                buckets: int = BUCKETS) -> DataFrame:
    """(group..., bucket, codes, texts, n_kmers): super-k-mers of all sequences; null ones and those below k letters give none.

    A task passes on one row per (group, bucket) of up to ``ROWS`` sequences.  Up to k = 31 a piece of A/C/G/T is
    cut to 31 letters and packed into one long; every other piece is a string.
    """
    m = min(m, k)
    groups = [df.schema[g] for g in group_cols]
    schema = StructType([*groups, StructField("bucket", IntegerType()), StructField("codes", ArrayType(LongType())),
                         StructField("texts", ArrayType(StringType())), StructField("n_kmers", LongType())])
    rows = df.select(*group_cols, F.col(sequence_col).alias("_s")).where(F.length("_s") >= k)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                yield from pieces(b.slice(at, ROWS))

    def pieces(part):
        texts = part.column(part.num_columns - 1).to_pylist()
        whole = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        bucket = minimizer_buckets(whole, k, m, buckets)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        ok = text_of[:len(bucket)] == text_of[k - 1:]                     # the k letters lie in one text
        text_of = text_of[:len(bucket)]
        cut = np.ones(len(bucket), bool)
        cut[1:] = (bucket[1:] != bucket[:-1]) | (text_of[1:] != text_of[:-1]) | (ok[1:] != ok[:-1])
        if k <= LETTERS:
            at = np.arange(len(bucket))
            run_at = np.maximum.accumulate(np.where(cut, at, 0))
            cut |= (at - run_at) % (LETTERS - k + 1) == 0
        first = np.flatnonzero(cut)
        n = np.diff(np.append(first, len(bucket)))
        first, n = first[ok[first]], n[ok[first]]
        if not len(first):
            return
        ids: dict = {}
        named = [part.column(i).to_pylist() for i in range(len(groups))]
        group = np.array([ids.setdefault(v, len(ids)) for v in zip(*named)], np.int64) if groups else np.zeros(len(texts), np.int64)
        g = group[text_of[first]]
        order = np.lexsort((g, bucket[first]))
        first, n, g = first[order], n[order], g[order]
        b = bucket[first]
        new = np.append(True, (b[1:] != b[:-1]) | (g[1:] != g[:-1]))
        row, start = np.cumsum(new) - 1, np.flatnonzero(new)
        length = n + k - 1
        code, packable = _pack(whole, first, length) if k <= LETTERS else (np.zeros(len(first), np.int64), np.zeros(len(first), bool))
        begin = np.cumsum(sizes) - sizes
        loose = [texts[t][f:f + e] for t, f, e in zip(text_of[first[~packable]].tolist(), (first - begin[text_of[first]])[~packable].tolist(),
                                                     length[~packable].tolist())]
        take = pa.array(text_of[first[start]])
        yield pa.RecordBatch.from_arrays(
            [*[part.column(i).take(take) for i in range(len(groups))], pa.array(b[start]),
             _lists(pa.array(code[packable]), row[packable], len(start)), _lists(pa.array(loose, pa.string()), row[~packable], len(start)),
             pa.array(np.add.reduceat(n, start).astype(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def n_buckets(total: int, load: int = LOAD) -> int:
    """A power of two: a bucket for every ``load`` / 4 k-mers, at least ``BUCKETS``."""
    return max(BUCKETS, 1 << max(0, 4 * total // load - 1).bit_length())


def kmer_counts_by_minimizer(df: DataFrame, k: int, sequence_col: str = "sequence", group_cols: Sequence[str] = (),
                             m: int | None = None, buckets: int | None = None, hot: float = HOT, load: int = LOAD) -> DataFrame:
    """A5 for large k: (group..., kmer, n), equal to exploding all k-mers and counting them."""
    total = df.agg(F.sum(F.greatest(F.length(sequence_col) - F.lit(k - 1), F.lit(0)).cast("long"))).first()[0] or 0
    buckets = buckets or n_buckets(total, load)
    m = m or max(M, (16 * buckets).bit_length() // 2)                                        # 4^m minimizers for the buckets
    most = max(1.0, total / buckets * hot)
    pieces = materialize(super_kmers(df, k, sequence_col, group_cols, m, buckets))
    loads = pieces.groupBy(F.col("bucket").alias("_b")).agg(F.sum("n_kmers").alias("_load"))     # <= buckets rows
    loads = loads.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col("_load") / most)).cast("int"))
    before = F.sum(F.when(F.col("_salts") == 1, F.col("_load")).otherwise(0)).over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))                     # over the bucket table
    places = materialize(loads.withColumn("_task", F.floor(F.coalesce(before, F.lit(0)) / load).cast("int")))
    warm_load = places.where("_salts > 1").agg(F.sum("_load")).first()[0] or 0
    tasks, warm_tasks = total // load + 1, 2 * (warm_load // load + 1)
    dealt = pieces.join(F.broadcast(places), F.col("bucket") == F.col("_b"))

    def counted(spread, *place):
        piece = F.concat(F.transform("codes", unpack), F.col("texts"))
        each = spread.select(*place, *group_cols, F.explode(piece).alias("_piece"))
        return each.select(*place, *group_cols, F.explode(kmers("_piece", k)).alias("kmer")).groupBy(
            *place, *group_cols, "kmer").agg(F.count(F.lit(1)).alias("n"))

    cold = counted(dealt.where("_salts = 1").repartitionById(tasks, F.col("_task")), "_task").select(*group_cols, "kmer", "n")
    if not warm_load:
        return cold
    salted = dealt.where("_salts > 1").withColumn("_salt", F.pmod(F.xxhash64("codes", "texts"), F.col("_salts")).cast("int"))
    warm = counted(salted.repartition(warm_tasks, "bucket", "_salt"), "bucket", "_salt")
    warm = warm.repartition(warm_tasks, *group_cols, "kmer").groupBy(*group_cols, "kmer").agg(F.sum("n").alias("n"))
    return cold.unionByName(warm)
