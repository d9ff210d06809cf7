"""Packing by minimum bin slack (MBS).

Every document is cut into full windows of ``capacity`` tokens and a remainder.  Remainders matter
only by their length, so the problem is the histogram of lengths (at most ``capacity`` numbers,
whatever the corpus).  A window is opened with the longest remaining length; a bitset subset-sum over
the remaining multiset finds the reachable fill closest to the capacity, and backtracking through the
bitsets gives the counts of each length.  The pattern is used as often as the counts allow, so there
are at most ``capacity`` patterns.

Patterns that would leave more than ``tolerance`` padding (few or unlucky lengths) are dissolved: their
remainders are cut into power-of-two pieces, which fill whole windows or sequences whose length is
a power of two and which need no padding.

Which sequence and offset a piece gets follows from its length and its rank among the pieces of that
length.  Ranks are numbered in parallel; the pattern table has a bound of its own and goes to every task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import WordTokenizer, rank_within, save, sliced

CAPACITY = 2048
END_ID = 1
CACHE_WORDS = 600_000


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length of the subset that holds the longest length and is closest to ``capacity``."""
    seed = max(counts)
    room = capacity - seed
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1           # bit s: fill s is reachable
    for length in sorted(counts, reverse=True):
        left, part = counts[length] - (length == seed), 1
        left = min(left, room // length)
        while left > 0:                                         # 1, 2, 4, ... copies at a time
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    fill, picked = reach.bit_length() - 1, {seed: 1}
    for length, part, before in reversed(steps):
        if not before >> fill & 1:                              # reached only by taking these copies
            picked[length] = picked.get(length, 0) + part
            fill -= length * part
    return picked


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(counts per length of one window, number of such windows)] until the histogram is used up."""
    left, out = {k: n for k, n in histogram.items() if n}, []
    while left:
        picked = fill_window(left, capacity)
        times = min(left[k] // n for k, n in picked.items())
        for k, n in picked.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((picked, times))
    return out


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def plan(histogram: dict[int, int], capacity: int, tolerance: int) -> dict:
    """Arrays that give (sequence, offset) from (length, rank): whole remainders and dissolved ones.

    whole rows: length, first rank, copies per window, first sequence, offset of the first copy.
    dissolved rows: length, first rank, number; ``bits``: running number of 2^k pieces before each row.
    """
    whole, dissolved = [], []
    used: dict[int, int] = {}
    sequence = 0
    for picked, times in plan_patterns(histogram, capacity):
        fill = sum(k * n for k, n in picked.items())
        drop = capacity - fill > tolerance and not is_power_of_two(fill)
        offset = 0
        for k in sorted(picked, reverse=True):
            n = picked[k]
            if drop:
                dissolved.append((k, used.get(k, 0), n * times))
            else:
                whole.append((k, used.get(k, 0), n, sequence, offset))
                offset += k * n
            used[k] = used.get(k, 0) + n * times
        sequence += 0 if drop else times
    top = capacity.bit_length() - 1
    before = np.zeros((len(dissolved) + 1, top + 1), np.int64)
    for i, (k, _, n) in enumerate(dissolved):
        before[i + 1] = before[i] + [n * (k >> b & 1) for b in range(top + 1)]
    first = np.zeros(top + 1, np.int64)                         # first sequence of the 2^b pieces
    for b in range(top + 1):
        first[b] = sequence
        per, count = capacity >> b, int(before[-1][b])
        sequence += count // per + bin(count % per).count("1")  # what is left over: powers of two
    return {"whole": np.array(whole, np.int64).reshape(-1, 5), "dissolved": np.array(dissolved, np.int64).reshape(-1, 3),
            "before": before, "first": first, "sequences": sequence, "capacity": capacity}


def piece_place(number: int, b: int, plan_: dict) -> tuple[int, int]:
    """(sequence, offset) of the ``number``-th piece of length 2^b."""
    per, total = plan_["capacity"] >> b, int(plan_["before"][-1][b])
    group, at = divmod(number, per)
    sequence = int(plan_["first"][b]) + group
    rest = total - group * per
    if rest >= per:
        return sequence, at << b
    for k in range(per.bit_length(), -1, -1):                   # leftover of ``rest`` pieces: its binary digits
        if rest >> k & 1:
            if at < 1 << k:
                return sequence, at << b
            at -= 1 << k
            sequence += 1
    raise ValueError("piece beyond its count")


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, cuts): full windows and the remainder of every text.

    ``cuts``: checksums of the remainder's power-of-two pieces, largest first, should it be dissolved.
    """
    def run(batches):
        words = WordTokenizer(tokenizer, cache_words)
        for b in sliced(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            flat, bounds = words.encode(texts)
            rows = []
            for i, doc in enumerate(ids):
                tokens = np.append(flat[bounds[i]:bounds[i + 1]], end_id).astype("<u4")
                data, n = tokens.tobytes(), len(tokens)
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    part, cuts = data[4 * at:4 * (at + size)], []
                    if size < capacity:
                        k = 0
                        for bit in range(capacity.bit_length() - 1, -1, -1):
                            if size >> bit & 1:
                                cuts.append(zlib.crc32(part[4 * k:4 * (k + (1 << bit))]))
                                k += 1 << bit
                    rows.append((doc, at, size, zlib.crc32(part), n, cuts))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cuts"])

    return docs.selectExpr(f"cast(`{id_col}` as long)", f"`{text_col}`").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cuts array<long>")


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, tolerance: int | None = None,
         id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Null text is empty (its end id alone is packed); repeated rows are packed as often as they occur;
    null ids stay null; other columns are ignored; an empty table gives an empty result.  ``capacity``
    must be a power of two.  ``cache_words``: pieces a worker remembers (memory against speed, never results).  ``tolerance``: padding a window may have (default 2 % of the capacity).
    """
    spark = docs.sparkSession
    tolerance = capacity // 50 if tolerance is None else tolerance
    pieces = save(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, cache_words), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram.pop(capacity, None)                               # at most ``capacity`` lengths come to the driver
    shared = spark.sparkContext.broadcast(plan(histogram, capacity, tolerance))
    ranked = rank_within(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank")

    def run(batches):
        p = shared.value
        whole = p["whole"][np.lexsort((p["whole"][:, 1], p["whole"][:, 0]))]
        cut = np.lexsort((p["dissolved"][:, 1], p["dissolved"][:, 0]))
        gone = p["dissolved"][cut]
        keys = (whole[:, 0] << 44) | whole[:, 1]
        cut_keys = (gone[:, 0] << 44) | gone[:, 1]
        for b in batches:
            doc, start, length, crc, total, cuts, rank = (b.column(c).to_pylist() for c in (
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "cuts", "rank"))
            key = (np.array(length, np.int64) << 44) | np.array(rank, np.int64)
            at = np.searchsorted(keys, key, side="right") - 1
            lost = np.searchsorted(cut_keys, key, side="right") - 1
            rows = []
            for i, n in enumerate(length):
                if n == capacity:                               # after all packed sequences
                    rows.append((doc[i], start[i], n, crc[i], total[i], p["sequences"] + rank[i], 0))
                    continue
                j = lost[i]
                if j >= 0 and gone[j, 0] == n and rank[i] < gone[j, 1] + gone[j, 2]:
                    k, done = 0, 0
                    for bit in range(capacity.bit_length() - 1, -1, -1):
                        if n >> bit & 1:
                            number = int(p["before"][cut[j]][bit]) + rank[i] - int(gone[j, 1])
                            seq, off = piece_place(number, bit, p)
                            rows.append((doc[i], start[i] + done, 1 << bit, cuts[i][k], total[i], seq, off))
                            k, done = k + 1, done + (1 << bit)
                    continue
                _, first, copies, seq, off = whole[at[i]].tolist()
                window, copy = divmod(rank[i] - first, copies)
                rows.append((doc[i], start[i], n, crc[i], total[i], seq + window, off + copy * n))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long")


def packed_ids(docs: DataFrame, placed: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY,
               pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, n_tokens, ids): the padded sequences themselves, for unique ids.

    A sequence shorter than ``capacity`` is padded, except where its length is a power of two.
    """
    spans = placed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("at"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(spans, "doc_id")

    def cut(batches):
        words = WordTokenizer(tokenizer)
        for b in batches:
            flat, bounds = words.encode(b.column("text").to_pylist())
            out = []
            for i, at in enumerate(b.column("at").to_pylist()):
                ids = np.append(flat[bounds[i]:bounds[i + 1]], end_id)
                out += [(s["sequence_id"], s["offset"], ids[s["start"]:s["start"] + s["length"]].tolist()) for s in at]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    parts = rows.select("text", "at").mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    joined = (parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
              .select("sequence_id", F.flatten("p.ids").alias("ids")).withColumn("n_tokens", F.size("ids")))
    padding = F.when(F.expr("bit_count(n_tokens) = 1"), 0).otherwise(F.lit(capacity) - F.col("n_tokens"))
    return joined.select("sequence_id", "n_tokens", F.concat("ids", F.array_repeat(F.lit(pad_id), padding)).alias("ids"))


def op4_minimum_bin_slack(spark, sf_dir):
    import public_tokenizers

    from seqspark.llm.common import table
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
