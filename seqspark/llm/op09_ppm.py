"""Language-model scoring by prediction by partial matching (PPM).

The model is a byte-context trie of order ``order``: how often each byte follows each context of the
training texts.  A byte is coded in its longest context; where it has not been seen there, an escape
(estimated as distinct symbols / (count + distinct symbols), method C) leads to the next shorter
context, in which the symbols already ruled out are excluded.  The trie is static when it is applied
(pretrained); the code length of a text is the sum over its bytes.

The trie is a Spark table of (context, symbol, count).  The log-probability of every (context, symbol)
that occurs anywhere is computed once, by joining each context with its shorter contexts, and then
brought to the texts: texts lie in blocks of bounded bytes, each block asks for its own distinct grams
and words only.  Nothing is broadcast, no task sees more than a block, and what is gathered grows with
the data.  The same exchange brings the corpus counts of the unigram base score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import LOWER_ASCII, save
from seqspark.llm.op08_langid import remainder

ORDER = 4                       # context bytes
BLOCK_BYTES = 16 << 20          # text per block
BITS = 9                        # bits per symbol in a gram's code: 256 bytes and the start mark
START = 256                     # stands before the first byte of a text
WORD, GRAM = 0, 1


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``block``: consecutive rows of a task are gathered until ``block_bytes`` are reached."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        block, size = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            n = np.array([len(t) if t else 0 for t in b.column(at).cast(pa.binary()).to_pylist()], np.int64)
            ids = np.zeros(len(n), np.int64)
            for i, k in enumerate(n):
                if size and size + k > block_bytes:
                    block, size = block + 1, 0
                ids[i] = block
                size += int(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids)], [*b.schema.names, "block"])

    from pyspark.sql.types import LongType, StructField, StructType
    return docs.mapInArrow(run, StructType([*schema.fields, StructField("block", LongType())]))


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text number) of every byte of every text with its ``order`` symbols before it, newest lowest."""
    n = np.array([len(t) for t in texts], np.int64)
    padded = np.full(int(n.sum()) + order * len(texts), START, np.int64)
    body = np.ones(len(padded), bool)
    starts = np.cumsum(n + order) - n - order
    for k in range(order):
        body[starts + k] = False
    padded[body] = np.frombuffer(b"".join(texts), np.uint8)
    code = padded.copy()
    for k in range(1, order + 1):
        code[k:] |= padded[:len(padded) - k] << (BITS * k)
    return code[body], np.repeat(np.arange(len(texts)), n)


def in_parts(texts: list, marks: list, size: int = 1 << 20):
    """Runs of whole texts (with their marks) of about ``size`` bytes."""
    at = 0
    while at < len(texts):
        stop, n = at, 0
        while stop < len(texts) and (stop == at or n < size):
            n += len(texts[stop])
            stop += 1
        yield texts[at:stop], marks[at:stop]
        at = stop


def word_counts(texts: list[bytes], train: list) -> dict[bytes, int]:
    """Every lower-cased word of the texts with its count in those marked ``train``."""
    own: Counter[bytes] = Counter()
    others: set[bytes] = set()
    for t, use in zip(texts, train):
        words = t.translate(LOWER_ASCII).split()
        (own if use else others).update(words)
    for w in others:
        own.setdefault(w, 0)
    return own


class Places:
    """Places of codes in an array of distinct codes, by tables of hashes: what one table has no room for is in the next."""

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys), dtype=np.int32)
        while len(left):
            turn, which = divmod(len(self.tables), len(self.FACTORS))
            bits = max(4, (2 * len(left) - 1).bit_length())
            factor, shift = np.uint64(self.FACTORS[which] + 2 * turn), np.uint64(64 - bits)
            table = np.zeros(1 << bits, np.int32)
            slot = self._slots(keys[left], factor, shift)
            table[slot] = left
            self.tables.append((factor, shift, table))
            left = left[table[slot] != left]                    # one of those that share a slot stays in it

    @staticmethod
    def _slots(codes: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
        return ((codes.view(np.uint64) * factor) >> shift).view(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        at, open_ = np.zeros(len(codes), np.int32), np.arange(len(codes))
        for factor, shift, table in self.tables:
            some = codes if len(open_) == len(codes) else codes[open_]
            found = table[self._slots(some, factor, shift)]
            at[open_] = found
            open_ = open_[self.keys[found] != some]
            if not len(open_):
                break
        if len(open_):
            raise KeyError(int(codes[open_[0]]))
        return at


def word_hash(word: bytes) -> int:
    import xxhash
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def block_features(blocks: DataFrame, order: int) -> DataFrame:
    """(block, kind, key, own): distinct words (as 64-bit hashes) and grams with their counts in training texts."""

    def emit(block, texts, train):
        words = word_counts(texts, train)
        yield block, WORD, np.array([word_hash(w) for w in words], np.int64), np.array(list(words.values()), np.int64)
        found, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, use in in_parts(texts, train):
            code, owner = grams(part, order)
            learned = np.array(use, bool)[owner]
            for some, weight in ((code[learned], 1), (code[~learned], 0)):
                new, n = np.unique(some, return_counts=True)
                found.append(new)
                seen.append(n * weight)
        keys, counts = np.concatenate(found), np.concatenate(seen)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.diff(keys, prepend=-1))       # codes are not negative
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        yield block, GRAM, keys, counts

    def run(batches):
        for b in batches:
            ids = b.column("block").to_numpy()
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            train = [not h for h in b.column("held_out").to_pylist()]
            for block in np.unique(ids):
                at = np.flatnonzero(ids == block)
                for blk, kind, keys, own in emit(block, [texts[i] for i in at], [int(train[i]) for i in at]):
                    for k in range(0, len(keys), 200_000):
                        part = keys[k:k + 200_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), blk)), pa.array(np.full(len(part), kind, np.int32)),
                             pa.array(part), pa.array(own[k:k + 200_000])], ["block", "kind", "key", "own"])

    return blocks.select("block", "text", "held_out").mapInArrow(run, "block long, kind int, key long, own long")


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """(key, logp): log10 probability of the newest symbol of each gram given the symbols before it.

    ``counts(key, c)``: every gram that is needed, with its training count (0: not seen).
    """
    mask = (1 << BITS) - 1
    by_context = counts.select(F.shiftright("key", BITS).alias("ctx"),
                               F.col("key").bitwiseAND(mask).cast("int").alias("sym"), "c")
    pair = F.sort_array(F.collect_list(F.struct("sym", "c")))   # at most 257 symbols follow a context
    all_rows = save(by_context.groupBy("ctx").agg(pair.alias("l0"), F.min("c").alias("least")), "ppm-contexts")
    rows = all_rows.where("least = 0").select("ctx", "l0")      # only a symbol unseen here leads to shorter contexts
    seen = by_context.where("c > 0")
    for k in range(1, order + 1):                               # shorter contexts: drop the oldest symbol
        shorter = (1 << (BITS * (order - k))) - 1
        seen = (seen.select(F.col("ctx").bitwiseAND(shorter).alias("ctx"), "sym", "c")
                .groupBy("ctx", "sym").agg(F.sum("c").alias("c")))
        lists = seen.groupBy("ctx").agg(pair.alias(f"l{k}")).withColumnRenamed("ctx", "_c")
        rows = rows.join(lists, rows["ctx"].bitwiseAND(shorter) == F.col("_c"), "left").drop("_c")

    def run(batches):
        for b in batches:
            keys, out = [], []
            levels = [_pairs(b.column(k)) for k in range(1, b.num_columns)]
            for i, ctx in enumerate(b.column(0).to_pylist()):
                wanted = [s for s, _ in levels[0][i]]
                for sym, p in ppm_context([[x for x in level[i] if x[1] > 0] for level in levels], wanted):
                    keys.append((ctx << BITS) | sym)
                    out.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.float64())], ["key", "logp"])

    schema = "key long, logp double"
    complete = all_rows.where("least > 0").select("ctx", "l0").mapInArrow(run, schema)
    return complete.unionByName(rows.select("ctx", *[f"l{k}" for k in range(order + 1)]).mapInArrow(run, schema))


def _pairs(column: pa.ListArray) -> list[list[tuple[int, int]]]:
    """(symbol, count) lists of an array<struct> column; null is an empty list."""
    flat = column.flatten()
    both = list(zip(flat.field("sym").to_pylist(), flat.field("c").to_pylist()))
    ends = np.cumsum(np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64))
    return [both[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def ppm_context(levels: list[list[tuple[int, int]]], wanted: list[int]) -> list[tuple[int, float]]:
    """log10 probabilities of ``wanted`` symbols in one context; ``levels``: (symbol, count), longest context first."""
    out, left, ruled, escape = [], list(wanted), set(), 0.0
    for level in levels:
        if not left:
            break
        here = {s: c for s, c in level if s not in ruled}
        if not here:
            continue
        total = sum(here.values()) + len(here)
        out += [(s, escape + math.log10(here[s] / total)) for s in left if s in here]
        left = [s for s in left if s not in here]
        escape += math.log10(len(here) / total)
        ruled |= here.keys()
    rest = 256 - len(ruled)                                     # order -1: all bytes not ruled out are alike
    return out + [(s, escape - math.log10(rest)) for s in left]


def score_corpus(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes): one row per input row.

    ``held_out``: boolean Column; those rows are scored but not learned from (null: learned from).
    Null text is empty: one end token, score 0 (log10 of 1).  ``score`` is the PPM log10 probability
    of the text's UTF-8 bytes.  Repeated rows are scored alike and learned as often as they occur;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = save(in_blocks(rows, block_bytes), "ppm-blocks")
    per_key = Window.partitionBy("kind", "key")
    # A block whose rows are read by two tasks has two rows for some keys, which does no harm.
    counts = save(block_features(blocks, order).select(
        "block", "kind", "key", "own", F.sum("own").over(per_key).alias("c"),
        (F.row_number().over(per_key.orderBy("block", "own")) == 1).alias("first")), "ppm-counts")
    totals = counts.agg(F.sum(F.when(F.col("kind") == WORD, F.col("own"))).alias("n"),
                        F.sum(F.expr(f"int(kind = {WORD} and first and c > 0)")).alias("v")).first()
    ends = blocks.where("not held_out").count()
    n_all, distinct = int(totals["n"] or 0) + ends, int(totals["v"] or 0) + int(ends > 0)
    logp = gram_scores(counts.where(f"kind = {GRAM} and first").select("key", "c"), order)
    # A word found in no other block is known to its block already.
    words = counts.where(f"kind = {WORD} and c <> own").select("block", "kind", "key", F.col("c").cast("double").alias("x"))
    wanted = counts.where(f"kind = {GRAM}").select("block", "kind", "key").join(
        logp, "key").select("block", "kind", "key", F.col("logp").alias("x"))
    denominator = n_all + distinct + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, key, x = (right.column(c).to_numpy() for c in ("kind", "key", "x"))
        known = dict(zip(key[kind == WORD].tolist(), x[kind == WORD].tolist()))
        g_key, g_val = key[kind == GRAM], x[kind == GRAM]
        once = np.unique(g_key, return_index=True)[1] if len(g_key) else slice(0)     # a block read by two tasks asks twice
        g_key, g_val = g_key[once], g_val[once]
        places = Places(g_key)
        texts = [t or b"" for t in left.column("text").cast(pa.binary()).to_pylist()]
        held = left.column("held_out").to_pylist()
        own = word_counts(texts, [not h for h in held])
        for w, c in own.items():
            own[w] = known.get(word_hash(w), c)
        unknown = {w for w, c in own.items() if not c}
        value = {w: math.log10((c + 1) / denominator) for w, c in own.items()}
        end = math.log10((ends + 1) / denominator)
        base, n_tokens, n_known = [], [], []
        for t, h in zip(texts, held):
            ws = t.translate(LOWER_ASCII).split()
            base.append(math.fsum(map(value.__getitem__, ws)) + end)
            n_tokens.append(len(ws) + 1)
            n_known.append(len(ws) + (ends > 0) - (sum(w in unknown for w in ws) if h and unknown else 0))
        total = []
        for part, _ in in_parts(texts, held):
            code, owner = grams(part, order)
            total += np.bincount(owner, g_val[places.of(code)], len(part)).tolist() if len(code) else [0.0] * len(part)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"),
                         "n_tokens": pa.array(n_tokens, pa.int64()),
                         "n_known": pa.array(n_known, pa.int64()),
                         "train_tokens": pa.array([n_all] * len(texts), pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64()),
                         "n_bytes": pa.array([len(t) for t in texts], pa.int64())})

    return (blocks.groupBy("block").cogroup(words.unionByName(wanted).groupBy("block")).applyInArrow(
        lambda left, right: run(left, right),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, n_bytes long"))


def op9_ppm(spark, sf_dir):
    from seqspark.llm.common import table
    docs = table(spark, sf_dir, "documents")
    return score_corpus(docs, remainder("doc_id", 7) == 2)
