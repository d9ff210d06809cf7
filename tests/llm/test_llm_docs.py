"""Document operators against brute force on a small table with the awkward rows."""
import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EXTRA = ["key", "block", "rank", "size", "n", "sh", "shard", "slot", "_t", "words", "h"]


def rows():
    rng = random.Random(5)
    words = ["the", "Cat", "sat", "on", "mats", "Été", "naïve", "x1", "mit", "license", "a b", "ﬁ", "don't", "42"]
    base = [rng.choice(words) for _ in range(60)]
    out = [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (None, " ".join(base)), (3, None), (4, ""),
           (5, "   \n\t "), (6, "one two"), (7, "one two"), (8, " ".join(base[:58] + ["new", "end"])),
           (9, "…!?"), (10, " leading and  double  spaces\n\nand lines "), (11, " ".join(rng.choice(words) for _ in range(9000))),
           (12, "nul\x00byte <|endoftext|> tail"), (13, "\U0001f600 emoji   sep")]
    for i in range(14, 40):
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    for c in EXTRA:
        df = df.withColumn(c, F.lit(7))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def tokens(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_tokenizer_equals_library():
    from seqspark.llm.common import WordTokenizer
    texts = [t for _, t in rows()] + ["a  b", " a", "b ", "a\n b", "a \nb", "a  b", "a  b", "x\x1c y", "it's we'll",
        "a, b. c\nd.\ne,\nf. ", "x?, y!. z", "1. 2, _. é, ñ.\nñ", "\n", "\na", "a\n", "a\n\nb", "a.\n b", "a \nb", "a\u0301, b",
        "\0", "a\0 \0b, c", ", a", ". ", "a,b.c, d", "it's, 'tis. don't\n's", "x\r\ny, z", "…. a", "a.. b,, c", "²³, ½. Ⅷ,\nz"]
    for limit in (4, 30, 100_000):
        w = WordTokenizer(BPE, max_words=limit, chars=400)
        for _ in range(2):
            flat, bounds = w.encode(texts)
            for i, t in enumerate(texts):
                assert flat[bounds[i]:bounds[i + 1]].tolist() == tokens(t), t


def test_word_tokenizer_letters_and_the_rest():
    """Letters alone go to the model without the pattern: what is a letter there, and where a word ends."""
    from seqspark.llm.common import WordTokenizer
    inside = ["", ".", "'s", "'", "''s", "'ſ", "x", "é", "²", "½", "Ⅷ", "ª", "º", "3", "٣", "_", "\u0301", "中", "Ｚ", "ʼ", "\u200d", "ẞ", "\n",
              "\n\n", ".\nB", "\0", "\ud7a3", "\U00013000", "\U0001e900", "\U0002ebf0", "\u1c89", "\U00010d4a", "Ġ", "Ċ", "<|endoftext|>"]
    texts = [f"{a}{b}{c}" for a in ("", "a", "de ab", "é") for b in inside for c in ("", "c", ".", " 7z d", "\nt")]
    texts += [f"x{a}{b}. y{b}{a},\nz" for a in inside for b in inside]
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for limit, chars in ((10, 200), (100_000, 10_000)):
        flat, bounds = WordTokenizer(BPE, max_words=limit, chars=chars).encode(texts)
        assert [(t, flat[a:b].tolist()) for t, a, b in zip(texts, bounds, bounds[1:])] == list(zip(texts, want))


def test_word_tokenizer_words_of_letters_skip_the_pattern(monkeypatch):
    """New words of letters, alone or before ASCII marks, are not sent through the file's pattern."""
    from seqspark.llm.common import WordTokenizer, process_cache
    process_cache("another")                                    # empties the cache
    seen, lines = [], WordTokenizer._of_lines
    monkeypatch.setattr(WordTokenizer, "_of_lines", lambda self, pieces, text: (seen.extend(pieces), lines(self, pieces, text))[1])
    WordTokenizer(BPE).encode(["one two, three. fünf\nsechs sieben!! été"])
    assert sorted(seen) == sorted(["\0one", "\0,", "\0.", "\0sechs", "\0!!"])


def test_word_tokenizer_adds_new_pieces_only(monkeypatch):
    """A batch's new pieces are added to the cache; what is known is not written again."""
    from seqspark.llm import common
    common.process_cache("another")                             # empties the cache
    w, taken, take = common.WordTokenizer(BPE), [], common._take
    w.encode([" ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx")])
    monkeypatch.setattr(common, "_take", lambda flat, n, at: (taken.append(len(at)), take(flat, n, at))[1])
    flat, _ = w.encode(["aiq new, words"])
    assert flat.tolist() == tokens("aiq new, words") and max(taken) <= 5


@pytest.mark.parametrize("high", [2, 300, 50257, 70_000, 1 << 27])
def test_codec_round_trip(high):
    from seqspark.llm.codec import decode_frame, encode_frame
    rng = np.random.default_rng(high)
    for n in (0, 1, 2, 63, 64, 65, 1000, 9000):
        ids = rng.integers(0, high, n).astype(np.uint32)
        ids[n // 2:n // 2 * 2] = ids[:n // 2]
        data = encode_frame([5, None, -1], ids, np.array([n, 0, 0]))
        back = decode_frame(data)
        assert back[0] == [5, None, -1] and back[1].tolist() == [n, 0, 0] and (back[2] == ids).all()
    assert len(encode_frame([1], np.zeros(20_000, np.uint32), np.array([20_000]))) < 2500
    for at in (3, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            decode_frame(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])
    with pytest.raises(ValueError):
        encode_frame([1], np.array([1 << 28], np.uint32), np.array([1]))


def test_codec_beats_zlib_and_order_zero():
    """Bits an id over all documents of sf0.01 as one frame, the header and the prior included."""
    import duckdb
    from seqspark.llm.codec import decode_frame, encode_frame
    from seqspark.llm.common import WordTokenizer
    texts = [t for (t,) in duckdb.sql("SELECT text FROM read_parquet('/root/testdata/sf0.01/documents.parquet') ORDER BY doc_id").fetchall()]
    flat, bounds = WordTokenizer(BPE).encode(texts)
    lengths = np.diff(bounds) + 1
    ids = np.concatenate([np.append(flat[a:b], np.uint32(2)) for a, b in zip(bounds, bounds[1:])])
    data = encode_frame(list(range(len(texts))), ids, lengths)
    assert (decode_frame(data)[2] == ids).all()
    bits = 8 * len(data) / len(ids)
    assert bits < 8.0 and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) - 0.8


def test_codec_escapes():
    """More distinct ids than a prior holds: the rest is escaped, also in the first and last place of a block."""
    from seqspark.llm.codec import MOST, decode_frame, encode_frame
    ids = np.random.default_rng(1).permutation(np.arange(2 * MOST, dtype=np.uint32) * 3001)
    assert (decode_frame(encode_frame([1], ids, np.array([len(ids)])))[2] == ids).all()


def test_op1_files_in_document_order(spark, docs, empty):
    from seqspark.llm.common import shared_path
    from seqspark.llm.op01_tokens import read_token_files, write_token_files
    path = shared_path(spark, "t1")
    write_token_files(docs, path, BPE, frame_tokens=500)
    at, want = 0, []
    for doc, text in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokens(text) + [2]
        want.append((doc, at, len(ids), crc(ids), ids))
        at += len(ids)
    assert collected(read_token_files(spark, path), "doc_id", "start", "n_tokens", "ids_crc32", "ids") == sorted(want, key=repr)
    write_token_files(empty, path + "e", BPE)
    assert read_token_files(spark, path + "e").count() == 0


def brute_components(data, threshold=75):
    sets = []
    for _, t in data:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(data))), [0] * len(data)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    named = collections.defaultdict(list)
    for i, (d, _) in enumerate(data):
        named[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in named[find(i)] if x is not None), default=None), links[i])
                   for i, (d, _) in enumerate(data)), key=repr)


COLS2 = ("doc_id", "n_shingles", "component_id", "n_links")


def test_op2_equals_brute_force(docs, empty):
    from seqspark.llm.op02_jaccard import jaccard_components
    assert collected(jaccard_components(docs), *COLS2) == brute_components(rows())
    assert jaccard_components(empty).count() == 0


@pytest.mark.parametrize("max_group,chunk,seed", [(2, 3, 1), (3, 1000, 2), (32, 7, 3), (4, 16, 4)])
def test_op2_frequent_blocks_and_chunks(spark, max_group, chunk, seed):
    """Clusters of edited copies around the threshold, and a passage that most documents share."""
    from seqspark.llm.op02_jaccard import jaccard_components
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage = [word() for _ in range(25)]
    data, doc = [], 0
    for size in (3, 8, 9, 40, 41, 90, 200):
        base = [word() for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(size // 8)]
            data.append((doc, " ".join(copy)))
            doc += 1
    for _ in range(30):
        data.append((doc, " ".join([word() for _ in range(rng.randint(0, 60))] + passage)))
        doc += 1
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert collected(jaccard_components(df, max_group=max_group, chunk=chunk), *COLS2) == brute_components(data)


@pytest.mark.parametrize("max_group", [2, 32])
def test_op2_few_blocks(spark, max_group):
    """Sets of 3 and 4 shingles that all fall into one block of their band agree in no block."""
    from seqspark.llm.op02_jaccard import bands, blocks, jaccard_components, shingles, word_hashes
    rng, hashes, data = random.Random(3), word_hashes(), []
    in_one = lambda t: len(blocks(shingles(t, hashes), 2)[0]) == 1
    assert bands(3)[-1] == bands(4)[0] == 2
    while len(data) < 12:
        short = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(7))
        if not in_one(short):
            continue
        longer = [t for t in (f"{short} e{i}" for i in range(200)) if in_one(t)][:5]
        data += [(len(data) + i, t) for i, t in enumerate([short, *longer])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = jaccard_components(df, max_group=max_group)
    want = brute_components(data)
    assert sum(n for *_, n in want) > 0
    assert collected(got, *COLS2) == want


def check_pack(pieces, data, end_id, capacity):
    by_doc = collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    want = collections.Counter()
    for d, t in data:
        ids = tokens(t) + [end_id]
        want[d, len(ids)] += len(ids)
        got = [r for r in by_doc[d, len(ids)]]
        assert got and all(r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]]) for r in got)
    assert want == {k: sum(r["length"] for r in v) for k, v in by_doc.items()}
    fill = collections.defaultdict(list)
    for r in pieces:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    assert sorted(fill) == list(range(len(fill)))
    return [sum(n for _, n in p) for p in fill.values()]


@pytest.mark.parametrize("capacity", [16, 256, 2048])
def test_op4_pieces(docs, empty, capacity):
    from seqspark.llm.op04_pack import pack
    fills = check_pack(pack(docs, BPE, capacity=capacity).collect(), rows(), 1, capacity)
    pad = sum(capacity - f for f in fills if f & (f - 1))
    assert pad <= 0.03 * sum(fills)
    assert pack(empty, BPE).count() == 0


def test_op4_one_hot_length_is_not_padded(spark):
    from seqspark.llm.op04_pack import pack, packed_ids
    data = [(i, "the cat " * 6 + "on") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    placed = pack(df, BPE, capacity=16).cache()
    fills = check_pack(placed.collect(), data, 1, 16)
    assert all(f == 16 or f & (f - 1) == 0 for f in fills)
    made = packed_ids(df, placed, BPE, capacity=16).collect()
    assert sum(r["n_tokens"] for r in made) == sum(fills) and all(len(r["ids"]) == 16 or r["n_tokens"] == len(r["ids"]) for r in made)


def test_op4_window_is_the_best_subset():
    from itertools import product

    from seqspark.llm.op04_pack import fill_window
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        cap = rng.randint(max(counts), 60)
        picked = fill_window(counts, cap)
        seed = max(counts)
        best = max(sum(k * n for k, n in zip(counts, c)) for c in product(*[range(n + 1) for n in counts.values()])
                   if dict(zip(counts, c))[seed] and sum(k * n for k, n in zip(counts, c)) <= cap)
        assert sum(k * n for k, n in picked.items()) == best and all(n <= counts[k] for k, n in picked.items())


def brute_licenses(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    hits = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
                          ("mit license", "mit")):
        p = phrase.encode().split()
        hits += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_op5_base_and_expressions(spark, docs, empty):
    from seqspark.llm.op05_license import evaluate, parse_expression, scan_licenses
    texts = [t for _, t in rows()] + ["Apache License, Version 2.0 and the MIT-License; mit license MIT LICENSE", "cc by", "CC BY-NC 4",
                                      "acc by", "cc byé", "x SPDX-License-Identifier: (MIT or Apache-2.0) and GPL-2.0 WITH foo */",
                                      "gnu general public license mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "gpl-2.0 with foo" in got[len(texts) - 2]["labels"] and "cc-by-nc" in got[len(rows()) + 2]["labels"]
    assert parse_expression("MIT OR (Apache-2.0 AND BSD-3-Clause) rest of line") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert parse_expression("MIT and") == ["mit"] and parse_expression(") MIT") is None and parse_expression("") is None
    assert evaluate(["a", "b", "or", "c", "and"]) == ("(a or b) and c", ["a", "b", "c"])
    assert parse_expression("(MIT or X) with e") == ["mit", "x", "or"] and parse_expression("a with b with c") == ["a", "b", "with"]
    assert parse_expression("(MIT and (") == ["mit"] and parse_expression("MIT)") == ["mit"]
    assert scan_licenses(docs).count() == len(rows()) and scan_licenses(empty).count() == 0


def test_op5_long_expressions_are_linear():
    """Alternatives are not multiplied out, and neither terms nor parentheses cost more than once."""
    import time
    from seqspark.llm.op05_license import automaton, evaluate, parse_expression, scan_text
    terms = " and ".join(f"(MIT-{i} or Apache-{i}.0)" for i in range(200))
    expression, licenses = evaluate(parse_expression(terms))
    assert expression == terms.lower() and len(licenses) == 400
    start = time.process_time()
    for text in (" or ".join(f"mit-{i}" for i in range(50_000)), "(" * 50_000 + "mit" + ")" * 50_000,
                 " and ".join(f"(mit-{i} or x{i})" for i in range(30_000)), "mit) " * 30_000):
        assert scan_text(f"SPDX-License-Identifier: {text}", automaton())["expressions"]
    assert time.process_time() - start < 20
    got = scan_text("SPDX-License-Identifier: see LICENSE\nspdx-license-identifier: GPL-2.0+ WITH Classpath-exception-2.0", automaton())
    assert got["labels"] == "gpl-2.0+ with classpath-exception-2.0,unknown"


def test_op6_law_and_slots(spark, docs, empty):
    from seqspark.llm.op06_shard import assign_shards, lpt
    out = assign_shards(docs, n_shards=4).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows() if d is not None)
    shards = collections.defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(4))
    groups = collections.defaultdict(set)
    sizes = collections.Counter()
    for d, t in rows():
        sizes[t or ""] += len((t or "").encode()) + 8
    for r in out:
        groups[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    heap = [0] * 4                                              # few groups: each is an item of its own
    for s in sorted(sizes.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    load = collections.Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert sorted(load[k] for k in range(4)) == sorted(heap)
    assert lpt([("a", 3), ("b", 3), ("c", 2)], 2) == {"a": 0, "b": 1, "c": 0}
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', int(id % 97))").alias("text"))
    many = many.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    load = [r[1] for r in assign_shards(many, n_shards=5, fineness=64).groupBy("shard").agg(F.sum("size")).collect()]
    assert max(load) - min(load) < 0.02 * sum(load) / 5
    assert assign_shards(empty).count() == 0


def items():
    rng = random.Random(8)
    base = [t for d, t in rows() if d == 11][0].split()
    return [(1, " ".join(base[100:140])), (2, " ".join(base[200:213])), (3, " ".join(base[300:312])), (4, "One two"),
            (5, None), (6, "..."), (7, "mit"), (7, "mit"), (None, " ".join(base[400:420])),
            (10, " ".join(rng.choice(base) for _ in range(30)))]


def brute_contamination(data, bench):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    out = []
    for d, t in data:
        w, hit, found = split(t), set(), set()
        for i, b in bench:
            bw = split(b)
            n = min(13, len(bw))
            windows = {tuple(bw[k:k + n]) for k in range(len(bw) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(i)
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_op7_equals_brute_force(spark, docs, empty):
    from seqspark.llm.op07_winnow import contamination
    bench = spark.createDataFrame(items(), "item_id long, text string").withColumn("words", F.lit(1))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collected(contamination(docs, bench), *cols) == brute_contamination(rows(), items())
    none = spark.createDataFrame([], "item_id long, text string")
    assert collected(contamination(docs, none), *cols) == brute_contamination(rows(), [])
    assert contamination(empty, bench).count() == 0
    plan = contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapIn", plan)


def test_op8_cross_parsing(spark, docs, empty):
    from seqspark.llm.op08_langid import SuffixAutomaton, fit, phrase_counts, predict, to_symbols
    auto = SuffixAutomaton([1, 2, 1, 2, 3])
    table, parse = auto.table(5), []
    for word in ([1, 2, 1, 2, 3], [3, 1, 2], [4, 4], [2, 1, 2, 3, 1]):
        state = phrases = 0
        for c in word:
            step = int(table[state + c])
            phrases, state = phrases + (step & 1), step >> 1
        parse.append(phrases)
    assert parse == [1, 2, 2, 2]
    train = [(i, ("the cat and the dog ran home " if i % 2 else "le chat et la chienne sont rentrés ") * 5, "en" if i % 2 else "fr")
             for i in range(20)] + [(99, "text", None), (None, "no id", "xx")]
    model = fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model["langs"] == ["en", "fr"]
    tests = [(1, "the dog and the cat"), (2, "la chienne et le chat"), (3, None), (4, ""), (5, "12 !?"), (6, "the dog " * 4000)]
    df = spark.createDataFrame(tests, "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(df, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "fr", "und", "und", "und", "en"] and all(0 <= s <= 1 for _, s in got.values())
    # brute force: greedy longest phrases inside the reference
    ref = to_symbols(" ".join(t for _, t, x in sorted(train, key=lambda r: 0) if x == "en"), model["points"], model["codes"]).tobytes()
    s = to_symbols(tests[1][1], model["points"], model["codes"]).tobytes()
    at = n = 0
    while at < len(s):
        k = 1
        while at + k < len(s) and s[at:at + k + 1] in ref:
            k += 1
        at, n = at + k, n + 1
    counts, size, _ = phrase_counts([tests[1][1]], model)
    assert counts[0][0] == n and size[0] == len(s)
    assert predict(docs, model).count() == len(rows()) and predict(empty, model).count() == 0
    assert fit(empty.withColumn("lang", F.lit("en")))["langs"] == []
    assert {r["lang_pred"] for r in predict(df, fit(empty.withColumn("lang", F.lit("en")))).collect()} == {"und"}


def test_op8_long_texts_are_learned(spark):
    """A language whose texts are all long, or start without letters, is learned; the bound cuts the last text only."""
    from seqspark.llm.op08_langid import fit, predict
    rng = random.Random(2)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    english, french, german = "the cat sat on mats".split(), "le chat était sur des tapis".split(), "der Hund lag im Zwinger".split()
    data = [(i, text(english, 40), "en") for i in range(30)]
    data += [(100 + i, text(french, 12_000), "fr") for i in range(3)] + [(200, "1 2 " * 20_000 + text(german, 300), "de")]
    data += [(300, "12 34", "xx"), (301, None, "yy"), (302, text(english, 9), None)]
    schema = "doc_id long, text string, lang string"
    model = fit(spark.createDataFrame(data, schema))
    assert model["langs"] == ["de", "en", "fr"]
    assert 40_000 < model["lengths"][2] < 42_000              # 40,000 characters; é has two bytes
    new = spark.createDataFrame([(1, text(french, 50)), (2, text(english, 50)), (3, text(german, 50))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in predict(new, model).collect()} == {1: "fr", 2: "en", 3: "de"}
    alone = fit(spark.createDataFrame([r for r in data if r[2] == "fr"], schema))
    assert {r["lang_pred"] for r in predict(new, alone).collect()} == {"fr"}


def test_op8_rare_letters_of_a_large_alphabet_are_told_apart(spark):
    """Two languages of a thousand letters each, none in common and none frequent."""
    from seqspark.llm.op08_langid import fit, predict
    rng = random.Random(4)
    alphabet = {"a": [chr(0x4E00 + 2 * i) for i in range(1000)], "b": [chr(0x4E00 + 2 * i + 1) for i in range(1000)]}
    rows = [(i, "".join(rng.choices(alphabet["ab"[i % 2]], k=300)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df.where("doc_id < 40"))
    assert model["n_symbols"] <= 256
    got = {r["doc_id"]: r["lang_pred"] for r in predict(df.where("doc_id >= 40"), model).collect()}
    assert got == {i: "ab"[i % 2] for i in range(40, 60)}


def test_op8_held_out_accuracy(spark):
    from seqspark.llm.op08_langid import op8_cross_parsing
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = op8_cross_parsing(spark, "/root/testdata/sf0.001").join(d, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def brute_ppm(train, texts, order):
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    ctx = lambda t, i, k: tuple(([256] * order + list(t[:i]))[len(t[:i]) + order - k:])
    for t in train:
        for i, b in enumerate(t):
            for k in range(order + 1):
                seen[k][ctx(t, i, k)][b] += 1
    out = []
    for t in texts:
        total = 0.0
        for i, b in enumerate(t):
            ruled, p = set(), 1.0
            for k in range(order, -1, -1):
                here = {s: c for s, c in seen[k][ctx(t, i, k)].items() if s not in ruled}
                if not here:
                    continue
                n = sum(here.values()) + len(here)
                if b in here:
                    p *= here[b] / n
                    break
                p *= len(here) / n
                ruled |= here.keys()
            else:
                p /= 256 - len(ruled)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_op9_equals_brute_force(docs, empty, block):
    from seqspark.llm.op09_ppm import score_corpus
    data = [r for r in rows() if r[0] != 11]
    held = F.col("doc_id") % 3 == 0
    got = score_corpus(docs.where("doc_id <> 11 or doc_id is null"), held, order=2, block_bytes=block).collect()
    raw = [(t or "").encode() for _, t in data]
    train = [t for t, (d, _) in zip(raw, data) if not (d is not None and d % 3 == 0)]
    counts = collections.Counter(w for t in train for w in t.translate(LOWER).split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    want = []
    for (d, _), t, s in zip(data, raw, brute_ppm(train, raw, 2)):
        ws = t.translate(LOWER).split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((str(d), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(base, 7) + 0.0, round(s, 7) + 0.0))
    have = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 7) + 0.0,
             round(r["score"], 7) + 0.0) for r in got]
    assert sorted(have) == sorted(want)
    assert score_corpus(empty, held).count() == 0


def test_op9_places_without_searching():
    """Codes are found by hashing, whatever their number; one that is not there is an error."""
    from seqspark.llm.op09_ppm import Places
    rng = np.random.default_rng(5)
    for keys in (np.zeros(0, np.int64), np.array([0]), np.arange(5000) << 36, np.unique(rng.integers(0, 1 << 45, 200_000))):
        codes = keys[rng.integers(0, len(keys), 300_000)] if len(keys) else keys
        assert (Places(keys).of(codes) == np.searchsorted(keys, codes)).all()
        with pytest.raises(KeyError):
            Places(keys).of(np.array([(1 << 46) + 1]))


def test_op9_default_order(spark):
    """Unless told otherwise, four bytes are the context."""
    from seqspark.llm.op09_ppm import score_corpus
    data = [(i, "abcde xbcdf abcde ybcdg " * (i + 1)) for i in range(4)]
    raw = [t.encode() for _, t in data]
    got = score_corpus(spark.createDataFrame(data, "doc_id long, text string"), F.col("doc_id") == 3).collect()
    have = {r["doc_id"]: r["score"] for r in got}
    for (d, _), s in zip(data, brute_ppm(raw[:3], raw, 4)):
        assert have[d] == pytest.approx(s, abs=1e-7)


def test_op2_texts_take_one_python_pass(spark):
    from seqspark.llm.op02_jaccard import meetings, set_hash, shingles, texts_of, word_hashes
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y"), (3, ""), (4, None), (None, "p q r")], "doc_id long, text string")
    wanted = spark.createDataFrame([(1,), (3,), (4,), (None,)], "doc_id long")
    got = texts_of(docs, wanted)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1      # one worker for each task
    assert {(r["sh"], r["text"]) for r in got.collect()} == {
        (set_hash(shingles(t, word_hashes())), t) for t in ("a b c d e f", "p q r")}
    keys = spark.createDataFrame([(64 * k + 1, s) for k in range(3) for s in (5, 6)] + [(2, 5), (2, 7), (1, 7), (4, 9)], "key long, sh long")
    found = sorted(tuple(r) for r in meetings(keys, 32).groupBy("a", "b", "band").sum("n").collect())
    assert found == [(5, 6, 1, 3), (5, 7, 1, 1), (5, 7, 2, 1), (6, 7, 1, 1)]
