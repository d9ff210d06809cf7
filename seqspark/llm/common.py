"""Small helpers shared by the training-data operators.

* ``save``: writes a DataFrame once under the folder named by ``spark.checkpoint.dir`` and reads it
  back, so lineage is cut on shared storage and a lost executor costs one re-read.
* ``rank_within``: dense 0-based rank inside a (possibly hot) group without one task per group.
* ``components``: connected components by alternating large-star / small-star joins.
* ``WordTokenizer``: a public tokenizer file applied to whole texts, each distinct piece encoded once.
"""

from __future__ import annotations

import ctypes
import re
import sys
import types
import uuid
from itertools import compress, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.session import ensure_checkpoint_dir

LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))   # A-Z only, other bytes stay


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder (never a machine-local one on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, removed: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` (null included) is not in ``removed(doc_id)``.

    A bitmap of fixed size tells for most rows that they stay; only the rest, the removed ids and the few
    that share a bit with them, is shuffled for the exact anti-join.  No row is decided by the bitmap alone
    unless its bit is unset, which proves that its id is not removed.
    """
    gone = save(removed.select(F.col("doc_id").alias("_id")).distinct(), "removed")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = gone.select(at("_id").alias("p")).groupBy((F.col("p") / 64).cast("int").alias("_w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("_bits"))               # at most bits / 64 rows
    marked = docs.withColumn("_p", at("doc_id")).withColumn("_w", (F.col("_p") / 64).cast("int"))
    marked = marked.join(F.broadcast(save(words, "removed-bits")), "_w", "left")
    maybe = F.coalesce(F.expr("(shiftright(_bits, int(_p % 64)) & 1L) = 1"), F.lit(False))
    doubtful = marked.where(maybe).select(*docs.columns)
    return marked.where(~maybe).select(*docs.columns).unionByName(
        doubtful.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def process_cache(name: str) -> dict:
    """A dictionary that lives in the Python worker process (tasks of one worker share it) until another one is asked for."""
    holder = sys.modules.setdefault("_seqspark_process_cache", types.ModuleType("_seqspark_process_cache"))
    held = holder.__dict__.setdefault("caches", {})
    if name not in held:
        held.clear()
    return held.setdefault(name, {})


def sliced(batches, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows, so that only so many texts are Python strings at a time.

    At the end of the task's rows the worker gives back what it no longer needs (see ``release``).
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def release() -> None:
    """Return freed memory of this Python worker to the system; an idle worker would hold it through later stages."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                           # a C library without it
        pass


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0-based gapless rank of each row inside its ``keys`` group.

    Rows of a group are dealt over hash buckets of ``order``, numbered inside each (group, bucket) and
    shifted by the bucket's offset, so a group holding a third of all rows is still spread over all
    tasks.  ``df`` must be a written table (it is read twice).  The rank order is by (bucket, order);
    rows equal in all ``order`` columns are interchangeable.  ``keys`` must not be null.
    """
    buckets = shuffle_partitions(df.sparkSession)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_rn", F.row_number().over(inside) - 1)
    return (numbered.join(offsets, [*keys, "_bucket"])
            .withColumn(name, (F.col("_off") + F.col("_rn")).cast("long")).drop("_bucket", "_rn", "_off"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: returns (node, component = smallest node).

    Alternating large-star and small-star steps; every step is a map-side combined minimum per node
    and an equi-join, and its result is written to the shared folder.  Isolated nodes do not occur.
    """
    cur = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .distinct(), "cc")
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u <> v")
        nxt = save(small.unionByName(low2.withColumnRenamed("_m", "v")).distinct(), "cc")
        if _stamp(nxt) == _stamp(cur):
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        cur = nxt
    raise RuntimeError("connected components did not settle")


def _stamp(df: DataFrame):
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


class _Numbering(dict):
    """Numbers names in the order in which they are first asked for; ``new``: those numbered since it was emptied."""

    def __init__(self, items=()):
        super().__init__(items)
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        self.new.append(name)
        self[name] = number = len(self)
        return number


def _take(flat: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists ``at`` of those of lengths ``n`` that lie in ``flat``, one after the other."""
    import pyarrow as pa
    bounds = pa.array(np.concatenate([[0], np.cumsum(n)]))
    return pa.LargeListArray.from_arrays(bounds, pa.array(flat)).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file, each distinct piece encoded once per worker process.

    The byte-level pattern of the file always ends a pre-token in four places: before a single space
    between two non-white characters, on both sides of a single line feed between two such characters,
    and between a letter and an ASCII character that is none.  A text is cut at the spaces, and at line feeds if
    all are single, and a new piece at the other places into atoms, whose ids are joined.  A space and letters alone are one pre-token: the
    file's model gets them without its pattern, in the byte alphabet, many at a time; which characters are
    letters is asked of the pattern itself.  Other atoms without white space are encoded many at a time with
    line feeds between them, the rest alone.  Pieces are kept in a cache; at ``max_words`` entries those that
    were met once are forgotten.  Texts are never shortened.  Special-token strings inside a text are ordinary text.

    A piece is written without its leading space; ``BARE`` before it marks that it has none.
    """

    BARE = "\0"
    # White space by Unicode, apart from the space and the line feed.
    WHITE = ("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
             "\u200a\u2028\u2029\u202f\u205f\u3000")
    UNSAFE = ("  ", " \n", "\n ", BARE, *WHITE)
    SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, max_words: int = 600_000, chars: int = 2_000_000):
        cache = process_cache("tokenizers")
        if path not in cache:
            cache[path] = self._load(path)
        self.state, self.max_words, self.chars = cache[path], max_words, chars
        if "index" not in self.state:
            self._reset()

    @staticmethod
    def _load(path: str) -> dict:
        from tokenizers import Tokenizer, models, pre_tokenizers
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        state = {"tok": tok, "newline": tok.encode("\n", add_special_tokens=False).ids, "letters": set(), "others": set()}
        # The byte alphabet: printable Latin-1 characters stand for themselves, the others, in order, from U+0100.
        alphabet = np.arange(256, dtype="<u2")
        hidden = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)]
        alphabet[hidden] = np.arange(256, 256 + len(hidden))
        if isinstance(tok.model, models.BPE):
            tok.model._resize_cache(0)                          # atoms come once; the library's cache costs more than it saves
            cut, vocab = tok.pre_tokenizer and tok.pre_tokenizer.pre_tokenize_str("a b"), tok.get_vocab()
            if tok.normalizer is None and cut == [("a", (0, 1)), ("\u0120b", (1, 3))] and all(
                    chr(c) in vocab for c in alphabet):
                state["model"] = Tokenizer(tok.model)
                state["model"].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
                state["first"] = np.zeros(max(vocab.values()) + 1, bool)                # ids that begin with a space
                state["first"][[i for w, i in vocab.items() if w[0] == "\u0120"]] = True
        alphabet[10] = 10                                       # a line feed stays: it ends a word
        state["alphabet"] = alphabet
        return state

    def _reset(self):
        self.state.update(index=_Numbering(), flat=np.zeros(0, np.uint32), n=np.zeros(0, np.int64), uses=np.zeros(0, np.int32))

    def _forget(self):
        """Keep the pieces met most often, at most half of ``max_words``."""
        s, least = self.state, 2
        while (s["uses"] >= least).sum() > self.max_words // 2:
            least *= 2
        old = np.flatnonzero(s["uses"] >= least)                # names lie in the order of their numbers
        kept = compress(s["index"], (s["uses"] >= least).tolist())
        s.update(index=_Numbering(zip(kept, range(len(old)))), flat=_take(s["flat"], s["n"], old),
                 n=s["n"][old], uses=s["uses"][old] // 2)

    def _plain(self, text: str) -> bool:
        """Every space is a place to cut, and every place to cut at is a space."""
        return not (text[0].isspace() or text[-1].isspace() or any(x in text for x in self.UNSAFE))

    def _numbers(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts in order, number of pieces of each text); new pieces are numbered."""
        import pyarrow as pa
        import pyarrow.compute as pc
        index, parts, plain = self.state["index"], [np.zeros(0, np.int64)] * len(texts), []
        for i, t in enumerate(texts):
            if t and self._plain(t):
                plain.append(i)
            elif t:
                pieces = [t] if self.BARE in t else self.SAFE_CUT.split(t)
                pieces[0] = self.BARE + pieces[0]
                parts[i] = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        if plain:                                               # each distinct piece is looked up once
            # A single line feed is a piece of its own, as spaces stand around it.
            lines = f" {self.BARE}\n {self.BARE}"
            cut = [texts[i] if "\n\n" in texts[i] else texts[i].replace("\n", lines) for i in plain]
            text = pa.array([" ".join([self.BARE + t for t in cut])], pa.large_string())
            words = pc.split_pattern(text, " ").flatten().dictionary_encode()
            names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
            k = np.fromiter(map(index.get, names, repeat(-1)), np.int64, len(names))
            unknown = np.flatnonzero(k < 0)
            new = [names[i] for i in unknown.tolist()]
            k[unknown] = np.arange(len(index), len(index) + len(new))
            index.update(zip(new, k[unknown].tolist()))
            index.new += new
            k = k[words.indices.to_numpy()]
            ends = np.cumsum([t.count(" ") + 1 for t in cut]).tolist()
            for i, a, b in zip(plain, [0, *ends], ends):
                parts[i] = k[a:b]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _know(self, chars: set[str]):
        """Ask the file's pattern which of the characters are letters; ``word``: letters, then the rest of a line."""
        s = self.state
        asked = [c for c in chars - s["letters"] - s["others"] if c.isalnum() and not c.isdecimal()]
        for c in asked:
            one = "model" in s and len(s["tok"].pre_tokenizer.pre_tokenize_str(f"a{c}a")) == 1
            s["letters" if one else "others"].add(c)
        if asked or "word" not in s:
            not_letters = "".join(map(re.escape, sorted(s["others"])))
            s["word"] = re.compile(rf"(\0?[^\W\d_{not_letters}]++)([\x01-\x7f].*)?", re.S)

    def _atoms(self, piece: str) -> list[str]:
        """Atoms of a piece that has a line feed."""
        word = self.state["word"].fullmatch
        body = piece[1:] if piece[0] == self.BARE else piece
        lines = body.split("\n")
        if "" in lines or self.BARE in body or len(body.split()) != len(lines):
            return [piece]
        lines[0] = piece[:len(piece) - len(body)] + lines[0]
        out: list[str] = []
        for k, line in enumerate(lines):
            if k:
                line = self.BARE + line
                out.append(self.BARE + "\n")
            if (m := word(line)) and m[2]:
                out += [m[1], self.BARE + m[2]]
            else:
                out.append(line)
        return out

    def _easy(self, piece: str) -> bool:
        """Without white space: it can stand on a line of its own."""
        return piece != self.BARE and piece.rfind(self.BARE) < 1 and piece.split() == [piece]

    def _of_letters(self, pieces: list[str]):
        """(ids, numbers of ids) of pieces that are single pre-tokens and have a leading space, by the model alone."""
        s = self.state
        for i in range(0, len(pieces), 200):
            data = np.frombuffer((" " + "\n ".join(pieces[i:i + 200])).encode(), np.uint8)
            text = s["alphabet"][data].tobytes().decode("utf-16-le")
            ids = np.array(s["model"].encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            yield ids, np.diff(np.flatnonzero(s["first"][ids]), append=len(ids))

    def _of_lines(self, pieces: list[str], text):
        """(ids, numbers of ids) of pieces without white space, by the tokenizer, a piece a line."""
        s = self.state
        for i in range(0, len(pieces), 2000):
            ids = np.array(s["tok"].encode("\n".join(map(text, pieces[i:i + 2000])), add_special_tokens=False).ids, np.uint32)
            line = ids == s["newline"][0]
            yield ids[~line], np.diff(np.flatnonzero(line), prepend=-1, append=len(ids)) - 1

    def _learn(self):
        """Encode the pieces that were numbered last, by their atoms."""
        s = self.state
        index, base, new = s["index"], len(s["n"]), s["index"].new
        chars = set("".join(new))
        self._know(chars)
        word, whole, bare = s["word"].fullmatch, len(s["newline"]) == 1, self.BARE
        model = "model" in s
        clean = model and not any(map(str.isalpha, chars & s["others"]))    # then Python's letters are the pattern's
        kinds: tuple[list, list, list] = ([], [], [])               # numbers: of letters, on a line, others
        letter, joined, atoms_of, sizes = kinds[0].append, [], [], []
        for number, p in enumerate(new, base):                      # atoms are added to ``new``
            if clean and p.isalpha():
                letter(number)
                continue
            m = None
            if clean and p[-1:] in (",", ".") and p[:-1].isalpha():
                atoms = [p[:-1], bare + p[-1]]
            elif (m := word(p)) and m[2] and "\n" not in p and bare not in m[2]:
                atoms = [m[1], bare + m[2]]
            else:
                atoms = self._atoms(p) if "\n" in p else [p]
            if len(atoms) > 1:
                joined.append(number)
                sizes.append(len(atoms))
                atoms_of += map(index.__getitem__, atoms)
            else:
                alone = model and m and not m[2] and p[0] != bare
                kinds[0 if alone else 1 if whole and self._easy(p) else 2].append(number)
        letters, lines, others = ([new[i - base] for i in k] for k in kinds)
        text = lambda p: p[1:] if p[0] == bare else " " + p
        found = [(s["flat"], s["n"]), *self._of_letters(letters), *self._of_lines(lines, text)]
        for e in s["tok"].encode_batch(list(map(text, others)), add_special_tokens=False):
            found.append((np.array(e.ids, np.uint32), np.array([len(e.ids)], np.int64)))
        flat, n = (np.concatenate(x) for x in zip(*found))
        # The list of each new number among all that are known or found; those of its atoms, if it has several.
        place, parts_in, several = np.zeros(len(new), np.int64), np.ones(len(new), np.int64), np.zeros(len(new), bool)
        place[np.concatenate([np.array(k, np.int64) for k in kinds]) - base] = np.arange(base, len(n))
        at, atoms_of = np.array(joined, np.int64) - base, np.array(atoms_of, np.int64)
        parts_in[at], several[at] = sizes, True
        ends = np.cumsum(parts_in)
        parts = np.repeat(place, parts_in)
        parts[np.repeat(several, parts_in)] = np.where(atoms_of < base, atoms_of, place[np.maximum(atoms_of - base, 0)])
        s["flat"] = np.concatenate([s["flat"], _take(flat, n, parts)])
        s["n"] = np.concatenate([s["n"], np.add.reduceat(n[parts], ends - parts_in)])
        s["uses"] = np.concatenate([s["uses"], np.zeros(len(new), np.int32)])
        index.new = []

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(flat uint32 ids, int64 bounds): ids of text i are ``flat[bounds[i]:bounds[i + 1]]``; null is empty.

        Runs of whole texts of about ``chars`` characters are worked on at a time.
        """
        parts, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < self.chars):
                size += len(texts[stop] or "")
                stop += 1
            parts.append(self._encode(texts[at:stop]))
            at = stop
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        shift = np.cumsum([0] + [int(b[-1]) for _, b in parts])
        return (np.concatenate([f for f, _ in parts]),
                np.concatenate([[0], *[b[1:] + s for (_, b), s in zip(parts, shift)]]).astype(np.int64))

    def _encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        if len(self.state["index"]) > self.max_words:
            self._forget()
        s = self.state
        try:
            k, counts = self._numbers(texts)
            if s["index"].new:
                self._learn()
        except BaseException:
            self._reset()                                       # no name stays without ids
            raise
        s["uses"] += np.bincount(k, minlength=len(s["uses"])).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(s["n"][k])])
        return _take(s["flat"], s["n"], k), ends[np.concatenate([[0], np.cumsum(counts)])]
