"""Language identification by cross-parsing.

One suffix automaton is built per language from labelled text.  A text is parsed greedily into the
longest phrases that occur in a language's reference; the language whose reference needs the fewest
phrases, normalised to bits per symbol (phrases x log2 of the reference length / symbols), wins.
Symbols are the UTF-8 bytes of lower-cased letters, so every alphabet has at most 256 of them and no
two letters are merged; what is no letter is a separator.

The automata become dense transition tables (state x symbol).  A missing transition is stored as the
one that starts a new phrase at this symbol, with a mark to be counted, so a step of the parse is one
table look-up, done for thousands of text segments at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import process_cache, save, sliced

CHARS_PER_LANGUAGE = 40_000     # bound of the reference sample, in characters per language
DOCS_PER_LANGUAGE = 400         # and in documents; the text that reaches the bound is cut
SEGMENT = 1024                  # symbols parsed in a row; every segment starts a new phrase


def remainder(id_col: str, n: int):
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % n


class SuffixAutomaton:
    """Online construction over small integer symbols."""

    def __init__(self, symbols):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            cur = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    copy = self._state(dict(self.next[q]), self.length[p] + 1)
                    self.link[copy] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def _state(self, moves: dict, length: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def table(self, n_symbols: int) -> np.ndarray:
        """int32[state * n_symbols + symbol] = 2 * (next state * n_symbols) + (1 if a new phrase starts)."""
        root = np.zeros(n_symbols, np.int64)
        for c, s in self.next[0].items():
            root[c] = s
        out = np.tile((root * n_symbols * 2 + 1).astype(np.int32), len(self.next))
        for state, moves in enumerate(self.next):
            for c, s in moves.items():
                out[state * n_symbols + c] = s * n_symbols * 2
        out[:n_symbols] |= 1                                    # a phrase that starts at the root counts
        return out


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    points = np.zeros(0x110000, bool)
    points[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return points


def letter_bytes(text: str, points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of the lower-cased text, 0 where they are not a letter's."""
    low = text.lower()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    return np.where(np.repeat(points[code], width), raw, 0).astype(np.uint8)


def symbol_codes(texts: list[str], points: np.ndarray) -> tuple[np.ndarray, int]:
    """uint8 per byte: 0 separator, 1.. the letter bytes of ``texts``, last: bytes that occur in none (no phrase holds them)."""
    seen = np.zeros(256, bool)
    for t in texts:
        seen[letter_bytes(t, points)] = True
    seen[0] = False
    codes = np.full(256, seen.sum() + 1, np.uint8)
    codes[seen], codes[0] = np.arange(1, seen.sum() + 1), 0
    return codes, int(seen.sum()) + 2


def to_symbols(text: str, points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Symbols of the lower-cased text; a run of other characters is one separator."""
    s = codes[letter_bytes(text, points)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    return s[keep]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        chars: int = CHARS_PER_LANGUAGE, max_docs: int = DOCS_PER_LANGUAGE) -> dict:
    """Fit on a bounded sample: per language, at most ``max_docs`` texts in an order given by a hash of the id, until
    ``chars`` characters are gathered; the last text is cut there.  A text counts from its first letter on; every
    language with a letter is learned.  Rows with null id, text or language and texts without letters are not used."""
    # The sample is picked on narrow rows (hash, id, length); only its texts are fetched, cut to ``chars`` characters.
    start = F.regexp_extract(text_col, rf"(?s)\p{{L}}.{{0,{chars - 1}}}", 0)
    rows = docs.select(F.col(lang_col).alias("lang"), start.alias("text"), F.col(id_col).alias("_i")).where(
        "lang is not null and _i is not null and text <> ''").withColumn("_t", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("_i"), "_i", "_t")
    picked = (rows.select("lang", "_i", "_t", F.length("text").alias("_c")).withColumn("_k", F.row_number().over(order))
              .where(f"_k <= {max_docs}"))
    before = F.sum("_c").over(Window.partitionBy("lang").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    picked = save(picked.withColumn("_n", F.coalesce(before, F.lit(0))).where(f"_n < {chars}").select("lang", "_i", "_t", "_k", "_n"),
                  "language-sample")
    texts = rows.join(picked, ["lang", "_i", "_t"]).dropDuplicates(["lang", "_k"])          # rows may repeat
    by_lang: dict[str, list[str]] = {}
    for r in sorted(texts.select("lang", "text", "_k", "_n").collect(), key=lambda r: (r["lang"], r["_k"])):
        by_lang.setdefault(r["lang"], []).append(r["text"][:chars - r["_n"]])
    points = letters()
    codes, n_symbols = symbol_codes([t for ts in by_lang.values() for t in ts], points)
    tables, lengths = [], []
    for lang in sorted(by_lang):
        ref = to_symbols(" ".join(by_lang[lang]), points, codes)
        tables.append(SuffixAutomaton(ref.tolist()).table(n_symbols))
        lengths.append(len(ref))
    return {"langs": sorted(by_lang), "points": points, "codes": codes, "n_symbols": n_symbols, "tables": tables, "lengths": lengths}


def phrase_counts(texts: list, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases[text, language], symbols[text], has_letter[text]) by cross-parsing every whole text."""
    n_texts, n_langs = len(texts), len(model["langs"])
    symbols = [to_symbols(t, model["points"], model["codes"]) if t else np.zeros(0, np.uint8) for t in texts]
    n = np.array([len(s) for s in symbols], np.int64)
    letters = np.array([bool(s.any()) for s in symbols], bool)
    flat = np.concatenate([*symbols, np.zeros(SEGMENT, np.uint8)])
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    segs = (n + SEGMENT - 1) // SEGMENT
    owner = np.repeat(np.arange(n_texts), segs)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(segs) - segs, segs)
    begin, size = first[owner] + k * SEGMENT, np.minimum(SEGMENT, n[owner] - k * SEGMENT)
    order = np.argsort(-size, kind="stable")                    # lanes that end early come last
    owner, begin, size = owner[order], begin[order], size[order]
    counts = np.zeros((n_texts, n_langs), np.int64)
    if not len(owner):
        return counts, n, letters
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    for lang, table in enumerate(model["tables"]):
        state, phrases = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
        for t, a in enumerate(active):
            step = table[state[:a] + flat[begin[:a] + t]]
            phrases[:a] += step & 1
            state[:a] = step >> 1
        counts[:, lang] = np.bincount(owner, phrases, n_texts).astype(np.int64)
    return counts, n, letters


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", shared: list | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, bits): one row per input row, from the whole text alone.

    ``lang_pred`` is ``und`` with score 0 for a text that is null, empty or without letters (or when
    nothing was learned).  ``bits`` maps every language to bits per symbol.  The score is the second
    best rate's share, second / (best + second); 1 with a single language.  Ties go to the language that comes first
    by name.  No shuffle; other columns are ignored.  The broadcast model is appended to ``shared``, so that a caller who
    has saved the result can destroy it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)      # at most CHARS_PER_LANGUAGE per language
    if shared is not None:
        shared.append(sent)

    def run(batches):
        m = sent.value
        process_cache("languages")                              # what an earlier operator left in this worker goes
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            langs, scores, rates = [], [], []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4_000_000):
                    size += len(texts[end] or "")
                    end += 1
                counts, n, letters = phrase_counts(texts[at:end], m)
                at = end
                for c, k, has in zip(counts, n, letters):
                    if not has or not m["langs"]:
                        langs.append("und"), scores.append(0.0), rates.append([])
                        continue
                    rate = [float(x * np.log2(length + 1) / k) for x, length in zip(c, m["lengths"])]
                    best = min(range(len(rate)), key=lambda i: (rate[i], m["langs"][i]))
                    second = min((r for i, r in enumerate(rate) if i != best), default=None)
                    langs.append(m["langs"][best])
                    scores.append(1.0 if second is None else second / (rate[best] + second))
                    rates.append(list(zip(m["langs"], rate)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rates, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "bits"])

    return docs.selectExpr(f"cast(`{id_col}` as long)", f"`{text_col}`").mapInArrow(
        run, "doc_id long, lang_pred string, score double, bits map<string,double>")


def op8_cross_parsing(spark, sf_dir):
    from seqspark.llm.common import table
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                                       "lang_pred", "score")
