"""Column expressions on DNA strings.

All functions return JVM-side ``Column`` expressions (no Python UDF), so they
stay inside whole-stage codegen or Spark's higher-order-function evaluator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference semantics).
# Base order of the one-hot rows: A, C, G, T.
BASES = ["A", "C", "G", "T"]
# Legal letters kept by clean_dna; every other character becomes N.
LEGAL = "ACGTN"
# Label ids and names.
LABEL_NAMES = {0: "weak_promoter", 1: "strong_promoter"}
# Characters Python's str.isspace() treats as whitespace (removed by clean_dna),
# written as a Java/RE2 character class usable in Spark and DuckDB alike.
WHITESPACE_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Re-coding of ASCII letters to bases used by the fixture views: a..z cycle A,C,G,T.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
ALPHABET_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_dna(seq) -> Column:
    """upper -> drop all whitespace -> any char outside ACGTN becomes N. NULL stays NULL.

    Already-clean strings (the common case) take a one-regex fast path.
    """
    raw = _c(seq)
    s = F.upper(raw)
    s = F.regexp_replace(s, WHITESPACE_CLASS, "")
    full = F.regexp_replace(s, f"[^{LEGAL}]", "N")
    return F.when(raw.rlike(rf"\A[{LEGAL}]*\z"), raw).otherwise(full)   # $ would also match before a final line end


def recode_letters(text) -> Column:
    """Keep the ASCII letters of lower(text) and map them onto A/C/G/T."""
    letters = F.regexp_replace(F.lower(_c(text)), "[^a-z]", "")
    return F.translate(letters, ALPHABET, ALPHABET_BASES)


def tiles(seq, width: int = 81) -> Column:
    """Consecutive ``width``-long pieces of a string (the last one may be shorter).

    One linear regex pass (``regexp_extract_all``); pair with ``posexplode``
    to get the tile number.  Empty array for '' / NULL.
    """
    return F.coalesce(F.regexp_extract_all(_c(seq), F.lit(f"(?s).{{1,{width}}}"), F.lit(0)),
                      F.array().cast("array<string>"))


def kmers(seq, k: int) -> Column:
    """Overlapping k-mers with stride 1; empty when len < k or NULL.

    One linear regex pass: a zero-width lookahead captures the k characters
    that start at every position (no per-k-mer substring walk).
    """
    return F.coalesce(F.regexp_extract_all(_c(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)),
                      F.array().cast("array<string>"))


def chars(seq) -> Column:
    """Characters of a string as an array (never ``['']`` for the empty string)."""
    return F.regexp_extract_all(_c(seq), F.lit("(?s)."), F.lit(0))


def one_hot(seq) -> Column:
    """4 x L one-hot (rows A,C,G,T) of upper(seq); an unknown base gives an all-zero column."""
    cs = chars(F.upper(_c(seq)))
    return F.transform(F.array(*[F.lit(b) for b in BASES]),
                       lambda b: F.transform(cs, lambda c: (c == b).cast("int")))


def decode_one_hot(mat) -> Column:
    """Per-column argmax over the 4 rows, first row wins ties (all-zero column -> 'A').

    The 4 rows are zipped once, so the work is linear in the sequence length.
    """
    m = _c(mat)
    z = F.arrays_zip(*[m.getItem(i).alias(b) for i, b in enumerate(BASES)])

    def pick(cell):
        va, vc, vg, vt = (cell[b] for b in BASES)
        return (F.when((va >= vc) & (va >= vg) & (va >= vt), "A")
                .when((vc >= vg) & (vc >= vt), "C")
                .when(vg >= vt, "G").otherwise("T"))

    return F.array_join(F.transform(z, pick), "")


def matrix_to_strings(mat) -> list[Column]:
    """Render an int one-hot matrix as 4 digit strings (one per base row)."""
    m = _c(mat)
    return [F.array_join(F.transform(m.getItem(i), lambda v: v.cast("string")), "")
            .alias(f"onehot_{b.lower()}") for i, b in enumerate(BASES)]


def pad_truncate(tokens, max_length: int, pad_token: str = "<pad>", side: str = "right") -> list[Column]:
    """Pad/truncate a token array to ``max_length``; returns (input_tokens, attention_mask).

    Truncation keeps the head (tokenizer default); padding goes right or left.
    """
    t = F.slice(_c(tokens), 1, max_length)
    n_pad = F.greatest(F.lit(max_length) - F.size(t), F.lit(0))
    pad = F.array_repeat(F.lit(pad_token), n_pad)
    ones = F.array_repeat(F.lit(1), F.size(t))
    zeros = F.array_repeat(F.lit(0), n_pad)
    if side == "right":
        return [F.concat(t, pad), F.concat(ones, zeros)]
    if side == "left":
        return [F.concat(pad, t), F.concat(zeros, ones)]
    raise ValueError("side must be 'right' or 'left'")


def prompt_text(seq, prompt: str | None = None) -> Column:
    """``prompt.strip() + ' ' + seq`` when a prompt is given, else the sequence alone."""
    s = _c(seq).cast("string")
    if prompt is None or prompt.strip() == "":
        return s
    return F.concat(F.lit(prompt.strip() + " "), s)


def label_name(label) -> Column:
    """0 -> weak_promoter, 1 -> strong_promoter, anything else NULL."""
    lab = _c(label)
    return F.when(lab == 0, LABEL_NAMES[0]).when(lab == 1, LABEL_NAMES[1])
