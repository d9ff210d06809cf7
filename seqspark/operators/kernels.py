"""Arrow kernels over batches of sequences as byte matrices: counts per position, scores, mutation sums.

Each task makes one pass with bounded state (positions x bases numbers per group) and passes on partial sums
only, so that nothing is exploded to one row per cell.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from seqspark.functions.dna import BASES, LEGAL
from seqspark.operators.delivery import with_model

NONE = 4                        # code of a letter that is no base, and of the cells behind a shorter sequence
ROWS = 8192                     # sequences worked on at a time
_CODE = np.full(256, NONE, np.uint8)
_CODE[[ord(b) for b in BASES]] = range(4)


def code_matrix(texts: list, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes rows x width, lengths): A, C, G, T are 0 .. 3, anything else 4; null is empty.

    Without a width the longest text's length; longer texts are looked at up to the width.
    """
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    joined = "".join((t or "")[:width].ljust(width, "\0") for t in texts)
    return _CODE[np.frombuffer(joined.encode("ascii", "replace"), np.uint8)].reshape(len(texts), width), sizes


def batches_of(batches, rows: int = ROWS):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def position_counts(df: DataFrame, sequence_col: str = "sequence", group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., pos, n_A, n_C, n_G, n_T, n): how often each base stands at each position, n all letters there.

    One row per group and position; each task sums its rows first.
    """
    groups = [df.schema[g] for g in group_cols]
    names = [*[f"n_{b}" for b in BASES], "n"]
    counts = [StructField(c, LongType()) for c in names]
    schema = StructType([*groups, StructField("pos", IntegerType()), *counts])

    def run(batches):
        sums: dict = {}
        for b in batches_of(batches):
            codes, sizes = code_matrix(b.column(b.num_columns - 1).to_pylist())
            ids: dict = {}
            keys = list(zip(*[b.column(i).to_pylist() for i in range(len(groups))])) or [()] * b.num_rows
            group = np.array([ids.setdefault(k, len(ids)) for k in keys])
            for key, g in ids.items():
                mine, inside = codes[group == g], sizes[group == g][:, None] > np.arange(codes.shape[1])
                part = np.stack([*[(mine == c).sum(axis=0) for c in range(4)], inside.sum(axis=0)], axis=1)
                have = sums.get(key, np.zeros((0, 5), np.int64))
                whole = np.zeros((max(len(have), len(part)), 5), np.int64)
                whole[:len(have)] += have
                whole[:len(part)] += part
                sums[key] = whole
        for key, s in sums.items():
            cols = [pa.array([v] * len(s), t) for v, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(s), dtype=np.int32)), *[pa.array(s[:, i]) for i in range(5)]],
                                             names=schema.names)

    types = [to_arrow_type(g.dataType) for g in groups]
    parts = df.select(*group_cols, sequence_col).mapInArrow(run, schema)
    out = parts.groupBy(*group_cols, "pos").agg(*[F.sum(c).alias(c) for c in names])
    return out.where("n > 0")


_LEGAL_ONLY = re.compile(f"[{LEGAL}]*").fullmatch
_LETTERS = np.frombuffer(LEGAL.encode(), np.uint8)
_DIGIT = np.full(256, len(LEGAL), np.uint8)
_DIGIT[_LETTERS] = np.arange(len(LEGAL))
DENSE = 1 << 20                 # counters a task holds per group and k; a larger k is counted batch by batch


def _digits_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(base-5 digits of all letters, their text number) of texts of legal letters."""
    digits = _DIGIT[np.frombuffer("".join(texts).encode(), np.uint8)]
    return digits, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _kmer_codes(digits: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Base-5 codes of all k-mers that lie in one text."""
    n = len(digits) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for i in range(k):
        code *= len(LEGAL)
        code += digits[i:n + i]
    return code[owner[:n] == owner[k - 1:]]


def _kmer_strings(codes: np.ndarray, k: int) -> pa.Array:
    letters = np.empty((len(codes), k), np.uint8)
    for i in range(k - 1, -1, -1):
        codes, digit = np.divmod(codes, len(LEGAL))
        letters[:, i] = _LETTERS[digit]
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(np.arange(0, (len(letters) + 1) * k, k, dtype=np.int32).tobytes()),
                                       pa.py_buffer(letters.tobytes()))


def kmer_sums(df: DataFrame, ks: Sequence[int], group_col: str, sequence_col: str = "sequence") -> DataFrame:
    """(group, k, kmer, n): partial counts of all overlapping k-mers; a k-mer may have several rows, one or more per task.

    Letters A, C, G, T, N are counted as numbers and only a task's sums become strings; a text with another
    letter is counted by its substrings.  Null texts and those below k letters have no k-mers.
    """
    ks = sorted(set(ks))
    schema = StructType([df.schema[group_col], StructField("k", IntegerType()), StructField("kmer", StringType()), StructField("n", LongType())])
    kind = to_arrow_type(df.schema[group_col].dataType)

    def rows_of(group, k, kmers, n):
        return pa.RecordBatch.from_arrays([pa.array([group] * len(n), kind), pa.array(np.full(len(n), k, np.int32)), kmers,
                                           pa.array(n.astype(np.int64))], names=schema.names)

    def run(batches):
        sums: dict = {}
        for b in batches_of(batches):
            groups, texts, other = b.column(0).to_pylist(), b.column(1).to_pylist(), Counter()
            by_group: dict = {}
            for g, t in zip(groups, texts):
                if t:
                    by_group.setdefault(g, []).append(t)
            for g, some in by_group.items():
                odd = [t for t in some if not _LEGAL_ONLY(t)] if not _LEGAL_ONLY("".join(some)) else []
                for t in odd:
                    other.update((g, k, t[i:i + k]) for k in ks for i in range(len(t) - k + 1))
                legal = [t for t in some if _LEGAL_ONLY(t)] if odd else some
                digits, owner = _digits_of(legal)
                for k in ks:
                    if k > 26:                                  # 5^27 exceeds 64 bits
                        other.update((g, k, t[i:i + k]) for t in legal for i in range(len(t) - k + 1))
                        continue
                    codes = _kmer_codes(digits, owner, k)
                    if len(LEGAL) ** k <= DENSE:
                        part = np.bincount(codes, minlength=len(LEGAL) ** k)
                        sums[g, k] = sums[g, k] + part if (g, k) in sums else part
                    elif len(codes):
                        found, n = np.unique(codes, return_counts=True)
                        yield rows_of(g, k, _kmer_strings(found, k), n)
            for g, k in {x[:2] for x in other}:
                mine = [(x[2], n) for x, n in other.items() if x[:2] == (g, k)]
                yield rows_of(g, k, pa.array([x for x, _ in mine], pa.string()), np.array([n for _, n in mine], np.int64))
        for (g, k), n in sums.items():
            found = np.flatnonzero(n)
            if len(found):
                yield rows_of(g, k, _kmer_strings(found, k), n[found])

    return df.select(group_col, F.col(sequence_col).cast("string")).mapInArrow(run, schema)


def weight_table(values) -> np.ndarray:
    """(positions, 5) from a dense array of position x base weights; code 4 weighs nothing."""
    flat = np.array(values or [], float).reshape(-1, 4)
    return np.hstack([flat, np.zeros((len(flat), 1))])


def table_scores(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Weight of every cell (rows x positions of the table)."""
    codes = codes[:, :len(table)]
    return table[np.arange(codes.shape[1])[None, :], codes]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def substitution_sums(df: DataFrame, model: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    """(pos, ref_A .. ref_T, ref_other, p_A .. p_T): letters of the scanned cells and, per alternative, the sum of |p_mut - p_wt|.

    ``model`` is one row with the dense weight array.  A cell's substitutions are the bases that differ from it.
    """
    names = [*[f"ref_{b}" for b in (*BASES, "other")], *[f"p_{b}" for b in BASES]]
    schema = StructType([StructField("pos", IntegerType()), *[StructField(c, DoubleType()) for c in names]])

    def run(batches):
        table, sums = None, np.zeros((0, 9))
        for b in batches_of(batches, 2048):
            if table is None:
                table = weight_table(b.column(1)[0].as_py())
            codes, sizes = code_matrix(b.column(0).to_pylist())
            width = codes.shape[1]
            full = np.zeros((max(width, len(table)), 5))
            full[:len(table)] = table
            full = full[:width]
            own = table_scores(full, codes)
            score = own.sum(axis=1)[:, None]
            p, inside = _sigmoid(score), np.arange(width)[None, :] < sizes[:, None]
            part = np.zeros((width, 9))
            for c in range(4):
                here = inside & (codes != c)
                part[:, c] = (inside & (codes == c)).sum(axis=0)
                part[:, 5 + c] = np.where(here, np.abs(_sigmoid(score + full[None, :, c] - own) - p), 0.0).sum(axis=0)
            part[:, 4] = (inside & (codes == NONE)).sum(axis=0)
            whole = np.zeros((max(len(sums), width), 9))
            whole[:len(sums)] += sums
            whole[:width] += part
            sums = whole
        if len(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), *[pa.array(sums[:, i]) for i in range(9)]],
                                             names=schema.names)

    rows = with_model(df.select(sequence_col), _model=model)
    return rows.mapInArrow(run, schema).groupBy("pos").agg(*[F.sum(c).alias(c) for c in names])


def grouped_scores(df: DataFrame, models: DataFrame, fold_col: str, keep: Sequence[str], sequence_col: str = "sequence") -> DataFrame:
    """(trial_id, keep..., score): every row scored by all trials' models of its fold.

    ``models`` is one row with an array of (fold, trial_id, weights); a row of a fold without models gives no row.
    """
    schema = StructType([StructField("trial_id", IntegerType()), *[df.schema[c] for c in keep], StructField("score", DoubleType())])

    def run(batches):
        by_fold = None
        for b in batches_of(batches):
            if by_fold is None:
                by_fold = {}
                for m in b.column(b.num_columns - 1)[0].as_py() or []:
                    by_fold.setdefault(m["fold"], []).append((m["trial_id"], weight_table(m["weights"])))
            fold = np.array([-1 if f is None else f for f in b.column(0).to_pylist()])
            codes, _ = code_matrix(b.column(1).to_pylist())
            for f in np.unique(fold).tolist():
                at = np.flatnonzero(fold == f)
                kept = [b.column(2 + i).take(pa.array(at)) for i in range(len(keep))]
                for trial, table in by_fold.get(f, []):
                    score = table_scores(table, codes[at]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), trial, np.int32)), *kept, pa.array(score)], names=schema.names)

    rows = df.select(F.col(fold_col).alias("_fold"), F.col(sequence_col).alias("_sequence"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    return with_model(rows, _models=models).mapInArrow(run, schema)
