"""Adaptive context-mixing range coder for token ids.

A frame stores a prior once: the frequencies of its ids (order 0) and each id's most frequent successor.  Given the
prior, a block is coded on its own, from a fresh model.  Four predictions of the next id are mixed:

* order 2: the id that followed the last two ids in this block (hashed), with a confidence 0..3;
* order 1: the id that followed the last id in this block (hashed), with a confidence 0..3;
* order 1 of the frame: the last id's most frequent successor;
* order 0: the frequencies of the frame.

The mixer holds adaptive frequencies of the four for every pair of confidences and every agreement between the
predictions.  Which of them gives the id is range-coded with these; order 0 then codes the id with its frequency.
Ids beyond the ``MOST`` most frequent of a frame are an escape of order 0, followed by 16 (or 32) plain bits.

Blocks are independent, so all blocks of a frame advance together, one id per step and block, with
NumPy operations over the blocks.  At a few thousand blocks a call costs as much as its work, so a step is kept
to few calls: bounds of the mixer share one integer, orders 1 and 2 lie side by side in one table, and nothing is
done for a part of the blocks but the plain bits.  The last block is filled up to the length of the others.
All arithmetic is on integers (a float quotient is exact where it is used), so every machine decodes the same ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BUCKET_BITS = 9                 # buckets of predictions a block: order 1, then three of order 2
TOP = 14                        # the mixer's frequencies add up to 2^TOP
RATE = 5                        # and move by 1 / 2^RATE
MOST = 1 << 15                  # ids in a frame's prior
ZERO_BITS = 16                  # the prior's frequencies add up to 2^16
MAX_ID = (1 << 28) - MOST
STEPS = 128                     # after so many the encoder puts its digits in place
SMALL = 1 << 20                 # ids below are looked up in a list

# The range coder keeps 2^32 <= width <= 2^48 between ids.  An id narrows it by 2^30 at most, so two digits restore it.
_WIDE, _ONE, _TWO = np.int64(1 << 48), np.int64(1 << 32), np.int64(1 << 16)
_LOW32, _DIGIT = np.int64((1 << 32) - 1), np.int64(0xFFFF)
_TOP, _RATE, _16, _59 = np.int64(TOP), np.int64(RATE), np.int64(16), np.int64(59)
_LEFT = np.zeros(33, np.int64)                                  # what stays of ``low`` after 0, 1 or 2 digits
_LEFT[[0, 16, 32]] = -1, _LOW32, _DIGIT

# A row of the mixer: the bounds of outcomes 0, 1, 2 and 3 (always 2^TOP) in fields of 16 bits.
_FIELDS = np.int64(1 + (1 << 16) + (1 << 32))
_KEPT = np.int64(((1 << TOP - RATE) - 1) * int(_FIELDS))
_SIGNS = np.int64(0x8000 * int(_FIELDS))
# By 16 * outcome: bounds above it rise towards 2^TOP, the others fall; all four frequencies stay above 0.
_GAIN = np.zeros(49, np.int64)
for _s in range(4):
    _GAIN[16 * _s] = sum((j if j <= _s else (1 << TOP - RATE) - 4 + j) << (16 * (j - 1)) for j in (1, 2, 3))



def _fresh() -> np.ndarray:
    """The 64 rows of a new mixer, by the confidences of orders 2 and 1 (4: other than order 1, than the frame's)."""
    rows = np.zeros(64, np.int64)
    for at in range(64):
        sure, other = (at >> 3 & 3, at & 3), (at >> 5, at >> 2 & 1)
        weights = [(1, 4, 24, 96)[sure[0]], (1, 4, 16, 32)[sure[1]] if other[0] else 1, 6 if other[1] else 1, 32]
        bounds = np.cumsum(weights) * ((1 << TOP) - 4) // sum(weights) + np.arange(1, 5)
        rows[at] = sum(int(b) << (16 * j) for j, b in enumerate(bounds))
    return rows


_FRESH = _fresh()
_HASH, _U1, _U2, _U3, _U4 = (np.uint32(x) for x in (2654435761, 1, 2, 3, 4))
_BUCKET, _SUB, _SURE = np.uint32(32 - BUCKET_BITS), np.uint32(30), np.uint32(0x7FFFFFFE)


class Prior:
    """Order 0 and first successors of a frame.  An id of the prior is named by its place, another one by ``size`` + id."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray, following: np.ndarray):
        self.ids, self.freqs, self.size = ids.astype(np.int64), freqs.astype(np.int64), len(ids)     # freqs: escape last
        self.starts = np.cumsum(self.freqs) - self.freqs
        self.following = np.append(following.astype(np.int32), np.int32(-1))                         # -1: none

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        if len(ids) and int(ids.max()) < SMALL:
            counts = np.bincount(ids)
            values = np.flatnonzero(counts)
            counts = counts[values]
        else:
            values, counts = np.unique(ids, return_counts=True)
        top = np.sort(np.lexsort((values, -counts))[:MOST])
        values, rest, counts = values[top], len(ids) - int(counts[top].sum()), counts[top].astype(np.int64)
        weights = np.append(counts, rest)
        freqs = np.where(weights > 0, weights * ((1 << ZERO_BITS) - len(weights)) // max(1, len(ids)) + 1, 0)
        freqs[np.argmax(freqs)] += (1 << ZERO_BITS) - freqs.sum()
        prior = cls(values, freqs, np.full(len(values), -1))
        if len(ids) > 1:
            names = prior.names(ids)
            names = np.minimum(names, prior.size, out=names).astype(np.uint32, copy=False)
            pairs = np.sort(names[:-1] * np.uint32(prior.size + 1) + names[1:])                      # below 2^31
            starts = np.concatenate([[0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1])
            n, (first, second) = np.diff(starts, append=len(pairs)), np.divmod(pairs[starts], np.uint32(prior.size + 1))
            known = (first < prior.size) & (second < prior.size)
            if known.any():                                     # the most frequent, then the last by name
                first, best = first[known], (n[known] << 16) | second[known]
                starts = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1])
                prior.following[first[starts]] = np.maximum.reduceat(best, starts) & 0xFFFF
        return prior

    def names(self, ids: np.ndarray) -> np.ndarray:
        if not self.size:
            return ids.astype(np.int32)
        if len(ids) and int(ids.max()) < SMALL:
            highest = int(ids.max())
            listed = np.arange(self.size, self.size + highest + 1, dtype=np.int32)
            here = self.ids <= highest
            listed[self.ids[here]] = np.flatnonzero(here)
            return listed.take(ids)
        ids = ids.astype(np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), self.size - 1)
        return np.where(self.ids[at] == ids, at, self.size + ids)

    def values(self, names: np.ndarray) -> np.ndarray:
        if not self.size:
            return names
        if not self.freqs[-1]:                                  # no id was escaped
            return self.ids.astype(np.uint32).take(names, mode="clip")
        return np.where(names < self.size, self.ids[np.minimum(names, self.size - 1)], names - self.size)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and frequency of every name, of the escape and, last, of an id that order 0 does not code."""
        return np.append(self.starts, 0), np.append(self.freqs, 1 << ZERO_BITS)

    def pack(self) -> bytes:
        delta = np.diff(self.ids, prepend=0).astype("<u4")
        return zlib.compress(struct.pack("<I", self.size) + delta.tobytes() + self.freqs.astype("<u4").tobytes()
                             + self.following[:-1].astype("<i2").tobytes(), 9)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        raw = zlib.decompress(data)
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)), np.frombuffer(raw, "<u4", n + 1, 4 + 4 * n),
                   np.frombuffer(raw, "<i2", n, 8 + 8 * n))


class _Mixer:
    """Predictions and mixer of all blocks.  An id is written as 4 * name, a prediction as 4 * name + confidence."""

    def __init__(self, lanes: int, prior: Prior):
        self.following, self.last = prior.following.astype(np.uint32) << 2, prior.size
        self.table = np.zeros(lanes << (BUCKET_BITS + 2), np.uint32)
        self.cdf = np.repeat(_FRESH, lanes)                     # a row of all blocks lies together
        self.lane, self.lanes, self.stride = np.arange(lanes, dtype=np.int64), np.uint32(lanes), np.uint32(4 * lanes)
        self.base = np.arange(lanes, dtype=np.uint32) << 2
        self.guess = np.zeros((4, lanes), np.uint32)            # order 2, order 1, the frame's, order 0 (the decoder's)
        self.both = self.guess[:2]
        self.sub = np.ones(lanes, np.uint32)                    # place of order 2 in a bucket, by the id before the last
        self.place = np.empty((2, lanes), np.uint32)
        self.at, self.mix, self.bounds = np.empty((2, lanes), np.int64), np.empty(lanes, np.int64), np.empty((2, lanes), np.int64)
        self.k, self.h = np.empty(lanes, np.uint32), np.empty(lanes, np.uint32)
        self.c, self.d, self.m, self.q = self.bounds[1], *(np.empty((2, lanes), np.uint32) for _ in range(3))
        self.right, self.wide = np.empty((2, lanes), bool), np.empty(lanes, np.int64)

    def predict(self, prev: np.ndarray, place: np.ndarray):
        """``prev``: the last ids; ``place``: their names, ``size`` for those beyond the prior."""
        k, h, at, d, m = self.k, self.h, self.place, self.d, self.m
        np.multiply(prev, _HASH, out=k)
        np.right_shift(k, _BUCKET, out=h)
        np.multiply(h, self.stride, out=h)                      # a bucket of all blocks lies together
        np.add(self.base, h, out=at[1])
        np.add(at[1], self.sub, out=at[0])
        np.right_shift(k, _SUB, out=k)
        np.maximum(k, _U1, out=self.sub)
        np.copyto(self.at, at)
        self.table.take(self.at, out=self.both, mode="clip")
        self.following.take(place, out=self.guess[2], mode="clip")
        np.bitwise_xor(self.both, self.guess[1:3], out=d)       # below 4: they agree
        np.minimum(d, _U4, out=d)
        np.bitwise_and(d, _U4, out=d)
        np.bitwise_and(self.both, _U3, out=m)
        np.bitwise_or(m, d, out=m)
        np.left_shift(m[0], _U3, out=h)
        np.bitwise_or(h, m[1], out=h)
        np.multiply(h, self.lanes, out=h)
        np.add(self.lane, h, out=self.mix)
        self.cdf.take(self.mix, out=self.c, mode="clip")

    def narrow(self, width: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Narrow ``width`` to the outcomes (times 16); returns how far they are from the lower end."""
        bounds = self.bounds
        np.right_shift(width, _TOP, out=width)
        np.left_shift(self.c, _16, out=bounds[0])
        span = np.right_shift(bounds, outcome)
        np.bitwise_and(span, _DIGIT, out=span)
        np.multiply(span, width, out=span)
        np.subtract(span[1], span[0], out=width)
        return span[0]

    def update(self, outcome: np.ndarray, ids: np.ndarray):
        c, d, m, q, wide = self.c, self.d, self.m, self.q, self.wide
        np.right_shift(c, _RATE, out=wide)
        np.bitwise_and(wide, _KEPT, out=wide)
        np.subtract(c, wide, out=c)
        _GAIN.take(outcome, out=wide, mode="clip")
        np.add(c, wide, out=c)
        self.cdf[self.mix] = c
        # A right prediction gains confidence; a wrong one falls to 1, or is replaced when it was below 2.
        np.bitwise_xor(self.both, ids, out=d)
        np.bitwise_and(self.both, _U2, out=m)
        np.multiply(m, _SURE, out=m)                            # all bits of the name, or none
        np.bitwise_and(m, d, out=m)
        np.bitwise_xor(m, np.bitwise_or(ids, _U1, out=self.h), out=m)
        np.less(d, _U4, out=self.right)
        np.minimum(d, _U2, out=q)
        np.multiply(q, self.right, out=q)
        np.add(m, q, out=m)
        self.table[self.at] = m


def _missing(width: np.ndarray, digits: np.ndarray, more: np.ndarray, flags: np.ndarray):
    """``digits``: by how many the widths are to grow (0, 1 or 2); ``more``: 16 for each."""
    np.less(width, _ONE, out=flags[0])
    np.less(width, _TWO, out=flags[1])
    one, two = flags.view(np.uint8)
    np.left_shift(np.add(one, two, out=digits), 4, out=more)


def encode_blocks(names: np.ndarray, literal_words: int, prior: Prior) -> list[bytes]:
    """Payloads of the blocks ``names[i]``."""
    lanes, longest = names.shape
    mixer, (starts, freqs), escapes = _Mixer(lanes, prior), prior.spans(), bool(prior.freqs[-1])
    by_step = np.ascontiguousarray(names.T).astype(np.uint32, copy=False)
    by_step <<= 2
    low, width = np.zeros(lanes, np.int64), np.full(lanes, _WIDE)
    rows = 1 + literal_words * escapes                          # a step's first record has two digits, of which ``emitted`` count
    records, emitted = np.empty((STEPS * rows, lanes), np.int64), np.zeros((STEPS * rows, lanes), np.uint8)
    room = longest * (2 + literal_words) + 4
    digits, n_digits = np.zeros(lanes * room, np.int32), np.arange(lanes, dtype=np.int32 if lanes * room < 1 << 31 else np.int64) * room
    ends, shifts = np.empty(records.shape, n_digits.dtype), np.empty((2, lanes), bool)

    def write(n_rows):
        """The digits of the records behind those before; only ``emitted`` of each count."""
        for i in range(n_rows):
            np.add(ends[i - 1] if i else n_digits, emitted[i], out=ends[i])
        k = np.flatnonzero(emitted[:n_rows])
        record, n, end = records.reshape(-1)[k], emitted.reshape(-1)[k], ends.reshape(-1)[k]
        digits[end - n] = record >> 16
        k = np.flatnonzero(n == 2)
        digits[end[k] - 1] = record[k] & _DIGIT
        n_digits[:] = ends[n_rows - 1]
        emitted[:] = 0

    wrong, differ, more = np.empty((3, lanes), bool), np.empty((3, lanes), np.uint32), np.empty(lanes, np.int64)
    flags, guess, outcome = wrong.view(np.uint8), mixer.guess[:3], np.empty(lanes, np.int64)
    prev, place = np.full(lanes, prior.size << 2, np.uint32), np.full(lanes, prior.size, np.int64)
    at = 0
    for now in by_step:
        if at == len(records):
            write(at)
            at = 0
        mixer.predict(prev, place)
        place = np.right_shift(now, _U2).astype(np.int64)
        if escapes:
            np.minimum(place, prior.size, out=place)
        np.bitwise_xor(guess, now, out=differ)
        np.greater(differ, _U3, out=wrong)
        kind = np.bitwise_and(flags[1], flags[2])
        np.add(kind, flags[1], out=kind)
        np.add(kind, 1, out=kind)
        np.multiply(kind, flags[0], out=kind)                   # 0: order 2, 1: order 1, 2: the frame's, 3: order 0
        np.left_shift(kind, 4, out=outcome)
        np.add(low, mixer.narrow(width, outcome), out=low)
        mixer.update(outcome, now)
        np.bitwise_xor(outcome, 48, out=outcome)
        np.left_shift(outcome, _16, out=outcome)
        np.bitwise_or(outcome, place, out=outcome)              # beyond the list unless order 0 codes the id
        np.right_shift(width, _16, out=width)
        np.add(low, np.multiply(starts.take(outcome, mode="clip"), width), out=low)
        np.multiply(width, freqs.take(outcome, mode="clip"), out=width)
        np.right_shift(low, _16, out=records[at])
        _missing(width, emitted[at], more, shifts)
        np.bitwise_and(low, _LEFT.take(more, mode="clip"), out=low)
        np.left_shift(low, more, out=low)
        np.left_shift(width, more, out=width)
        k = np.flatnonzero(outcome == prior.size) if escapes else ()
        for w in range(literal_words if len(k) else 0):
            width[k] >>= 16
            here = low[k] + width[k] * (((now[k].astype(np.int64) >> 2) - prior.size >> (16 * w)) & 0xFFFF)
            records[at + 1 + w, k], emitted[at + 1 + w, k] = here >> 16, 1
            low[k], width[k] = (here & _LOW32) << 16, width[k] << 16
        at += rows
        prev = now
    write(at)
    for i in range(3):                                          # what is left, two digits and one
        records[i], emitted[i] = (low >> 32 - 16 * i & _DIGIT if i else low >> 32) << 16, 1
    write(3)
    first = np.arange(lanes) * room
    out = np.concatenate([digits[a:b] for a, b in zip(first.tolist(), n_digits.tolist())])
    ends = np.cumsum(n_digits - first)
    while len(k := np.flatnonzero(out > 0xFFFF)):               # carries; none leaves the first digit of a block
        out[k] &= 0xFFFF
        out[k - 1] += 1
    out = out.astype("<u2")
    return [out[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def decode_blocks(payloads: list[bytes], longest: int, literal_words: int, prior: Prior) -> np.ndarray:
    """names[i] of the blocks, ``longest`` each."""
    lanes = len(payloads)
    n_digits = np.array([len(p) // 2 for p in payloads], np.int64)
    pairs = np.concatenate([np.frombuffer(b"".join(payloads), "<u2"), np.zeros(4, "<u2")]).astype(np.uint32)
    pairs[:-1] = (pairs[:-1] << 16) | pairs[1:]                 # two digits from each place
    at, lane = np.cumsum(n_digits) - n_digits, np.arange(lanes, dtype=np.int64)
    code, at = (pairs[at].astype(np.int64) << 16) | (pairs[at + 2] >> 16), at + 3
    digits, more, shifts = np.empty(lanes, np.uint8), np.empty(lanes, np.int64), np.empty((2, lanes), bool)
    width = np.full(lanes, _WIDE)
    mixer, (starts, freqs), escapes = _Mixer(lanes, prior), prior.spans(), bool(prior.freqs[-1])
    by_slot = np.append(np.repeat(np.arange(prior.size + 1), prior.freqs), prior.size + 1).astype(np.uint16)
    guess, rows = mixer.guess.reshape(-1), np.zeros(49, np.int64)
    rows[[0, 16, 32, 48]] = np.arange(4) * lanes
    names = np.empty((longest, lanes), np.uint32)
    prev, place, quotient, unit = np.full(lanes, prior.size << 2, np.uint32), np.full(lanes, prior.size, np.int64), np.empty(lanes), np.empty(lanes, np.int64)
    for now in names:
        mixer.predict(prev, place)
        np.right_shift(width, _TOP, out=unit)
        outcome = np.true_divide(code, unit, out=quotient).astype(np.int64)
        np.multiply(outcome, _FIELDS, out=outcome)              # which bounds lie at or below the code
        np.bitwise_or(outcome, _SIGNS, out=outcome)
        np.subtract(outcome, mixer.c, out=outcome)
        np.bitwise_and(outcome, _SIGNS, out=outcome)
        np.multiply(outcome, _FIELDS, out=outcome)              # their number, at bit 47
        np.right_shift(outcome, 43, out=outcome)
        np.bitwise_and(outcome, 48, out=outcome)
        np.subtract(code, mixer.narrow(width, outcome), out=code)
        np.right_shift(width, _16, out=width)
        slot = np.true_divide(code, width, out=quotient).astype(np.int64)
        np.bitwise_xor(outcome, 48, out=unit)
        np.left_shift(unit, 12, out=unit)
        np.maximum(slot, unit, out=slot)                        # the last place unless order 0 codes the id
        name = by_slot.take(slot, mode="clip").astype(np.int64)
        np.subtract(code, np.multiply(starts.take(name, mode="clip"), width), out=code)
        np.multiply(width, freqs.take(name, mode="clip"), out=width)
        np.left_shift(name, 2, out=mixer.guess[3], casting="unsafe")
        _missing(width, digits, more, shifts)
        np.left_shift(code, more, out=code)
        np.left_shift(width, more, out=width)
        word = pairs.take(at, mode="clip").astype(np.int64)
        np.right_shift(word, np.subtract(32, more, out=unit), out=word)
        np.bitwise_or(code, word, out=code)
        np.add(at, digits, out=at)
        k = np.flatnonzero(name == prior.size) if escapes else ()
        if len(k):
            value = np.full(len(k), prior.size, np.int64)
            for w in range(literal_words):
                width[k] >>= 16
                part = np.minimum((code[k] / width[k]).astype(np.int64), 0xFFFF)
                value += part << (16 * w)
                code[k] = ((code[k] - width[k] * part) << 16) | (pairs.take(at[k], mode="clip") >> 16)
                width[k] <<= 16
                at[k] += 1
            mixer.guess[3, k] = value << 2
        np.add(rows.take(outcome, mode="clip"), lane, out=unit)
        guess.take(unit, out=now, mode="clip")
        np.bitwise_and(now, np.uint32(0xFFFFFFFC), out=now)
        mixer.update(outcome, now)
        place = np.right_shift(now, _U2).astype(np.int64)
        if escapes:
            np.minimum(place, prior.size, out=place)
        prev = now
    return np.ascontiguousarray((names >> 2).T)


MAGIC = b"TIDF\x03"
_HEAD = "<5sBIIIQII"               # magic, plain words, documents, blocks, ids a block, ids, bytes and crc32 of the prior
_BLOCK = np.dtype([("tokens", "<u4"), ("bytes", "<u4"), ("crc32", "<u4")])


def encode_frame(doc_ids: list, ids: np.ndarray, lengths: np.ndarray, block_tokens: int = 2048) -> bytes:
    """A self-contained frame: header, documents (id, null mark, length), prior, block table, payloads, checksum.

    ``ids``: all ids of the documents in order; few ids make shorter blocks, so that many advance together.
    """
    n = len(ids)
    if n and int(ids.max()) >= MAX_ID:
        raise ValueError("ids of 2^28 - 2^15 and more are not supported")
    block_tokens = int(min(block_tokens, max(256, 1 << max(0, n // 512).bit_length())))
    words = 1 if not n or int(ids.max()) < 65536 else 2
    lanes = -(-n // block_tokens)
    prior = Prior.of(ids)
    grid = np.zeros(lanes * block_tokens, np.int32)
    grid[:n] = prior.names(ids)
    grid = grid.reshape(lanes, block_tokens)
    sizes = np.full(lanes, block_tokens, np.int64)
    if lanes:
        sizes[-1] = n - (lanes - 1) * block_tokens
    payloads = encode_blocks(grid, words, prior) if lanes else []
    stored = prior.pack()
    table = np.zeros(lanes, _BLOCK)
    raw = ids.astype("<u4")
    for i in range(lanes):
        table[i] = (sizes[i], len(payloads[i]), zlib.crc32(raw[i * block_tokens:(i + 1) * block_tokens].tobytes()))
    body = b"".join([
        struct.pack(_HEAD, MAGIC, words, len(doc_ids), lanes, block_tokens, n, len(stored), zlib.crc32(stored)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.asarray(lengths).astype("<u8").tobytes(),
        stored, table.tobytes(), *payloads])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_frame(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, all ids); raises on a wrong checksum of the frame or of any block."""
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("frame checksum does not match")
    magic, words, n_docs, lanes, block_tokens, n, n_prior, crc_prior = struct.unpack_from(_HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token-id frame")
    at = struct.calcsize(_HEAD)
    docs = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    stored = data[at:at + n_prior]
    if zlib.crc32(stored) != crc_prior:
        raise ValueError("prior checksum does not match")
    prior = Prior.unpack(stored)
    at += n_prior
    table = np.frombuffer(data, _BLOCK, lanes, at)
    at += lanes * _BLOCK.itemsize
    ends = at + np.cumsum(table["bytes"].astype(np.int64))
    payloads = [data[e - b:e] for e, b in zip(ends.tolist(), table["bytes"].tolist())]
    ids = np.zeros(0, np.uint32)
    if lanes:
        sizes = table["tokens"].astype(np.int64)
        grid = prior.values(decode_blocks(payloads, block_tokens, words, prior))
        for row, k, crc in zip(grid, sizes.tolist(), table["crc32"].tolist()):
            if zlib.crc32(row[:k].astype("<u4").tobytes()) != crc:
                raise ValueError("block checksum does not match")
        ids = grid.reshape(-1)[:n].astype(np.uint32)
    return [None if x else d for d, x in zip(docs.tolist(), null.tolist())], lengths, ids
