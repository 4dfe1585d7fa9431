"""Vectorised text primitives that run inside Arrow tasks.

A batch of texts is looked at as one UTF-8 byte buffer with offsets, so that
words, lines and windows of thousands of documents are found with a few numpy
passes.  Every array is proportional to one chunk (a few MB of text, or one
single longer document), never to a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space of the word rule [^\x20\x09-\x0D]+ (all ASCII, hence exact on UTF-8 bytes).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Text bytes looked at together.
CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[raw[0] : raw[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, raw - raw[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = n + n // 8 + (1 << 16)
        have = np.full(size, _BASE if which == "up" else _INVERSE, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:  # one very long text must not stay resident
            _powers[which] = have
    return have[:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of symbols[k] * base^k for i <= k < j, modulo 2^64."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _power("up", len(symbols)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span stands."""
    value = (prefix[end] - prefix[start]) * _power("down", len(prefix))[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[buf]


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one entry more than documents)."""
    inside = IS_WORD[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1 : len(buf)]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1 : len(buf)]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def token_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_bounds, but a word is cut where letters or digits meet other signs."""
    kind = np.ones(256, np.uint8)
    kind[list(SPACES)] = 0
    kind[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 2
    of = kind[buf]
    cut = np.ones(len(buf) + 1, bool)
    cut[1:-1] = of[1:] != of[:-1]
    cut[off] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    keep = of[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, off)


def windows(symbols: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q symbols, by doubling; windows that cross documents are left to the caller."""
    out, have, cur, span = None, 0, symbols, 1
    while q:
        if q & 1:
            if out is None:
                out, have = cur, span
            else:
                n = max(0, len(cur) - have)
                out = mix(out[:n] * _BASE + cur[have : have + n])
                have += span
        q >>= 1
        if q:
            n = max(0, len(cur) - span)
            cur = mix(cur[:n] * _BASE + cur[span : span + n])
            span *= 2
    return out


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    span = 1
    while 2 * span <= w:
        values = np.minimum(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    rest = w - span
    if rest:
        values = np.minimum(values[:-rest], values[rest:]) if len(values) > rest else values[:0]
    return values


def owner(off: np.ndarray) -> np.ndarray:
    """Document index of each symbol."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
