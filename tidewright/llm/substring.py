"""Substring dedup over bytes by bucket-pointer refinement.

Suffixes are taken around anchors (see repeats).  Those of one q-gram form a
bucket; a bucket whose neighbourhoods are all equal, or all of one document, is
settled at once, the others are refined in one task each.  There every suffix has
a pointer to its bucket (the place where the bucket begins in sorted order), at
first that of its eight bytes.  A bucket is refined by sorting its suffixes on
the pointers at the offset down to which they are equal: what shares a bucket
and points to one bucket there is equal twice as far.  New buckets' pointers
replace the old ones, so every refinement reuses those before it, and a suffix
alone leaves for good.  A neighbourhood that shares neither the bytes before its
q-gram nor those behind it (half of what a window has besides) with another
document has no window in common with any, and leaves before the first sort.  Three refinements (8, 16, 18 bytes on) reach the depth
of a window; what then still shares a bucket is equal, byte for byte.

Defined results: as in repeats; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.repeats import Rule, apply_intervals, covered, order_by, pack, repeated_starts, spread, unpack
from tidewright.llm.textkernel import byte_symbols, flat, mix

RULE = Rule(length=50, q=18, within=False)
#: Open neighbourhoods of one q-gram beyond which it is lengthened to the whole window; neighbourhoods refined together.
LARGE, TOGETHER = 20_000, 20_000
#: Bytes of an initial bucket.
_STEP = 8
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_symbols(buf), off


def gather(rule: Rule, batch: pa.RecordBatch, off: np.ndarray, ids: np.ndarray, place: np.ndarray, rest: dict[str, np.ndarray], buckets: int) -> Iterator[tuple[int, str, bytes]]:
    """The bytes around every open anchor, for its bucket."""
    buf, _ = flat(batch.column(1))
    d = np.searchsorted(off, place, "right") - 1
    left = np.minimum(place - off[d], rule.reach - 1)
    right = np.minimum(off[d + 1] - place, rule.length)
    wide = rule.reach - 1 + rule.length
    span = np.arange(-(rule.reach - 1), rule.length)
    text = np.zeros((len(place), -(-wide // 8) * 8), np.uint8)
    inside = (span >= -left[:, None]) & (span < right[:, None])
    text[:, :wide][inside] = buf[(place[:, None] + span)[inside]]
    words = text.view(np.uint64)
    for bucket, some in spread(rest["bucket"].astype(np.int64), buckets):
        some = some[np.argsort(rest["gram"][some], kind="stable")]
        columns = {f"w{i}": words[some, i] for i in range(words.shape[1])}
        yield bucket, "gathered", pack(doc=ids[d[some]], place=(place - off[d])[some].astype(np.uint32), gram=rest["gram"][some], left=left[some].astype(np.uint8), right=right[some].astype(np.uint8), **columns)


def refine(rule: Rule, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of windows that came in an earlier document."""
    a = unpack(blobs)
    wide = rule.reach - 1 + rule.length
    some = np.flatnonzero(_may_share(rule, a, np.stack([a[f"w{i}"] for i in range(-(-wide // 8))], axis=1).view(np.uint8)))
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = some[np.argsort(a["gram"][some], kind="stable")]
    a = {k: v[order] for k, v in a.items()}
    cuts = np.flatnonzero(np.concatenate([[True], a["gram"][1:] != a["gram"][:-1]]))
    found, at = [], 0
    while at < len(order):
        after = cuts[np.searchsorted(cuts, at, "right") :]
        fit = after[after <= at + TOGETHER]
        end = int(fit[-1]) if len(fit) and len(after) and at + TOGETHER < len(order) else (int(after[0]) if len(after) and at + TOGETHER < len(order) else len(order))
        part = {k: v[at:end] for k, v in a.items()}
        text = np.stack([part[f"w{i}"] for i in range(-(-wide // 8))], axis=1).view(np.uint8)
        found.append(_refine(rule, part, text))
        at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _may_share(rule: Rule, a: dict[str, np.ndarray], text: np.ndarray) -> np.ndarray:
    """Which neighbourhoods have the half before or behind the q-gram in common with another document's; all others have no window in common with any."""
    half, middle = (rule.length - rule.q) // 2, rule.reach - 1
    keep = np.zeros(len(text), bool)
    for at in (middle - half, middle + rule.q):
        key = a["gram"].astype(np.uint64)
        for word in np.ascontiguousarray(text[:, at : at + half]).view(np.uint64).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        doc = a["doc"][order]
        keep[order] |= np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
    return keep


class BucketPointers:
    """Pointers of all suffixes (row by row) to their buckets; suffixes that could reach out of their row take no part.

    text: one neighbourhood a row; low, high: the bytes of each row that are there.
    """

    def __init__(self, text: np.ndarray, low: np.ndarray, high: np.ndarray):
        n, self.width = text.shape
        self.low, self.high, self.depth = low, high, _STEP
        place = np.arange(self.width)
        suffix = np.flatnonzero((place >= low[:, None]) & (place + _STEP <= high[:, None]))
        value = np.lib.stride_tricks.sliding_window_view(text, _STEP, axis=1)
        value = np.ascontiguousarray(value[suffix // self.width, suffix % self.width]).view(np.uint64).ravel()
        order = np.argsort(value)
        self.pointer = np.full(n * self.width, -1, np.int64)
        self.active, _ = self._point(suffix[order], np.zeros(len(order), np.int64), value[order])

    def _point(self, suffix: np.ndarray, bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New pointers for sorted suffixes; which of them share their bucket, and the pointers of these."""
        if not len(suffix):
            return suffix, bucket
        fresh = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        old = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        fresh[1:] |= key[1:] != key[:-1]
        first = np.flatnonzero(fresh)
        begin = first[np.cumsum(fresh) - 1]
        self.pointer[suffix] = bucket + begin - old  # where the new bucket begins inside the old one
        shared = np.repeat(np.diff(np.append(first, len(suffix))) > 1, np.diff(np.append(first, len(suffix))))
        return suffix[shared], self.pointer[suffix[shared]]

    def refine(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Refine all buckets from their present depth to `depth`, at most twice as deep; suffixes that share buckets, and their pointers, in order."""
        row, place = np.divmod(self.active, self.width)
        suffix = self.active[place + depth <= self.high[row]]
        bucket, later = self.pointer[suffix], self.pointer[suffix + (depth - self.depth)]
        order = order_by(bucket, later)
        self.depth = depth
        self.active, pointer = self._point(suffix[order], bucket[order], later[order])
        return self.active, pointer


def _refine(rule: Rule, a: dict[str, np.ndarray], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = rule.reach - 1
    buckets = BucketPointers(text, middle - a["left"].astype(np.int64), middle + a["right"].astype(np.int64))
    for depth in (2 * _STEP, 4 * _STEP, rule.length):
        suffix, pointer = buckets.refine(depth)
    row, start = np.divmod(suffix, buckets.width)
    some = start <= middle
    row, start, pointer = row[some], start[some], pointer[some]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = a["doc"][row]
    first = np.flatnonzero(np.concatenate([[True], pointer[1:] != pointer[:-1]]))
    later = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(row))))
    return doc[later], a["place"][row[later]].astype(np.int64) - middle + start[later]


def remove(text: pa.RecordBatch, ids: np.ndarray, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and removed bytes of a chunk."""
    buf, off = flat(text.column(1))
    return buf, off, covered(RULE, off, ids, found)


def _finish(batch: pa.RecordBatch, ids: np.ndarray, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    buf, off, gone = remove(batch, ids, found)
    removed = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[off[:-1][off[:-1] < len(buf)]] = gone[off[:-1][off[:-1] < len(buf)]]
    spans = np.concatenate([[0], np.cumsum(begins)])
    kept = buf[~gone].tobytes()
    at = (off - removed[off]).tolist()
    digest = [hashlib.sha256(kept[s:e]).hexdigest() for s, e in zip(at, at[1:])]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(np.diff(off)), pa.array(np.diff(removed[off])), pa.array(np.diff(spans[off])), pa.array(digest, pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def dedup_substrings(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """Digest of every text without the bytes of 50-byte strings that start in an earlier document."""
    home_docs, found = repeated_starts(docs, symbols, RULE, large, gather, refine)
    return apply_intervals(home_docs, found, _finish, SCHEMA)
