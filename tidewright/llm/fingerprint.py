"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo two primes, the polynomial of every
prefix over code points; the difference of two entries is the hash of a span,
so any two spans are compared in constant time and the longest common
extension of two places is found by binary search.  A fingerprint is the hash
of the whole text and the least hashes of its spans of a fixed length; the
spans of an edited text are read off the arrays of the two texts it is made of.

The next document is found by order: documents are dealt out by ranges of
doc_id, one task for each, sorted inside, and each range also gets the first
document of the next one.  Bounds are quantiles of doc_ids drawn by the size of
their texts, so ranges are alike in bytes; only bounds and first ids (one for
each range) reach the driver.

Defined results: a null text is empty; empty texts have a fingerprint of their
own; a very long text costs eight bytes of prefix arrays and four of code points
a sign, all else goes by pieces; the order is doc_id (null first), then a hash
of the text, so repeated rows follow each other; a single document is its own
next; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.ranges import rank_in
from tidewright.llm.sharding import drawn, quantiles
from tidewright.llm.store import cut, partitions

#: The two moduli and bases of the polynomials.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points of a span, spans that a fingerprint keeps; places of a text worked on together; text bytes of a range, draws for each range.
SPAN, KEPT, PIECE, RANGE_BYTES, DRAWN = 16, 40, 1 << 16, 8 << 20, 64
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lce_edited bigint, lce_next bigint"


def _powers(base: int, p: int) -> np.ndarray:
    """base^i modulo p for the places of a piece, by doubling."""
    have = np.ones(1, np.int64)
    while len(have) < PIECE:
        have = np.concatenate([have, have * pow(base, len(have), p) % p])
    return have


#: For each modulus: it, the base and its inverse, and the powers of both.
FIELDS = [(p, b, pow(b, -1, p), _powers(b, p), _powers(pow(b, -1, p), p)) for p, b in zip(PRIMES, BASES)]


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = len(codes)
        self.arrays = []
        for p, base, _, up, _ in FIELDS:
            prefix = np.zeros(self.size + 1, np.uint32)
            for s in range(0, self.size, PIECE):
                part = codes[s : s + PIECE].astype(np.int64) + 1
                part = part * up[: len(part)] % p
                if s:
                    part = part * pow(base, s, p) % p
                np.cumsum(part, out=part)
                prefix[s + 1 : s + 1 + len(part)] = (part + int(prefix[s])) % p
            self.arrays.append(prefix)

    def __len__(self) -> int:
        return self.size

    def span(self, start: int, end: int) -> int:
        """Hash of [start, end), the same wherever an equal span stands."""
        out = 0
        for (p, _, inverse, _, _), a in zip(FIELDS, self.arrays):
            out = out << 31 | (int(a[end]) - int(a[start])) * pow(inverse, start, p) % p
        return out

    def spans(self, start: int, end: int, size: int = SPAN) -> Iterator[np.ndarray]:
        """Hashes of all spans of `size` inside [start, end), piece by piece."""
        for s in range(start, end - size + 1, PIECE):
            n = min(PIECE, end - size + 1 - s)
            out = np.zeros(n, np.int64)
            for (p, _, inverse, _, down), a in zip(FIELDS, self.arrays):
                x = (a[s + size : s + size + n].astype(np.int64) - a[s : s + n]) % p * down[:n] % p
                out = out << 31 | (x * pow(inverse, s, p) % p if s else x)
            yield out


class Joined:
    """The text left[:cut] + right[:size], seen through the arrays of both."""

    def __init__(self, left: PrefixHashes, cut: int, right: PrefixHashes, size: int):
        self.left, self.cut, self.right, self.size = left, cut, right, size
        self.text = left.text[:cut] + right.text[:size]

    def __len__(self) -> int:
        return self.cut + self.size

    def span(self, start: int, end: int) -> int:
        """Only prefixes are asked for: start is 0."""
        if end <= self.cut:
            return self.left.span(0, end)
        out = 0
        for (p, base, *_), a, b in zip(FIELDS, self.left.arrays, self.right.arrays):
            out = out << 31 | (int(a[self.cut]) + int(b[end - self.cut]) * pow(base, self.cut, p)) % p
        return out

    def spans(self, start: int, end: int, size: int = SPAN) -> Iterator[np.ndarray]:
        """All spans of the whole: those of both parts, and those over the seam."""
        yield from self.left.spans(0, self.cut, size)
        yield from self.right.spans(0, self.size, size)
        if self.cut and self.size:
            seam = PrefixHashes(self.text[max(0, self.cut - size + 1) : self.cut + size - 1])
            yield from seam.spans(0, len(seam), size)


def common_extension(a: PrefixHashes | Joined, b: PrefixHashes | Joined) -> int:
    """Length of the longest common prefix, by binary search over equal spans."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(0, middle) == b.span(0, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _scatter(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def fingerprint(text: PrefixHashes | Joined) -> str:
    """Length and hash of the whole text, then the KEPT least span hashes, in hexadecimal."""
    n = len(text)
    few = [np.zeros(0, np.uint64)]
    for part in text.spans(0, n) if n >= SPAN else [np.array([text.span(0, n)] if n else [], np.int64)]:
        part = _scatter(part)
        least = np.unique(np.partition(part, 4 * KEPT)[: 4 * KEPT] if len(part) > 8 * KEPT else part)
        few.append((least if len(least) >= KEPT else np.unique(part))[:KEPT])
    least = np.unique(np.concatenate(few))[:KEPT]
    return f"{n:x}-{text.span(0, n):016x}-" + "".join(f"{x:08x}" for x in least.tolist())


def likeness(a: str, b: str) -> float:
    """Share of common spans (Dice) as the two samples tell it: 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a.rpartition("-")[2], b.rpartition("-")[2]))
    if not x or not y:
        return 0.0
    least = sorted(x | y)[:KEPT]
    j = sum(s in x and s in y for s in least) / len(least)
    return 2 * j / (1 + j)


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents in sorted ranges, each range followed by the first document of the next (ahead = 1)."""
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    sizes = cut(plain.select("doc_id", (F.octet_length("text").cast("bigint") + 1).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n = max(partitions(docs.sparkSession), math.ceil(total / RANGE_BYTES))
    bounds = quantiles(sizes.select("doc_id", drawn(F.col("size"), total, DRAWN * n, "doc_id", "size").alias("draws")), "doc_id", n)
    place = rank_in(F.col("doc_id"), bounds).cast("int")
    ranged = plain.withColumn("range", place)
    # the first id of each range; min() passes over null ids, which come first of all
    firsts = sorted((r["range"], r["f"], r["nulls"]) for r in sizes.withColumn("range", place).groupBy("range").agg(F.min("doc_id").alias("f"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect())
    if not firsts:
        return ranged.withColumn("ahead", F.lit(0)).withColumn("h", F.lit(0).cast("bigint"))
    ids = [None if nulls and i == 0 else f for i, (_, f, nulls) in enumerate(firsts)]
    target = [firsts[i - 1][0] for i in range(len(firsts))]  # the last range looks ahead to the first document
    looked = docs.sparkSession.createDataFrame(list(zip(ids, target)), "first bigint, target int")
    ahead = plain.join(F.broadcast(looked), F.equal_null("doc_id", "first")).select("doc_id", "text", F.col("target").alias("range"), F.lit(1).alias("ahead"))
    both = ranged.select("doc_id", "text", "range", F.lit(0).alias("ahead")).unionByName(ahead)
    both = both.withColumn("h", F.xxhash64("text"))
    return both.repartitionById(n, F.col("range")).sortWithinPartitions("range", "ahead", F.asc_nulls_first("doc_id"), "h")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like each is to the edited and to the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sign, out = None, "", []
        for batch in batches:
            for doc_id, text, place, ahead in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is not None and place == now[0]:
                    new = PrefixHashes(text)
                    out.append(_row(now[1], now[2], sign, new))
                    sign = out[-1][-1]
                else:
                    new = None if ahead else PrefixHashes(text)
                    sign = fingerprint(new) if new is not None else ""
                now = None if ahead else (place, doc_id, new)
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return _ordered(docs).select("doc_id", "text", "range", "ahead").mapInArrow(run, SCHEMA)


def _row(doc_id, text: PrefixHashes, sign: str, new: PrefixHashes) -> tuple:
    n = len(text)
    half = n // 2
    edited = Joined(text, n - half, new, min(half, len(new)))
    edited_sign, new_sign = fingerprint(edited), fingerprint(new)
    return (
        doc_id,
        n,
        hashlib.sha256(edited.text.encode("utf-8", "surrogatepass")).hexdigest(),
        sign,
        edited_sign,
        likeness(sign, edited_sign),
        likeness(sign, new_sign),
        common_extension(text, edited),
        common_extension(text, new),
        new_sign,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*(r[:-1] for r in rows)), types)], names)
