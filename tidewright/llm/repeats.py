"""Repeated windows of a corpus: what substring dedup over bytes and over words have in common.

A window is `length` neighbouring symbols (bytes or words) of one text.  Each
window is represented by the q-gram in it of least hash, its anchor, so equal
windows have equal anchors at equal places; one anchor in about (length - q)/2
places has to be shuffled instead of every window.

  1. Every anchor goes, with a hash of its whole neighbourhood, to the bucket
     of its q-gram.  If its neighbourhood came earlier, all of its windows
     did.  If the bucket has no other neighbourhood, none of them did.
  2. Only anchors of buckets with several neighbourhoods are left.  They are
     refined: their neighbourhoods are gathered once for each bucket and handed
     to the operator.  Where a bucket would be overfull, its q-gram is lengthened
     to the whole window: windows get identifiers of their own (those of their
     halves, joined again and again) and are dealt out by them.
  3. Intervals of repeated window starts go back to their documents.

A q-gram that very many neighbourhoods share is known before step 1, from a
sixteenth (or less) of the documents; its windows are dealt out at once and its
anchors never meet.  What is sampled decides on the way of a window, not on its
result.  A map task first resolves what repeats inside it, so a very frequent
window sends one record for each task, whatever its share of the corpus.
Records travel in compressed column blobs, one for each task and bucket.

Neighbourhoods and lengthened q-grams are known by 64-bit hashes.

Defined results: null texts are empty; texts shorter than a window keep
everything; a null doc_id comes before all others; rows of one doc_id are
taken for copies of one document; a very long text is anchored in parts that
overlap by a window, and counts its places in 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.store import buckets_for, text_bytes
from tidewright.llm.textkernel import _power, chunks, flat, mix, owner, prefix_hash, sliding_min, span_hash, windows

#: Anchors that a task holds before it sends them off; bits of a place in the order of anchors; symbols anchored together.
HELD = 1 << 20
#: Text bytes anchored together: its arrays of 64-bit values stay in a core's cache.
ANCHOR_BYTES = 128 << 10
_PLACE, PART = np.uint64(28), 1 << 27
#: Sampling for frequent q-grams: one document in so many at least, text bytes of the sample at most, sampled neighbourhoods of
#: a q-gram at least, q-grams at most (8 bytes each, sent to all tasks; those beyond go the ordinary way).
ONE_IN, SAMPLE_BYTES, SEEN, MOST_HOT = 16, 4 << 30, 50, 100_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))


@dataclass(frozen=True)
class Rule:
    """Window length, anchor length, and whether a repetition inside one document counts."""

    length: int
    q: int
    within: bool

    @property
    def reach(self) -> int:
        """Windows that hold one anchor."""
        return self.length - self.q + 1


#: symbols(buffer, offsets) -> hashes of the symbols of a chunk, and offsets of the documents among them
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(**columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed blob; doc_ids, which ascend, as steps."""
    if "doc" in columns:
        columns["doc"] = np.diff(columns["doc"], prepend=0)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of all blobs, one after another; empty without blobs."""
    parts = []
    for b in blobs:
        table = pa.ipc.open_stream(b).read_all()
        part = {n: table.column(n).to_numpy() for n in table.column_names}
        if "doc" in part:
            part["doc"] = np.cumsum(part["doc"])
        parts.append(part)
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]} if parts else {}


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def spread(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of the rows of each key below n, in order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.searchsorted(keys[order], np.arange(n + 1))
    for k in range(n):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


def prime_over(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def gram_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` symbols."""
    n = len(prefix) - size
    return mix((prefix[size:] - prefix[:n]) * _power("down", len(prefix))[:n]) if n > 0 else np.zeros(0, np.uint64)


def anchors(symbols: np.ndarray, off: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document index and place in it, q-gram hash and neighbourhood hash of every anchor of a chunk."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(symbols) < rule.length:
        return none
    prefix = prefix_hash(symbols)
    gram = gram_hash(prefix, rule.q)
    doc = owner(off)
    chosen = np.zeros(len(gram), bool)
    for s in range(0, len(gram), PART):
        part = gram[s : s + PART + rule.reach - 1]
        order = (part >> _PLACE << _PLACE) | np.arange(len(part), dtype=np.uint64)
        least = sliding_min(order, rule.reach)
        whole = doc[s : s + len(least)] == doc[s + rule.length - 1 : s + rule.length - 1 + len(least)]
        chosen[s + (least[whole] & np.uint64((1 << 28) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    if not len(at):
        return none
    d = doc[at]
    low, high = np.maximum(at - (rule.reach - 1), off[d]), np.minimum(at + rule.length, off[d + 1])
    near = mix(span_hash(prefix, low, high) + (at - low).astype(np.uint64))
    return d, at - off[d], gram[at], near


def order_by(*fields: np.ndarray) -> np.ndarray:
    """An order by integer fields, the first one above all; rows equal in all come in any order. One sort of 64-bit values where the fields fit there together."""
    low = [int(f.min()) for f in fields] if len(fields[0]) else []
    bits = [(int(f.max()) - n).bit_length() for f, n in zip(fields, low)]
    if not low or sum(bits) > 63:
        return np.lexsort(fields[::-1])
    key = np.zeros(len(fields[0]), np.int64)
    for f, n, b in zip(fields, low, bits):
        key = (key << b) | (f - f.dtype.type(n)).astype(np.int64)
    return np.argsort(key)


def firsts(rule: Rule, doc: np.ndarray, place: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that keeps rows of equal keys together, by document and place; and which rows in it have an earlier row of equal keys.

    One key of 64 bits, or one of 32 and one of 64: sorted by the first 64 bits, which leaves few rows to be ordered among themselves.
    """
    lead = keys[0] if len(keys) == 1 else (keys[0].astype(np.uint64) << np.uint64(32)) | (keys[1] >> np.uint64(32))
    order = np.argsort(lead)
    same = lead[order[1:]] == lead[order[:-1]]
    at = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(order) else order
    if len(at):
        some = order[at]
        group = np.cumsum(np.concatenate([[True], ~same]))[at]
        rest = [k[some] for k in keys[1:]]
        order[at] = some[order_by(group, doc[some], place[some])] if all((k[1:] == k[:-1])[np.diff(group) == 0].all() for k in rest) else some[np.lexsort((place[some], doc[some], *rest, group))]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(order) else order
    doc, place = doc[order], place[order]
    later = doc > doc[head]
    if rule.within:  # another row of the very document and place is no other window
        later |= (doc == doc[head]) & (place > place[head])
    return order, later


def frequent_grams(docs: DataFrame, symbols: Symbols, rule: Rule, large: int, size: int) -> np.ndarray:
    """Hashes (ascending) of q-grams that, by a sample of documents (of `size` bytes in all), are in more than about `large` neighbourhoods."""
    one_in = max(ONE_IN, -(-size // SAMPLE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, _, gram, near = anchors(*symbols(*flat(batch.column(0))), rule)
            gram, count = np.unique(gram[np.unique(near, return_index=True)[1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count)], ["gram", "count"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(one_in)) == 0).select("text")
    counted = some.mapInArrow(run, "gram bigint, count bigint").groupBy("gram").agg(F.sum("count").alias("count"))
    often = counted.where(F.col("count") > max(SEEN, large // one_in)).orderBy(F.desc("count"), "gram").limit(MOST_HOT).collect()
    return np.sort(np.array([r["gram"] for r in often], np.int64).view(np.uint64))


def listed(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are in the ascending list."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


#: A task's share of a bucket: anchors to be compared and anchors known to repeat; or rows that pass by (see DEALT).
SENT = "bucket int, fresh binary, known binary, kind string, blob binary"
COMPARED = "home int, full binary, rest binary, bucket int, kind string, blob binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def send_anchors(docs: DataFrame, symbols: Symbols, rule: Rule, buckets: int, homes: int, hot: np.ndarray) -> DataFrame:
    """Every task's anchors for their buckets, and the windows of frequent q-grams, dealt out one by one."""

    def deal(windows_: list) -> pa.RecordBatch:
        return _batch(SENT, [(bucket, None, None, kind, blob) for bucket, kind, blob in deal_windows(rule, windows_, buckets, homes)])

    def flush(held: list) -> pa.RecordBatch:
        doc, place, gram, near = (np.concatenate(x) for x in zip(*held))
        order, later = firsts(rule, doc, place, near)
        known = np.zeros(len(doc), bool)
        known[order[later]] = True
        by_doc = order_by(doc, place)
        rows = []
        for bucket, some in spread((gram[by_doc] % np.uint64(buckets)).astype(np.int64), buckets):
            some = by_doc[some]
            new, old = some[~known[some]], some[known[some]]
            high = (gram[new] >> np.uint64(32)).astype(np.uint32)
            rows.append((bucket, pack(doc=doc[new], place=place[new].astype(np.uint32), gram=high, near=near[new]), pack(doc=doc[old], place=place[old].astype(np.uint32)), None, None))
        return _batch(SENT, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, windows_, many = [], 0, [], 0
        for batch in chunks(batches, limit=ANCHOR_BYTES):
            ids = ids_of(batch.column(0))
            symbol, off = symbols(*flat(batch.column(1)))
            d, place, gram, near = anchors(symbol, off, rule)
            often = listed(gram, hot)
            if often.any():
                first, last = window_range(rule, off, d[often], place[often])
                starts = np.flatnonzero(union(len(symbol), first, last))
                windows_.append(window_records(rule, symbol, off, ids, starts))
                many += len(starts)
                d, place, gram, near = d[~often], place[~often], gram[~often], near[~often]
            if len(d):
                held.append((ids[d], place, gram, near))
                size += len(d)
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
            if many >= HELD:
                yield deal(windows_)
                windows_, many = [], 0
        if size:
            yield flush(held)
        if many:
            yield deal(windows_)

    return docs.mapInArrow(run, SENT)


def compare_anchors(sent: DataFrame, rule: Rule, homes: int, large: int) -> DataFrame:
    """For each home (group of documents): anchors that repeat with all their windows, and anchors that need refinement."""

    def run(table):
        bucket = table["bucket"][0].as_py()
        by = [(home, None, None, bucket, kind, blob) for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()) if kind for home in [int(kind[5:]) if kind.startswith("done") else bucket % homes]]
        sure = unpack([b for b in table["known"].to_pylist() if b])
        a = unpack([b for b in table["fresh"].to_pylist() if b])
        if not a:
            return pa.Table.from_batches([_batch(COMPARED, by)])
        near = a["near"]
        order, later = firsts(rule, a["doc"], a["place"], a["gram"], near)
        gram = a["gram"][order]
        cut = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
        group = np.cumsum(cut) - 1
        other = np.concatenate([[False], (near[order][1:] != near[order][:-1]) & ~cut[1:]]) if len(gram) else cut
        mixed = np.bincount(group, weights=other)[group] > 0 if len(gram) else cut
        open_ = mixed & ~later
        size = np.bincount(group, weights=open_)[group] if len(gram) else group
        full = order[later]
        doc_full, place_full = np.concatenate([sure["doc"], a["doc"][full]]), np.concatenate([sure["place"], a["place"][full]])
        rest = order[open_]
        crowd = size[open_] > large
        rows = {}
        for home, some in spread(_home(doc_full, homes), homes):
            some = some[np.argsort(doc_full[some], kind="stable")]
            rows.setdefault(home, [None, None])[0] = pack(doc=doc_full[some], place=place_full[some])
        for home, some in spread(_home(a["doc"][rest], homes), homes):
            some = some[np.argsort(a["doc"][rest[some]], kind="stable")]
            at = rest[some]
            rows.setdefault(home, [None, None])[1] = pack(doc=a["doc"][at], place=a["place"][at], gram=a["gram"][at], bucket=np.full(len(at), bucket, np.int32), crowd=crowd[some])
        return pa.Table.from_batches([_batch(COMPARED, [(home, *r, None, None, None) for home, r in rows.items()] + by)])

    return sent.groupBy("bucket").applyInArrow(run, COMPARED)


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    return (doc % homes).astype(np.int64)


def housed(docs: DataFrame, homes: int) -> DataFrame:
    """doc_id, text and home of every document."""
    doc = docs["doc_id"].cast("bigint")
    return docs.select(doc.alias("doc_id"), docs["text"], F.pmod(F.coalesce(doc, F.lit(NO_ID)), F.lit(homes)).cast("int").alias("home"))


def matched(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ids, index in `doc`, which ascends) of equal documents."""
    low, high = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
    size = high - low
    row = np.repeat(np.arange(len(ids)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def sorted_by_doc(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    if not a:
        return a
    order = np.argsort(a["doc"], kind="stable")
    return {n: c[order] for n, c in a.items()}


def union(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n places lie in some interval [first, last]."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    return np.cumsum(step[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each maximal run."""
    step = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def intervals(ids: np.ndarray, off: np.ndarray, flags: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of flagged starts as rows (doc, first, last). A window ends inside its text, so a run never crosses texts unless windows of one symbol do."""
    first, last = runs(flags)
    d = np.searchsorted(off, first, "right") - 1
    return {"doc": ids[d], "first": (first - off[d]).astype(np.uint32), "last": (last - off[d]).astype(np.uint32)}


def window_records(rule: Rule, symbol: np.ndarray, off: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Identifier (made of the identifiers of shorter runs at later offsets), document and start of single windows."""
    d = np.searchsorted(off, starts, "right") - 1
    cut = np.flatnonzero(np.diff(starts) > 1)
    inside = union(len(symbol), starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + rule.length - 1) if len(starts) else np.zeros(len(symbol), bool)
    window = windows(symbol[inside], rule.length)[(np.cumsum(inside) - 1)[starts]] if len(starts) else np.zeros(0, np.uint64)
    return {"doc": ids[d], "place": (starts - off[d]).astype(np.uint32), "window": window}


def deal_windows(rule: Rule, parts: list[dict[str, np.ndarray]], buckets: int, homes: int) -> Iterator[tuple[int, str, bytes]]:
    """Windows for the buckets of their identifiers, as rows (bucket, kind, blob); those that repeat among these are done with."""
    a = _joined(parts)
    order, later = firsts(rule, a["doc"], a["place"], a["window"])
    doc, start = a["doc"][order[later]], a["place"][order[later]].astype(np.int64)
    for home, some in spread(_home(doc, homes), homes):
        yield home % buckets, f"done {home}", pack(**start_runs(doc[some], start[some]))
    at = np.sort(order[~later])
    a = sorted_by_doc({k: v[at] for k, v in a.items()})
    for bucket, some in spread((a["window"] % np.uint64(buckets)).astype(np.int64), buckets):
        yield bucket, "window", pack(**{k: v[some] for k, v in a.items()})


def window_range(rule: Rule, off: np.ndarray, d: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows around an anchor at `place` of document d."""
    n = off[d + 1] - off[d]
    return off[d] + np.maximum(place - (rule.reach - 1), 0), off[d] + np.minimum(place, n - rule.length)


DEALT = "bucket int, kind string, blob binary"


def repeated_windows(rule: Rule, a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of the windows that came earlier."""
    order, later = firsts(rule, a["doc"], a["place"], a["window"])
    at = order[later]
    return a["doc"][at], a["place"][at].astype(np.int64)


def start_runs(doc: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Single starts as intervals (doc, first, last), by document."""
    order = order_by(doc, start)
    doc, start = doc[order], start[order]
    if not len(doc):
        return {"doc": doc, "first": start.astype(np.uint32), "last": start.astype(np.uint32)}
    cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return {"doc": doc[first], "first": start[first].astype(np.uint32), "last": start[last].astype(np.uint32)}


Gather = Callable[[Rule, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], int], Iterator[tuple[int, str, bytes]]]
Refine = Callable[[Rule, list[bytes]], tuple[np.ndarray, np.ndarray]]


def refine_anchors(home_docs: DataFrame, compared: DataFrame, symbols: Symbols, rule: Rule, buckets: int, homes: int, gather: Gather, refine: Refine) -> DataFrame:
    """Intervals of repeated window starts, as rows (home, blob).

    Beside their documents, anchors that repeat become intervals; open ones are
    gathered (by `gather`, or in overfull buckets window by window), dealt out
    again with the windows that were dealt before, and what `refine` (or
    the windows' identifiers) finds to repeat becomes intervals, too.
    """

    def beside(left, right):
        full, rest = sorted_by_doc(unpack([b for b in right["full"].to_pylist() if b])), sorted_by_doc(unpack([b for b in right["rest"].to_pylist() if b]))
        rows: list[tuple[int, str, bytes]] = [x for x in zip(right["bucket"].to_pylist(), right["kind"].to_pylist(), right["blob"].to_pylist()) if x[1]]
        if (full or rest) and left.num_rows:
            home = left["home"][0].as_py()
            done, windows_ = [], []
            for batch in chunks(iter(left.combine_chunks().to_batches())):
                ids = ids_of(batch.column(0))
                symbol, off = symbols(*flat(batch.column(1)))
                n = np.diff(off)
                known = np.zeros(len(symbol), bool)

                def starts(a, off=off, n=n, ids=ids):
                    row, at = matched(ids, a["doc"])
                    place = a["place"][at].astype(np.int64)
                    ok = place < n[row]
                    row, at, place = row[ok], at[ok], place[ok]
                    return at, *window_range(rule, off, row, place), off[row] + place

                if full:
                    _, first, last, _ = starts(full)
                    ok = last >= first
                    known = union(len(symbol), first[ok], last[ok])
                    done.append(intervals(ids, off, known))
                if rest:
                    at, first, last, place = starts(rest)
                    sums = np.concatenate([[0], np.cumsum(known)])
                    open_ = (last >= first) & (sums[np.maximum(last, first) + 1] - sums[first] < last - first + 1)
                    at, first, last, place = at[open_], first[open_], last[open_], place[open_]
                    single = rest["crowd"][at]
                    if single.any():
                        flags = union(len(symbol), first[single], last[single]) & ~known
                        windows_.append(window_records(rule, symbol, off, ids, np.flatnonzero(flags)))
                    if not single.all():
                        some = ~single
                        rows.extend(gather(rule, batch, off, ids, place[some], {k: v[at[some]] for k, v in rest.items()}, buckets))
            if done:
                rows.append((home % buckets, f"done {home}", pack(**_joined(done))))
            if windows_:
                rows.extend(deal_windows(rule, windows_, buckets, homes))
        return pa.Table.from_batches([_batch(DEALT, rows)])

    def resolve(table):
        by: dict[str, list[bytes]] = {}
        out: list[tuple[int, bytes]] = []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
            if kind.startswith("done"):
                out.append((int(kind[5:]), blob))
            else:
                by.setdefault(kind, []).append(blob)
        found = []
        if "window" in by:
            found.append(repeated_windows(rule, unpack(by["window"])))
        if "gathered" in by:
            found.append(refine(rule, by["gathered"]))
        for doc, start in found:
            for home, some in spread(_home(doc, homes), homes):
                out.append((home, pack(**start_runs(doc[some], start[some]))))
        return pa.table([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["home", "blob"])

    dealt = home_docs.groupBy("home").cogroup(compared.groupBy("home")).applyInArrow(beside, DEALT)
    return dealt.groupBy("bucket").applyInArrow(resolve, "home int, blob binary")


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return sorted_by_doc({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})


def apply_intervals(home_docs: DataFrame, found: DataFrame, finish: Callable[[pa.RecordBatch, np.ndarray, dict[str, np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """`finish` sees each chunk of documents with the intervals of its repeated window starts."""

    def run(left, right):
        a = sorted_by_doc(unpack(right["blob"].to_pylist()))
        if not a:
            a = {"doc": np.zeros(0, np.int64), "first": np.zeros(0, np.uint32), "last": np.zeros(0, np.uint32)}
        out = [finish(batch, ids_of(batch.column(0)), a) for batch in chunks(iter(left.combine_chunks().to_batches()))]
        return pa.Table.from_batches(out) if out else empty

    empty = _empty(schema)
    return home_docs.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


def covered(rule: Rule, off: np.ndarray, ids: np.ndarray, a: dict[str, np.ndarray]) -> np.ndarray:
    """Which symbols of a chunk lie in a repeated window."""
    row, at = matched(ids, a["doc"])
    n = np.diff(off)[row]
    first, last = a["first"][at].astype(np.int64), np.minimum(a["last"][at].astype(np.int64), n - rule.length)
    ok = last >= first
    return union(int(off[-1]), off[row][ok] + first[ok], off[row][ok] + last[ok] + rule.length - 1)


def sizes(docs: DataFrame, size: int | None = None) -> tuple[int, int]:
    """Buckets and homes for the size of the texts (counted if it is not given), the latter a prime, for ids that come in steps."""
    n = buckets_for(docs, text_bytes(docs) if size is None else size)
    return n, prime_over(2 * n)


def repeated_starts(docs: DataFrame, symbols: Symbols, rule: Rule, large: int, gather: Gather, refine: Refine) -> tuple[DataFrame, DataFrame]:
    """Documents by home, and intervals of the starts of windows that came earlier, as rows (home, blob)."""
    size = text_bytes(docs)
    buckets, homes = sizes(docs, size)
    home_docs = housed(docs, homes)
    texts = home_docs.select("doc_id", "text")
    hot = frequent_grams(texts, symbols, rule, large, size)
    compared = compare_anchors(send_anchors(texts, symbols, rule, buckets, homes, hot), rule, homes, large)
    return home_docs, refine_anchors(home_docs, compared, symbols, rule, buckets, homes, gather, refine)
