r"""N-gram Jaccard join by set-relation skipping.

A document's set holds its distinct word n-grams.  Candidates first: two sets of
similarity t or more differ in few elements, so if both are cut by hash into one
part more than that number, some part is the same in both.  A part without
elements says nothing and has no list; a set with so many of them that they could
be all that it has in common with another is cut anew, by another hash.  Lists
are keyed by size class, part position and part content, so lists of other
positions and of classes out of reach are skipped; copies of one set enter once.
Parts of nothing but frequent elements (passages that many documents share, found
in a sample) are taken for empty, too, as long as enough parts are left without
them.  Sets that meet in a short list are compared by their parity sketches: these
differ in no more bits than the sets in elements, so no linked pair is lost.

Sets that meet in some list form a family, and a family is answered from its
pivot, the member most like the others:

  answers  One pass computes the pivot's overlap with every member.  The answers
           of any other member are derived from these and from its difference
           to the pivot: members of one size and one size of difference (a
           class) have the same bounds, so a class is surely linked with all of
           another one, surely with none of it, or open.  Sure links are counted
           by classes, however large the family is.
  lists    Open classes are read from index lists over the elements of the
           differences, rare elements first.  An entry stands in its list by its
           position (by what its difference still has behind it); a probe stops
           at the first entry that leaves too little, and skips the rest of the
           list.  Pairs found are verified on their differences alone.

Large families are cut into slices that all know the same pivot: sets are
shuffled once (a slice at a time), classes are summed up over slices, and only
the differences of open members meet in pairs of slices.  What tasks return are
forests of links and sums, never all pairs.

Defined results: a null text has no words; a document without words has an
empty set and is linked with nothing; with fewer words than n the whole
sequence is the one element; a very long text is one set like any other; rows of
one doc_id are taken for one document (a null doc_id included); an empty table
gives no rows; extra columns are not read by the join and kept by keep_one.
Sets and elements are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.components import components, forest, looked_up
from tidewright.llm.repeats import NO_ID, housed, ids_of, matched, pack, sizes, spread, unpack
from tidewright.llm.store import cut, free
from tidewright.llm.textkernel import byte_symbols, chunks, flat, mix, owner, prefix_hash, span_hash, windows, word_bounds

#: Elements that a task holds before it sends their parts off; sets of a list that are compared pair by pair at most.
HELD, SHORT = 1 << 20, 24
#: Text bytes, and elements, that a task looks at together: a worker keeps what it once took, and the working arrays are many.
CHUNK, PORTION = 1 << 18, 1 << 18
#: Sampling for frequent elements: documents of the sample, documents of which a frequent element is in one at least, elements
#: at most (8 bytes each, sent to all tasks; a share of all documents bounds their number), cuts that leave them out.
SAMPLE, ONE_OF, MOST_FREQUENT, PATIENT = 16_384, 1000, 500_000, 2
#: Members of a slice of a family; members that choose its pivot; members, and pairs of classes or members, looked at together.
SLICE, VOTERS, TOGETHER, PAIRS = 1024, 32, 4096, 1 << 20
#: Hashes by which sets are cut one after another; what the last one leaves open is listed by its empty parts, too.
CUTS = mix(np.arange(1, 17, dtype=np.uint64))
CUTS[0] = 0xA5A5A5A5A5A5A5A5
SCHEMA = "doc_id bigint, n_shingles bigint, component_id bigint, n_links bigint"


@dataclass(frozen=True)
class Join:
    """Words of a shingle, and the least similarity in percent."""

    n: int = 5
    percent: int = 80

    def differences(self, total: int) -> int:
        """Most elements in which two linked sets of `total` elements together differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def classes(self, most: int) -> np.ndarray:
        """Lower bounds of the size classes up to `most`: linked sets are in the same or in neighbouring classes."""
        bounds = [1]
        while bounds[-1] <= most:
            bounds.append(bounds[-1] * 100 // self.percent + 1)
        return np.array([*bounds, bounds[-1] * 100 // self.percent + 1])

    def parts(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the lists of each class: most elements in which linked sets differ whose smaller one is of that class, and
        the parts of a set: more than that number, with some to spare for empty ones."""
        most = np.array([self.differences(top + top * 100 // self.percent) for top in (bounds[1:] - 1).tolist()])
        return most, most + 1 + (3 * (most + 1) * np.exp(-bounds[:-1] / (most + 1))).astype(np.int64)

    def apart(self, total: np.ndarray) -> np.ndarray:
        """The same for arrays of totals, exactly."""
        return (100 - self.percent) * total // (100 + self.percent)

    def unlike(self, size: np.ndarray) -> np.ndarray:
        """Most elements in which a set of each size and one that is linked with it differ."""
        return (100 - self.percent) * (size + size * 100 // self.percent) // (100 + self.percent)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after another, each ascending, and their offsets."""
    buf, off = flat(texts)
    buf = np.where((buf >= 0x41) & (buf <= 0x5A), buf + 32, buf).astype(np.uint8)
    starts, ends, first = word_bounds(buf, off)
    word = span_hash(prefix_hash(byte_symbols(buf)), starts, ends)
    count = np.diff(first)
    doc = owner(first)
    gram = windows(word, n) if len(word) >= n else np.zeros(0, np.uint64)
    whole = doc[: len(gram)] == doc[n - 1 :] if len(gram) else np.zeros(0, bool)
    few = np.flatnonzero((count > 0) & (count < n))
    rest = [mix(np.array([len(word[first[d] : first[d + 1]])], np.uint64) + _fold(word[first[d] : first[d + 1]])) for d in few]
    token = np.concatenate([gram[whole], *rest]) if len(few) else gram[whole]
    of = np.concatenate([doc[: len(gram)][whole], few])
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (token[1:] != token[:-1])]) if len(of) else np.zeros(0, bool)
    token, of = token[fresh], of[fresh]
    return token, np.searchsorted(of, np.arange(len(off)))


def _fold(words: np.ndarray) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for w in words:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out[0]


def set_hash(token: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hash of each set, from sums that don't depend on order."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token))])
    return mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64))


def frequent_elements(docs: DataFrame, join: Join) -> np.ndarray:
    """Elements (ascending) that, by a sample of documents, are in one of ONE_OF documents or more."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(78)), F.lit(max(1, n // SAMPLE))) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, limit=CHUNK):
            held.append(shingle_sets(batch.column(0), join.n)[0])
            size += len(held[-1])
            if size >= 2 * HELD:
                yield _counted(held)
                held, size = [], 0
        if size:
            yield _counted(held)

    counted = some.mapInArrow(run, "element bigint, count bigint").groupBy("element").agg(F.sum("count").alias("count"))
    often = counted.where(F.col("count") >= max(4, min(n, SAMPLE) // ONE_OF)).orderBy(F.desc("count"), "element").limit(MOST_FREQUENT)
    return np.sort(np.array([r["element"] for r in often.collect()], np.int64).view(np.uint64))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    """Elements that come twice or more; those that come once here are not frequent here."""
    element, count = np.unique(np.concatenate(held), return_counts=True)
    some = count > 1
    return pa.RecordBatch.from_arrays([pa.array(element[some].view(np.int64)), pa.array(count[some])], ["element", "count"])


def sketches(token: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of all sets as 64-bit words, and their offsets: each element turns one of (about twice as many) bits."""
    size = np.diff(off)
    words = 1 << np.clip(np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64), 0, 12)
    begin = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(begin[-1], np.uint64)
    for s, e in _portions(size, PORTION):
        who = np.repeat(np.arange(s, e), size[s:e])
        place = (mix(token[off[s] : off[e]] + np.uint64(0x51ED)) >> np.uint64(20)) & (64 * words[who] - 1).astype(np.uint64)
        np.bitwise_xor.at(out, begin[who] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out, begin


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), len(a)
    while n > len(b):
        n //= 2
        x = x >> 8 * n ^ x & (1 << 8 * n) - 1
    return (x ^ int.from_bytes(b, "little")).bit_count()


def set_parts(join: Join, token: np.ndarray, off: np.ndarray, frequent: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray]:
    """Set index and key of every part of every set, in the lists of its own class and of the class below."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for s, e in _portions(np.diff(off), PORTION):
        who, key = _set_parts(join, token[off[s] : off[e]], off[s : e + 1] - off[s], frequent)
        found.append((who + s, key))
    return tuple(np.concatenate(x) for x in zip(*found))


def _set_parts(join: Join, token: np.ndarray, off: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(off)
    bounds = join.classes(int(size.max(initial=1)))
    most, many = join.parts(bounds)
    own = np.searchsorted(bounds, size, "right") - 1
    rare = ~_in(token, frequent)
    who, keys = [], []
    for level in (own, own - 1):
        left = np.flatnonzero((size > 0) & (level >= 0))
        for turn, seed in enumerate(CUTS):
            parts, length = many[level[left]], size[left]
            base = np.concatenate([[0], np.cumsum(parts)])
            of, place = _expanded(off[left], length)
            scattered = mix(token[place] ^ seed)
            part = base[of] + ((scattered >> np.uint64(33)) % parts[of].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, part, scattered)
            set_of = np.repeat(np.arange(len(left)), parts)
            position = np.arange(base[-1]) - base[set_of]
            listed = sums != 0
            if turn < PATIENT and len(frequent):
                listed = np.bincount(part[rare[place]], minlength=base[-1]) > 0
            # linked sets have parts - unlike equal parts; with fewer that have no list some equal part has one
            unlike = np.minimum(join.unlike(length), most[level[left]])
            few = np.bincount(set_of[~listed], minlength=len(left)) >= parts - unlike
            if turn == len(CUTS) - 1:
                listed |= few[set_of]
            where = (np.uint64(turn) << np.uint64(48)) + (level[left][set_of].astype(np.uint64) << np.uint64(32)) + position.astype(np.uint64) + np.uint64(1)
            who.append(left[set_of[listed]])
            keys.append(mix(sums + mix(where))[listed])
            left = left[few]
            if not len(left):
                break
    return np.concatenate(who), np.concatenate(keys)


def _lists(key: np.ndarray, doc: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document; the first row of each key; rows that add a set to a list that has another one already."""
    order = np.lexsort((doc, same, key))
    k, s = key[order], same[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    new_set = new_key | np.concatenate([[True], s[1:] != s[:-1]]) if len(k) else new_key
    # the leader of a list is its least document among the sets' least ones
    first = np.flatnonzero(new_key)
    least = np.minimum.reduceat(np.where(new_set, doc[order], np.iinfo(np.int64).max), first) if len(first) else np.zeros(0, np.int64)
    leader = least[np.cumsum(new_key) - 1] if len(first) else np.zeros(0, np.int64)
    return order, leader, new_set


def candidates(docs: DataFrame, join: Join, buckets: int) -> DataFrame:
    """Edges (a, b, same, ask): copies of one set (same), sets that meet in some list, or (ask) may be found apart by their
    sketches; and with a `sketch`, the size (b) and sketch of a set (a)."""
    frequent = frequent_elements(docs, join)

    def flush(held: list) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        doc, identity, token, off = held[0]
        if len(held) > 1:
            doc, identity, token = (np.concatenate([h[i] for h in held]) for i in range(3))
            size = np.concatenate([np.diff(h[3]) for h in held])
            off = np.concatenate([[0], np.cumsum(size)])
        # copies inside the task: one stands for all
        order = np.lexsort((doc, identity))
        fresh = np.concatenate([[True], identity[order][1:] != identity[order][:-1]])
        rep = doc[order][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        alike = (doc[order][~fresh], rep[~fresh])
        keep = np.sort(order[fresh])
        size = np.diff(off)[keep]
        token = token[np.repeat(off[keep] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        off = np.concatenate([[0], np.cumsum(size)])
        doc, identity = doc[keep], identity[keep]
        who, key = set_parts(join, token, off, frequent)
        lead = np.argsort(who, kind="stable")
        drawn, begin = sketches(token, off)
        by_bucket = dict(spread((key[lead] % np.uint64(buckets)).astype(np.int64), buckets))
        by_set = dict(spread((identity % np.uint64(buckets)).astype(np.int64), buckets))
        edges = pack(a=alike[0], b=alike[1])
        some = sorted({*by_bucket, *by_set})
        bearer = some[int(mix(doc[:1].astype(np.uint64))[0] % np.uint64(len(some)))]  # of the task's own edges; another one for each task
        for bucket in some:
            at = lead[by_bucket.get(bucket, np.zeros(0, np.int64))]
            ids = by_set.get(bucket, np.zeros(0, np.int64))
            yield bucket, pack(doc=doc[who[at]], key=key[at], set=identity[who[at]]), pack(doc=doc[ids], identity=identity[ids], size=size[ids], words=np.diff(begin)[ids]), pack(word=drawn[_expanded(begin[ids], np.diff(begin)[ids])[1]]), edges if bucket == bearer else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, limit=CHUNK):
            ids = ids_of(batch.column(0))
            token, off = shingle_sets(batch.column(1), join.n)
            full = np.diff(off) > 0
            if full.any():
                held.append((ids[full], set_hash(token, off)[full], token, np.concatenate([[0], np.cumsum(np.diff(off)[full])])))
                size += len(token)
            if size >= HELD:
                yield _rows(flush(held))
                held, size = [], 0
        if held:
            yield _rows(flush(held))

    def compare(table):
        pairs, copies = [], []
        for blob in table["edges"].to_pylist():
            if blob:
                e = unpack([blob])
                copies.append((e["a"], e["b"]))
        a = unpack(table["lists"].to_pylist())
        order, leader, new_set = _lists(a["key"], a["doc"], a["set"])
        order, leader = order[new_set], leader[new_set]  # each set of a list once
        member, key = a["doc"][order], a["key"][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(key)))
        long_ = np.repeat(length > SHORT, length) & (member != leader)
        node, root = forest(member[long_], leader[long_])
        of, place = _expanded(first, np.where(length <= SHORT, length, 0))
        probe, other = _expanded(first[of], place - first[of])  # in a short list, every set with those before it
        x, y = np.maximum(member[place[probe]], member[other]), np.minimum(member[place[probe]], member[other])
        x, y = np.unique(np.stack([x, y]), axis=1) if len(x) else (x, y)
        s = unpack(table["sets"].to_pylist())
        begin = np.cumsum(s["words"]) - s["words"]
        order = np.lexsort((s["doc"], s["identity"]))
        doc, identity = s["doc"][order], s["identity"][order]
        fresh = np.concatenate([[True], identity[1:] != identity[:-1]]) if len(doc) else np.zeros(0, bool)
        rep = doc[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(doc) else doc
        copies.append((doc[~fresh], rep[~fresh]))
        word, least = unpack(table["sketches"].to_pylist())["word"] if len(doc) else np.zeros(0, np.uint64), order[fresh]
        drawn = [word[i : i + n].tobytes() for i, n in zip(begin[least], s["words"][least])]
        same = [np.concatenate(c) for c in zip(*copies)]
        parts = [(*same, True, False), (node, root, False, False), (x, y, False, True)]
        columns = [np.concatenate([p[i] for p in parts]) for i in range(2)] + [np.concatenate([np.full(len(p[0]), p[i]) for p in parts]) for i in (2, 3)]
        columns = [c[columns[0] != columns[1]] for c in columns]
        n, more = len(columns[0]), [doc[fresh], s["size"][least], np.zeros(len(drawn), bool), np.zeros(len(drawn), bool)]
        return pa.table([*(pa.array(np.concatenate(c)) for c in zip(columns, more)), pa.array([None] * n + drawn, pa.binary())], [c.split()[0] for c in EDGES.split(", ")])

    sent = docs.mapInArrow(run, "bucket int, lists binary, sets binary, sketches binary, edges binary")
    return sent.groupBy("bucket").applyInArrow(compare, EDGES)


EDGES = "a bigint, b bigint, same boolean, ask boolean, sketch binary"


def _rows(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4))], ["bucket", "lists", "sets", "sketches", "edges"])


def near_by_sketch(found: DataFrame, join: Join) -> DataFrame:
    """Those of the asked pairs (a, b) whose sketches do not show that they are too far apart."""
    drawn = found.where("sketch is not null")
    a, b = (drawn.select(F.col("a").alias(x), F.col("b").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    asked = found.where("sketch is null and ask").select("a", "b").distinct()
    beside = asked.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # a sketch may be long
            far = join.apart(batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            near = [sketch_distance(x, y) <= f for x, y, f in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), far)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return beside.mapInArrow(run, "a bigint, b bigint")


def _in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are among the ascending ones."""
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values if len(ascending) else np.zeros(len(values), bool)


def _expanded(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs [start, start + size): the run of every place, and the places."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size - start, size)


def _portions(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows whose sizes sum up to `limit` at most, one row at least."""
    reached, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def differences(family: np.ndarray, doc: np.ndarray, votes: np.ndarray, off: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Difference of each set to its family's pivot: sizes, then (set, element) of every element in which they differ.

    family: ascending numbers from 0.  The pivot is the voter nearest to what most voters have (of equal ones the
    least document); a family without voters has an empty pivot.
    """
    n, size = len(family), np.diff(off)
    known, number = np.unique(token, return_inverse=True)
    who = np.repeat(np.arange(n), size)
    key = family[who] << 32 | number
    voted, count = np.unique(key[votes[who]], return_counts=True)
    voters = np.bincount(family[votes], minlength=family[-1] + 1)
    core = voted[2 * count > voters[voted >> 32]]
    wide = np.bincount(core >> 32, minlength=len(voters))
    off_core = size + wide[family] - 2 * np.bincount(who[_in(key, core)], minlength=n)
    order = np.lexsort((doc, off_core, ~votes, family))
    best = order[np.searchsorted(family[order], np.arange(len(voters)))]
    pivot = np.where(voters > 0, best, -1)
    there = pivot >= 0
    of, place = _expanded(off[pivot[there]], size[pivot[there]])
    inside = _in(key, np.sort(np.flatnonzero(there)[of] << 32 | number[place]))
    mine = pivot[family]
    of, place = _expanded(off[mine], np.where(mine >= 0, size[mine], 0))
    lost = of << 32 | number[place]
    lost = lost[~_in(lost, who << 32 | number)]
    both = np.sort(np.concatenate([(who << 32 | number)[~inside], lost]))
    return np.bincount(both >> 32, minlength=n), both >> 32, known[both & 0xFFFFFFFF] if len(known) else token


def classes_of(m: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Class of each member, and the classes: family, size, difference, weight and least document, in this order."""
    order = np.lexsort((m["doc"], m["delta"], m["size"], m["family"]))
    keys = [m[k][order] for k in ("family", "size", "delta")]
    fresh = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    first = np.flatnonzero(fresh)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return of, {"family": keys[0][first], "size": keys[1][first], "delta": keys[2][first], "weight": np.add.reduceat(m["weight"][order], first), "doc": m["doc"][order][first]}


def settle(join: Join, m: dict[str, np.ndarray], c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What follows from the pivot's answers: edges (a, b), the weight linked with each member, and the common elements that
    it needs at least with some member of an open class (0: nothing is open). `c` has all classes of the members' families."""
    of, own = classes_of(m)
    low, many = np.searchsorted(c["family"], own["family"]), 0
    many = np.searchsorted(c["family"], own["family"], "right") - low
    links, need = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    itself, partner = np.zeros(len(low), bool), np.full(len(low), np.iinfo(np.int64).max)
    edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s, e in _portions(many, PAIRS):
        i, j = _expanded(low[s:e], many[s:e])
        i += s
        far = join.apart(own["size"][i] + c["size"][j])
        spare = own["delta"][i] + c["delta"][j] - far  # elements that have to be common to both differences, twice counted
        sure = spare <= 0
        open_ = ~sure & (np.abs(own["delta"][i] - c["delta"][j]) <= far) & (np.abs(own["size"][i] - c["size"][j]) <= far)
        links[s:e] += np.bincount(i[sure] - s, weights=c["weight"][j[sure]], minlength=e - s).astype(np.int64)
        np.minimum.at(partner, i[sure], c["doc"][j[sure]])
        itself[i[sure & (own["size"][i] == c["size"][j]) & (own["delta"][i] == c["delta"][j])]] = True
        least = np.full(e - s, np.iinfo(np.int64).max)
        np.minimum.at(least, i[open_] - s, (spare[open_] + 1) // 2)
        need[s:e] = np.where(least < np.iinfo(np.int64).max, least, 0)
        edges.append(forest(own["doc"][i[sure]], c["doc"][j[sure]]))
    has = partner[of] < np.iinfo(np.int64).max
    edges.append((m["doc"][has], partner[of[has]]))
    a, b = (np.concatenate(x) for x in zip(*edges))
    return a, b, links[of] - np.where(itself[of], m["weight"], 0), need[of]


def read_lists(join: Join, m: dict[str, np.ndarray], who: np.ndarray, element: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of linked members of open classes, found in index lists over the elements of their differences.

    who, element: all elements in which open members differ from the pivot, by member; side: only pairs of two sides count.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(who):
        return none
    _, number = np.unique(element, return_inverse=True)
    held = who << 32 | number  # for verification
    held.sort()
    key = m["family"][who] << 32 | number
    lists, of, count = np.unique(key, return_inverse=True, return_counts=True)
    order = np.lexsort((of, count[of], who))  # rare elements first, in one order for all
    who, of = who[order], of[order]
    first = np.searchsorted(who, np.arange(len(m["doc"])))
    rest = m["delta"][who] - (np.arange(len(who)) - first[who])  # this element and those behind it
    keep = (rest >= m["need"][who]) & (count[of] > 1)
    who, of, rest = who[keep], of[keep], rest[keep]
    order = np.lexsort((-rest, of))
    who, of, rest = who[order], of[order], rest[order]
    top = int(rest.max(initial=0)) + 1
    stands = of * (top + 1) + (top - rest)  # by list, then by what is left: the entries that a probe needs come first
    start = np.searchsorted(stands, of * (top + 1))
    readable = np.searchsorted(stands, of * (top + 1) + (top - m["need"][who]), "right") - start
    found = [np.zeros(0, np.int64)]
    for s, e in _portions(readable, PAIRS):
        probe, at = _expanded(start[s:e], readable[s:e])
        x, y, left = who[s + probe], who[at], np.minimum(rest[s + probe], rest[at])
        far = join.apart(m["size"][x] + m["size"][y])
        spare = m["delta"][x] + m["delta"][y] - far
        ok = (x < y) & (spare > 0) & (np.abs(m["delta"][x] - m["delta"][y]) <= far) & (2 * left >= spare)
        if side is not None:
            ok &= side[x] != side[y]
        found.append(np.unique(x[ok] << 32 | y[ok]))
    pairs = np.unique(np.concatenate(found))
    x, y = pairs >> 32, pairs & 0xFFFFFFFF
    spare = m["delta"][x] + m["delta"][y] - join.apart(m["size"][x] + m["size"][y])
    shorter = m["delta"][x] <= m["delta"][y]
    x, y = np.where(shorter, x, y), np.where(shorter, y, x)
    begin, linked = np.searchsorted(held, x << 32), np.zeros(len(x), bool)
    for s, e in _portions(m["delta"][x], PAIRS):
        pair, at = _expanded(begin[s:e], m["delta"][x[s:e]])
        common = np.bincount(pair[_in(y[s:e][pair] << 32 | held[at] & 0xFFFFFFFF, held)], minlength=e - s)
        linked[s:e] = 2 * common >= spare[s:e]
    return x[linked], y[linked]


#: One row for each result: an edge (a, b) or a sum (a, a, links); or for each slice of a cut family: its members and their differences.
ANSWERS = "a bigint, b bigint, links bigint, family bigint, slice bigint, slices bigint, heads binary, elements binary"
_MEMBER = ("doc", "size", "delta", "weight")


def _answers(edges: list[tuple[np.ndarray, np.ndarray]], sums: list[tuple[np.ndarray, np.ndarray]], pieces: list[tuple] = ()) -> pa.Table:
    a, b = (np.concatenate([e[i] for e in edges]) if edges else np.zeros(0, np.int64) for i in range(2))
    a, b = forest(a, b)
    some = a != b
    doc, links = (np.concatenate([x[i] for x in sums]) if sums else np.zeros(0, np.int64) for i in range(2))
    told = links > 0
    a, b = a[some], b[some]
    n, more = len(a) + int(told.sum()), len(pieces)
    columns = [np.concatenate([a, doc[told]]), np.concatenate([b, doc[told]]), np.concatenate([np.zeros(len(a), np.int64), links[told]])]
    out = [pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(more, pa.int64())]) for c in columns]
    for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())):
        out.append(pa.concat_arrays([pa.nulls(n, kind), pa.array([p[i] for p in pieces], kind)]))
    return pa.table(out, names=[c.split()[0] for c in ANSWERS.split(", ")])


def _open(join: Join, m: dict[str, np.ndarray], who: np.ndarray, element: np.ndarray, edges: list, sums: list, side: np.ndarray | None = None) -> None:
    """Adds what open members find in their lists."""
    some = m["need"][who] > 0
    x, y = read_lists(join, m, who[some], element[some], side)
    edges.append((m["doc"][x], m["doc"][y]))
    sums += [(m["doc"][x], m["weight"][y]), (m["doc"][y], m["weight"][x])]


def _summed(sums: list) -> list:
    doc, links = (np.concatenate([s[i] for s in sums]) if sums else np.zeros(0, np.int64) for i in range(2))
    known, at = np.unique(doc, return_inverse=True)
    return [(known, np.bincount(at, weights=links, minlength=len(known)).astype(np.int64))]


def family_links(home_docs: DataFrame, members: DataFrame, join: Join, buckets: int) -> DataFrame:
    """Forests of links (a, b) inside every family, and rows (a, a, links) that sum up to the documents linked with a.

    members: doc, family, count (members of the family), copies (documents with the very set), home.
    """

    def beside(left, right):
        doc = right["doc"].to_numpy()
        order = np.argsort(doc, kind="stable")
        doc, family, count, weight = doc[order], *(right[c].to_numpy()[order] for c in ("family", "count", "copies"))
        rows = []
        if len(doc):
            for batch in chunks(iter(left.combine_chunks().to_batches()), limit=CHUNK):
                row, at = matched(ids_of(batch.column(0)), doc)
                if not len(row):
                    continue
                token, off = shingle_sets(batch.column(1).take(pa.array(row)), join.n)
                scattered = mix(doc[at].astype(np.uint64))
                slices = -(-count[at] // SLICE)
                own = (scattered % slices.astype(np.uint64)).astype(np.int64)
                # in a cut family, voters go to all slices, so that each finds the same pivot
                votes = (slices == 1) | (scattered // np.uint64(1 << 20) % (-(-count[at] // VOTERS)).astype(np.uint64) == 0)
                copies = np.where(votes, slices, 1)
                m, piece = _expanded(np.where(votes, 0, own), copies)
                task = (mix(mix(family[at][m].astype(np.uint64)) + piece.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                for bucket, some in spread(task, buckets):
                    some = some[np.lexsort((piece[some], family[at][m[some]]))]
                    x = m[some]
                    size = np.diff(off)[x]
                    _, place = _expanded(off[x], size)
                    heads = pack(doc=doc[at][x], family=family[at][x], slice=piece[some], slices=slices[x], votes=votes[x], own=own[x] == piece[some], size=size, weight=weight[at][x])
                    rows.append((bucket, heads, pack(token=token[place])))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "heads", "tokens"])

    def answer(table):
        heads, tokens = unpack(table["heads"].to_pylist()), unpack(table["tokens"].to_pylist())["token"]
        begin = np.cumsum(heads["size"]) - heads["size"]
        order = np.lexsort((heads["doc"], heads["slice"], heads["family"]))
        group = np.cumsum(np.concatenate([[False], (np.diff(heads["family"][order]) != 0) | (np.diff(heads["slice"][order]) != 0)]))
        edges, sums, pieces = [], [], []
        weight = np.maximum(np.bincount(group) * (PORTION // TOGETHER), np.bincount(group, weights=heads["size"][order]).astype(np.int64))
        for s, e in _portions(weight, PORTION):
            of = order[np.searchsorted(group, s) : np.searchsorted(group, e)]
            size = heads["size"][of]
            _, place = _expanded(begin[of], size)
            m = {"family": group[np.searchsorted(group, s) : np.searchsorted(group, e)] - s, **{k: heads[k][of] for k in ("doc", "size", "weight")}}
            m["delta"], who, element = differences(m["family"], m["doc"], heads["votes"][of], np.concatenate([[0], np.cumsum(size)]), tokens[place])
            # families in one piece are answered here
            whole = heads["slices"][of] == 1
            if whole.any():
                at = np.cumsum(whole) - 1
                w = {k: v[whole] for k, v in m.items()}
                a, b, links, w["need"] = settle(join, w, classes_of(w)[1])
                edges.append((a, b))
                sums.append((w["doc"], links))
                some = whole[who]
                _open(join, w, at[who[some]], element[some], edges, sums)
            mine = ~whole & heads["own"][of]
            for g in np.unique(m["family"][mine]):
                own = np.flatnonzero(mine & (m["family"] == g))
                first, last = np.searchsorted(who, own), np.searchsorted(who, own, "right")
                _, at = _expanded(first, last - first)
                pieces.append((heads["family"][of][own[0]], heads["slice"][of][own[0]], heads["slices"][of][own[0]], pack(**{k: m[k][own] for k in _MEMBER}), pack(element=element[at])))
        return _answers(edges, _summed(sums), pieces)

    dealt = home_docs.groupBy("home").cogroup(members.groupBy("home")).applyInArrow(beside, "bucket int, heads binary, tokens binary")
    answers = cut(dealt.groupBy("bucket").applyInArrow(answer, ANSWERS))
    pieces = answers.where("slice is not null").select("family", "slice", "slices", "heads", "elements")
    told = answers.where("slice is null").select("a", "b", "links")
    if not pieces.limit(1).count():
        return told
    return told.unionByName(cut_family_links(pieces, join))


def cut_family_links(pieces: DataFrame, join: Join) -> DataFrame:
    """The same for families in several slices: classes are summed up, and slices with open members meet in pairs."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for family, slices, heads in zip(*(batch.column(i).to_pylist() for i in range(3))):
                m = unpack([heads])
                _, c = classes_of(m | {"family": np.zeros(len(m["doc"]), np.int64)})
                n = len(c["doc"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, family)), pa.array(np.full(n, slices)), *(pa.array(c[k]) for k in ("size", "delta", "weight", "doc"))], ["family", "slices", "size", "delta", "weight", "doc"])

    def settled(left, right):
        if not left.num_rows:
            return _answers([], [])
        heads, elements = left["heads"].to_pylist(), left["elements"].to_pylist()
        m = unpack(heads)
        zero = np.zeros(len(m["doc"]), np.int64)
        c = {k: right[k].to_numpy() for k in ("size", "delta", "weight", "doc")}
        a, b, links, need = settle(join, m | {"family": zero}, c | {"family": np.zeros(len(c["doc"]), np.int64)})
        some, pieces_ = need > 0, []
        if some.any():
            element = unpack(elements)["element"]
            _, place = _expanded((np.cumsum(m["delta"]) - m["delta"])[some], m["delta"][some])
            pieces_.append((left["family"][0].as_py(), left["slice"][0].as_py(), left["slices"][0].as_py(), pack(**{k: m[k][some] for k in _MEMBER}, need=need[some]), pack(element=element[place])))
        return _answers([(a, b)], [(m["doc"], links)], pieces_)

    def meet(table):
        m = unpack(table["heads"].to_pylist())
        element = unpack(table["elements"].to_pylist())["element"]
        side = np.repeat(table["slice"].to_numpy(), [len(unpack([h])["doc"]) for h in table["heads"].to_pylist()])
        alone = table.num_rows == 1 and table["low"][0].as_py() == table["high"][0].as_py()
        m["family"] = np.zeros(len(m["doc"]), np.int64)
        edges, sums = [], []
        if alone or table.num_rows == 2:
            _open(join, m, np.repeat(np.arange(len(m["doc"])), m["delta"]), element, edges, sums, None if alone else side)
        return _answers(edges, _summed(sums))

    summed = pieces.select("family", "slices", "heads").mapInArrow(classes, "family bigint, slices bigint, size bigint, delta bigint, weight bigint, doc bigint")
    summed = summed.groupBy("family", "slices", "size", "delta").agg(F.sum("weight").alias("weight"), F.min("doc").alias("doc"))
    each = summed.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))).drop("slices")
    first = cut(pieces.groupBy("family", "slice").cogroup(each.groupBy("family", "slice")).applyInArrow(settled, ANSWERS))
    open_ = first.where("slice is not null").select("family", "slice", "slices", "heads", "elements")
    pairs = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    pairs = pairs.select("family", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice", "heads", "elements")
    met = pairs.groupBy("family", "low", "high").applyInArrow(meet, ANSWERS)
    return first.where("slice is null").select("a", "b", "links").unionByName(met.select("a", "b", "links"))


def join_documents(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Of every document: set size, least document reachable by links (itself included), documents linked with it."""
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
    edges, links = links_of(plain, join)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            _, off = shingle_sets(batch.column(1), join.n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(ids_of(batch.column(0)))], ["doc_id", "n_shingles", "node"])

    counted = plain.mapInArrow(count, "doc_id bigint, n_shingles bigint, node bigint")
    component = F.coalesce(F.col("label"), F.col("node"))
    told = counted.join(labels_of(edges, links), "node", "left").join(link_counts(edges, links), "node", "left")
    return told.select("doc_id", "n_shingles", F.when(component != NO_ID, component).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def links_of(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Edges among sets that meet (and copies), and the links inside families."""
    buckets, homes = sizes(docs)
    found = cut(candidates(docs, join, buckets))
    known = found.where("sketch is null and not ask").select("a", "b", "same")
    edges = cut(known.unionByName(near_by_sketch(found, join).withColumn("same", F.lit(False))))
    # copies of a set hold families together, but only the first of them is compared
    families = cut(components(edges.select("a", "b")).join(edges.where("same").select(F.col("a").alias("node")), "node", "left_anti"))
    counted = families.join(families.groupBy("label").count().where("count > 1"), "label")
    counted = counted.join(copies_of(edges), "node", "left")
    members = counted.select(F.col("node").alias("doc"), F.col("label").alias("family"), "count", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), F.pmod("node", F.lit(homes)).cast("int").alias("home"))
    return edges, cut(family_links(housed(docs, homes), members, join, buckets))


def copies_of(edges: DataFrame) -> DataFrame:
    """(node, copies) of the first document of every set that has copies.

    A copy points to the first one of its task, and that one to the first of
    all, so counts are taken before they are moved up: no key is hot in a join.
    """
    same = edges.where("same")
    direct = same.groupBy("b").agg(F.count("*").alias("n"))
    above = same.select(F.col("a").alias("b"), F.col("b").alias("root"))
    return direct.join(above, "b", "left").groupBy(F.coalesce("root", "b").alias("node")).agg((F.sum("n") + 1).alias("copies"))


def labels_of(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of every document that has links."""
    return components(links.where("a <> b").select("a", "b").unionByName(edges.where("same").select("a", "b")))


def link_counts(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(node, n_links) of every document that has links: those of its set's family, and its set's other copies."""
    sets = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others")).join(copies_of(edges), "node", "full")
    first = sets.select("node", (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    same = edges.where("same")
    above = same.select(F.col("a").alias("b"), F.col("b").alias("root"))
    rep = same.select(F.col("a").alias("copy"), "b").join(above, "b", "left").select("copy", F.coalesce("root", "b").alias("node"))
    return first.unionByName(looked_up(rep, "node", first, "copy").select(F.col("copy").alias("node"), "n_links"))


def link_components(docs: DataFrame, join: Join) -> DataFrame:
    """(node, label) of every document that has links."""
    return labels_of(*links_of(docs, join))


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of `docs`, all columns, of one document (the least id) of each component."""
    (node,) = free(docs.columns, "node")
    labels = link_components(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]), join)
    gone = labels.where("node <> label").select(F.col("node").alias(node))
    keyed = docs.withColumn(node, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)))
    return keyed.join(gone, node, "left_anti").select(docs.columns)
