"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes (over words, taken around anchors, see repeats) are split by prefixes
of variable length.  Between tasks the prefix is the six words of an anchor, and
where such a group would be overfull the whole window, which is a node already.
A group of one neighbourhood is a leaf and needs no tree.  Inside a task the
suffixes of the other groups are counted by their first word, and a prefix whose
suffixes would not fit the stated memory (GROUP_BYTES) is lengthened word by word
until they do; groups are then taken together as far as they fit.

For each of them the tree is grown from its prefix: a node's suffixes are split
by their next word; where all go on alike the edge gets longer, where they part
the node is an internal one of that depth with its children, a suffix alone is a
leaf.  A branch that two suffixes still share at the depth of a window ends in a
deep internal node, a maximal repeat of that many words or more; its earliest leaf
stays.  Uniting neighbouring repeats of a document gives them their full length.

Defined results: as in repeats; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.repeats import Rule, apply_intervals, covered, firsts, pack, repeated_starts, spread, unpack
from tidewright.llm.textkernel import byte_symbols, flat, prefix_hash, span_hash, word_bounds

RULE = Rule(length=20, q=6, within=True)
#: Open neighbourhoods of one anchor beyond which its prefix is lengthened to the whole window.
LARGE = 20_000
#: Memory for the suffixes of a group, and what growing a tree takes for one suffix.
GROUP_BYTES, SUFFIX_BYTES = 48 << 20, 160
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(buf, off)
    return span_hash(prefix_hash(byte_symbols(buf)), starts, ends), first


def gather(rule: Rule, batch: pa.RecordBatch, off: np.ndarray, ids: np.ndarray, place: np.ndarray, rest: dict[str, np.ndarray], buckets: int) -> Iterator[tuple[int, str, bytes]]:
    """The words around every open anchor, for the group of its prefix."""
    word, _ = symbols(*flat(batch.column(1)))
    d = np.searchsorted(off, place, "right") - 1
    left = np.minimum(place - off[d], rule.reach - 1)
    right = np.minimum(off[d + 1] - place, rule.length)
    for bucket, some in spread(rest["bucket"].astype(np.int64), buckets):
        some = some[np.argsort(rest["gram"][some], kind="stable")]
        columns = {}
        for i, step in enumerate(range(-(rule.reach - 1), rule.length)):
            inside = (step >= -left[some]) & (step < right[some])
            columns[f"w{i}"] = np.where(inside, word[np.where(inside, place[some] + step, 0)], np.uint64(0))
        yield bucket, "gathered", pack(doc=ids[d[some]], place=(place - off[d])[some].astype(np.uint32), gram=rest["gram"][some], left=left[some].astype(np.uint8), right=right[some].astype(np.uint8), **columns)


@dataclass
class Tree:
    """Nodes of a forest of prefixes: parent (-1: a prefix), depth in words, first word of the edge; and each suffix's deep node, or -1."""

    parent: np.ndarray
    depth: np.ndarray
    word: np.ndarray
    leaf_of: np.ndarray


def partition(words: np.ndarray, row: np.ndarray, shift: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix (a number) of each suffix and how many words it has: one, and more while more than `most` suffixes share it."""
    _, prefix = np.unique(words[row, shift], return_inverse=True)
    size = np.ones(len(row), np.int64)
    for have in range(1, length):
        over = np.flatnonzero((np.bincount(prefix) > most)[prefix])
        if not len(over):
            break
        _, longer = np.unique(prefix[over] * (int(words.max()) + 1) + words[row[over], shift[over] + have], return_inverse=True)
        prefix[over] = int(prefix.max()) + 1 + longer
        size[over] = have + 1
    return np.unique(prefix, return_inverse=True)[1], size


def grow_tree(words: np.ndarray, row: np.ndarray, shift: np.ndarray, prefix: np.ndarray, size: np.ndarray, length: int) -> Tree:
    """The trees of some prefixes over the suffixes (row, shift), down to `length` words.

    prefix: number of each suffix's prefix; size: its words.  All branches grow together, one word a round.
    """
    count = int(prefix.max()) + 1
    parent, depth, word = [np.full(count, -1, np.int64)], [np.zeros(count, np.int64)], [np.zeros(count, np.int64)]
    depth[0][prefix] = size
    word[0][prefix] = words[row, shift]
    branch, at, leaf_of = prefix.copy(), np.arange(len(row)), np.full(len(row), -1, np.int64)
    shared = np.bincount(branch)[branch] > 1
    at, branch, below = at[shared], branch[shared], size[shared]
    while len(at):
        ends = below == length
        leaf_of[at[ends]] = branch[ends]
        at, branch, below = at[~ends], branch[~ends], below[~ends]
        if not len(at):
            break
        next_ = words[row[at], shift[at] + below]
        order = np.lexsort((next_, branch))
        at, branch, below, next_ = at[order], branch[order], below[order], next_[order]
        part = np.concatenate([[True], branch[1:] != branch[:-1]])
        child = part.copy()
        child[1:] |= next_[1:] != next_[:-1]
        first = np.flatnonzero(child)
        of = np.cumsum(child) - 1
        children = np.bincount(np.cumsum(part)[first] - 1)[np.cumsum(part) - 1]  # of the branch of each suffix
        suffixes = np.diff(np.append(first, len(at)))[of]
        # where suffixes part, the branch is an internal node, and children that are shared are new branches
        new = np.flatnonzero(child & (children > 1) & (suffixes > 1))
        fork = np.flatnonzero(part & (children > 1))
        named = np.full(len(first), -1, np.int64)
        named[of[new]] = count + np.arange(len(new))
        depths = np.concatenate(depth)
        depths[branch[fork]] = below[fork]
        parent.append(branch[new])
        depth = [depths, below[new] + 1]
        word.append(next_[new])
        count += len(new)
        branch = np.where(children > 1, named[of], branch)
        stay = suffixes > 1
        at, branch, below = at[stay], branch[stay], below[stay] + 1
    depths = np.concatenate(depth)
    depths[leaf_of[leaf_of >= 0]] = length
    return Tree(np.concatenate(parent), depths, np.concatenate(word), leaf_of)


def grow(rule: Rule, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of the windows that are not the earliest leaf of their deep internal node."""
    a = unpack(blobs)
    reach, length = rule.reach, rule.length
    words = np.stack([a[f"w{i}"] for i in range(reach - 1 + length)], axis=1)
    shape = words.shape
    words = np.unique(words, return_inverse=True)[1].reshape(shape).astype(np.int32)
    inside = (np.arange(reach) >= reach - 1 - a["left"].astype(int)[:, None]) & (np.arange(reach) + length <= reach - 1 + a["right"].astype(int)[:, None])
    row, shift = np.nonzero(inside)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(row):
        most = GROUP_BYTES // SUFFIX_BYTES
        prefix, size = partition(words, row, shift, length, most)
        order = np.argsort(prefix, kind="stable")
        members = np.bincount(prefix)
        reached = np.cumsum(members)
        at = 0
        while at < len(members):  # prefixes that fit together
            end = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + most, "right")))
            some = order[(reached[at - 1] if at else 0) : reached[end - 1]]
            tree = grow_tree(words, row[some], shift[some], prefix[some] - at, size[some], length)
            deep = some[tree.leaf_of >= 0]
            doc, start = a["doc"][row[deep]], a["place"][row[deep]].astype(np.int64) - (reach - 1) + shift[deep]
            order_, later = firsts(rule, doc, start, tree.leaf_of[tree.leaf_of >= 0])
            found.append((doc[order_[later]], start[order_[later]]))
            at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _finish(batch: pa.RecordBatch, ids: np.ndarray, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    buf, off = flat(batch.column(1))
    starts, ends, first = word_bounds(buf, off)
    gone = covered(RULE, first, ids, found)
    removed = np.concatenate([[0], np.cumsum(gone)])
    # kept words, each followed by one space, as one buffer
    s, size = starts[~gone], (ends - starts)[~gone]
    place = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(place[-1], 0x20, np.uint8)
    inner = np.ones(place[-1], bool)
    inner[place[1:] - 1] = False
    text[inner] = buf[np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    kept = text.tobytes()
    at = place[first - removed[first]].tolist()
    digest = [hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(np.diff(removed[first])), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_words(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """Digest of every text without the words of 20-word windows that came earlier."""
    home_docs, found = repeated_starts(docs, symbols, RULE, large, gather, grow)
    return apply_intervals(home_docs, found, _finish, SCHEMA)
