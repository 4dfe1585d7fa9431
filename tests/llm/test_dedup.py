"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewright.llm import jaccard, repeats, substring, suffixtree
from tidewright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_bytes(rows):
    first, out = {}, []
    docs = [(-1 if r[0] is None else r[0], (r[1] or "").encode(), r[0]) for r in rows]
    for i, b, _ in sorted(docs):
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, b, ident in docs:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes() if len(b) else b""
        out.append((ident, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows):
    first, out = {}, []
    docs = [(-1 if r[0] is None else r[0], WORD.findall(r[1] or ""), r[0]) for r in rows]
    for i, w, _ in sorted(docs):
        for j in range(len(w) - 19):
            first.setdefault(tuple(w[j : j + 20]), (i, j))
    for i, w, ident in docs:
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if first[tuple(w[j : j + 20])] != (i, j):
                gone[j : j + 20] = [True] * 20
        out.append((ident, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def brute_sets(rows, n=3, percent=90):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists, links = defaultdict(list), Counter()
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0])):
        met = Counter(j for g in sets[k] for j in lists[g])
        for g in sets[k]:
            lists[g].append(k)
        for j, both in met.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[j]) - both):
                a, b = sorted((find(rows[k][0]), find(rows[j][0])), key=lambda x: (x is not None, x))
                parent[b] = a
                if rows[k][0] != rows[j][0]:
                    links.update((rows[k][0], rows[j][0]))
    return [(r[0], len(s), find(r[0]), links[r[0]]) for r, s in zip(rows, sets)]


def test_pointers_are_those_of_a_sorted_suffix_array():
    """After each refinement, suffixes share a bucket exactly if they are equal down to its depth."""
    r = np.random.default_rng(1)
    pattern = r.integers(97, 99, 30).astype(np.uint8)
    text = np.where(r.random((60, 88)) < 0.03, 120, np.resize(pattern, 88)).astype(np.uint8)
    for k in range(60):
        text[k] = np.roll(text[k], k % 4)
    low, high = r.integers(0, 10, 60), 82 - r.integers(0, 10, 60)
    buckets = substring.BucketPointers(text, low, high)
    for depth in (8, 16, 32, 50):
        if depth > 8:
            shared, pointer = buckets.refine(depth)
            assert np.array_equal(np.unique(shared), np.sort(shared)) and (np.diff(pointer) >= 0).all()
        of = {}
        for k in range(60):
            for p in range(low[k], high[k] - depth + 1):
                of.setdefault(text[k, p : p + depth].tobytes(), set()).add(k * 88 + p)
        several = sorted(i for s in of.values() if len(s) > 1 for i in s)
        assert sorted(buckets.active.tolist()) == several
        for s in of.values():
            assert len({buckets.pointer[i] for i in s}) == 1
        assert len({buckets.pointer[min(s)] for s in of.values() if len(s) > 1}) == sum(len(s) > 1 for s in of.values())


def test_tree_is_that_of_brute_force():
    """Variable prefixes fit the limit; internal nodes are where suffixes part; deep nodes are equal windows."""
    r = np.random.default_rng(2)
    length, wide = 8, 14
    words = r.integers(0, 3, (80, wide)).astype(np.int32)
    words[::3] = words[0]
    row, shift = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(wide - length + 1), indexing="ij"))
    suffix = [tuple(words[k, s : s + length]) for k, s in zip(row, shift)]
    for most in (10**6, 60, 5):
        prefix, size = suffixtree.partition(words, row, shift, length, most)
        assert all(n <= most for n, m in zip(np.bincount(prefix), range(prefix.max() + 1)) if size[prefix == m][0] < length)
        names = {}
        for s, p, n in zip(suffix, prefix, size):
            assert names.setdefault(p, s[:n]) == s[:n]
        assert len(set(names.values())) == len(names)
        tree = suffixtree.grow_tree(words, row, shift, prefix, size, length)
        many = Counter(suffix)
        assert all((leaf >= 0) == (many[s] > 1) for s, leaf in zip(suffix, tree.leaf_of))
        assert len({(s, leaf) for s, leaf in zip(suffix, tree.leaf_of) if leaf >= 0}) == len({leaf for leaf in tree.leaf_of if leaf >= 0}) == sum(n > 1 for n in many.values())
        want = set()  # strings below a prefix after which suffixes go on differently, and repeated windows
        for s, n in zip(suffix, size):
            for d in range(n, length + 1):
                if many[s] > 1 and d == length or d < length and len({t[d] for t, m in zip(suffix, size) if t[:d] == s[:d]}) > 1:
                    want.add(s[:d])
        forks = {*tree.parent.tolist(), *tree.leaf_of.tolist()} - {-1}
        assert forks <= set(range(len(tree.depth))) and {tree.depth[k] for k in forks} <= {len(w) for w in want}
        deep = [tree.depth[k] for k in set(tree.leaf_of.tolist()) - {-1}]
        assert set(deep) <= {length} and len(deep) == sum(len(w) == length for w in want)
        assert all(tree.depth[k] > tree.depth[p] for k, p in enumerate(tree.parent) if p >= 0)


def same(df, want):
    got = sorted((tuple(x) for x in df.collect()), key=repr)
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("large", [20_000, 1])
def test_substrings(docs, rows, large):
    same(substring.dedup_substrings(docs, large), brute_bytes(rows))


@pytest.mark.parametrize("large", [20_000, 1])
def test_words(docs, rows, large):
    same(suffixtree.dedup_words(docs, large), brute_words(rows))


QUERY = jaccard.Join(n=3, percent=90)


def test_frequent_grams_go_their_own_way(spark, monkeypatch):
    """A phrase that many documents have between different words is dealt out window by window, with equal results."""
    monkeypatch.setattr(repeats, "ONE_IN", 2)
    monkeypatch.setattr(repeats, "SEEN", 3)
    r = random.Random(8)
    phrase, say = "a phrase that comes again and again in very many of these documents here", lambda n: " ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(n))
    rows = [(i, f"{say(r.randint(0, 9))} {phrase} {say(r.randint(0, 9))} {say(25) if i % 3 else 'the same end of twenty words ' * 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for symbols, rule in ((substring.symbols, substring.RULE), (suffixtree.symbols, suffixtree.RULE)):
        assert len(repeats.frequent_grams(docs, symbols, rule, 20, 10**6)) > 0
    same(substring.dedup_substrings(docs, 20), brute_bytes(rows))
    same(suffixtree.dedup_words(docs, 20), brute_words(rows))


def test_anchors_in_parts(monkeypatch):
    r = np.random.default_rng(4)
    buf = r.integers(97, 100, 5000).astype(np.uint8)
    whole = repeats.anchors(*substring.symbols(buf, np.array([0, 1200, 1230, 5000])), substring.RULE)
    monkeypatch.setattr(repeats, "PART", 97)
    for a, b in zip(whole, repeats.anchors(*substring.symbols(buf, np.array([0, 1200, 1230, 5000])), substring.RULE)):
        assert np.array_equal(a, b)


def test_what_shares_no_half_is_not_refined(monkeypatch):
    """Neighbourhoods of one frequent q-gram: only those that can share a window are sorted."""
    r, gram = random.Random(11), "a frequent q-gram!"
    side = lambda: "".join(r.choice(string.ascii_letters) for _ in range(32))
    shared = side()
    texts = [side() + gram + side() for _ in range(50)] + [side() + gram + shared for _ in range(2)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    text = np.zeros((len(texts), 88), np.uint8)
    text[:, :82] = buf.reshape(len(texts), 82)
    n, words = len(texts), text.view(np.uint64)
    blob = repeats.pack(doc=np.arange(n), place=np.full(n, 32, np.uint32), gram=np.ones(n, np.uint32), left=np.full(n, 32, np.uint8), right=np.full(n, 50, np.uint8), **{f"w{i}": words[:, i] for i in range(11)})
    sorted_, plain = [], substring._refine
    monkeypatch.setattr(substring, "_refine", lambda rule, a, text: sorted_.append(len(text)) or plain(rule, a, text))
    doc, start = substring.refine(substring.RULE, [blob])
    assert sorted_ == [2] and sorted(zip(doc.tolist(), start.tolist())) == [(51, 32)]


def test_windows_are_hashed_where_they_are_asked_for(monkeypatch):
    text = np.frombuffer(bytes(random.Random(12).randrange(256) for _ in range(5000)), np.uint8)
    symbol, off, starts = text.astype(np.uint64), np.array([0, 3000, 5000]), np.array([0, 1, 2, 700, 2950, 3000, 4950])
    hashed, plain = [], repeats.windows
    monkeypatch.setattr(repeats, "windows", lambda s, q: hashed.append(len(s)) or plain(s, q))
    got = repeats.window_records(substring.RULE, symbol, off, np.array([7, 8]), starts)
    assert hashed[0] < 500 and got["doc"].tolist() == [7] * 5 + [8] * 2 and got["place"].tolist() == [0, 1, 2, 700, 2950, 0, 1950]
    assert (got["window"] == plain(symbol, 50)[starts]).all()


def test_order_by_fields():
    r = np.random.default_rng(13)
    for a in (r.integers(-5, 5, 300), np.array([repeats.NO_ID, 3, 1 << 62] * 100), np.full(300, repeats.NO_ID)):
        b = r.integers(0, 9, 300).astype(np.uint32)
        got, want = repeats.order_by(a, b), np.lexsort((b, a))
        assert (a[got] == a[want]).all() and (b[got] == b[want]).all()
    # a second key that differs where the first 64 bits are the same
    gram, near, doc, place = np.ones(6, np.uint32), np.array([5, 6, 5, 6, 5, 7], np.uint64), np.array([3, 2, 1, 2, 3, 0]), np.arange(6)
    order, later = repeats.firsts(substring.RULE, doc, place, gram, near)
    assert sorted(order[later].tolist()) == [0, 4] and near[order].tolist() == sorted(near.tolist())


def test_join(docs, rows):
    same(jaccard.join_documents(docs, QUERY), brute_sets(rows))
    same(jaccard.join_documents(docs), brute_sets(rows, 5, 80))


def family(r, n, length=60, edits=4):
    """One text in many versions: few edits each, some of them shared, some versions far from the rest."""
    base, shared = [f"w{i}" for i in range(length)], [(r.randrange(length), f"s{i}") for i in range(6)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits if i % 7 else 3 * edits)):
            at, new = r.choice(shared) if r.random() < 0.6 else (r.randrange(length), f"x{r.randrange(10**6)}")
            w[at] = new
        out.append(" ".join(w[r.randint(0, 3) :]))
    return out


@pytest.mark.parametrize("join", [QUERY, jaccard.Join()])
def test_join_in_slices(spark, docs, rows, monkeypatch, join):
    """Families cut into slices, with few voters, pairs looked at a few at a time, and copies beside near copies."""
    monkeypatch.setattr(jaccard, "SLICE", 4)
    monkeypatch.setattr(jaccard, "VOTERS", 6)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    monkeypatch.setattr(jaccard, "TOGETHER", 30)
    same(jaccard.join_documents(docs, join), brute_sets(rows, join.n, join.percent))
    r = random.Random(5)
    texts = [*family(r, 70), *family(r, 60, 200, 12)]
    many = [(i, t) for i, t in enumerate([*texts, *texts[::5], *texts[::9]])]
    same(jaccard.join_documents(spark.createDataFrame(many, "doc_id bigint, text string").repartition(5), join), brute_sets(many, join.n, join.percent))


def test_join_of_large_groups(spark):
    """Very many copies of one text, and a family larger than a slice, next to unrelated texts."""
    r = random.Random(6)
    texts = [*family(r, 3000, 100, 3), *["the one text that is copied again and again"] * 20_000, *[f"unlike {i} text {i} here {i}" for i in range(500)]]
    r.shuffle(texts)
    got = {x.doc_id: x for x in jaccard.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6), QUERY).collect()}
    copies = [i for i, t in enumerate(texts) if t.startswith("the one")]
    assert {got[i].component_id for i in copies} == {copies[0]} and {got[i].n_links for i in copies} == {len(copies) - 1}
    near = [(i, t) for i, t in enumerate(texts) if t[0] in "wsx"]
    for i, _, component, links in brute_sets(near):
        assert (got[i].component_id, got[i].n_links) == (component, links)
    assert all(got[i].n_links == 0 for i, t in enumerate(texts) if t.startswith("unlike"))


def test_odd_tables(odd, empty):
    rows = [tuple(r)[:5] for r in odd.collect()]
    same(substring.dedup_substrings(odd), brute_bytes(rows))
    same(suffixtree.dedup_words(odd), brute_words(rows))
    same(jaccard.join_documents(odd, QUERY), brute_sets(rows))
    for f in (substring.dedup_substrings, suffixtree.dedup_words, jaccard.join_documents, jaccard.keep_one):
        assert f(empty).count() == 0


def test_keep_one(docs, rows):
    want = {i for i, _, c, _ in brute_sets(rows, 5, 80) if i == c}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 997}" for i in range(400_000))
    rows = [(1, text, None, None, 0), (2, text[1000:1200] + " end", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in suffixtree.dedup_words(docs).collect()}
    assert got[1].n_words == 400_000 and got[1].n_removed == 400_000 - 997 - 0 and got[2].n_removed >= 20
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs).collect()}[1] == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (150, 200), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == got[100] == 100
