"""The pipeline's stage of near copies: five words, four fifths, against brute force."""

import random
import tracemalloc

import numpy as np

import corpus_pipeline as cp
from tidewright.llm import jaccard
from tidewright.llm.components import components

SCHEMA = "doc_id bigint, text string"


def brute_kept(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                linked.append((both, len(sets[a] | sets[b])))
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {rows[k][0] for k in range(len(rows)) if find(k) == k}, linked


def near_rows():
    r = random.Random(3)
    rows, word = [], iter(range(10**9))
    for length in [*range(1, 40), 60, 100, 100, 150, 300, 700]:
        base = [f"w{next(word)}" for _ in range(length)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(4):
            w = list(base)
            for _ in range(r.randint(0, max(1, length // 40))):
                w[r.randrange(length)] = f"w{next(word)}"
            w = w[r.randint(0, length // 12) :]
            rows.append((len(rows), " ".join(w)))
    return rows


def test_two_replaced_words_of_a_hundred(spark):
    base = [f"w{i}" for i in range(100)]
    other = ["x" if i == 30 else "y" if i == 60 else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], SCHEMA)
    assert [r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()] == [1]


def test_stage_is_brute_force(spark):
    rows = near_rows()
    kept, linked = brute_kept(rows)
    assert sum(80 * union <= 100 * both < 90 * union for both, union in linked) > 20
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(kept)


def test_unrelated_sets_do_not_meet():
    r = np.random.default_rng(5)
    size = np.concatenate([r.integers(1, 60, 2000), r.integers(60, 2000, 200)])
    token, off = r.integers(0, 1 << 63, int(size.sum())).astype(np.uint64), np.concatenate([[0], np.cumsum(size)])
    for join in (jaccard.Join(3, 90), cp.NEAR):
        who, key = jaccard.set_parts(join, token, off)
        _, at = np.unique(key, return_index=True)
        assert len(at) == len(key)
        assert len(np.unique(who)) == len(size)


def test_linked_sets_meet_whatever_the_cut(monkeypatch):
    """Also where the first cuts leave all the sets open."""
    r = np.random.default_rng(6)
    for cuts in (jaccard.CUTS, jaccard.CUTS[:1], jaccard.CUTS[:2]):
        monkeypatch.setattr(jaccard, "CUTS", cuts)
        for size in [*range(1, 60), 100, 300]:
            for _ in range(5):
                a = r.integers(0, 1 << 63, size).astype(np.uint64)
                gone = int(r.integers(0, size // 5 + 1))
                b = a[gone:]
                new = r.integers(0, 1 << 63, size).astype(np.uint64)[: max(0, (len(b) * 100 // 80) - size)]
                b = np.concatenate([b, new])
                both = len(np.intersect1d(a, b))
                if 100 * both < 80 * (len(a) + len(b) - both):
                    continue
                token, off = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, size, size + len(b)])
                who, key = jaccard.set_parts(cp.NEAR, token, off)
                assert np.intersect1d(key[who == 0], key[who == 1]).size


def test_frequent_elements_are_left_out_where_enough_parts_are_left():
    """Linked sets meet also if half of their elements, or all, are frequent."""
    r = np.random.default_rng(7)
    frequent = np.sort(r.integers(0, 1 << 63, 300).astype(np.uint64))
    for size, many in [(60, 0), (60, 10), (60, 30), (60, 60), (300, 150), (300, 300), (8, 8), (100, 70)]:
        for _ in range(10):
            own = r.integers(0, 1 << 63, size - many).astype(np.uint64)
            a = np.concatenate([own, r.choice(frequent, many, replace=False)])
            r.shuffle(a)
            b = a[size // 6 :]
            token, off = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, size, size + len(b)])
            who, key = jaccard.set_parts(cp.NEAR, token, off, frequent)
            assert np.intersect1d(key[who == 0], key[who == 1]).size


def test_sketches_never_tell_more_than_the_sets_differ():
    r = np.random.default_rng(8)
    for size in (1, 5, 31, 33, 64, 200, 1000):
        for gone in (0, size // 10, size // 2):
            a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
            b = np.concatenate([a[gone:], r.integers(0, 1 << 63, size // 20).astype(np.uint64)])
            words, off = jaccard.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            x, y = words[: off[1]].tobytes(), words[off[1] :].tobytes()
            apart = len(np.setxor1d(a, b))
            assert jaccard.sketch_distance(x, y) <= apart and jaccard.sketch_distance(y, x) <= apart
            if size >= 200 and gone == size // 2:
                assert jaccard.sketch_distance(x, y) > 0.5 * apart


def test_short_and_long_lists(spark, monkeypatch):
    """Pairs of short lists go by their sketches, long lists as before; frequent elements by any threshold."""
    rows = near_rows()
    kept, _ = brute_kept(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for short, one_of in ((2, 1000), (24, 50), (0, 10**6)):
        monkeypatch.setattr(jaccard, "SHORT", short)
        monkeypatch.setattr(jaccard, "ONE_OF", one_of)
        assert sorted(r.doc_id for r in jaccard.keep_one(docs, cp.NEAR).collect()) == sorted(kept)


def drawn_sets(n, size):
    r = np.random.default_rng(9)
    off = np.concatenate([[0], np.cumsum(r.integers(1, 2 * size, n))])
    return r.integers(0, 1 << 63, int(off[-1])).astype(np.uint64), off


def test_a_worker_needs_little_beside_its_sets():
    """Parts and sketches of a million elements take working arrays for a portion of them only."""
    token, off = drawn_sets(4000, 250)
    for step in (lambda: jaccard.set_parts(jaccard.Join(3, 90), token, off), lambda: jaccard.sketches(token, off)):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6


def test_portions_change_nothing(monkeypatch):
    token, off = drawn_sets(300, 40)
    told = []
    for portion in (1, 1000, 1 << 40):
        monkeypatch.setattr(jaccard, "PORTION", portion)
        who, key = jaccard.set_parts(jaccard.Join(3, 90), token, off)
        told.append((np.stack([who.astype(np.uint64), key])[:, np.lexsort((key, who))], *jaccard.sketches(token, off)))
    assert all(np.array_equal(x, y) for t in told[1:] for x, y in zip(t, told[0]))


def test_families_by_any_portion(spark, monkeypatch):
    rows = near_rows()
    kept, _ = brute_kept(rows)
    monkeypatch.setattr(jaccard, "PORTION", jaccard.TOGETHER)
    monkeypatch.setattr(jaccard, "SLICE", 3)
    assert sorted(r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3), cp.NEAR).collect()) == sorted(kept)


def test_components_take_few_jobs(spark):
    """Each job costs its tasks in every executor, however few the edges are; a frequent node is one of them."""
    edges = [(i, 0) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1006)] + [(5000 + i, 300) for i in range(50)]
    spark.sparkContext.setJobGroup("components", "components")
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert set(got.values()) == {0, 1000} and len(got) == 457
    assert jobs <= 20
