"""The distance verdict: planted outliers of each statistic go, clean texts stay."""

import numpy as np

from tidewright.llm import rules


def test_least_spreads_are_a_floor():
    least = np.array(list(rules.STATS.values()))
    wide = np.diag((2 * least) ** 2)
    assert np.allclose(rules._floored(wide)[0], np.linalg.inv(wide))
    assert np.allclose(rules._floored(np.zeros((6, 6)))[0], np.diag(1 / least**2))
    assert abs(rules._median(np.ones(6)) - 5.348) < 0.02
    sample = (np.random.default_rng(0).normal(size=(200_000, 6)) ** 2).sum(1)
    near = np.sort(sample)[:150_000]
    assert abs(near.sum() / len(near) / 6 - rules.consistency(0.75)) < 0.01


def test_planted_outliers_of_each_statistic(spark):
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(2000)]
    say = lambda n: [str(w) for w in r.choice(words, n)]
    clean = [" ".join(say(int(r.lognormal(5.7, 0.7)) + 12)) for _ in range(1000)]
    odd = {
        "x_len": " ".join(say(100_000)),
        "x_word": " ".join(w * 8 for w in say(300)),
        "x_sign": " ".join(w + "##" for w in say(300)),
        "x_lines": "\n".join(x for _ in range(40) for x in ("a", "b", "c", "d", " ".join(say(20)))),
        "x_upper": " ".join(say(300)).upper(),
    }
    texts = clean + list(odd.values())
    got = {x.doc_id: x for x in rules.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")).collect()}
    distances = {name: (got[1000 + k].base_failed, got[1000 + k].distance) for k, name in enumerate(odd)}
    assert all(not failed and d > rules.CUTOFF for failed, d in distances.values()), distances
    assert all(got[i].kept for i in range(1000) if not got[i].base_failed)


def plain_mcd(x):
    """Concentration steps on sorted rows from many starts, the least determinant, the median distance of normal variables."""
    r, n = np.random.default_rng(0), len(x)
    h, best = int(0.75 * n), None
    for k in range(40):
        some = r.choice(n, 12, replace=False)
        centre, scatter = (np.median(x, 0), np.diag(((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349) ** 2)) if not k else (x[some].mean(0), np.cov(x[some].T, bias=True))
        for _ in range(12):
            near = np.argsort(np.einsum("ij,jk,ik->i", x - centre, rules._floored(scatter)[0], x - centre))[:h]
            centre, scatter = x[near].mean(0), np.cov(x[near].T, bias=True) / rules.consistency(h / n)
        if best is None or rules._floored(scatter)[2] < best[0]:
            best = rules._floored(scatter)[2], centre, scatter
    _, centre, scatter = best
    distance = np.einsum("ij,jk,ik->i", x - centre, rules._floored(scatter)[0], x - centre)
    scatter = scatter * np.median(distance) / rules._median(rules._floored(scatter)[1])
    return np.einsum("ij,jk,ik->i", x - centre, rules._floored(scatter)[0], x - centre)


def test_distances_are_those_of_a_plain_estimate(spark):
    """Two languages, one with many sources of few rows: these borrow from their language."""
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(900):
        w = [str(x) for x in r.choice(words, int(r.lognormal(5.5, 0.9)) + 15)]
        if i % 10 == 3:
            w = [x + "#" * int(r.integers(3, 9)) for x in w]
        elif i % 10 == 4:
            w = [x.upper() * 3 for x in w]
        else:
            w = [x.title() if r.random() < 0.2 else x for x in w]
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", "s" if i % 2 else f"s{i % 18}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {x.doc_id: x for x in rules.judge(docs).collect()}
    vectors = {x.doc_id: [x[c] for c in rules.STATS] for x in rules.statistics(docs).collect()}
    for lang in ("en", "fr"):
        some = [i for i, _, of, _ in rows if of == lang and not got[i].base_failed]
        want = plain_mcd(np.array([vectors[i] for i in some]))
        have = np.array([got[i].distance for i in some])
        assert np.corrcoef(np.log1p(want), np.log1p(have))[0, 1] > 0.98
        assert [got[i].kept for i in some] == list(have <= rules.CUTOFF)
        clear = (want < 0.6 * rules.CUTOFF) | (want > 1.6 * rules.CUTOFF)
        assert ((have > rules.CUTOFF) == (want > rules.CUTOFF))[clear].all() and (want > 1.6 * rules.CUTOFF).sum() > 40


def test_a_group_of_nine_borrows(spark):
    r = np.random.default_rng(9)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(2000)]
    text = lambda: " ".join(str(w) for w in r.choice(words, 80))
    rows = [(i, text(), "en", "large") for i in range(200)] + [(1000 + i, text(), "en", "small") for i in range(8)] + [(2000, text().replace(" ", "### "), "en", "small"), (3000, text().replace(" ", "### "), None, None)]
    got = {x.doc_id: x.kept for x in rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert sorted(i for i, kept in got.items() if not kept) == [2000, 3000]
