"""Mixing and sharding: laws that every result must keep."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewright.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return max(1, len(WORD.findall(text or "")))


def plain_exponent(totals, good):
    """Bisection in a loop: the greatest exponent (entropy) or least one (repetition) that is good."""
    low, high = 0.0, 1.0
    for _ in range(mixing.STEPS * mixing.ROUNDS):
        middle = (low + high) / 2
        up = good(middle)
        low, high = (middle, high) if up else (low, middle)
    return low, high


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 40)), "big" if i % 3 else f"s{i % 15}") for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


@pytest.mark.parametrize("target", [mixing.Target(repetition=2.0), mixing.Target(repetition=1.3), mixing.Target(repetition=None, entropy=0.9), mixing.Target(repetition=None, entropy=0.97, budget=9000)])
def test_mixture(skewed, target):
    rows, docs = skewed
    totals = Counter()
    for _, t, s in rows:
        totals[s] += tokens(t)
    whole = sum(totals.values())
    share = {s: n / whole for s, n in totals.items()}

    def weights(t):
        z = sum(p**t for p in share.values())
        return {s: p**t / z for s, p in share.items()}

    def repeats(t):
        w = weights(t)
        budget = target.budget or max(totals[s] / w[s] for s in w)
        return {s: w[s] * budget / totals[s] for s in w}

    if target.entropy is not None:
        t = plain_exponent(totals, lambda x: -sum(w * math.log(w) for w in weights(x).values()) >= target.entropy * math.log(len(totals)))[0]
    else:
        t = plain_exponent(totals, lambda x: max(repeats(x).values()) > target.repetition)[1]
    got = mixing.mix_documents(docs, target).collect()
    want, size, spent = repeats(t), {i: tokens(x) for i, x, _ in rows}, Counter()
    epochs = defaultdict(Counter)
    for r in got:
        assert abs(r.mix_weight - weights(t)[r.source]) < 1e-6
        spent[r.source] += size[r.doc_id]
        epochs[r.source][r.epoch] += 1
        assert 0 <= r.mix_place < want[r.source] + 1e-6
    for s, e in want.items():
        assert abs(spent[s] - e * totals[s]) <= 45  # one document more at most
        for k in range(int(e + 1e-6)):  # whole epochs have every document once
            assert epochs[s][k] == sum(x[2] == s for x in rows)
    if target.budget is None:
        assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_mixture_of_odd_tables(odd, empty):
    assert mixing.mix_documents(empty).count() == 0
    got = mixing.mix_documents(odd)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in odd.collect()}
    epoch, weight, place = mixing.added(odd.columns)
    assert (epoch, weight, place) == ("epoch_", "mix_weight", "mix_place") and got.columns == [*odd.columns, epoch, weight, place]
    assert got.where(f"{epoch} = 0").count() == odd.count() and {r.epoch for r in got.collect()} == {r.epoch for r in odd.collect()}


def check_shards(rows, got, shards=8):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for s in by:
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r.size for r in by[s]) - total / shards) <= most


def test_shards(docs, rows):
    check_shards(rows, sharding.shard_documents(docs).collect())


def test_copies_and_overfull_ranges(spark, monkeypatch):
    rows = [(i, "the same text for very many" if i % 2 else f"text {i} " * (i % 7)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    check_shards(rows, sharding.shard_documents(docs).collect())
    monkeypatch.setattr(sharding, "SAMPLED", 1)  # a poor sample leaves overfull ranges
    monkeypatch.setattr(sharding, "LEAST_RANGES", 8)
    check_shards(rows, sharding.shard_documents(docs).collect())


def test_draws_follow_sizes(spark):
    """Twenty large records among thousands of small ones: ranges are alike in bytes."""
    rows = [(i, "x" * 20_000 if i % 200 == 7 else f"text {i}") for i in range(4000)]
    records = sharding.sized(spark.createDataFrame(rows, "doc_id bigint, text string"))
    total = sum(len(t) + 1 for _, t in rows)
    bounds = sharding.splitters(records, total, 64)
    sizes = Counter()
    for r in records.collect():
        sizes[sum(b <= r.key for b in bounds)] += r["size"] * r.copies
    assert max(sizes.values()) <= 20_001 + 2 * total / 64


def test_many_rows_of_one_record(spark, monkeypatch):
    monkeypatch.setattr(sharding, "AT_ONCE", 100)
    rows = [(5, "the very same row")] * 2500 + [(None, "no id")] * 700 + [(i, f"text {i}") for i in range(300)]
    check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect())


def test_shards_of_odd_tables(odd, empty):
    assert sharding.shard_documents(empty).count() == 0
    check_shards([tuple(r)[:2] for r in odd.collect()], sharding.shard_documents(odd).collect())
