"""Operators whose results SQL does not say, and edge cases of the others."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import correlate, decide, joins, privacy, rows, sql, state, transforms, windows

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def events(spark, data):
    return spark.createDataFrame([(u, at(h), i) for u, h, i in data], "user_id int, ts timestamp_ntz, event_id int")


# -- correlation --------------------------------------------------------------------
def test_await_outcomes(spark):
    first = events(spark, [(1, 0, 1), (1, 1, 2), (1, 10, 3), (2, 0, 4), (3, 0, 5)])
    second = events(spark, [(1, 2, 10), (1, 3, 11), (2, 30, 12), (4, 0, 13), (3, 0, 14)])
    got = sorted(((r.user_id, r.first_id, r.second_id, r.outcome) for r in correlate.await_match(first, second, ["user_id"], "ts", "event_id", "4 hours").collect()), key=repr)
    want = [(1, 1, None, "replaced"), (1, 2, 10, "matched"), (1, None, 11, "unmatched"), (1, 3, None, "timeout"), (2, 4, None, "timeout"), (2, None, 12, "unmatched"), (4, None, 13, "unmatched"), (3, 5, 14, "matched")]
    assert got == sorted(want, key=repr)


def loop_hold(data, hours, count):
    out, held = {}, {}
    for u, h, i in sorted(data, key=lambda x: (x[0], x[1], x[2])):
        number, since, size, done = held.get(u, (0, None, 0, True))
        if done or h > since + hours:
            number, since, size = number + 1, h, 0
        size += 1
        held[u] = (number, since, size, size >= count)
        out.setdefault((u, number), []).append(i)
    return {i: "complete" if len(v) >= count else "timeout" for v in out.values() for i in v}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 40)), min_size=1, max_size=25))
def test_hold_equals_a_loop(spark, data):
    data = [(u, h, i) for i, (u, h) in enumerate(data)]
    got = {r.event_id: r.outcome for r in correlate.hold_window(events(spark, data), ["user_id"], "ts", ["event_id"], "6 hours", 3).collect()}
    assert got == loop_hold(data, 6, 3)


def test_hold_ends_at_a_marker(spark):
    df = events(spark, [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 20, 5)])
    held = correlate.hold_window(df, ["user_id"], "ts", ["event_id"], "6 hours", 10, F.col("event_id") == 2)
    assert sorted((r.event_id, r.buffer, r.outcome) for r in held.collect()) == [(1, 1, "complete"), (2, 1, "complete"), (3, 2, "timeout"), (4, 2, "timeout"), (5, 3, "timeout")]


# -- decision tables -----------------------------------------------------------------
CELLS = {
    "any": (lambda: decide.anything, lambda v: True),
    "exact": (lambda: decide.exact(3), lambda v: v == 3),
    "null": (lambda: decide.exact(None), lambda v: v is None),
    "span": (lambda: decide.span(2, 5), lambda v: v is not None and 2 <= v <= 5),
    "in": (lambda: decide.one_of(1, 4), lambda v: v in (1, 4)),
    "not in": (lambda: decide.none_of(1, 4), lambda v: v not in (1, 4)),
    "less": (lambda: decide.less(3), lambda v: v is not None and v < 3),
    "unlike": (lambda: decide.unlike(3), lambda v: v != 3),
    "chain": (lambda: decide.chain(decide.more(4), ("or", decide.less(1)), ("and", decide.unlike(6))), lambda v: ((v is not None and v > 4) or (v is not None and v < 1)) and v != 6),
}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b"]), st.sampled_from(sorted(CELLS)), max_size=2), min_size=1, max_size=5))
def test_tables_equal_a_row_evaluator(spark, shape):
    values = [None, 0, 1, 2, 3, 4, 5, 6]
    data = [(a, b) for a in values for b in values]
    table = decide.DecisionTable([decide.Row({c: CELLS[k][0]() for c, k in r.items()}, {"n": F.lit(i)}, priority=i % 3) for i, r in enumerate(shape)], {"n": "int"})
    df = spark.createDataFrame(data, "a int, b int").coalesce(1)
    got = df.select("a", "b", table.first_match()["n"].alias("first"), F.transform(table.hits(), lambda h: h["n"]).alias("all"), table.single_hit()["n"].alias("single"), F.transform(table.by_priority(), lambda h: h["n"]).alias("ranked")).collect()
    for r in got:
        hits = [i for i, s in enumerate(shape) if all(CELLS[k][1](r[c]) for c, k in s.items())]
        assert r["first"] == (hits[0] if hits else None)
        assert r["all"] == hits
        assert r["single"] == (hits[0] if len(hits) == 1 else None)
        assert r["ranked"] == sorted(hits, key=lambda i: -(i % 3))


def test_strict_single_hit(spark):
    table = decide.DecisionTable([decide.Row({"a": decide.less(5)}, {"n": F.lit(1)}), decide.Row({"a": decide.less(3)}, {"n": F.lit(2)})], {"n": "int"})
    df = spark.createDataFrame([(4,)], "a int")
    assert df.select(table.single_hit(strict=True)["n"]).first()[0] == 1
    for bad in (1, 9):
        with pytest.raises(Exception, match="row"):
            spark.createDataFrame([(bad,)], "a int").select(table.single_hit(strict=True)["n"]).collect()
    with pytest.raises(ValueError):
        decide.DecisionTable([decide.Row({}, {"x": F.lit(1)})], {"n": "int"})


def test_nothing_runs_after_a_return(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "a int")
    out = decide.procedure(df, [decide.If([(F.col("a") > 3, [decide.Act("big"), decide.Return(), decide.Act("never")])], [decide.Set("b", F.lit(7))]), decide.Act("end")])
    got = {r.a: (r.b, r.actions) for r in out.collect()}
    assert got == {1: (7, ["end"]), 5: (None, ["big"]), None: (7, ["end"])}


# -- joins -----------------------------------------------------------------------------
def test_null_keys_never_match(spark):
    l = spark.createDataFrame([(None, at(0), 1), (1, at(0), 2)], "k int, lt timestamp_ntz, li int")
    r = spark.createDataFrame([(None, at(0), 1), (1, at(1), 2)], "k int, rt timestamp_ntz, ri int")
    assert [(x.li, x.ri) for x in joins.interval_join(l, r, ["k"], "lt", "rt", "1 hour", "1 hour").collect()] == [(2, 2)]  # the bound itself is in
    assert joins.interval_join(l, r, ["k"], "lt", "rt", "1 hour", "1 hour", "full").count() == 3


def test_as_of_ties_and_missing(spark):
    h = spark.createDataFrame([(1, at(1), 10), (1, at(1), 11), (1, at(5), 12)], "k int, eff timestamp_ntz, v int")
    q = spark.createDataFrame([(1, at(0), 1), (1, at(1), 2), (1, at(4), 3), (1, at(5), 4), (2, at(5), 5)], "k int, ts timestamp_ntz, i int")
    got = {r.i: r.v for r in joins.lookup_as_of(q, h, ["k"], "ts", "eff", ["v"]).collect()}
    assert got == {1: None, 2: 11, 3: 11, 4: 12, 5: None}


def test_null_keys_have_no_history(spark):
    h = spark.createDataFrame([(None, None, at(1), 10), (1, None, at(1), 11), (1, 2, at(1), 12)], "k int, m int, eff timestamp_ntz, v int")
    q = spark.createDataFrame([(None, None, at(2), 1), (1, None, at(2), 2), (1, 2, at(2), 3)], "k int, m int, ts timestamp_ntz, i int")
    assert {r.i: r.v for r in joins.lookup_as_of(q, h, ["k", "m"], "ts", "eff", ["v"]).collect()} == {1: None, 2: None, 3: 12}


def test_null_keys_await_nothing(spark):
    first, second = events(spark, [(None, 0, 1), (None, 1, 2), (1, 0, 3)]), events(spark, [(None, 2, 10), (1, 1, 11)])
    got = sorted(((r.user_id, r.first_id, r.second_id, r.outcome) for r in correlate.await_match(first, second, ["user_id"], "ts", "event_id", "4 hours").collect()), key=repr)
    assert got == sorted([(None, 1, None, "timeout"), (None, 2, None, "timeout"), (None, None, 10, "unmatched"), (1, 3, 11, "matched")], key=repr)


def test_actions_of_timeouts(spark):
    first, second = events(spark, [(1, 0, 1), (2, 0, 2)]), events(spark, [(1, 1, 10)])
    outcomes = correlate.await_match(first, second, ["user_id"], "ts", "event_id", "4 hours")
    for action, on, aside in (("emit", ["matched", "timeout"], []), ("dead_letter", ["matched"], [("timeout", "late")]), ("skip", ["matched"], [])):
        goes_on, goes_aside = correlate.on_timeout(outcomes, action, "late")
        assert sorted(r.outcome for r in goes_on.collect()) == on and [(r.outcome, r.reason) for r in goes_aside.collect()] == aside
    with pytest.raises(ValueError):
        correlate.on_timeout(outcomes, "nothing")


def test_late_rows_over_spans(spark):
    """Without keys, and with a key that has most of the rows: as one ordered pass would judge."""
    import random

    r = random.Random(3)
    data = [(i, at(i / 10 - (r.randint(0, 40) if r.random() < 0.3 else 0)), r.choice(["a", "a", "a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(data, "i int, ts timestamp_ntz, k string").repartition(3)
    for keys in ((), ("k",)):
        late, seen = set(), {}
        for i, ts, k in data:
            key = k if keys else 0
            if key in seen and ts < seen[key] - dt.timedelta(hours=5):
                late.add(i)
            seen[key] = max(seen.get(key, ts), ts)
        on_time, aside = windows.late_split(df, "ts", "i", "5 hours", keys, spans=7)
        assert {x.i for x in aside.collect()} == late and {x.i for x in on_time.collect()} == {x[0] for x in data} - late
        assert on_time.columns == df.columns


def test_first_values(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("a", None, 0), ("a", 2, 3), ("b", 5, 1), ("c", None, 1)], "k string, v int, o int")
    assert {r.k: r["values"] for r in windows.first_values(df, ["k"], F.col("v"), [F.col("o")], 2).collect()} == {"a": [3, 1], "b": [5]}
    assert {r.k: r.top for r in windows.top_values(df, ["k"], F.col("v"), 2).collect()} == {"a": [3, 2], "b": [5]}


def test_merge_into(spark):
    target = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, v int")
    source = spark.createDataFrame([(2, None, False), (3, 9, True), (4, 4, False), (5, 5, True)], "k int, v int, gone boolean")
    assert sorted((r.k, r.v) for r in joins.merge_into(target, source, "k", ["v"], F.col("gone")).collect()) == [(1, 1), (2, None), (4, 4)]


def test_sized(spark):
    assert "ResolvedHint" in joins.sized(spark.range(5))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in joins.sized(spark.range(50), 10)._jdf.queryExecution().analyzed().toString()


# -- rows --------------------------------------------------------------------------------
def test_guard(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "a int")
    check = [rows.Check(F.col("a") > 0, "not positive")]
    good, bad = rows.guard(df, check, rows.OnError())
    assert good.count() == 1 and bad.count() == 2
    assert rows.guard(df, check, rows.OnError("skip"))[1].count() == 0
    assert sorted(r.a for r in rows.guard(df, check, rows.OnError("default", {"a": F.lit(0)}))[0].collect()) == [0, 0, 1]
    with pytest.raises(Exception, match="not positive"):
        rows.guard(df, check, rows.OnError("raise"))[0].collect()


def test_routing_keeps_every_row(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "k string")
    outputs = rows.destinations(df, F.col("k"), ["a", "b"])
    assert {n: d.count() for n, d in outputs.items()} == {"a": 1, "b": 1, "default": 2}


def test_on_change_sees_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, 5), (1, 4, 5), (1, 5, None)], "k int, o int, v int")
    assert [r.changed for r in transforms.on_change(df, ["k"], ["o"], ["v"]).orderBy("o").collect()] == [True, False, True, False, True]


def test_checked_transform(spark):
    df = spark.createDataFrame([(1,), (50,), (-3,)], "a int")
    t = transforms.Transform({"b": F.col("a") * 3}, before=[rows.Check(F.col("a") > 0, "in")], after=[rows.Check(F.col("b") < 100, "out")])
    good, bad = t.checked(df)
    assert [r.b for r in good.collect()] == [3]
    assert sorted((r.a, r.errors) for r in bad.collect()) == [(-3, ["in"]), (50, ["out"])]


# -- state -----------------------------------------------------------------------------
def test_state_machine():
    with pytest.raises(ValueError):
        state.StateMachine("a", {"a": ["x"]}, states=["a", "b"])


def test_machine_edges(spark):
    m = state.StateMachine("new", {"new": ["open"], "open": ["closed"], "*": ["void"]}, states=["new", "open", "closed", "void"])
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["new", "open", None, "open", "void"])], "k int, o int, s string")
    assert [r.valid for r in m.check(df, ["k"], ["o"], "s").orderBy("o").collect()] == [True, True, False, False, True]
    assert [r.f for r in df.select("o", m.is_final(F.col("s")).alias("f")).orderBy("o").collect()] == [False, False, False, False, True]


def test_session_gap_is_inclusive(spark):
    df = events(spark, [(1, 0, 1), (1, 2, 2), (1, 5, 3)])
    got = sorted(r.n for r in windows.session(df, "ts", "2 hours", [F.count("*").alias("n")], ["user_id"]).collect())
    assert got == [1, 2]
    assert sorted((r.event_id, r.session) for r in windows.sessions(df, ["user_id"], "ts", "2 hours").collect()) == [(1, 0), (2, 0), (3, 1)]


def test_row_patterns(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("ABBBCABC")], "k int, o int, s string")
    found = sql.match_rows(df, ["k"], ["o"], {"A": F.col("s") == "A", "B": F.col("s") == "B", "C": F.col("s") == "C"}, "AB{2,}C")
    assert [(r.match_number, r.first_row, r.last_row, r.letters) for r in found.collect()] == [(1, 0, 4, "ABBBC")]


def test_encryption_round_trip(spark):
    df = spark.createDataFrame([("4111-1111",), (None,)], "v string")
    key = F.lit("0123456789abcdef")
    out = df.select("v", privacy.encrypt(F.col("v"), key).alias("e")).select("v", "e", privacy.decrypt(F.col("e"), key).alias("d")).collect()
    assert all(r.v == r.d for r in out) and out[0].e != out[0].v


def test_mask_by_name_either_way(spark):
    df = spark.createDataFrame([("x", "mail me: a.b@c.org", "plain", 5)], "email_address string, note string, name string, qty int")
    assert tuple(privacy.mask_records(df, ["email", "surname"]).first()) == ("***", "***", "***", 5)


def test_sql_leaves_no_view(spark):
    df = spark.range(3)
    assert sql.sql("SELECT SUM(id) AS s FROM numbers", numbers=df).first().s == 3
    assert not [t for t in spark.catalog.listTables() if t.name == "numbers"]
