import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, odd characters, empty and long ones."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(150)] + ["Æther", "naïve,", "x;", "###", "$1"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = say(40), say(200)
    out = [say(r.randint(0, 120)) for _ in range(30)]
    out += [f"{say(20)} {passage}\n{say(10)}" for _ in range(6)]
    out += [base, base, base.upper()]
    for _ in range(12):
        w = base.split(" ")
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += ["", None, " \t\n", "one", "one two", "ONE two", "a b c", f"{passage} {passage}", "line one is here\n" * 30, say(6000), "日本語 😀 テキスト " * 20]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i * 3, t, ["en", "fr", None][i % 3], ["a", "a", "b", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, a null id, nulls in other columns, and columns whose names operators use themselves."""
    again = [*rows[:40], *rows[:5], (None, "a text without an id that has some words in it", None, None, None)]
    more = "bucket int, home int, epoch int, range int, shard int, key bigint, size bigint, score double, ahead int, mix_key bigint, label string"
    return make(spark, [(*x, 1, 2, 3, 4, 5, 6, 7, 0.5, 8, 9, "l") for x in again], f"{SCHEMA}, {more}")
