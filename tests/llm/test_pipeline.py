"""The pipeline's stages, one after another, each judged on its own input."""

import math
import re
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as cp
from test_documents import brute_spans
from test_near_duplicates import brute_kept
from tidewright.llm import classifier

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again."""
    out, docs = {"documents": spark.read.parquet(f"{FOLDER}/documents.parquet")}, None
    docs = out["documents"]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]
    for name in ("quality", "near_duplicates", "secrets", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def plain_score(model, text):
    """One document's score, term by term."""
    total = model[classifier.DIMENSIONS]
    for _, at, value in zip(*classifier.features(pa.array([text or ""]))):
        total += model[at] * value
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


def test_rejected_documents_go(spark, stages):
    docs = stages["documents"]
    model = classifier.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in docs.collect() if plain_score(model, r.text) >= 0.3}
    assert {r.doc_id for r in stages["quality"].collect()} == good and 100 < len(good) < docs.count()


def test_one_of_each_group_stays(stages):
    rows = sorted((r.doc_id, r.text) for r in stages["quality"].collect())
    kept, _ = brute_kept([(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows])
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == kept


def test_no_secret_is_left_and_nothing_else_changes(stages):
    before = {r.doc_id: r for r in stages["near_duplicates"].collect()}
    for r in stages["secrets"].collect():
        old, spans = before[r.doc_id], brute_spans(before[r.doc_id].text)
        want, done = [], 0
        for s, e in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",") if x):
            if s >= done:
                want += [old.text[done:s], "[secret]"]
            done = max(done, e)
        want = None if old.text is None else "".join([*want, old.text[done:]])
        if "ghp_" not in (old.text or "") and "npm_" not in (old.text or ""):
            assert r.asDict() == (old.asDict() | {"text": want, "n_chars": len(want)} if spans else old.asDict())
        assert not brute_spans(r.text)


def test_mixture_keeps_every_document(stages):
    assert {r.doc_id for r in stages["mixing"].collect()} == {r.doc_id for r in stages["secrets"].collect()}


def test_tokens_are_the_library_s(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages["mixing"].collect()}
    got = stages["tokens"].collect()
    assert len(got) == stages["mixing"].count()
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(repr, cp.run(spark, FOLDER).collect())) == sorted(map(repr, stages["tokens"].collect()))


OWN = ("mix_key", "mix_block", "mix_source", "mix_tokens", "mix_place", "epoch", "node", "label", "_node", "_label", "home", "score", "bucket", "ids", "part", "p", "Node")


@pytest.fixture(scope="module")
def clashing(spark):
    """Nulls in every column, empty, long and repeated texts, and columns that bear the operators' own names."""
    texts = ["some words that are here to be kept as they are", "", None, "word " * 20_000, "a b c d e f g h i j", "a b c d e f g h i j", "token=abcdefgh12345 and more words", " \n\t"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t), *range(i, i + len(OWN))) for i, t in enumerate(texts * 3)]
    rows += [rows[0], rows[6], (None, "a row without an id but with words", None, None, None, *[None] * len(OWN))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in OWN[:-1]) + ", more int")


def test_stages_on_clashing_tables(spark, clashing):
    empty = clashing.where("doc_id < -1")
    rest = [c for c in clashing.columns if c not in ("text", "n_chars")]
    rows = Counter(tuple(r[c] for c in rest) for r in clashing.collect())
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, clashing, FOLDER)
        assert out.columns == clashing.columns, name
        got = Counter(tuple(r[c] for c in rest) for r in out.collect())
        if name in ("quality", "near_duplicates"):
            assert all(n == rows[r] for r, n in got.items()), name  # all rows of a document, or none
        elif name == "secrets":
            assert got == rows
        else:
            assert set(got) == set(rows) and all(n >= rows[r] for r, n in got.items())
        assert stage(spark, empty, FOLDER).count() == 0 and stage(spark, empty, FOLDER).columns == clashing.columns
    kept = {r.doc_id for r in cp.near_duplicates(spark, clashing, FOLDER).collect()}
    words = {r.doc_id: " ".join((r.text or "").split()) for r in clashing.collect()}
    least = {}
    for i in sorted(i for i in words if i is not None):
        least.setdefault(words[i], i)
    assert kept == {i for i, w in words.items() if not w or i is None or least[w] == i}
    tokens = cp.tokens(spark, clashing, FOLDER)
    assert tokens.count() == clashing.count() and cp.tokens(spark, empty, FOLDER).count() == 0


def test_no_import_error_is_swallowed():
    text = open(cp.__file__).read()
    assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", text)
