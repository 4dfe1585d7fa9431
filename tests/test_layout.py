"""The training-data subpackage can be taken away: only the entry module knows of it."""

import pathlib
import re

HOME = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (HOME / "tidewright").rglob("*.py"):
        if "llm" not in path.relative_to(HOME).parts:
            assert not re.search(r"\btidewright\.llm\b|\bcorpus_pipeline\b", path.read_text()), path


def test_every_query_has_sql():
    from tidewright import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql())
