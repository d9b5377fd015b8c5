import importlib
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "top_articles" in e.queries()


def test_nothing_outside_needs_the_subpackage():
    code = "import sys; sys.modules['millrace.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('p1_') for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False"], said.stderr
    for p in (REPO / "millrace").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "millrace.llm" not in p.read_text(encoding="utf8"), p


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_flagship(spark):
    e = importlib.import_module("__spark_entry__")
    got = e.entry(spark)
    assert got.columns == ["article_id", "title", "total"]
    assert 0 < got.count() <= 10
