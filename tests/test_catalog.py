"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from lociflow.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) and math.isfinite(value) else str(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    found = db.execute(catalog.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = sorted(tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want
    assert want


@pytest.mark.parametrize("missing", ["lociflow.llm", "lociflow.llm.registry", "corpus_pipeline"])
def test_entry_imports_without_the_optional_folder(monkeypatch, missing):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("lociflow.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # importing it raises
    again = importlib.reload(entry)
    assert set(catalog.QUERIES) <= set(again.queries()) and "pipeline" not in again.queries()
    assert set(again.oracle_sql()) <= set(again.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_dedupe_prunes_before_its_shuffle(spark):
    plan = catalog.QUERIES["dedupe_first"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("=[min_by(") < plan.index("Exchange hashpartitioning(contig") < plan.index("=[partial_min_by(")
