"""The driver contract, and the independence of the core."""

import importlib.util
import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert "p1_found" in queries
    if importlib.util.find_spec("quillspark.llm"):
        assert {"p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p9_found"} <= set(queries)


def test_core_does_not_import_the_subpackage():
    for path in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"quillspark[.]llm|from quillspark import llm", path.read_text(encoding="utf-8")), path


@pytest.mark.skipif(not os.path.exists(DATA), reason="test data not here")
def test_core_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillspark.plans import registry

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    queries, sql = registry.queries(), registry.oracle_sql()
    for name in sorted(sql):
        got = queries[name](spark, DATA)
        want = con.execute(sql[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns), name
        rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
        assert rows == sorted(map(repr, want.fetchall())), name


@pytest.mark.skipif(not os.path.exists(DATA), reason="test data not here")
def test_tasks_are_plans(spark):
    from quillspark import api

    for task in (api.citation_graph, api.match_notes, api.cited_by, api.reference_lists, api.converted_pages, api.clean_images, api.rename_files, api.remove_dois, api.archive, api.trash, api.resolve):
        plans = task(spark, DATA)
        assert plans and all(p.columns for p in plans.values())
