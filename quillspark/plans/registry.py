"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import graph, linkage, orphans, refs, texts, vault
from quillspark.plans import graph_sql, linkage_sql, pointer_sql, refs_sql, texts_sql, vault_sql
from quillspark.streaming import inbox


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": orphans.p1_found, "p1_report": orphans.p1_report, **graph.QUERIES, **linkage.QUERIES, **refs.QUERIES, **texts.QUERIES, **vault.QUERIES, **inbox.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**pointer_sql.SQL, **graph_sql.SQL, **linkage_sql.SQL, **refs_sql.SQL, **texts_sql.SQL, **vault_sql.SQL, **inbox.SQL}
