"""Writing results: notes as files, lookup tables, and plans carried out."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def rendered(fm: pd.Series, body: pd.Series) -> pd.Series:
    """A note's text: its front matter (JSON) as YAML in the given order, characters as they are, then its body; the body
    alone if there is none."""
    try:
        import yaml
    except ImportError:
        yaml = None

    def one(f, b):
        value = json.loads(f) if f else {}
        if not value:
            return b or ""
        block = yaml.safe_dump(value, allow_unicode=True, sort_keys=False) if yaml else "".join(f"{k}: {v}\n" for k, v in value.items())
        return f"---\n{block}---\n{b or ''}"

    return pd.Series([one(f, b) for f, b in zip(fm, body)])


def write_notes(notes: DataFrame, root: str) -> int:
    """Notes (path_parts, fm, body) as files below a new folder that all executors share; returns how many. The notes read
    are never changed: a task that is run again writes the same file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for parts, text in zip(batch["path_parts"], batch["text"]):
                path = os.path.join(root, *parts)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path + ".part", "w", encoding="utf-8", newline="\n") as file:
                    file.write(text)
                os.replace(path + ".part", path)
            yield pd.DataFrame({"n": [len(batch)]})

    rows = notes.select("path_parts", rendered("fm", "body").alias("text"))
    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def save_lookup(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def carried_out(plan: DataFrame) -> DataFrame:
    """Copies of a plan (source, target) made in a folder that all executors share, with a status per row: ``not found``,
    ``exists``, ``copied``. Copies, no links: what is changed in a copy must not change its source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status = []
            for source, target in zip(batch["source"], batch["target"]):
                if not os.path.exists(source):
                    status.append("not found")
                elif os.path.exists(target):
                    status.append("exists")
                else:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    shutil.copy2(source, target + ".part")
                    os.replace(target + ".part", target)
                    status.append("copied")
            yield pd.DataFrame({"source": batch["source"], "target": batch["target"], "status": status})

    return plan.select("source", "target").mapInPandas(run, "source string, target string, status string")
