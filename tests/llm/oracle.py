"""A query of motifgrid.llm held against its SQL, as DuckDB runs it on the same tables."""

import collections
import os

import duckdb

from motifgrid.llm import entry

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _value(x):
    return round(x, 9) if isinstance(x, float) else x


def assert_same(spark, sf_dir, name):
    own = entry.QUERIES[name](spark, sf_dir)
    with duckdb.connect() as db:
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.sql(entry.ORACLES[name])
        columns = sorted(want.columns)
        rows = want.project(", ".join(columns)).fetchall()
    assert sorted(own.columns) == columns
    found = collections.Counter(tuple(_value(x) for x in r) for r in own.select(columns).collect())
    assert found == collections.Counter(tuple(_value(x) for x in r) for r in rows)
    return sum(found.values())
