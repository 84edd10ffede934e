"""Compares a query with its SQL on the same tables."""

import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compare(spark, query, sql):
    db = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    held = db.execute(sql)
    names = [d[0] for d in held.description]
    made = query(spark, FOLDER)
    assert sorted(made.columns) == sorted(names)
    order = sorted(names)
    want = sorted(repr([r[names.index(c)] for c in order]) for r in held.fetchall())
    assert sorted(repr([r[c] for c in order]) for r in made.collect()) == want
