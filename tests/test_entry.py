"""Registered queries against their SQL, and the package without the training-data operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from glyphline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf_dir).toPandas()
    if name not in plans.SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(plans.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(pd.notna(d[cols]), None).values.tolist()))
    assert rows(got) == rows(want)


def test_rest_stands_alone():
    code = "import sys; sys.modules['glyphline.llm'] = None\nimport glyphline.plans.queries, glyphline.functions.catalog as c; c.modules(); assert not [m for m in sys.modules if m.startswith('glyphline.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
