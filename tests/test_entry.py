from __future__ import annotations

import importlib
import os
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40


def test_the_rest_stands_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("landgrid.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "landgrid.llm", None)
    try:
        again = importlib.reload(entry)
        assert not any(n.startswith("op") and n[2].isdigit() for n in again.queries()) and "hex_rollup" in again.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


NAMES = sorted(n for n in (entry._core.REGISTRY.sql if entry._core else {}))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_core_query_equals_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)

    def rows(df):
        cell = lambda v: "" if pd.isna(v) else repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)
