"""Every registered query with SQL against DuckDB; the others must run and keep their schema."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans.all import QUERIES, SQL
from tests.conftest import DATA


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return int(v) if float(v).is_integer() else float(v)
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return sorted(repr([plain(v) for v in r]) for r in frame[names].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), oracle.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_are_tested_elsewhere():
    """Each is compared with plain Python, or with what must hold, in the named file."""
    places = {"test_chunks.py": {"txt_sections", "txt_section_stats", "txt_section_at", "txt_footnotes", "txt_chunks", "txt_page_chunks"}, "test_evaluation.py": {"stat_bootstrap", "stat_paired_tests", "topics_approx"}, "test_tokens.py": {"txt_token_chunks"}, "test_html.py": {"html_page_blocks", "html_page_fields"}, "test_density.py": {"vec_knn_cells", "topics_density"}}
    assert set(QUERIES) - set(SQL) == set().union(*places.values())


def test_entry_works_without_the_corpus_package(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("tessera.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(QUERIES)
    assert entry.entry(spark).count() > 0
