"""Every registered query against DuckDB, and the rest for running at all."""

from __future__ import annotations

import pytest

from tests.oracle import connect, same_rows
from weftline import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_duckdb(spark, sf_dir, con, name):
    same_rows(queries.queries()[name](spark, sf_dir), con, queries.oracle_sql()[name])


def test_html_extract(spark, sf_dir):
    """The only query without SQL: its fields equal those that have it, and its markdown holds all words of the text."""
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"html_extract"}
    made = {r["page_id"]: r for r in queries.queries()["html_extract"](spark, sf_dir).collect()}
    known = {r["page_id"]: r for r in queries.queries()["html_text"](spark, sf_dir).collect()}
    assert made.keys() == known.keys()
    for key, row in made.items():
        assert all(row[c] == known[key][c] for c in ("title", "text", "links"))
        marked = "".join(row["markdown"].split())
        assert all(w in marked for w in row["text"].split() if w.isalpha())
