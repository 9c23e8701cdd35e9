"""Queries over pages that the small tables lack: several pages at one URL, references cut off, code pages told by the language."""

from __future__ import annotations

import pytest

from tests.oracle import TABLES, connect, same_rows
from weftline import queries


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """The small tables, with these pages added."""
    folder = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        if name != "pages":
            (folder / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    page = "<!DOCTYPE html><html><head><title>T {0}</title></head><body><article><p>One {0} &amp; two &amp{1}</p></article></body></html>"
    rows = [(10_000, "http://a.example.com/x", page.format(1, ";")), (10_001, "http://a.example.com/x", page.format(2, ";")), (10_002, "http://a.example.com/y", page.format(2, ";"))]
    rows += [(10_003, "http://a.example.com/z", page.format(3, "")), (10_006, "http://a.example.com/z", page.format(4, ""))]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.unionByName(spark.createDataFrame(rows, pages.schema)).coalesce(1).write.parquet(str(folder / "written"))
    next((folder / "written").glob("*.parquet")).rename(folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["archive_fetch_faults", "corpus_documents", "html_content", "html_text"])
def test_same_as_duckdb_on_odd_pages(spark, odd_dir, name):
    same_rows(queries.queries()[name](spark, odd_dir), connect(odd_dir), queries.oracle_sql()[name])
