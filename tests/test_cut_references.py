"""Pages whose headings are cut off inside a reference, as titles of limited length are."""

from __future__ import annotations

import pytest

from tests.oracle import TABLES, connect, same_rows
from weftline import queries

#: What a cut leaves of references, and what stands after other signs.
ENDS = ("&quot;", "&quot", "&quo", "&q", "&amp;", "&amp", "&am", "&a", "&", "&lt", "&gt", "&copy", "&#39;", "&#39", "&#3", "&amp;quot", "&ampquot;", "&quotx", "&ampx", "&amp &quot", "a&b;&lt")


@pytest.fixture(scope="module")
def cut_dir(spark, sf_dir, tmp_path_factory):
    """The small tables, with a page for each of these ends."""
    folder = tmp_path_factory.mktemp("cut")
    for name in TABLES:
        if name != "pages":
            (folder / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    page = '<!DOCTYPE html><html lang="en"><head><title>Said he {0}</title></head><body><div class="ad">Buy {0}</div><article><h1>Said he {0}</h1><p>One &quot;{0}</p><p>{0}</p></article></body></html>'
    rows = [(10_000 + k, f"http://a.example.com/{k}", page.format(end)) for k, end in enumerate(ENDS)]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.unionByName(spark.createDataFrame(rows, pages.schema)).coalesce(1).write.parquet(str(folder / "written"))
    (folder / "pages.parquet").symlink_to(next((folder / "written").glob("*.parquet")))
    return str(folder)


def test_main_content_same_as_duckdb_on_cut_references(spark, cut_dir):
    same_rows(queries.queries()["html_main"](spark, cut_dir), connect(cut_dir), queries.oracle_sql()["html_main"])
