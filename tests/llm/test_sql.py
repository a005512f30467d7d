"""Queries against their SQL, over the small tables and over planted rows."""

from __future__ import annotations

import pytest
from oracle import connect, spark_rows, sql_rows
from wardlens.llm.queries import ORACLES, QUERIES


def same(spark, name, folder):
    names, ours = spark_rows(QUERIES[name](spark, folder))
    columns, theirs = sql_rows(connect(folder), ORACLES[name])
    assert names == columns and ours == theirs


@pytest.mark.parametrize("name", list(ORACLES))
def test_small_tables(spark, name):
    same(spark, name, "/root/testdata/sf0.001")


def test_planted_links(spark, tmp_path):
    link = '<html><head><link rel="canonical" href="%s"></head><body>x</body></html>'
    pages = [
        (1, "http://a.example.org/1", link % "http://b.example.com/de/2"), (2, "http://b.example.com/de/2", "<p>x"),
        (3, "http://c.de/3#top", '<meta http-equiv="refresh" content="0; url=http://a.example.org/1">'),
        (4, "http://d.de/4", link % "https://x.net/"), (5, "http://d.de/5", link % "http://d.de/4"),
        (6, "http://e.org/fr/6", link % "http://d.de/4"), (7, "http://f.de/7", "<!-- " + link % "https://x.net/" + " -->"),
        (8, None, link % "https://x.net/"), (9, "no address", None), (10, "HTTP://D.DE:80/4", ""), (11, "http://d.de/4", None),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/w")
    (only,) = (tmp_path / "w").glob("part-*.parquet")
    only.rename(tmp_path / "pages.parquet")
    same(spark, "op13_redirects", str(tmp_path))
    found = {r.page_id: r.verdict for r in QUERIES["op13_redirects"](spark, str(tmp_path)).collect()}
    # an allowed page (6) and a blocked one (x.net) share a component: what no rule names in it is allowed
    assert found == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow",
                     9: "allow", 10: "allow", 11: "allow"}
