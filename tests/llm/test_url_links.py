"""Every canonical link and refresh of a page counts, relative targets too."""

import pytest

from bazaarlens.llm import urls


@pytest.fixture(scope="module")
def links(spark):
    page = "http://A.net/d/e/p.html?q=1#t"
    cases = {"page2.html": "http://a.net/d/e/page2.html", "../x": "http://a.net/d/x", "../../../x": "http://a.net/x",
             "?p=1": "http://a.net/d/e/p.html?p=1", "./y/./z?u=http://b.org/": "http://a.net/d/e/y/z?u=http://b.org/",
             "..": "http://a.net/d/", "/r/../s": "http://a.net/s", "//c.org/1": "http://c.org/1",
             "https://d.org/2": "https://d.org/2", "mailto:x@y": None, "#f": "http://A.net/d/e/p.html?q=1#f"}
    rows = [(page, t, w) for t, w in cases.items()] + [("http://a.net", "x", "http://a.net/x"), ("nothing", "x", None)]
    df = spark.createDataFrame(rows, "url string, target string, want string")
    return df.select("target", "want", urls.resolved(df["url"], df["target"]).alias("got")).collect()


def test_resolved(links):
    assert [r["got"] for r in links] == [r["want"] for r in links]


def test_later_and_relative_links_spread_a_block(spark):
    first, second = '<link rel="canonical" href="http://one.net/1">', '<link rel=canonical href="http://blocked.com/de/1">'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [(1, "http://a.net/1", first + second), (2, "http://b.net/1", refresh.format("http://b.net/2") + refresh.format("http://blocked.com/de/2")),
            (3, "http://c.net/d/1", '<link href="../other" rel="canonical">'), (4, "http://c.net/other", second),
            (5, "http://e.net/1", first.replace("one", "two")), (6, "http://f.net/1", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}
