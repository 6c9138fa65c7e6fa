import duckdb
import pytest

from tidemark.llm import url_filters as u
from tidemark.llm.scratch import Scratch

RULES = u.RULES


def rule_of(host, path):
    fits = [(len(h + p), len(h), a == "allow", h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    tail = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail


URLS = [
    "http://a.NET/", "http://a.net", "http://example.net/en/1", "https://x.example.net/en/", "http://example.net/de/", "http://Example.com/de/x?y#z", "http://xexample.com/de/", "http://a.example.org/fr/2",
    "http://org/fr/", "noscheme.net/x", None, "", "http://h.example/?q://net/", "http://alias.example/1#frag", "http://alias.example/1", "http://alias.example/2", "http://free.example/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string").selectExpr("*", "1 AS key", "2 AS host", "3 AS rule")
    none = spark.createDataFrame([], "src string, dst string")
    rows = {r.page_id: r for r in u.filter_urls(pages, none, u.rule_table(spark, RULES), Scratch(spark)).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = split(url)
        rule, action = rule_of(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, action or "allow"), url
    no_rules = u.filter_urls(pages, none, u.rule_table(spark, []), Scratch(spark)).collect()
    assert {r.verdict for r in no_rules} == {"allow"}
    assert u.filter_urls(pages.limit(0), none, u.rule_table(spark, RULES), Scratch(spark)).count() == 0


def test_blocks_reach_aliases_and_allow_wins(spark):
    edges = [("http://alias.example/1#x", "http://alias.example/2"), ("http://alias.example/2", "HTTP://A.net/"), ("http://p.example/", "http://a.net/q"), ("http://p.example/", "http://example.net/en/9"), ("http://free.example/", "http://other.example/")]
    urls = ["http://alias.example/1", "http://alias.example/2#f", "http://a.net/", "http://p.example/", "http://a.net/q", "http://free.example/", "http://alias.example/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    out = u.filter_urls(pages, spark.createDataFrame(edges, "src string, dst string"), u.rule_table(spark, RULES), Scratch(spark))
    assert [r.verdict for r in out.orderBy("page_id").collect()] == ["block", "block", "block", "allow", "block", "allow", "block"]


@pytest.mark.parametrize("link,want", [("/x?a=1&amp;b=2", "http://H.example/x?a=1&b=2"), ("//o.example/p", "http://o.example/p"), ("https://o.example/", "https://o.example/"), ("y.html", "http://H.example/d/y.html")])
def test_links_of_pages(spark, link, want):
    page = f"<head><LINK href='{link}' rel=\"canonical\"></head>"
    refresh = f"<meta http-equiv='refresh' content='0; URL={link}'>"
    pages = spark.createDataFrame([("http://H.example/d/e?f", page), ("http://H.example/d/e", refresh), ("http://H.example/", "<p>canonical"), (None, page), ("x", None)], "url string, html string")
    assert {(r.src, r.dst) for r in u.link_edges(pages).collect()} == {("http://H.example/d/e?f", want), ("http://H.example/d/e", want)}


def test_query_equals_its_sql(spark, tmp_path):
    data = [(i, url, "") for i, url in enumerate(URLS)]
    data += [(100, "http://c1.example/a", "<link rel=canonical href='http://a.net/z'>"), (101, "http://c2.example/a", "<link rel='canonical' href='http://c1.example/a'>"), (101, "http://c2.example/a", None), (None, "http://c3.example/", '<meta http-equiv="refresh" content="3;url=/k">'), (102, "http://c3.example/k", "<link href=http://example.net/en/5 rel=canonical>")]
    data += [(103, "http://d1.example", "<link rel=canonical href='/1'><link rel='canonical' href='../../x/./y/..'><meta http-equiv=refresh content='0;url=?q=4'>")]
    data += [(104, "http://d1.example/x/", ""), (105, "http://d1.example/1", "<link rel=canonical href='http:&#47;&#x2f;A.net&sol;'>"), (106, "http://d1.example/?q=4", None), (107, "HTTP://D1.example/", None)]
    data += [(108, "http://d2.example/a", "<link rel=canonical href='mailto:x@a.net'><link rel=canonical href='#f'><link rel=canonical href='//A.NET/b/../c'>"), (109, "http://d2.example?z", "<link rel=canonical href='/r?u=http://a.net/'>")]
    spark.createDataFrame(data, "page_id int, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(repr, (tuple(r) for r in u.op6_url_filters(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(map(repr, con.sql(u.ORACLE_SQL).fetchall()))
    verdicts = {r.page_id: r.verdict for r in u.op6_url_filters(spark, str(tmp_path)).collect()}
    assert all(verdicts[k] == "block" for k in (103, 104, 105, 106, 107, 108)) and verdicts[109] == "allow"


@pytest.mark.parametrize(
    "base,link,want",
    [
        ("http://h.example/d/e?f", "?p=2", "http://h.example/d/e?p=2"),
        ("http://h.example/d/e?f", "#x", "http://h.example/d/e?f#x"),
        ("http://h.example/a/b/c", "../x", "http://h.example/a/x"),
        ("http://h.example/a/b/c", "./x?y=../z", "http://h.example/a/b/x?y=../z"),
        ("http://h.example/a/b/c", "../../../x/.", "http://h.example/x/"),
        ("http://h.example/a/b/c", "..", "http://h.example/a/"),
        ("http://h.example/a", "/b/../c#d/../e", "http://h.example/c#d/../e"),
        ("http://h.example/a", "http://o.example/b/./c", "http://o.example/b/c"),
        ("http://h.example/a", "//o.example/b/../c", "http://o.example/c"),
        ("http://h.example/a", "/r?u=http://o.example/", "http://h.example/r?u=http://o.example/"),
        ("http://h.example", "x", "http://h.example/x"),
        ("http://h.example/a", "mailto:a@o.example", None),
    ],
)
def test_links_are_resolved_by_rfc_3986(spark, base, link, want):
    pages = spark.createDataFrame([(base, f"<link rel=canonical href='{link}'>")], "url string, html string")
    assert [r.dst for r in u.link_edges(pages).collect()] == ([want] if want else [])


def test_every_tag_of_a_page_gives_an_edge(spark, tmp_path):
    html = (
        "<link rel=canonical><link rel=canonical href='/1'><link rel='canonical' href='http://b.example/2'>"
        "<meta http-equiv=refresh content=5><meta http-equiv=refresh content='0;url=../3'><meta http-equiv='refresh' content='0; url=?q=4'>"
    )
    pages = spark.createDataFrame([("http://a.example/x/y", html)], "url string, html string")
    assert sorted(r.dst for r in u.link_edges(pages).collect()) == ["http://a.example/1", "http://a.example/3", "http://a.example/x/y?q=4", "http://b.example/2"]
    data = [(0, "http://a.example/x/y", html), (1, "http://b.example/2", "<link rel=canonical href='/2'><link rel=canonical href='http://a.net/z'>"), (2, "http://a.example/3", "")]
    spark.createDataFrame(data, "page_id int, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.verdict for r in u.op6_url_filters(spark, str(tmp_path)).collect()} == {0: "block", 1: "block", 2: "block"}
