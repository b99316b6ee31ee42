import re

import duckdb

from placebook.llm.components import components
from placebook.llm.oracles import OP3
from placebook.llm.redirect_equivalence import RULES, judged
from tests.llm.cases import collected

CANONICAL = "<html><head><link href='{}' rel=canonical></head>"
REFRESH = '<meta content="0; URL={}" http-equiv="Refresh">'


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(url):
    host, path = parts(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, node string")


def test_rules_alone_over_the_whole_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = []
    for r in table.collect():
        rule = rule_of(r.url)
        want.append((r.page_id, *parts(r.url), rule.host + rule.path if rule else "-", rule.verdict if rule else "allow"))
    out = judged(table, str(tmp_path)).fillna("-", ["rule"])
    assert collected(out, "page_id", "host", "path", "rule", "verdict") == sorted(want)


def test_awkward_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "x://EXAMPLE.com", "HTTP://www.Example.COM/en/a?b=/c#d", "a://b://net/es/",
            "http://net/es/x", "http://xnet/es/x", "https://É.net/fr/\nq", "http://h?x://net/es/", "://net/fr/"]
    out = {r.page_id: r for r in judged(pages(spark, [(i, u, None) for i, u in enumerate(urls)]), str(tmp_path)).collect()}
    for i, url in enumerate(urls):
        rule = rule_of(url)
        assert (out[i].host, out[i].path) == parts(url), url
        assert (out[i].rule, out[i].verdict) == ((rule.host + rule.path, rule.verdict) if rule else (None, "allow")), url


def test_decisions_reach_aliases(spark, tmp_path):
    rows = [
        (1, "http://a.org/1", CANONICAL.format("http://b.net/es/1")),  # a blocked target
        (2, "http://c.org/2", REFRESH.format("http://a.org/1#frag")),  # an alias of an alias
        (3, "http://d.org/3", CANONICAL.format("/x")),
        (4, "http://d.org/x", CANONICAL.format("//e.net/fr/")),  # relative links
        (5, "http://f.org/", CANONICAL.format("http://g.com/") + REFRESH.format("http://h.net/es/")),  # allow goes first
        (6, "http://h.net/es/", None),  # its own rule stands
        (7, "http://lone.org/", "<link rel=stylesheet href='http://b.net/es/1'>"),
        (1, "http://a.org/1", CANONICAL.format("http://b.net/es/1")),
        (8, None, CANONICAL.format("http://b.net/es/1")),
    ]
    moved = spark.createDataFrame([("http://r.org/", "http://b.net/es/1"), (None, "http://b.net/es/1")], "a string, b string")
    rows.append((9, "HTTP://R.org/", None))
    out = judged(pages(spark, rows), str(tmp_path), redirects=moved)
    assert collected(out, "page_id", "verdict") == sorted(
        [(1, "block"), (1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "allow"), (6, "block"), (7, "allow"), (8, "allow"), (9, "block")]
    )


def test_no_pages(spark, tmp_path):
    assert judged(pages(spark, []), str(tmp_path)).count() == 0


def test_components_of_chains_hubs_and_loops(spark, tmp_path):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (210, 211), (211, 210), (210, 211)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect())
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {210: 210, 211: 210}
    assert got == want


def test_every_tag_of_a_page_counts(spark, tmp_path):
    lone, blocked, allowed = "http://lone.org/x", "http://b.net/es/1", "http://g.com/"
    link = "<link rel={} href='{}'>"
    html = [
        link.format("canonical", lone) + link.format("canonical", blocked),
        REFRESH.format(lone) + REFRESH.format(blocked),
        CANONICAL.format(lone) + REFRESH.format(blocked) + CANONICAL.format(allowed),  # allow goes first
        link.format('"alternate canonical"', blocked),
        link.format("' Canonical alternate'", blocked),
        f"<LINK href={blocked} rel=canonical>",
        f"<link rel=canonical href={blocked}",
        link.format('"alternate"', blocked),
        link.format('"non-canonical canonical-x"', blocked),
        f"<link rel=canonical><link href={blocked}>",
    ]
    want = ["block", "block", "allow", "block", "block", "block", "block", "allow", "allow", "allow"]
    html = [text.replace("lone", f"lone{i}") for i, text in enumerate(html)]
    rows = [(i, f"http://a{i}.org/", text) for i, text in enumerate(html)] + [(99, "http://none.org/", None)]
    # No two pages share a blocked or allowed target, so that each verdict comes from its own tags.
    rows = [(i, url, text and text.replace("b.net", f"b{i}.net").replace("g.com", f"g{i}.com")) for i, url, text in rows]
    got = collected(judged(pages(spark, rows), str(tmp_path)), "page_id", "verdict")
    assert got == [*enumerate(want), (99, "allow")]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted((r[0], r[1]) for r in duck.sql(f"SELECT page_id, verdict FROM ({OP3})").fetchall()) == got


#: (base, link, target): RFC 3986, section 5.4, and what pages hold besides.
RESOLVED = [
    ("http://a.net/b/c/d;p?q", "g", "http://a.net/b/c/g"),
    ("http://a.net/b/c/d;p?q", "./g", "http://a.net/b/c/g"),
    ("http://a.net/b/c/d;p?q", "g/", "http://a.net/b/c/g/"),
    ("http://a.net/b/c/d;p?q", "/g", "http://a.net/g"),
    ("http://a.net/b/c/d;p?q", "//g", "http://g/"),
    ("http://a.net/b/c/d;p?q", "?y", "http://a.net/b/c/d;p?y"),
    ("http://a.net/b/c/d;p?q", "#s", "http://a.net/b/c/d;p?q"),
    ("http://a.net/b/c/d;p?q", ".", "http://a.net/b/c/"),
    ("http://a.net/b/c/d;p?q", "..", "http://a.net/b/"),
    ("http://a.net/b/c/d;p?q", "../g", "http://a.net/b/g"),
    ("http://a.net/b/c/d;p?q", "../..", "http://a.net/"),
    ("http://a.net/b/c/d;p?q", "../../../g", "http://a.net/g"),
    ("http://a.net/b/c/d;p?q", "/./g", "http://a.net/g"),
    ("http://a.net/b/c/d;p?q", "g;x=1/../y", "http://a.net/b/c/y"),
    ("http://a.net/b/c/d;p?q", "g?y/../x", "http://a.net/b/c/g?y/../x"),
    ("http://a.net/b/c/d;p?q", "..g/g.", "http://a.net/b/c/..g/g."),
    ("http://a.net", "g", "http://a.net/g"),
    ("HTTP://A.net:80", "?z", "http://a.net/?z"),
    ("https://a.net:443/x", "http://B.net:80", "http://b.net/"),
    ("https://a.net:80/x", "y//../z", "https://a.net:80/y/z"),
]


def test_links_are_resolved(spark):
    rows = spark.createDataFrame(RESOLVED, "base string, link string, target string")
    from pyspark.sql import functions as F

    from placebook.llm.redirect_equivalence import node_of, resolved

    got = rows.select("base", "link", node_of(resolved(F.col("link"), F.col("base"))).alias("target")).collect()
    assert [tuple(r) for r in got] == RESOLVED


def test_base_comments_attributes_and_ports(spark, tmp_path):
    """The operator and the SQL on pages that hold all of them."""
    link = "<link rel=canonical href='{}'>"
    html = [
        "<base href='http://b0.net/'>" + link.format("es/1"),
        "<BASE target=_top><base href=../es/ ><base href='http://lone.org/'>" + link.format("x"),
        "<!-- " + link.format("http://b2.net/es/") + " -->" + link.format("http://lone2.org/"),
        "<!-- open " + link.format("http://b3.net/es/"),
        link.format("../../es/./q"),
        link.format("http://b5.net:80/x/../es/q"),
        "<link title=\"rel=stylesheet href='http://lone6.org/'\" rel=canonical href=http://b6.net/es/ >",
        "<meta name=x content='0;url=http://b7.net/es/'>",
        '<meta http-equiv="refresh" content="5; URL=\'http://b8.net/es/\'">',
        link.format("javascript:go()") + link.format("mailto:a@b9.net"),
        "<base href='mailto:x'>" + link.format("//b10.net/es/"),
        "<link rel=canonical/>" + "<link data-rel=canonical href=http://b11.net/es/>",
        link.format(" http://b12.net/fr/?a&amp;b "),
        "<link rel=canonical rel=stylesheet href=http://b13.net/es/ href=http://lone13.org/>",
    ]
    want = "block block allow allow block block block allow block allow block allow block block".split()
    urls = [f"http://p{i}.org/a/b" for i in range(len(html))]
    urls[1], urls[4] = "http://p1.net/a/b/c", "http://p4.net/a/b/c/d"
    want[1] = "allow"  # /a/es/x is not /es/x
    html[4] = link.format("../../../es/./q")
    rows = [(i, url, text) for i, (url, text) in enumerate(zip(urls, html, strict=True))]
    rows.append((50, "http://b5.net/es/q?", None))
    got = collected(judged(pages(spark, rows), str(tmp_path)), "page_id", "verdict")
    assert got == [*enumerate(want), (50, "block")]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted((r[0], r[1]) for r in duck.sql(f"SELECT page_id, verdict FROM ({OP3})").fetchall()) == got


def test_long_pages_of_open_tags_take_linear_time(spark, tmp_path):
    import time

    texts = ["<link " * 180_000, "<!--" * 250_000, "<meta content=" * 80_000, "<link rel='" * 100_000, "<base href=a" * 90_000]
    one = pages(spark, [(i, f"http://a{i}.org/", text) for i, text in enumerate(texts)]).cache()
    assert one.count() == 5
    from placebook.llm.redirect_equivalence import alias_edges

    alias_edges(one).count()
    began = time.monotonic()
    assert alias_edges(one).count() == 0
    assert time.monotonic() - began < 5
