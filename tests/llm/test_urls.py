import pytest

from tests.llm.conftest import plain
from waylace.llm import url_filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER = {chr(c): chr(c + 32) for c in range(65, 91)}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    return "".join(UPPER.get(c, c) for c in host), path


def rule_of(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def node_of(url):
    if url is None or "://" not in url:
        return None
    scheme, rest = url.split("#", 1)[0].split("://", 1)
    cut = min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])
    low = lambda s: "".join(UPPER.get(c, c) for c in s)
    return f"{low(scheme)}://{low(rest[:cut])}{rest[cut:]}"


def brute(pages, links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    verdicts = {}
    for n in list(root):
        verdicts.setdefault(find(n), set()).add(rule_of(n)[1])
    out = []
    for i, url, _ in pages:
        rule, verdict = rule_of(url)
        if verdict is None:
            known = verdicts.get(find(node_of(url)), set()) if node_of(url) in root else set()
            verdict = "allow" if "allow" in known else "block" if "block" in known else "allow"
        host, path = parts(url)
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "host", "path", "rule", "verdict")
PAGES = [
    (1, "http://a.com/x#top", '<link rel="canonical" href="http://Bad.net/y">'),
    (2, "http://b.com/x", "<META http-equiv='refresh' content='0; URL=http://a.com/x'>"),
    (3, "http://c.com/x", '<link href="http://good.org/fr/1" rel=canonical>'),
    (4, "http://bad.net/y", None),
    (5, "http://d.com/x", '<link rel="canonical" href="http://bad.net/y"><meta http-equiv="refresh" content="5;url=http://c.com/x">'),
    (6, "http://e.example.net/en/1", '<link rel="canonical" href="http://bad.net/z">'),
    (7, "HTTP://F.com", "<p>no links <a href='http://bad.net/y'>plain</a></p>"),
    (8, None, '<link rel="canonical" href="http://bad.net/y">'),
    (9, "no scheme", ""),
    (10, "http://net/", ""),
    (11, "http://subnet/", ""),
    (12, "http://x.example.com/de", ""),
    (13, "http://x.example.com/de/1?q=/fr/#x", ""),
    (14, "http://g.com/a/b", '<link rel="canonical" href="c?x=1&amp;y=2">'),
    (15, "http://g.com/a/c?x=1&y=2", '<link rel="canonical" href="/d">'),
    (16, "http://g.com/d", '<link rel="canonical" href="//h.net/e">'),
    (17, "http://i.com", '<link rel="canonical" href="j">'),
    (None, "http://i.com/j", None),
    (1, "http://a.com/x#top", '<link rel="canonical" href="http://Bad.net/y">'),
]
LINKS = [
    ("http://a.com/x", "http://bad.net/y"),
    ("http://b.com/x", "http://a.com/x"),
    ("http://c.com/x", "http://good.org/fr/1"),
    ("http://d.com/x", "http://bad.net/y"),
    ("http://d.com/x", "http://c.com/x"),
    ("http://e.example.net/en/1", "http://bad.net/z"),
    ("http://g.com/a/b", "http://g.com/a/c?x=1&y=2"),
    ("http://g.com/a/c?x=1&y=2", "http://g.com/d"),
    ("http://g.com/d", "http://h.net/e"),
    ("http://i.com", "http://i.com/j"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_planted_links(pages):
    from pyspark.sql import functions as F

    wide = pages.select("*", *[F.lit(1).alias(c) for c in ("rule", "verdict", "node", "host", "root")])
    want = brute(PAGES, LINKS)
    assert plain(url_filter.url_verdicts(wide), *COLUMNS) == want
    verdicts = {i: v for i, *_, v in want}
    assert (verdicts[14], verdicts[7], verdicts[6]) == ("block", "allow", "allow")


def test_block_reaches_aliases_unless_one_is_allowed(pages):
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages.where("page_id in (1, 2, 4)")).collect()}
    assert got == {1: "block", 2: "block", 4: "block"}
    whole = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages).collect()}
    assert whole[1] == whole[2] == whole[3] == whole[5] == "allow" and whole[4] == "block"


def test_redirect_table(spark, pages):
    moved = spark.createDataFrame([("http://z.com/1", "http://bad.net/q"), (None, "http://bad.net/q"), ("http://z.com/1", None)], "from_url string, to_url string")
    one = spark.createDataFrame([(1, "http://z.com/1", None)], "page_id long, url string, html string")
    assert url_filter.url_verdicts(one, redirects=moved).first()["verdict"] == "block"
    assert url_filter.url_verdicts(one).first()["verdict"] == "allow"


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert plain(url_filter.url_verdicts(pages), *COLUMNS) == brute(rows, [])


def test_many_rules_are_joined(pages):
    more = [*RULES, *[("block", f"h{i}.test", "/") for i in range(100)]]
    assert plain(url_filter.url_verdicts(pages, rules=more), *COLUMNS) == plain(url_filter.url_verdicts(pages), *COLUMNS)


def test_empty(pages):
    assert url_filter.url_verdicts(pages.where("false")).count() == 0


def test_sql_says_the_same(pages, tmp_path):
    import duckdb

    from waylace.llm.queries import oracle_sql

    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    rows = con.sql(f"select {', '.join(COLUMNS)} from ({oracle_sql()['op10_url_filter']})").fetchall()
    assert sorted(map(tuple, rows), key=repr) == brute(PAGES, LINKS)
