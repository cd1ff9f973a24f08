from pyspark.sql import functions as F

from likeness.llm import url_filters as U
from likeness.llm.catalog import URL_RULES

URLS = [
    None, "", "no scheme", "http://a.com", "http://a.com/", "HTTP://A.COM/x", "http://example.com/en/1", "https://www.Example.com/en/1?q#f", "http://b.example.com/en/", "http://b.example.com/de/",
    "http://x.net/es/1", "http://net/fr/", "http://x.net/fr?/fr/", "http://notexample.com/en/", "http://a.com:80/", "http://é.net/es/", "http://x.org/", "http://x.org?://y.com/", "x://", "http:///en/", "http://com/",
]


def _plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.partition("://")[2]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def _pages(spark, urls, html=None):
    rows = [(i, u, (html or {}).get(i), "clash") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")


def test_hosts_paths_and_rules(spark):
    got = U.judge(_pages(spark, URLS), URL_RULES).orderBy("page_id").collect()
    for url, r in zip(URLS, got, strict=True):
        host, path, rule, verdict = _plain(url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), url


def test_long_rule_lists_are_joined_alike(spark, monkeypatch):
    want = U.judge(_pages(spark, URLS), URL_RULES).orderBy("page_id").collect()
    monkeypatch.setattr(U, "RULES_IN_EXPRESSION", 2)
    assert U.judge(_pages(spark, URLS), URL_RULES).orderBy("page_id").collect() == want


def test_decisions_reach_aliases(spark):
    urls = ["http://a.org/1", "http://b.org/2", "http://c.net/es/", "http://d.org/4#x", "https://d.org/4", "http://e.net/fr/", "http://f.org/", "http://g.com/", "http://h.org/"]
    html = {
        0: '<head><link rel="canonical" href="http://b.org/2"></head>', 1: '<META HTTP-EQUIV=refresh content="0; URL=http://c.net/es/">', 3: "<link href='http://c.net/es/' rel=canonical>",
        5: '<link rel="canonical" href="http://f.org/">', 6: '<link rel="canonical" href="http://g.com/">', 8: '<link rel="canonical" href="/relative">',
    }
    got = {r.page_id: r.verdict for r in U.judge(_pages(spark, urls, html), URL_RULES).collect()}
    # 0 -> 1 -> 2 is blocked; 3 and 4 are one address; 5 keeps its own rule, 6 gets 7's explicit allow
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow"}


def test_long_chains_and_hubs(spark):
    n = 300
    edges = spark.range(n).select(F.format_string("http://c%d.org/", F.col("id")).alias("source"), F.format_string("http://c%d.org/", F.col("id") + 1).alias("target"))
    hub = spark.range(500).select(F.format_string("http://h%d.org/", F.col("id")).alias("source"), F.lit(f"http://c{n}.org/").alias("target"))
    block = edges.unionByName(hub).unionByName(spark.createDataFrame([("http://c7.org/", "http://z.net/es/"), (None, "http://q.org/")], "source string, target string"))
    pages = _pages(spark, [f"http://c{i}.org/" for i in range(0, n, 50)] + ["http://h499.org/", "http://other.org/"])
    got = [r.verdict for r in U.judge(pages, URL_RULES, block).orderBy("page_id").collect()]
    assert got == ["block"] * 7 + ["allow"]


def test_empty(spark):
    assert U.judge(_pages(spark, URLS).limit(0), URL_RULES).count() == 0


def test_targets_are_resolved(spark):
    page = "http://x.net/a/b/c?k=1#f"
    targets = {
        "/es/1": "http://x.net/es/1", "//y.net/es/1": "http://y.net/es/1", "d": "http://x.net/a/b/d", "../d?q#g": "http://x.net/a/d?q#g", "./": "http://x.net/a/b/", "..": "http://x.net/a/",
        "?z": "http://x.net/a/b/c?z", "#h": "http://x.net/a/b/c?k=1#h", "https://q.org/1": "https://q.org/1", "mailto:a@b": "mailto:a@b", "/../../e": "http://x.net/e", "u?r=http://w": "http://x.net/a/b/u?r=http://w",
    }
    rows = spark.createDataFrame([(page, t) for t in targets], "page string, target string")
    got = {r.target: r.u for r in rows.select("target", U.resolved(F.col("target"), F.col("page")).alias("u")).collect()}
    assert got == targets
    assert spark.createDataFrame([("http://x.net", "d")], "page string, target string").select(U.resolved(F.col("target"), F.col("page"))).first()[0] == "http://x.net/d"


def test_all_declared_targets_make_edges(spark):
    html = {
        0: '<link rel="canonical" href="//y.net/es/1">', 1: '<meta http-equiv="refresh" content="0; url=/es/1">', 2: "<link rel='x canonical' href='http://z.org/?a=1&amp;b=2'>",
        3: '<link rel=canonical href="http://one.org/"><link href=two rel="canonical"><meta content="5;URL=\'http://three.org/\'" http-equiv=Refresh>',
        4: '<link rel="stylesheet" href="/canonical"><link rel="canonicals" href="/x"><link rel="icon" data-href="/y" title="rel=canonical">', 5: "<link title='a>b' rel=canonical href=http://w.org/&#47;&#x24;>",
        6: '<link rel="canonical" data-href="/no" href=" /yes/ "/>', 7: '<link rel=canonical href="/self&amp;lt;">', 8: '<link rel="canonical"href="/c?a&copy=1&eacute;&amp">', 9: "<link rel=canonical href=/it's><meta http-equiv=refresh content=7><meta name=x content='0;url=/no'>",
    }
    got = [r.target for r in U.page_edges(_pages(spark, ["http://x.net/a"] * 10, html)).collect()]
    assert set(got) == {
        "http://y.net/es/1", "http://x.net/es/1", "http://z.org/?a=1&b=2", "http://one.org/", "http://x.net/two", "http://three.org/", "http://w.org//$", "http://x.net/yes/", "http://x.net/self&lt;", "http://x.net/c?a&copy=1é&", "http://x.net/it's",
    }


def test_comments_and_scripts_declare_nothing(spark):
    link = '<link rel="canonical" href="/es/1">'
    html = {0: f"<!-- {link} -->", 1: f"<!-- a\n{link}", 2: f"<script type='x'>var a = '{link}';</script >", 3: f"<STYLE>/* {link} */</STYLE>", 4: f"<!-- x --><p>{link}<!-- y -->", 5: f"<scripted>{link}"}
    got = U.judge(_pages(spark, [f"http://x.net/{i}" for i in range(6)], html), URL_RULES).collect()
    assert {r.page_id: r.verdict for r in got} == {0: "allow", 1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block"}


def test_relative_targets_decide(spark):
    pages = _pages(spark, ["http://x.org/a", "http://x.net/a"], {0: '<link rel="canonical" href="//y.net/es/1">', 1: '<meta http-equiv="refresh" content="0; url=/es/1">'})
    assert {r.verdict for r in U.judge(pages, URL_RULES).collect()} == {"block"}


def test_planted_redirects_equal_recursive_sql(spark, sf_dir):
    import duckdb

    from likeness.llm import catalog

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS FROM '{sf_dir}/pages.parquet'")
    want = duck.execute(catalog.ORACLE_SQL["url_aliases"])
    columns = [d[0] for d in want.description]
    want = sorted(map(repr, want.fetchall()))
    found = catalog.url_aliases(spark, sf_dir).select(columns)
    assert sorted(repr(tuple(r)) for r in found.collect()) == want
    assert found.filter("rule is null and verdict = 'block'").count() > 0
