from pyspark.sql import functions as F

from curatorium.llm import urls


def page(link):
    return f'<html><head><link rel="canonical" href="{link}"></head></html>'


def judge(spark, rows, redirects=None):
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"verdict": F.lit("old"), "address": F.lit(1)})
    edges = spark.createDataFrame(redirects, "from_url string, to_url string") if redirects else None
    return {r["page_id"]: r for r in urls.judged(docs, redirects=edges).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        (None, "", "", None), ("no scheme/x", "", "", None), ("http://A.Org", "a.org", "", None), ("http://A.Org/", "a.org", "/", "org/"),
        ("x://example.org/es/1?q#f", "example.org", "/es/1", "example.org/es/"), ("x://m.EXAMPLE.org/en/12", "m.example.org", "/en/12", "example.org/en/1"),
        ("x://notexample.org/es/", "notexample.org", "/es/", "org/"), ("x://a.com/fr/x", "a.com", "/fr/x", "com/fr/"), ("x://a.com/de/#x", "a.com", "/de/", "com/de/"),
        ("x://a.com?/de/", "a.com", "", None), ("x://y://z/k", "y:", "//z/k", None), ("://h/p", "h", "/p", None), ("x://É.com/de/", "É.com", "/de/", "com/de/"),
        ("x://com/de/1", "com", "/de/1", "com/de/"), ("", "", "", None),
    ]
    got = judge(spark, [(i, c[0], None) for i, c in enumerate(cases)])
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), cases[i]
        want = {"org/": "allow", "com/fr/": "allow"}.get(rule, "block" if rule else "allow")
        assert got[i]["verdict"] == want


def test_blocks_reach_aliases_but_not_explicit_allows(spark):
    rows = [
        (1, "http://a.net/1", page("http://b.com/de/1")),            # alias of a blocked page
        (2, "http://a.net/2", page("//a.net/1#x")),                    # alias of an alias
        (3, "http://x.org/free", page("http://a.net/1")),              # an explicit allow stands
        (4, "https://a.net/2?q=1", page("http://a.net/4")),            # another address
        (5, "http://r.net/start", None), (6, "http://r.net/end", '<meta http-equiv="Refresh" content="0; URL=../de/x">'),
        (7, "http://r.net/a/b", "<LINK href='c?d=1&amp;e=2' REL='Canonical'>"), (8, "http://r.net/a/c?d=1&e=2", "<meta http-equiv=refresh content='5'>"),
        (9, "HTTP://A.NET/1#frag", ""), (10, "http://far.net/", None), (1, "http://a.net/1", None),
    ]
    chain = [(f"http://hop{i}.net/", f"http://hop{i + 1}.net/") for i in range(60)]
    redirects = chain + [("http://far.net/", "http://hop0.net/"), ("http://hop60.net/", "http://gone.com/de/z"),
                         ("http://r.net/start", "http://r.net/a/b"), (None, "http://r.net/start"), ("http://r.net/start", "junk"),
                         ("http://r.net/a/c?d=1&e=2", "http://m.example.org/es/9")]
    got = judge(spark, rows, redirects)
    assert {k: r["verdict"] for k, r in got.items()} == {
        1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "block", 8: "block", 9: "block", 10: "block"}
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert urls.judged(docs).count() == len(rows)


def test_links_of_a_page():
    url = "http://h.net/a/b"
    assert urls.links(url, page("c") + page("/d") + page("")) == ["http://h.net/a/c", "http://h.net/d"]
    assert urls.links(url, '<link rel="stylesheet canonical" href=x><a href="canonical">') == ["http://h.net/a/x"]
    assert urls.links(url, page("http://[bad")) == []


def test_empty(spark):
    assert judge(spark, []) == {}
