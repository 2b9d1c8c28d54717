"""URL filters: rules, canonical forms and the list."""

from joeira.llm.queries import URL_RULES
from joeira.llm.url_filter import bloom_blocks, filter_urls


def judge(spark, urls, listed):
    pages = spark.createDataFrame([(k, u, "block") for k, u in enumerate(urls)], "page_id int, url string, verdict string")
    known = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r.page_id: r for r in filter_urls(pages, known, URL_RULES).collect()}


def test_rules_and_list(spark):
    urls = [
        "http://WWW.Example.COM/en/a", "https://blog.example.com/en/a", "https://example.com/fr/", "http://example.com", "ftp://a.net/fr/x?y://z",
        "http://notexample.com/en/", "http://bad.org/x/", "https://www.bad.org:443/x?utm_source=q#f", "http://bad.org/y", None, "", "no scheme", "://", "http://",
        "http://bad.org/x/", "http://a.org/?b=2&a=1&ref=3", "http://a.org/?a=1&b=2", "http://net/es/\nq", "x://h.net/es/",
    ]
    got = judge(spark, urls, ["http://bad.org/x", "http://bad.org/x/", "https://a.org?a=1&b=2", None, "nothing"])
    rule = {k: r.rule for k, r in got.items()}
    assert rule[0] == "www.example.com/en/" and rule[1] == "example.com/en/" and rule[2] == "com/" and rule[3] is None
    assert rule[4] == "net/fr/" and rule[5] == "com/" and rule[17] == "net/es/" and rule[18] == "net/es/"
    assert [got[k].verdict for k in range(6)] == ["allow", "block", "allow", "allow", "block", "allow"]
    assert [got[k].verdict for k in (6, 7, 8, 14, 15, 16)] == ["block", "block", "allow", "block", "block", "block"]
    for k in (9, 10, 11):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == ("", "", None, "allow")
    assert (got[17].host, got[17].path) == ("net", "/es/\nq") and got[0].host == "www.example.com"
    assert len(got) == len(urls)


def test_empty_tables(spark):
    assert len(judge(spark, [], ["http://a.org/"])) == 0
    assert judge(spark, ["http://a.org/"], [])[0].verdict == "allow"


def test_the_filter_holds_all_that_is_listed_and_little_else(spark):
    urls = [f"h{k}.org/p" for k in range(3000)]
    listed = [f"http://{u}" for u in urls[:1000]]
    got = judge(spark, [f"https://{u}/" for u in urls], listed)
    assert [got[k].listed for k in range(3000)] == [k < 1000 for k in range(3000)]
    blocks = bloom_blocks(spark.createDataFrame([(u,) for u in urls[:1000]], "u string"), "u", 42)
    assert 1 <= blocks.count() <= 42


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string")
    plan = filter_urls(pages, pages.select("url"), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
