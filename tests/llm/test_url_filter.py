import re

from quillstat.llm.url_filter import RULES, apply_rules

SCHEMA = "page_id bigint, url string, verdict string, extra int"


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7", "https://example.com/en/71", "https://a.example.com/en/8?x#y", "http://com/en/",
    "http://notexample.com/en/7", "http://x.example.net/de/8", "http://example.net/de/9", "http://xexample.net/de/8", "http://b.org/es/#f", "http://b.org/ES/",
    "http://b.org?/es/", "http://b.org#://c.org/es/", "x://y://com/en/", "http://..com/en/q", "http://İ.com/en/7", "http://a.b.c.d.e.net/de/" + "z" * 5000,
    "http://com./en/", "http://a.org/es/\nnext", "https://example.com/en/7", "https://example.com/en/7",
]


def judged(spark, urls, rules=RULES):
    pages = spark.createDataFrame([(k, u, "theirs", 7) for k, u in enumerate(urls)], SCHEMA)
    out = apply_rules(pages, spark.createDataFrame(list(rules), "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def test_edge_urls(spark):
    got = judged(spark, URLS)
    assert got == {k: brute(u) for k, u in enumerate(URLS)}


def test_whole_pages(spark, sf_dir):
    urls = [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert judged(spark, urls) == {k: brute(u) for k, u in enumerate(urls)}


def test_many_rules_have_no_false_hits(spark):
    rules = [(f"h{k}.com", "/", "block") for k in range(3000)]
    got = judged(spark, [f"http://h{k}.com/x" for k in range(6000)], rules)
    assert sum(v[3] == "block" for v in got.values()) == 3000
    assert all((got[k][3] == "block") == (k < 3000) for k in got)


def test_pages_without_a_hit_stay_where_they_are(spark):
    """Only possible hits are exploded and shuffled: the branch of the others has no exchange."""
    pages = spark.createDataFrame([(k, f"http://h{k}.com/x", "t", 1) for k in range(100)], SCHEMA)
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    plan = apply_rules(pages, rules)._jdf.queryExecution().optimizedPlan().toString()
    quiet, loud = plan.split("Union")[1].split("Aggregate", 1)[0], plan.split("Union")[1]
    assert "Generate" not in quiet and "Generate" in loud


def test_empty_sides(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://a.com/en/", "t", 1)], SCHEMA)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert apply_rules(pages, none).first()["verdict"] == "allow"


def test_hosts_of_many_labels_and_urls_of_many_pages(spark):
    far = "http://" + "a." * 100_000 + "example.com/en/7"  # only suffixes as long as listed ones are built
    urls = [far] + ["http://example.net/de/8"] * 500 + [None] * 500
    assert judged(spark, urls) == {k: brute(u) for k, u in enumerate(urls)}
    theirs = spark.createDataFrame([(k, u, f"b{k}", "h") for k, u in enumerate(urls)], "page_id bigint, url string, _best string, _row string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    for most in (500_000, 0):  # the filter on the rows, or joined by block
        got = apply_rules(theirs, rules, most_blocks=most).collect()
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {k: brute(u) for k, u in enumerate(urls)}
        assert all(r["_best"] == f"b{r['page_id']}" and r["_row"] == "h" for r in got) and len(got) == len(urls)
