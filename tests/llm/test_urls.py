import re

from rillflow.llm.urls import RULES, template_filter

URLS = [
    None, "", "no scheme", "http://", "http://Example.NET/en/1?x#y", "https://a.example.net/fr/2", "http://example.net", "ftp://x.ORG/fr/://z", "http://org/fr/", "http://borg/fr/1", "http://m.example.com/de/3.html",
    "http://u@h:80?q", "HTTP://É.net/é", "://net/a", "http://example.com/De/1", "http://a.com/x/y/z/u/v/w/1", "http://a\n.net/b",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else (None, None)


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    out = {r["page_id"]: r for r in template_filter(df).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, (rule, verdict) = expected(u)
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
        if not host:
            assert r["verdict"] == "allow"


def test_templates_are_rejected_by_their_labels(spark):
    rows = [(f"http://big.com/shop/item{i}-x{i}", None) for i in range(40)] + [(f"http://big.com/blog/{i}", None) for i in range(40)]
    rows += [(f"http://casino-win.com/p/{i}", None) for i in range(5)] + [(f"http://plain.com/p/{i}", None) for i in range(5)]
    labels = spark.createDataFrame([(u, int("/shop/" in u)) for u, _ in rows[:80:2]], "url string, bad int")
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    out = {r["url"]: r["verdict"] for r in template_filter(df, labels=labels).collect()}
    assert {out[u] for u, _ in rows[:40]} == {"block"} and {out[u] for u, _ in rows[40:80]} == {"allow"}
    assert {out[u] for u, _ in rows[80:85]} == {"block"} and {out[u] for u, _ in rows[85:]} == {"allow"}


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    out = template_filter(df)
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_templates_without_labels_have_their_parents_share(spark):
    rows = [(f"http://{host}.com/shop/{kind}/{i}", int(host != "good")) for host in ("bad", "good", "mixed") for kind in ("hats", "bags", "toys", "cups") for i in range(10)]
    quiet = {"http://bad.com/shop/quiet/1": "block", "http://bad.com/else/where/1": "block", "http://mixed.com/shop/quiet/1": "block", "http://good.com/shop/quiet/1": "allow", "http://new.com/shop/quiet/1": "allow"}
    # Many pages without a bad label are evidence of their own.
    plain = {f"http://mixed.com/help/faq/{i}": "allow" for i in range(100)}
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*(u for u, _ in rows), *quiet, *plain])], "page_id long, url string")
    out = {r["url"]: r["verdict"] for r in template_filter(df, labels=spark.createDataFrame(rows, "url string, bad int")).collect()}
    assert {u: out[u] for u in quiet | plain} == quiet | plain


def test_wildcards_are_found_under_wildcards(spark):
    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    urls = [f"http://wide.com/{word(i)}/posts/{word(100 + 2 * i + j)}" for i in range(60) for j in (0, 1)] + [f"http://wide.com/about/us/{i}" for i in range(120)]
    labels = spark.createDataFrame([(u, 1) for u in urls[:120] if urls.index(u) % 3] + [(u, 0) for u in urls[120:]], "url string, bad int")
    out = {r["url"]: r["verdict"] for r in template_filter(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), labels=labels).collect()}
    assert {out[u] for u in urls[:120]} == {"block"} and {out[u] for u in urls[120:]} == {"allow"}
