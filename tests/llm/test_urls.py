import re

from rasterloom.llm import urls

RULES = urls.RULES


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        host = rest[: cut.start()] if cut else rest
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        tail = rest[cut.start() :] if cut else ""
        path = re.split(r"[?#]", tail, maxsplit=1)[0] if tail.startswith("/") else ""
    fits = [(v, r) for v, r in RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    v, r = max(fits, key=lambda x: len(x[1]), default=(None, None))
    return host, path, r, v


URLS = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x=1", "https://example.org/en/2", "http://x.com/fr/a", "http://com/de/b", "http://notcom/de/b", "https://h.net/a?b=/c#d", "http://x.org?q", "http://ÀB.org/", "no scheme", "", None, "http://", "a://b://c.org/x",
        "https://m.host.com/de/5/7#top", "http://u:p@y.org:80/es/", "http://x.org/es/"] + [f"http://w{i}.example.{'org' if i % 2 else 'com'}/{'en' if i % 2 else 'de'}/{i * 7}" for i in range(60)]


def test_rules_and_method(spark):
    df = spark.createDataFrame([(i, u, "", "x") for i, u in enumerate(URLS + URLS[:3])], "page_id bigint, url string, html string, host string").repartition(3)
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    again = {r.page_id: r for r in urls.filter_urls(df.repartition(5)).collect()}
    assert len(got) == len(URLS) + 3
    for i, u in enumerate(URLS + URLS[:3]):
        host, path, rule, verdict = judged(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        assert r == again[i]


def test_trained_on_given_labels(spark):
    def url(i, bad):
        return f"http://{'x' * (i % 5)}shop.net/{'a/' * (6 if bad else 1)}p{i if bad else ''}{'?a=1&b=2&c=3' if bad else ''}"

    rows = [(url(i, i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    held = spark.createDataFrame([(i, url(i, i % 3 == 0)) for i in range(1000, 1100)], "page_id bigint, url string")
    out = urls.filter_urls(held, labelled=spark.createDataFrame(rows, "url string, blocked int")).collect()
    right = sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in out)
    assert right >= 97


def test_one_label_and_none(spark):
    one = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(one).collect()} == {1: "allow", 2: "allow"}
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).collect() == []
