import re

from pyspark.sql import functions as F

from rillwork.llm import common, url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "/fr/x", "block"), ("a.b.org", "", "allow"), (None, "/", "block"), ("", "/", "block")]
URLS = [None, "", "nothing", "http://net", "http://net/", "HTTP://A.NET/x", "http://a.example.net/en/x?q=1", "http://example.net/EN/", "http://example.net/en", "https://xexample.net/en/y", "http://example.com/de/#f",
        "http://example.com/fr/", "http://b.org/fr/x/y", "http://b.org/fr/y", "http://c.a.b.org/fr/x", "http://a.b.org?x=/fr/", "://org/fr/", "x://y://org/fr/", "http://org:80/fr/", "http://.net/", "http://a..net/", "http:///path", "http://ÄÖ.net/ü", "http://net//"]


def judged(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_verdicts(spark, picked):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://net/"), (3, "http://net")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = sorted([(i, *judged(u)) for i, u in enumerate(URLS)] + [(None, *judged("http://net/")), (3, *judged("http://net"))], key=repr)
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert picked(url_filter.url_verdicts(pages, rules), *columns) == want
    clash = pages.withColumns({"host": F.lit(1), "verdict": F.lit("x"), "_p": F.lit(2), "rule_host": F.lit(3), "a.b": F.lit(4)})
    assert picked(url_filter.url_verdicts(clash, rules), *columns) == want
    none = url_filter.url_verdicts(pages, rules.where("false"))
    assert none.where("verdict = 'allow' and rule is null").count() == len(URLS) + 2
    assert url_filter.url_verdicts(pages.where("false"), rules).count() == 0


def test_digests_are_confirmed(spark, picked, monkeypatch):
    monkeypatch.setattr(url_filter, "PREFIX_DIGITS", 1)  # many rules share a prefix
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert picked(url_filter.url_verdicts(pages, rules), "page_id", "host", "path", "rule", "verdict") == sorted([(i, *judged(u)) for i, u in enumerate(URLS)], key=repr)


def test_many_path_lengths(spark, picked):
    """A long list of rules: of each host only its own path lengths are expanded."""
    rules = [(f"h{i % 50}.net", "/" + "x" * i, "block" if i % 2 else "allow") for i in range(400)]
    urls = [(i, f"http://www.h{i % 60}.net/{'x' * (i % 410)}") for i in range(300)]
    want = []
    for i, u in urls:
        host, path = u[7:].split("/", 1)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if host == h or host.endswith("." + h) if ("/" + path).startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((i, best[1], best[2]))
    found = url_filter.url_verdicts(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert picked(found, "page_id", "rule", "verdict") == sorted(want, key=repr)
