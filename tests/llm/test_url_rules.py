import re

from sceneloom.llm import url_rules as ur

from .helpers import scratch

HOSTS = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    tail = rest[len(host) :]
    path = re.split(r"[?#]", tail)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in HOSTS if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    target = "".join(c.lower() if c.isascii() else c for c in host + tail)
    parts = re.split("[^a-z0-9_%]", target)
    cgi = target.partition("/cgi-bin/")[2]
    blocked = (
        host.startswith("spam-farm.")
        or ".spam-farm." in host
        or "-spam." in target
        or {"casino", "poker", "adult", "phishing"} & set(parts)
        or "/wp-login.php" in target
        or any(not cgi[m.end() :] or cgi[m.end()] not in "abcdefghijklmnopqrstuvwxyz0123456789_%" for m in re.finditer(re.escape(".cgi"), cgi))
    )
    return host, path, None, "block" if blocked else "allow"


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://xexample.com/en/", "http://m.www.example.com/en/2?x#y", "http://a.net/es/", "http://a.net/es", "http://a.net/fr/1", "http://net.org/fr/"]
URLS += ["http://spam-farm.example.org/a", "http://b.spam-farm.org", "http://x-spam.org/", "http://a.org/casino/1", "http://a.org/mycasino/1", "http://casino", "http://a.org/cgi-bin/run.cgi?x", "http://a.org/cgi-bin/run.cgis", "http://a.org/?q=phishing", "http://a.org?x=/wp-login.php", "x://y://com/", "http://a.com?/en/", "http://É.com/é", "http://a.org/\u212acasino/", "http://a.com/"]
URLS += ["http://casino.org/", "http://www.casino.org/", "https://PHISHING.net", "http://adult.org?x", "http://a.org/CASINO/", "http://a.org/x-SPAM.html", "http://a.org/cgi-bin/a.cgis/b.CGI", "http://mycasino.org/", "http://a.org/pok%65r/poker", "http://a.org/\ncgi-bin/a\nb.cgi", "http://a.org/cgi-bin/a\nb.cgi", "http://example.com/EN/1"]


def test_equals_plain(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string").repartition(3)
    for limit in (ur.BROADCAST_RULES, 0):
        rows = sorted(ur.judge(pages, scratch(spark), broadcast_rules=limit).collect())
        assert [tuple(r)[1:] for r in rows] == [plain(u) for u in URLS]


def test_every_fit_is_fetched_by_its_tokens():
    for rule in ur.HOST_RULES + ur.PATTERN_RULES:
        tokens = ur.literal_tokens(rule.text)
        assert tokens
        for url in filter(None, URLS):
            host, path, *_ = plain(url)
            if re.search(ur.regex_of(rule.text), host + (path if rule.rank else path.lower())):
                assert set(tokens) <= set(re.split("[^a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in host + path)))


def test_rules_without_tokens_and_no_rows(spark):
    rules = (ur.Rule("block", "*zz*", 0),)
    pages = spark.createDataFrame([(1, "http://a/azzb"), (1, "http://a/b"), (None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in ur.judge(pages, scratch(spark), rules).collect()) == ["allow", "allow", "block"]
    assert ur.judge(pages.limit(0), scratch(spark)).collect() == []


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame([*ur.HOST_RULES, *ur.PATTERN_RULES, ("block", "^CASINO^", None), ("allow", "^casino^", 0), (None, "^a^", 0), ("block", None, 0)], "verdict string, text string, rank int")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = sorted(ur.judge(pages, scratch(spark), rules).collect())
    assert [tuple(r)[1:] for r in rows] == [plain(u) for u in URLS]


def test_many_rules_and_few_fetched(spark):
    """12,000 rules of a table: verdicts equal those of all rules tried one by one, and a URL fetches few of them."""
    kinds = ("||shop{}.example.org^", "/track{}/*.gif", "^banner{}^", "-promo{}-")
    rules = [("block", kinds[i % 4].format(i), 0) for i in range(11_990)] + [("allow", f"^banner{i}^*keep", 0) for i in range(2, 42, 4)]
    hosts = [f"http://{'www.' if i % 2 else ''}shop{i * 4}.example.org/p" for i in range(40)]
    paths = [f"http://a.org/track{i * 4 + 1}/x/{i}.gif" for i in range(40)] + [f"http://a.org/banner{i * 4 + 2}/{'keep' if i % 3 else 'x'}" for i in range(40)]
    urls = hosts + paths + [f"http://b.net/x-promo{i * 4 + 3}-y" for i in range(40)] + ["http://shop4x.example.org/", "http://a.org/track1.gif", "http://c.io/example/org/gif"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, text string, rank int")
    tried = [(v, t, re.compile(ur.regex_of(t))) for v, t, _ in rules]

    def verdict(url):
        fits = [(len(t), t, v == "block", v) for v, t, r in tried if r.search(url.split("://")[1])]
        return max(fits)[3] if fits else "allow"

    want = [verdict(u) for u in urls]
    assert {"allow", "block"} == set(want)
    for limit in (ur.BROADCAST_RULES, 0):
        held = scratch(spark)
        assert [r.verdict for r in sorted(ur.judge(pages, held, table, broadcast_rules=limit).collect())] == want
        tokens, index = (spark.read.parquet(held.paths[n]) for n in ("tokens", "index"))
        assert index.count() == len(rules)
        fetched = tokens.join(index, "token").groupBy("url").count().agg({"count": "max"}).first()[0]
        assert fetched <= 3
