from chronoweave.llm import urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = [
    None, "", "no scheme", "http://", "https://Www.Example.ORG/es/x?b=2&a=1&utm_source=f#top", "http://example.org/en/12",
    "http://example.org", "http://a.example.org/en/2", "ftp://x.com/fr/1", "http://com/de/", "http://xcom/de/", "http://bad.net:80/p/index.html",
    "https://bad.net/p/?ref=1", "http://bad.net/p/?id=3", "http://good.net/p?x://y", "HTTP://É.example.net/ü?q#f", "x" * 50000 + "://h/" + "p" * 50000,
]


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def verdict(host, path):
    best = None
    for decision, rule in RULES:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = decision, rule
    return best


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] * 2, "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("https://www.bad.net/p",), (None,), ("nothing",), ("http://bad.net/p",)], "url string")
    got = urls.filter_urls(pages, listed, RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"]) == host_path(r["url"])
        rule = verdict(r["host"], r["path"])
        assert r["rule"] == (rule and rule[1])
        assert r["listed"] == (r["url"] in ("http://bad.net:80/p/index.html", "https://bad.net/p/?ref=1"))
        assert r["verdict"] == (rule[0] if rule else "block" if r["listed"] else "allow")


def test_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(5000).selectExpr("concat('host/', id) AS _key")
    table, blocks = urls.bloom_filter(keys)
    probes = spark.range(20000).selectExpr("id", "concat('host/', id) AS _key")
    for broadcast in (400_000, 0):
        urls.BROADCAST_BLOCKS = broadcast
        hits = {r["id"] for r in urls.possible_hits(probes, table, blocks).filter("_possible").collect()}
        assert set(range(5000)) <= hits and len(hits) < 5000 + 15000 * 0.02
    urls.BROADCAST_BLOCKS = 400_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.filter_urls(pages, none, RULES).first()["verdict"] == "allow"
    assert urls.filter_urls(pages.limit(0), none, []).count() == 0
