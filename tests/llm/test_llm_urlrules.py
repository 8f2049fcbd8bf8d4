import random

from ledgerlens.llm import urlrules

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.com", "", "block"),
    ("a.example.com", "", "allow"), ("Example.NET", "/x", "block"), (None, "/", "block"),
]


def judge(url):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, verdict in RULES:
        if h is None:
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), verdict)
            best = max(best, (key, h + p, verdict)) if best else (key, h + p, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls_equal_brute_force(spark):
    draw = random.Random(4)
    hosts = ["org", "example.org", "m.example.org", "xexample.org", "example.com", "a.example.com",
             "b.a.example.com", "EXAMPLE.net", "a..b.com", "", "com", "." + "a." * 3000 + "com"]
    paths = ["", "/", "/es/", "/es/9", "/en/1", "/en/12", "/en/2", "/fr/", "/de/x", "/x" * 2000, "/x?y=/es/"]
    urls = [f"http://{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '#top', '?a'])}" for _ in range(300)]
    urls += [None, "", "no scheme/es/", "http://", "http://example.org/es/"] + ["http://m.example.org/es/7"] * 200
    rows = [(i % 350, u, "x") for i, u in enumerate(urls)] + [(None, "http://org/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = urlrules.judge_urls(pages, rules, "page_id").collect()
    want = [(i, *judge(u)) for i, u, _ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urlrules.judge_urls(pages, rules, "page_id").first()["verdict"] == "allow"
    assert urlrules.judge_urls(pages.limit(0), rules, "page_id").count() == 0
