"""URL rules against trying every rule on every URL."""

import random

from cueglass.llm.url_filter import judge_urls

PAGES, RULES = "page_id long, url string", "host string, path string, verdict string"


def brute(pages, rules, default="allow"):
    best = {}
    for host, path, verdict in rules:
        if host and verdict is not None:
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path or ""
            best[key] = max(best.get(key, ""), verdict)
    out = []
    for page, url in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [
            (len(h + p), len(h), h + p, v)
            for (h, p), v in best.items()
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule = max(fits, default=(0, 0, None, default))
        out.append((page, host, path, rule[2], rule[3]))
    return out


def same(spark, pages, rules):
    got = judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(pages, rules), key=str)


def test_random_rules(spark):
    rng = random.Random(3)
    labels = ["a", "b", "ab", "net", "org"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", ""]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))

    rules = [(host(), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(40)]
    pages = [
        (i, f"http://{host()}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#x', 'c', '/b'])}") for i in range(400)
    ]
    pages += [(i, "http://a.net/a/b") for i in range(1000, 1300)]  # one host with most rows
    same(spark, pages, rules)


def test_odd_rows(spark):
    pages = [
        (1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "x://A.Net"), (6, "x://a.net?u://b.net/"),
        (7, "http://.net/"), (8, "http://a.net./"), (None, "http://a.net/"), (9, "http://é.net/é\n/x#y"),
        (9, "http://é.net/é\n/x#y"), (10, "http://a.net" + "/p" * 20_000),
    ]
    rules = [
        ("NET", "/", "block"), ("a.net", None, "allow"), ("net", "/", "allow"), (None, "/", "block"),
        ("", "/", "block"), ("é.net", "/é", "block"), ("a.net", "/p/p", None), ("a.net", "/p/p/p", "block"),
    ]
    same(spark, pages, rules)


def test_empty_tables_and_default(spark):
    same(spark, [], [("net", "/", "block")])
    same(spark, [(1, "http://a.net/")], [])
    pages = spark.createDataFrame([(1, "http://a.net/", "r", 2)], PAGES + ", rule string, range int")
    rules = spark.createDataFrame([("org", "/", "allow")], RULES)
    assert [tuple(r) for r in judge_urls(pages, rules, default="block").collect()] == [
        (1, "a.net", "/", None, "block")
    ]


def test_main_path_has_no_python(spark):
    plan = judge_urls(spark.createDataFrame([(1, "u")], PAGES), spark.createDataFrame([], RULES))
    assert "Python" not in plan._jdf.queryExecution().toString()
