from __future__ import annotations

import random

from casequeue.llm import url_rules

SCHEMA = "page_id long, url string, host string, rule long, key string"
RULES = "host string, path string, verdict string"


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        r for r in rules
        if None not in r and path.startswith(r[1]) and (host == r[0] or host.endswith("." + r[0]))
    ]
    best = min(fits, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1], r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "own", 5, "k") for i, u in enumerate(urls)], SCHEMA)
    out = url_rules.judge_urls(pages, spark.createDataFrame(rules, RULES))
    assert out.columns == [*pages.columns, "_host", "path", "_rule", "verdict"]
    assert out.where("host <> 'own' or rule <> 5").count() == 0
    return {r["page_id"]: tuple(r)[5:] for r in out.collect()}


def test_against_brute_force(spark):
    r = random.Random(2)
    labels, parts = ["a", "b", "net", "org", "é", "a-b", ""], ["/", "/en", "/en/", "/e", ""]
    hosts = [".".join(r.choice(labels) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    rules = [(r.choice(hosts), r.choice(parts), r.choice(["allow", "block"])) for _ in range(40)]
    rules += [(None, "/", "block"), ("a", None, "block"), rules[0]]
    urls = [
        f"http://{'x.' * r.randrange(0, 2)}{r.choice(hosts).upper()}{r.choice(parts)}{r.choice(['', '?q=/', '#t', 'n/z'])}"
        for _ in range(400)
    ]
    urls += [None, "", "nothing", "://", "http://", "a://b://c/d", "http://net", "HTTP://NET/", urls[0]]
    got = judged(spark, urls, rules)
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    assert judged(spark, ["http://a.b/c"], []) == {0: ("a.b", "/c", None, "allow")}
    assert judged(spark, [], [("a", "/", "block")]) == {}
