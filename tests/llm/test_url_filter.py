import random

import pytest

from casewatch.llm import url_filter as u

RULES = [("a.org/", "allow"), ("b.a.org/x", "block"), ("org", "block"), ("com/p/", "block"), ("COM/p/q", "allow"), ("dup.org/", "allow"), ("dup.org/", "block"), (None, "allow")]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest] or [len(rest)]
        host, rest = rest[: min(ends)], rest[min(ends) :]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, action in RULES:
        if rule is None:
            continue
        h, slash, p = rule.partition("/")
        h, p = h.lower(), slash + p
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (len(h + p), action == "block") > (len(best[0]), best[1] == "block"):
                best = (h + p, action)
    return host, path, *(best or (None, "allow"))


@pytest.mark.parametrize("block_rules", [None, 2])
def test_same_as_plain_rules(spark, block_rules):
    r = random.Random(1)
    hosts = ["a.org", "B.A.ORG", "x.b.a.org", "org", "nota.org", "com", "é.com", "dup.org", "", "a.org:80", ".org", "a..org", "com.net"]
    tails = ["", "/", "/x", "/xy?z=/p/", "/p/", "/p/q/r#f", "?a=b", "#/p/", "/P/", "\n/x"]
    urls = [f"{r.choice(['http', '', 'a'])}://{h}{t}" for h in hosts for t in tails] + [None, "", "a.org/x", "x://", "s://a.org://b"]
    urls += urls[:5] + ["http://" + "l." * 3_000 + "a.org/" + "y" * 3_000]
    pages = spark.createDataFrame([(i, x, "own") for i, x in enumerate(urls)], "page_id int, url string, rule string").repartition(3)
    rules = spark.createDataFrame(RULES, "rule string, action string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in u.judge_urls(pages, rules, block_rules=block_rules).collect()}
    assert got == {i: plain(x) for i, x in enumerate(urls)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string")
    none = spark.createDataFrame([], "rule string, action string")
    assert u.judge_urls(pages, none).first()["verdict"] == "allow"
    assert u.judge_urls(pages.limit(0), spark.createDataFrame(RULES, "rule string, action string")).count() == 0


def test_cascade_is_exact_over_its_keys():
    keys = [f"key{i}" for i in range(6_000)]
    listed, others = u.hashed(keys[:300]), u.hashed(keys[300:])
    first = u.Bloom(listed, 0.3, 0)
    cascade = u.build(listed, others[first.holds(others)], first)
    assert len(cascade.levels) > 2
    assert cascade.lists(listed).all() and not cascade.lists(others).any()
