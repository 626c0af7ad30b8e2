"""URL rules against a plain loop over all rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hazegrid.llm import queries, url_rules
from tests.oracle import same

RULES = queries.SITE_RULES + queries.PATTERNS + [("example.com/", "allow"), ("^de^", "block"), ("a*b", "block"), ("*", "allow"), ("ünï.net/x", "block"), ("net/", "allow"), ("m.x-y.org/a+b", "block")]
URLS = [None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "HTTP://a.Example.NET/en/", "http://example.net/EN/", "http://badexample.net/en/x", "https://x.example.com/de/1?q=/fr/", "ftp://x.org/fr/", "http://x.org?/fr/", "http://x.org#/fr/", "http://user:p@x.net:80/en/", "http://www.cheap-pills.org/a", "http://cheap.pills", "http://a/casino?x", "http://a/online-casinos", "http://ünï.net/x", "http://m.x-y.org/a+b/c", "http://m.x-y.org/aab", "http://net/" + "a/" * 500 + "casino/", "x://y://net/"]


def site(rule):
    return "*" not in rule and "^" not in rule


def plain(url, rules):
    after = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = re.split(r"[/?#]", after)[0]
    rest = after[len(host) :]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    path = re.split(r"[?#]", rest)[0]
    fits = []
    for rule, action in rules:
        if site(rule):
            h, _, p = rule.partition("/")
            ok = (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        else:
            text = rule.replace("*", "\0")
            ok = re.search("".join({"\0": "(?s:.*)", "^": r"(?:[^a-zA-Z0-9]|\A|\Z)"}.get(c, re.escape(c)) for c in text), host + rest, re.I | re.A) is not None
        if ok:
            fits.append((not site(rule), -len(rule), rule, {"block": "a", "allow": "b"}[action]))
    best = min(fits, default=None)
    return host, path, best and best[2], best and not best[0], "allow" if best is None or best[3] == "b" else "block"


@pytest.mark.parametrize("most", [200_000, 0])
def test_every_rule_on_every_url(spark, most):
    rng = random.Random(3)
    urls = URLS + ["http://" + ".".join(rng.choice(["www", "example", "de", "x", "org"]) for _ in range(3)) + rng.choice([".net", ".com", ".org", ""]) + rng.choice(["/en/", "/de/1", "/fr/", "?a", "#b", "", "/CASINO-x"]) for _ in range(300)] + ["http://hot.net/en/"] * 100
    d = spark.createDataFrame([(None if i == 3 else i, u, 1, "r") for i, u in enumerate(urls)], "page_id long, url string, host int, rule string").withColumn("target", F.lit(0))
    rules = spark.createDataFrame([*RULES, (None, "block")], "rule string, action string")
    got = sorted((tuple(r) for r in url_rules.judge(d, rules, most_rules=most).collect()), key=str)
    assert got == sorted(((None if i == 3 else i, *plain(u, RULES)) for i, u in enumerate(urls)), key=str)


def test_rules_are_filed_under_their_rarest_token(spark):
    assert url_rules.parse("example.net/en/")[2] == ["en", "example", "net"]
    assert url_rules.parse("example.net/en")[2] == ["example", "net"]  # /english starts with it too
    assert url_rules.parse("a*^b^c*d")[2] == ["b"]
    urls = spark.createDataFrame([("x.example.net/en/",)] * 5 + [("example.org/en/",)], "target string")
    rules = url_rules.parsed(spark.createDataFrame([("example.net/en/", "allow"), ("*x*", "block"), ("example.never/", "block")], "rule string, action string"))
    assert {r.rule: r.key for r in url_rules.filed(urls, rules).collect()} == {"example.net/en/": "net", "*x*": None, "example.never/": "never"}


def test_no_pages_no_rules_wrong_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "rule string, action string")
    assert [tuple(r) for r in url_rules.judge(pages, rules).collect()] == [(1, "a.net", "/", None, None, "allow")]
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(RULES, "rule string, action string")).count() == 0
    with pytest.raises(Exception, match="neither block nor allow"):
        url_rules.judge(pages, spark.createDataFrame([("a.net/", "maybe")], "rule string, action string")).collect()
    with pytest.raises(Exception, match="needs a slash"):
        url_rules.judge(pages, spark.createDataFrame([("a.net", "block")], "rule string, action string")).collect()


def test_query_equals_its_sql(spark):
    assert same(spark, queries.op11_url_rules, queries.ORACLES["op11_url_rules"]) > 0


def test_very_long_url(spark):
    """A pattern that almost fits a URL at each of a million places takes time in proportion."""
    pages = spark.createDataFrame([(1, "http://net/" + "a/" * 500_000), (2, "http://org/" + "a/" * 500_000 + "b")], "page_id long, url string")
    rules = spark.createDataFrame([("a*b", "block"), ("a*a*b", "block")], "rule string, action string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()} == {1: (None, "allow"), 2: ("a*a*b", "block")}
