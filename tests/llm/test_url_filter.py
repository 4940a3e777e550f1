import random

import pytest

from weft.llm.queries import RULES, op7_url_filter
from weft.llm.url_filter import Rule, UrlTrie, filter_urls, split_url


@pytest.mark.parametrize(
    "url, host, path",
    [(None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("HTTP://A.Com", "a.com", ""), ("x://a?b/c", "a", ""), ("x://a#/b", "a", ""), ("x://É.Com/Ä?q#f", "É.com", "/Ä"), ("x://y://z/p", "y:", "//z/p")],
)
def test_split(url, host, path):
    assert split_url(url) == (host, path)


def brute(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (r.host.count("."), len(r.host), len(r.path)), default=None)


def test_trie_against_all_rules():
    rng = random.Random(2)
    labels, segments = ["a", "b", "com", "net"], ["", "x", "xy", "y"]
    rules = {}
    for _ in range(40):
        r = Rule(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 3))), "/" + "/".join(rng.choices(segments, k=rng.randint(0, 3))))
        rules[r.host, r.path] = r
    rules = list(rules.values())
    trie = UrlTrie(rules)
    for _ in range(5000):
        host = ".".join(rng.choices([*labels, ""], k=rng.randint(0, 4)))
        path = rng.choice(["", "/"]) + "/".join(rng.choices(segments, k=rng.randint(0, 4)))
        assert trie.find(host, path) == brute(rules, host, path), (host, path)


def test_rows(spark, sf_dir):
    rows = op7_url_filter(spark, sf_dir).collect()
    for r in rows:
        want = brute(RULES, r.host, r.path)
        assert (r.rule, r.verdict) == ((want.name, want.action) if want else (None, "allow"))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "h"), (1, None, "h"), (2, "http://x.net/fr/1", "h"), (None, "http://net", "h"), (3, "http://" + "a." * 50000 + "com/", "h")], "page_id long, url string, host string")
    got = sorted(map(str, ((r.page_id, r.rule, r.verdict) for r in filter_urls(df, RULES).collect())))
    assert got == sorted(map(str, [(1, None, "allow"), (1, None, "allow"), (2, "net/fr/", "block"), (None, None, "allow"), (3, "com/", "allow")]))
    assert filter_urls(df.limit(0), RULES).collect() == []
