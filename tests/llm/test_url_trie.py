import random
import time

import pytest

from glotsieve.llm.url_trie import RULES, UrlTrie, filter_urls, split_url


@pytest.mark.parametrize(
    "url, host, path",
    [
        (None, "", ""),
        ("", "", ""),
        ("no mark", "", ""),
        ("http://", "", ""),
        ("http://A.Org", "a.org", ""),
        ("http://a.org?x=/y", "a.org", ""),
        ("http://a.org#/y", "a.org", ""),
        ("http://a.org/p/Q?x#y", "a.org", "/p/Q"),
        ("x://É.org/#", "É.org", "/"),
        ("a://b://c/d", "b:", "//c/d"),
    ],
)
def test_split(url, host, path):
    assert split_url(url) == (host, path)


def brute(url, rules, default="allow"):
    host, path = split_url(url)
    fits = [
        (len(h + p), h.count("."), action == "block", h + p, action)
        for action, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3:] if fits else (None, default)


def test_against_brute_force(spark):
    rules = [*RULES, ("block", "a.b.com", "/fr"), ("allow", "b.com", "/fr/x"), ("allow", "org", ""), ("block", "org", "")]
    hosts = ["a.b.com", "b.com", "xb.com", "com", "org", "example.org", "m.example.org", "notexample.org", ""]
    paths = ["", "/", "/fr", "/fr/", "/fr/x", "/fr/xy/z", "/de/1", "/en/1", "/en/12/3", "/es/", "/es", "//"]
    urls = [None, "x", *(f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/es/", "#"))]
    rows = [(i, u, "host") for i, u in enumerate([*urls, urls[5]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    for given in (RULES, rules):
        got = {r.page_id: r for r in filter_urls(df, given).collect()}
        assert len(got) == len(rows)
        for i, url, _ in rows:
            assert (got[i].rule, got[i].verdict) == brute(url, given), url


def test_a_list_in_parts_gives_what_one_trie_gives(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org"]
    rules = [
        (rng.choice(("allow", "block")), rng.choice(hosts), "/" + "/".join(rng.choices(("", "p", "pq", "q"), k=rng.randint(1, 3))))
        for _ in range(60)
    ]
    urls = [f"http://{rng.choice(('', 'm.', 'b.'))}{rng.choice(hosts)}/{'/'.join(rng.choices(('', 'p', 'pq', 'pqr', 'q'), k=3))}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([*urls, None, "x"])), "page_id long, url string")
    for most in (60, 7):
        got = {r.page_id: r for r in filter_urls(df, iter(rules), max_rules=most).collect()}
        assert len(got) == len(urls) + 2
        for i, url in enumerate([*urls, None, "x"]):
            assert (got[i].rule, got[i].verdict) == brute(url, rules), (most, url)


def test_many_beginnings_at_one_node_are_not_scanned():
    trie = UrlTrie([("block", "com", f"/{i:06}") for i in range(200_000)])
    start = time.perf_counter()
    for i in range(20_000):
        assert trie.match("a.com", f"/{i:06}x")[0] == f"com/{i:06}"
    assert time.perf_counter() - start < 5


def test_bounds(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty).count() == 0
    assert filter_urls(empty, [("allow", "a", "/")] * 3, max_rules=2).count() == 0
    page = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in filter_urls(page, []).collect()] == [(1, "a", "/b", None, "allow")]
    with pytest.raises(ValueError):
        UrlTrie([("maybe", "a", "/")])
