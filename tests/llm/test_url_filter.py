import re

import pytest

from rxweave.llm.queries import ORACLES, PATTERN_RULES, QUERIES, SITE_RULES
from rxweave.llm.url_filter import SiteRule, filter_urls

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/q?x=/en/", "http://example.com/EN/", "http://notexample.com/en/",
    "http://example.com?/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "http://x.org/ads/1", "http://x.org/badS/1", "http://x.org/a/wp-login.php", "http://x.org/wp-login.php?x",
    "http://doubleclick.org/", "http://ad.doubleclick.org", "http://x.org/file.EXE", "a://b://c.com/", "http://x.org/Banners/", "http://ünicode.net/es/ü", "http://x.org/" + "long/" * 5000 + "ads/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.verdict
    patterns = [r.verdict for r in PATTERN_RULES if re.search(re.sub(r"\(\?i:(\w+)\)", lambda m: "".join(f"[{c}{c.upper()}]" for c in m[1]), r.regex), host + path)]
    return host, path, None, max(patterns, default="allow")


def test_verdicts_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, rule string, host int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, SITE_RULES + PATTERN_RULES).collect()}
    assert found == {i: brute(u) for i, u in enumerate(URLS)}


def test_null_keys_repeated_rows_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([(None, "http://a.com/"), (None, "http://a.com/"), (1, None)], "page_id long, url string")
    assert [r.verdict for r in filter_urls(df, ()).collect()] == ["allow"] * 3
    assert filter_urls(df, (SiteRule("block", "com"),)).where("verdict = 'block'").count() == 2
    assert filter_urls(df.limit(0), SITE_RULES).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(compare, sf):
    compare(QUERIES, ORACLES, "op8_url_filter", sf)
