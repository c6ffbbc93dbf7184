import random
import re

from quire.llm import url_filter as U

LISTED = ["net/", "example.net/en/", "example.com/de/", "org/fr/"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def best(url):
    host, path = parts(url)
    fits = [r for r in LISTED for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=len, default=None)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://net", "http://NET/", "http://a.net?x", "x://example.net/en/1", "https://WWW.Example.NET/en/", "http://notnet/", "http://xexample.net/en/", "ftp://a://b.org/fr/", "http://org/fr/#a", "http://É.net/x", "http:///net/"]
    urls += [f"http://{rng.choice(['', 'a.', 'm.b.'])}{rng.choice(['example.net', 'example.com', 'org', 'net', 'com'])}{rng.choice(['', '/', '/en/', '/de/x', '/fr/', '?q', '/fr'])}" for _ in range(300)]
    rules = [U.prefix_rule(r, "block") for r in LISTED]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in U.judge_urls(df, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path) == parts(u), u
        assert got[i].rule == best(u), u
        assert got[i].verdict == ("block" if best(u) else "allow")


def test_patterns_ranks_and_rules_without_tokens(spark):
    rules = [U.Rule("digits", "block", r"\d{6}", []), U.Rule("spam", "block", r"spam", ["spam"]), U.prefix_rule("a.com/", "allow", 2)]
    df = spark.createDataFrame([(1, "http://x.de/123456"), (2, "http://spam.de/"), (3, "http://a.com/spam/123456"), (4, "http://ok.de/"), (2, "http://spam.de/")], "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in U.judge_urls(df, rules).where("page_id < 4").collect())
    assert got == [(1, "digits", "block"), (2, "spam", "block"), (2, "spam", "block"), (3, "a.com/", "allow")]
    assert U.judge_urls(df.limit(0), rules).count() == 0


def test_rarest_token_is_the_index(spark):
    urls = spark.createDataFrame([("com.example/x",)] * 5 + [("com.other/",)], "target string")
    rule = U.Rule("r", "block", "example", ["com", "example", "never"])
    assert [r.token for r in U.index(urls, [rule], spark).collect()] == ["never"]
    assert [r.token for r in U.index(urls, [U.Rule("r", "block", "e", ["com", "example"])], spark).collect()] == ["example"]


def test_no_rules_and_very_long_urls(spark):
    long = "http://spam.de/" + "x/" * 500_000
    df = spark.createDataFrame([(1, long), (2, "http://ok.de/"), (None, None)], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in U.judge_urls(df, []).collect()} == {(1, None, "allow"), (2, None, "allow"), (None, None, "allow")}
    got = {r.page_id: r for r in U.judge_urls(df, [U.Rule("spam", "block", "^spam", ["spam"]), U.Rule("deep", "block", r"x/$", [])]).collect()}
    assert got[1].rule in ("spam", "deep") and got[1].path == long[len("http://spam.de") :] and got[2].rule is None


def test_many_rules_are_joined_by_a_shuffle(spark, monkeypatch):
    rules = [U.Rule("digits", "block", r"\d{6}", []), *[U.prefix_rule(r, "block") for r in LISTED]]
    urls = [f"http://{h}{p}" for h in ("a.net", "example.com", "org", "x.de") for p in ("/", "/de/1", "/fr/123456", "/123456")] * 3
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(map(tuple, U.judge_urls(df, rules).collect()), key=str)
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, U.judge_urls(df, rules).collect()), key=str) == want and {r[4] for r in want} >= {"digits", "net/", "org/fr/", None}
