import duckdb

from quire.llm import url_filter, url_rules

SF = "/root/testdata/sf0.001"
JUNK = {"casino-win": "gambling", "free-bets": "gambling", "ads-track": "ads and tracking", "adult-x": "adult", "cheap-pills": "pills", "spam-farm": "link farms"}
CLEAN = ["free.example.com", "track.example.com", "farm.example.org", "adult-education.example.com", "casinova.example.com", "loads.example.com", "blog.thther.example.com", "dating.example.com"]


def test_a_host_of_every_kind(spark):
    urls = [f"https://m.{label.upper()}.example.com/x" for label in JUNK] + [f"http://{host}/casino/ads-track" for host in CLEAN]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, url_rules.RULES).collect()}
    assert set(JUNK.values()) == set(url_rules.KINDS)
    assert [(got[i].rule, got[i].verdict) for i in range(len(JUNK))] == [(f"{kind}: {label}", "block") for label, kind in JUNK.items()]
    assert all(got[i].rule is None and got[i].verdict == "allow" for i in range(len(JUNK), len(urls)))


def test_every_rule_finds_its_host(spark):
    df = spark.createDataFrame([(i, f"http://{'_'.join(r.tokens)}/") for i, r in enumerate(url_rules.GENERAL)], "page_id long, url string")
    assert all(r.verdict == "block" for r in url_filter.judge_urls(df, url_rules.GENERAL).collect())


def test_query_matches_its_sql(spark, tmp_path):
    extra = ["http://a.casino_win.com", "http://XXX", "http://free-bets/x", "http://m.ads-track.example.org/fr/", "http://ads.net/", "http://é-poker", None, "casino"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    pages.union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(extra)], pages.schema)).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cols = "page_id host path rule verdict".split()
    want = duck.execute(f"select {', '.join(cols)} from ({url_rules.ORACLE['url_filter_kinds']})").fetchall()
    got = url_rules.QUERIES["url_filter_kinds"](spark, str(tmp_path)).select(cols).collect()
    assert len(got) == pages.count() + len(extra)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
