"""The given rules of URLs, a general list by kind of junk, and the query that judges ``pages`` and names the kinds.

A rule's words must stand in the host as whole tokens, one after the other in one label
(``casino``, ``ads-track``); they are the rule's literal tokens too. Words that clean hosts
have as well (free, track, farm, adult) count only beside another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import url_filter

#: Given rules (host/path).
GIVEN = [
    url_filter.prefix_rule("net/", "block", 2),
    url_filter.prefix_rule("example.net/en/", "allow", 2),
    url_filter.prefix_rule("example.com/de/", "block", 2),
    url_filter.prefix_rule("org/fr/", "allow", 2),
]

KINDS = {
    "gambling": "casino casinos casino-win bets free-bets betting sportsbook bookmaker poker roulette blackjack jackpot jackpots free-slots online-slots slot-machines free-spins",
    "ads and tracking": "ads ads-track ad-track ad-server ad-network ad-click adserver adservers adservice adserving adclick adtracker doubleclick popads popunder click-tracker web-beacon tracking-pixel",
    "adult": "adult-x adult-xxx adult-video adult-videos adult-cam adult-cams adult-dating porn porno xxx hentai camgirls sex-cam sex-cams sex-chat sex-shop",
    "pills": "cheap-pills buy-pills diet-pills online-pills pills-online cheap-meds buy-meds online-pharmacy viagra cialis levitra tramadol",
    "link farms": "spam-farm link-farm links-farm linkfarm link-exchange link-wheel buy-backlinks buy-links cheap-backlinks free-backlinks seo-links backlinks",
}


def kind_rule(kind: str, words: str) -> url_filter.Rule:
    """A rule named ``kind: words`` for hosts that hold the words."""
    tokens = words.split("-")
    return url_filter.Rule(f"{kind}: {words}", "block", rf"^([^/]*[^a-z0-9/])?{'[-_]'.join(tokens)}([^a-z0-9]|$)", tokens)


GENERAL = [kind_rule(kind, words) for kind, listed in KINDS.items() for words in listed.split()]
#: The given rules go before.
RULES = GIVEN + GENERAL


def url_filter_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"url_filter_kinds": url_filter_kinds}
#: Pages with host, path, the given rule and the pattern of the general list that is the longest.
JUDGED_SQL = (
    r"""
with cut as (
  select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') h, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path from pages
), p as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from cut
), kinds(kind, listed) as (values """
    + ", ".join(f"('{kind}', '{listed}')" for kind, listed in KINDS.items())
    + r""")
, words as (select kind, unnest(string_split(listed, ' ')) as w from kinds
), own as (select host, first(kind || ': ' || w order by -length(kind || ': ' || w), kind || ': ' || w) as own
  from (select distinct host from p) join words on contains('-' || regexp_replace(host, '[^a-z0-9]', '-', 'g') || '-', '-' || w || '-') and regexp_matches(host, '(^|[^a-z0-9])' || replace(w, '-', '[-_]') || '([^a-z0-9]|$)')
  group by host
), r as (
  select p.*, own, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as given
  from p left join own using (host))
"""
)
VERDICT_SQL = "case when given in ('net/', 'example.com/de/') then 'block' when given is not null then 'allow' when own is not null then 'block' else 'allow' end as verdict"
ORACLE = {"url_filter_kinds": f"{JUDGED_SQL} select page_id, host, path, coalesce(given, own) as rule, {VERDICT_SQL} from r"}
