"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over ``host || path`` together with the literal tokens that
every matching URL holds as whole tokens. Each rule is filed under the one of its tokens that
the fewest URLs have; a URL's tokens fetch its candidate rules and only those run.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.work import keeps_names, literal_rows

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[a-z0-9]+"
#: A rule without a whole literal token is filed under tokens that no URL has by itself; each URL asks for one of so many.
EMPTY_TOKENS = 64
#: Rules up to this many are sent to every executor; more are joined by a shuffle on the token.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``name`` as reported; ``verdict``; ``pattern`` over host || path; ``tokens`` that it needs; ``rank``: higher wins, then the longer name."""

    name: str
    verdict: str
    pattern: str
    tokens: list[str] = field(default_factory=list)
    rank: int = 1


def prefix_rule(name: str, verdict: str, rank: int = 1) -> Rule:
    """A rule ``host/path``: the host, its subdomains, and every path that starts with the rule's."""
    host, slash, path = name.lower().partition("/")
    text = host + slash + path
    whole = [m.group() for m in re.finditer(_TOKEN, text) if m.end() < len(text)]
    return Rule(name, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + slash + re.escape(name.partition("/")[2]), whole, rank)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({_TOKEN})"), 1))


def _empty(k: Column) -> Column:
    return F.concat(F.lit("#"), k.cast("string"))


def index(urls: DataFrame, rules: list[Rule], spark: SparkSession) -> DataFrame:
    """(token, name, verdict, pattern, rank): every rule under its rarest token over all ``urls`` (column ``target``).

    A rule without a whole literal token is filed under each of EMPTY_TOKENS empty tokens, of which
    every URL has one by its hash, so that no single token is every URL's.
    """
    schema = "name: string, verdict: string, pattern: string, tokens: array<string>, rank: int"
    listed = literal_rows(spark, [asdict(r) | {"tokens": r.tokens or [""]} for r in rules], schema)
    needs = listed.select("name", "rank", F.explode("tokens").alias("token"))
    wanted = needs.select("token").distinct()
    if len(rules) <= BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    seen = urls.select(F.explode(_tokens(F.col("target"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").count()
    rarest = needs.join(seen, "token", "left").groupBy("name", "rank").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    filed = listed.join(rarest, ["name", "rank"])
    every = F.transform(F.sequence(F.lit(0), F.lit(EMPTY_TOKENS - 1)), _empty)
    return filed.select(F.explode(F.when(F.col("token") == "", every).otherwise(F.array("token"))).alias("token"), "name", "verdict", "pattern", "rank")


@keeps_names("won")
def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict (and rule_rank) to every row of ``pages``.

    Among the rules that match, the highest rank wins, then the longest name, then the smallest.
    Without one the rule is null and the verdict is ``default``. Null URLs have empty host and
    path and match nothing. Rows that repeat keep their number. Input columns named like an
    added one are replaced. Each distinct URL is judged once and its answer is joined to its rows:
    URLs are shuffled for the judging, and the rows of ``pages`` for the join where Spark does not
    broadcast the answers. Without rules all rows get the default.
    """
    spark = pages.sparkSession
    key = "_q_url"
    pages = pages.drop("host", "path", "rule", "rule_rank", "verdict").withColumn(key, F.col(url))
    urls = pages.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.concat(host_of(F.col(key)), path_of(F.col(key))).alias("target"))
    indexed = index(urls, rules, spark)
    if len(rules) <= BROADCAST_RULES:
        indexed = F.broadcast(indexed)
    fetched = urls.select(key, "target", F.explode(F.concat(_tokens(F.col("target")), F.array(_empty(F.pmod(F.xxhash64(key), F.lit(EMPTY_TOKENS)))))).alias("token")).join(indexed, "token")
    won = (
        fetched.where(F.expr("target rlike pattern"))
        .groupBy(key)
        .agg(F.min_by(F.struct(F.col("name").alias("rule"), "verdict", F.col("rank").alias("rule_rank")), F.struct(-F.col("rank"), -F.length("name"), "name")).alias("won"))
    )
    return (
        pages.join(won, key, "left")
        .withColumns({"host": host_of(F.col(key)), "path": path_of(F.col(key)), "rule": F.col("won.rule"), "rule_rank": F.col("won.rule_rank"), "verdict": F.coalesce("won.verdict", F.lit(default))})
        .drop(key, "won")
    )
