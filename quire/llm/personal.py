"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides.

Base patterns give spans that always count. Wider patterns give candidates beside them. On each span five
labelers vote for, against or not at all: its form, a gazetteer, words before it, its borders, its shape.
Expectation-maximisation over the counted patterns of votes estimates how each labeler votes on personal and
on other spans, and so how likely each pattern is personal; with these as soft labels a naive Bayes classifier
of features of a span and its surroundings is trained. It decides on the candidates. All are SQL functions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.work import free_name, saved

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _LABEL, _OCTET = "A-Za-z0-9._%+-", "A-Za-z0-9-", "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: The base patterns, possessive and begun where a run of their first class begins, so that long runs cost linear time and no stack.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider ones, of spans that the base patterns miss, take together with what stands beside, or drop.
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?: ?[\[({{] ?(?i:at) ?[\])}}] ?| ?@ ?| (?i:at) (?=[{_LABEL}]+ (?i:dot) ))[{_LABEL}]++(?:(?:\.| ?[\[({{] ?(?i:dot) ?[\])}}] ?| (?i:dot) )[{_LABEL}]++)++",
    "ip": rf"(?<![0-9])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[ .-]?){3}[0-9]{4}|3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5})(?![0-9])",
    "phone": r"(?:(?:\+|(?<![0-9A-Za-z])00)1[ .-]?)?(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|(?:\+|(?<![0-9A-Za-z])00)[1-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
}
#: What a candidate of a kind must hold besides: the last label of an address has no digits.
WIDE_HOLDS = {"email": "[A-Za-z]{2,}$"}
_ALL_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
#: Common top-level domains, card issuers' first digits, calling codes.
DOMAINS = "com org net edu gov int info biz io ai app dev de fr es uk it nl be ch at pt pl se no dk fi ie eu us ca mx br ar cl co au nz jp cn in ru"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|64|65)"
CODES = r"^(?:\+|00)(?:1|20|27|3[0-469]|4[0134567899]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
#: Words before a span that speak for its kind, and words that speak for something else.
CUES = {
    "email": "mail contact write reach correo courriel kontakt schreib",
    "ip": "ip host server address login client peer adresse direcci",
    "card": "card visa mastercard amex credit debit payment carte karte tarjeta",
    "phone": "phone tel call mobile cell fax whatsapp handy anruf appel llam",
}
AGAINST = "token password secret sha md5 hash uuid guid version release build isbn issn doi chapter section order invoice"
LABELERS = ["form", "gazetteer", "context", "borders", "shape"]
#: Pseudo-counts of votes for, none and against, on personal spans; on others they are the other way round.
PRIOR = [4.0, 2.0, 1.0]
ROUNDS = 25
#: Words before a span and its shape fall into so many buckets.
WORD_BUCKETS, SHAPE_BUCKETS = 64, 64
_STEP = 256


def _running(steps: Column) -> Column:
    """Running sums of an array that is a column, by blocks, so that no array is copied once an element."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _STEP).cast("int")), lambda k: F.slice(steps, k * _STEP + 1, _STEP))
    inner = lambda b: F.aggregate(b, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out")))
    empty = F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("out"))
    outer = F.aggregate(F.transform(blocks, inner), empty, lambda a, b: F.struct((a["sum"] + b["sum"]).alias("sum"), F.concat(a["out"], F.array(F.transform(b["out"], lambda x: x + a["sum"]))).alias("out")))
    return F.when(F.size(steps) > 0, F.flatten(outer["out"])).otherwise(F.array().cast("array<int>"))


def _matches(found: Column, gaps: Column, starts: Column) -> Column:
    """Array of (start, end, span, before, after) of matches, in code points; what stands beside goes no further than the next match."""
    return F.transform(
        starts,
        lambda start, i: F.struct(
            start.alias("start"),
            (start + F.length(F.get(found, i))).alias("end"),
            F.get(found, i).alias("span"),
            F.call_function("right", F.get(gaps, i), F.lit(48)).alias("before"),
            F.call_function("left", F.get(gaps, i + 1), F.lit(24)).alias("after"),
        ),
    )


def _steps(found: Column, gaps: Column) -> Column:
    """From each match's beginning to the next one's."""
    return F.transform(found, lambda x, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def is_valid(kind: str, span: Column) -> Column:
    """What a match of a base pattern must pass."""
    if kind == "ip":
        return span.rlike(_ALL_OCTETS)
    if kind == "card":
        return F.length(_digits(span)).between(12, 19) & _luhn(_digits(span))
    return F.length(_digits(span)).between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, x: Column) -> Column:
    """One vote of each labeler on a match: 1, 0 or -1."""
    span, digits = x["span"], _digits(x["span"])
    never = F.lit(False)
    form = {
        "email": lambda: _vote(span.rlike(rf"^[{_LOCAL}]*[A-Za-z0-9]@[^@]*\.[A-Za-z]{{2,}}$") | span.rlike(r"(?i)[\[({] ?at ?[\])}]"), span.rlike(r"\.[0-9-]+$|^[._%+-]")),
        "ip": lambda: _vote(span.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$|:"), ~span.rlike(":")),
        "card": lambda: _vote(_luhn(digits), ~_luhn(digits)),
        "phone": lambda: _vote(span.rlike(r"^(?:\+|00)") & F.length(digits).between(9, 15), ~F.length(digits).between(9, 15)),
    }[kind]()
    gazetteer = {
        "email": lambda: _vote(span.rlike(rf"(?i)(?:\.|dot\W*)(?:{DOMAINS.replace(' ', '|')})$"), never),
        "ip": lambda: _vote(~span.rlike(r"^0*(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), span.rlike(r"^0*(?:0|25[0-5])\.")),
        "card": lambda: _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": lambda: _vote(span.rlike(CODES) | span.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), never),
    }[kind]()
    words = lambda listed: rf"(?i)(?:{listed.replace(' ', '|')})"
    near = F.call_function("right", x["before"], F.lit(32))
    context = _vote(near.rlike(words(CUES[kind])), near.rlike(words(AGAINST)))
    glued = x["before"].rlike(r"[\p{L}\p{N}_=\"'][.-]?$") | x["after"].rlike(r"^[\p{L}\p{N}_]|^[.-][0-9]")
    seps = F.length(F.translate(F.array_join(F.array_distinct(F.split(F.regexp_replace(span, "[0-9A-Za-z()+]", ""), "")), ""), " ", "_"))
    shape = {"email": lambda: _vote(~span.rlike(r"\s"), span.rlike(r"\s.*\s.*\s")), "ip": lambda: _vote(span.rlike(r"[0-9]{2}"), never), "card": lambda: _vote(seps <= 1, seps > 1), "phone": lambda: _vote(seps > 0, seps == 0)}[kind]()
    return F.array(*(v.cast("int") for v in (form, gazetteer, context, _vote(~glued, glued), shape)))


def _features(kind: str, x: Column, votes: Column) -> Column:
    """Names of the features of a match; the first is every match's."""
    char = lambda c: F.when(c == "", "edge").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\p{N}"), "digit").when(c.rlike(r"\s"), "space").otherwise("mark")
    shape = F.regexp_replace(F.regexp_replace(x["span"], "[0-9]+", "0"), "[A-Za-z]+", "a")
    word = F.lower(F.regexp_extract(x["before"], r"(\p{L}+)[^\p{L}]*$", 1))
    named = {
        "before": char(F.call_function("right", x["before"], F.lit(1))),
        "after": char(F.call_function("left", x["after"], F.lit(1))),
        "form": F.get(votes, F.lit(0)).cast("string"),
        "digits": F.least(F.length(_digits(x["span"])), F.lit(20)).cast("string"),
        "shape": F.pmod(F.xxhash64(shape), F.lit(SHAPE_BUCKETS)).cast("string"),
        "word": F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("string"),
    }
    return F.array(F.lit("all"), *(F.concat(F.lit(f"{name}="), v) for name, v in named.items()))


_JUDGED = "array<struct<start: int, end: int, votes: array<int>, features: array<string>>>"


def _judged(kind: str, matches: Column) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _votes(kind, x).alias("votes"), _features(kind, x, _votes(kind, x)).alias("features")))


def _span(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"))


def _found(docs: DataFrame, text: str, name: str, base_too: bool) -> DataFrame:
    """``docs`` with a struct ``name``: per kind the base spans and, as ``<kind>_more``, what the wider patterns add, judged.

    Added matches lie in no base span and overlap none of their kind. With ``base_too`` the base spans are judged as well.
    """
    free = lambda x: free_name(docs, f"{name}_{x}")
    raw, gaps, steps, starts, at = ({(k, i): free(f"{step}_{k}{i}") for k in KINDS for i in (0, 1)} for step in ("raw", "gaps", "steps", "starts", "at"))
    kept, new = ({k: free(f"{step}_{k}") for k in KINDS} for step in ("kept", "new"))
    digit, sign, every = free("digit"), free("sign"), free("every")
    pattern = {(k, i): p[k] for k in KINDS for i, p in enumerate((BASE, WIDE))}
    whole = F.coalesce(F.col(text), F.lit(""))
    spelt = whole.contains("dot") | whole.contains("Dot") | whole.contains("DOT")
    marked = docs.withColumns({digit: whole.rlike("[0-9]"), sign: whole.contains("@")})
    may = {(k, i): F.col(digit) for k in KINDS for i in (0, 1)} | {("email", 0): F.col(sign), ("email", 1): F.col(sign) | spelt, ("phone", 0): F.col(digit) & whole.contains("+")}
    may[("ip", 1)] = F.col(digit) | whole.contains(":")
    none = F.array().cast("array<string>")
    # Columns of their own: what a struct is made of, or what stands in a lambda, would be computed again for each use.
    first = marked.withColumns({raw[x]: F.when(may[x], F.regexp_extract_all(whole, F.lit(p), F.lit(0))).otherwise(none) for x, p in pattern.items()})
    cut = first.withColumns({gaps[x]: F.when(F.size(raw[x]) > 0, F.split(whole, p, -1)).otherwise(none) for x, p in pattern.items()})
    cut = cut.withColumns({steps[x]: _steps(F.col(raw[x]), F.col(gaps[x])) for x in pattern})
    cut = cut.withColumns({starts[x]: _running(F.col(steps[x])) for x in pattern})
    located = cut.withColumns({at[x]: _matches(F.col(raw[x]), F.col(gaps[x]), F.col(starts[x])) for x in pattern})
    located = located.withColumns({kept[k]: F.filter(F.col(at[k, 0]), lambda x: is_valid(k, x["span"])) for k in KINDS})
    located = located.withColumn(every, F.concat(*(F.transform(F.col(kept[k]), _span) for k in KINDS)))
    packed = lambda x: x["start"].cast("long") * (1 << 32) + x["end"]
    located = located.withColumns({new[k]: F.array_except(F.transform(F.col(at[k, 1]), packed), F.transform(F.col(kept[k]), packed)) for k in KINDS})

    def more(k: str) -> Column:
        wide, own = F.col(at[k, 1]), F.col(kept[k])
        clear = lambda x: ~F.exists(own, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])) & ~F.exists(F.col(every), lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
        found = F.filter(wide, lambda x: F.array_contains(F.col(new[k]), packed(x)) & x["span"].rlike(WIDE_HOLDS.get(k, "")) & clear(x))
        return F.when(F.size(new[k]) > 0, _judged(k, found)).otherwise(F.array().cast(_JUDGED))

    base = lambda k: _judged(k, F.col(kept[k])) if base_too else F.transform(F.col(kept[k]), _span)
    columns = [base(k).alias(k) for k in KINDS] + [more(k).alias(f"{k}_more") for k in KINDS]
    own = [c for listed in (raw, gaps, steps, starts, at, kept, new) for c in listed.values()]
    return located.withColumn(name, F.struct(*columns)).drop(digit, sign, every, *own)


@dataclass(frozen=True)
class Model:
    """``weights`` of features by ``kind|feature``; the weight of ``all`` is the logarithm of a kind's odds."""

    weights: dict[str, float]


def reliabilities(patterns: DataFrame) -> DataFrame:
    """(kind, votes, n, p): how likely each pattern of votes (kind, votes, n) is that of personal data, by expectation-maximisation.

    Labelers are taken as independent given the class, with a distribution of their three votes in either
    class. The patterns of a kind, at most three to the power of the labelers, fold in one expression.
    """
    rows = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    labelers = F.sequence(F.lit(0), F.lit(len(LABELERS) - 1))
    doubles = lambda xs: F.array(*(F.lit(x) for x in xs))
    total = sum(PRIOR)
    start = F.struct(F.lit(0.5).alias("share"), *(F.array_repeat(doubles([v / total for v in values]), len(LABELERS)).alias(name) for name, values in (("yes", PRIOR), ("no", PRIOR[::-1]))))
    chance = lambda table, votes: F.aggregate(labelers, F.lit(1.0), lambda a, i: a * F.get(F.get(table, i), 1 - F.get(votes, i)))

    def likely(m: Column, votes: Column) -> Column:
        yes, no = m["share"] * chance(m["yes"], votes), (1 - m["share"]) * chance(m["no"], votes)
        return yes / (yes + no)

    def counted(soft: Column, values: list[float]) -> Column:
        """The votes of each labeler, weighted, as shares."""
        votes_of = lambda i, v, least: F.aggregate(soft, F.lit(least), lambda a, x: a + F.when(F.get(x["votes"], i) == v, x["w"]).otherwise(0.0))
        every = F.aggregate(soft, F.lit(total), lambda a, x: a + x["w"])
        return F.transform(labelers, lambda i: F.transform(F.array(*(votes_of(i, 1 - j, least) for j, least in enumerate(values))), lambda n: n / every))

    def step(m: Column) -> Column:
        soft = F.transform("rows", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * likely(m, x["votes"])).alias("w")))
        hard = lambda s: F.transform(s, lambda x: F.struct(x["votes"].alias("votes"), (x["n"] - x["w"]).alias("w")))
        share = lambda s: F.aggregate(s, F.lit(1.0), lambda a, x: a + x["w"]) / F.aggregate(s, F.lit(2.0), lambda a, x: a + x["n"])
        made = F.transform(F.array(soft), lambda s: F.struct(share(s).alias("share"), counted(s, PRIOR).alias("yes"), counted(hard(s), PRIOR[::-1]).alias("no")))
        return F.get(made, F.lit(0))

    fitted = rows.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda m, _: step(m)))
    each = fitted.select("kind", "model", F.explode("rows").alias("row"))
    return each.select("kind", "row.votes", "row.n", likely(F.col("model"), F.col("row.votes")).alias("p"))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Reliabilities and classifier from all rows of ``docs``; what comes to the driver is one weight a feature."""
    name = free_name(docs, "found")
    found = _found(docs.select(text), text, name, True)
    spans = F.concat(*(F.transform(F.concat(F.col(name)[k], F.col(name)[f"{k}_more"]), lambda x: F.struct(F.lit(k).alias("kind"), x["votes"].alias("votes"), x["features"].alias("features"))) for k in KINDS))
    each = found.select(F.explode(spans).alias("s")).select("s.kind", "s.votes", F.explode("s.features").alias("feature"))
    counts = saved(each.groupBy("kind", "votes", "feature").agg(F.count("*").alias("n")), "votes")
    soft = reliabilities(counts.where("feature = 'all'").select("kind", "votes", "n")).select(F.col("kind").alias("k"), F.col("votes").alias("v"), "p")
    sums = counts.join(soft, (F.col("kind") == F.col("k")) & (F.col("votes") == F.col("v"))).groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum("n").alias("n"))
    odds = lambda p: F.log(p / (1 - p))
    share = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.max(F.when(F.col("feature") == "all", F.col("yes") / F.col("n"))).over(Window.partitionBy("kind"))))
    lift = odds((F.col("yes") + 4 * F.col("share")) / (F.col("n") + 4)) - odds(F.col("share"))
    weighed = sums.withColumn("share", share).select(F.concat("kind", F.lit("|"), "feature").alias("key"), F.round(F.when(F.col("feature") == "all", odds(F.col("share"))).otherwise(lift), 9).alias("weight"))
    return Model({r.key: r.weight for r in weighed.collect()})


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds the personal data of each row's whole text, row by row and without a shuffle.

    ``n_email``, ``n_ip``, ``n_card``, ``n_phone``: base spans. ``base_sha256``: of the base spans as
    kind:start:end in code points, end exclusive, by start and then kind, with commas between. ``spans``:
    these and the candidates that the classifier takes, likewise. ``n_added``: how many those are. A null
    or empty text has no spans. Input columns named like an added one are replaced; rows may repeat. A kind
    that the model has not seen goes by the sum of its votes.
    """
    added = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_added"]
    docs = docs.drop(*(c for c in added if c != text))
    name, taken = free_name(docs, "found"), free_name(docs, "taken")
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string, double>")
    found = _found(docs, text, name, False)

    def is_personal(k: str, x: Column) -> Column:
        if f"{k}|all" not in model.weights:
            return F.aggregate(x["votes"], F.lit(0), lambda a, v: a + v) > 0
        return F.aggregate(x["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(weights, F.concat(F.lit(f"{k}|"), f)), F.lit(0.0))) > 0

    entry = lambda k, x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end"))
    base = F.concat(*(F.transform(F.col(name)[k], lambda x: entry(k, x)) for k in KINDS))
    more = F.concat(*(F.transform(F.filter(F.col(name)[f"{k}_more"], lambda x: is_personal(k, x)), lambda x: entry(k, x)) for k in KINDS))
    found = found.withColumn(taken, F.struct(base.alias("base"), more.alias("more")))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")
    counts = {f"n_{k}": F.size(F.col(name)[k]).cast("long") for k in KINDS}
    base, more = F.col(taken)["base"], F.col(taken)["more"]
    return found.withColumns(counts | {"base_sha256": F.sha2(shown(base), 256), "spans": shown(F.concat(base, more)), "n_added": F.size(more).cast("long")}).drop(name, taken)
