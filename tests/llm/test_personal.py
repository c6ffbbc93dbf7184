import hashlib
import random
import re

import pytest

from quire.llm import personal as P

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def fits(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_of(text):
    found = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PLAIN[k], text or "") if fits(k, m.group())]
    return [f"{KINDS[i]}:{a}:{b}" for a, i, b in sorted(found)]


def check_base(rows):
    for r in rows:
        want = base_of(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.text and r.text[:200]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in want) for k in KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), KINDS.index(x.split(":")[0]), int(x.split(":")[2])))


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if luhn(body + c))


def corpus(rng, n):
    """Texts with personal data that stands alone, and numbers and codes that are none."""
    word = lambda: rng.choice("the of ändern niño and éèà wor dot at".split())
    some = [
        lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        lambda: ".".join(str(rng.randrange(1, 224)) for _ in range(4)),
        lambda: card(rng),
        lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
    ]
    none = [lambda: "token=" + "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: str(rng.randrange(10**15, 10**16)), lambda: str(rng.randrange(2000)), word, word, word]
    return [" ".join(rng.choice(some + none * 2)() for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    texts = corpus(random.Random(1), 400)
    return P.fit(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_base_matches_brute_force(spark, model):
    rng = random.Random(2)
    pieces = ["a", "B7", "@", ".", "-", " ", "+", "(", ")", "1", "23", "255", "256", "0300", "4539578763621486", "é", "中😀", "%", "_", "\n", "com", "a@b.c", "1.2.3.4", "+49 30 1234567"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(1500)] + corpus(rng, 100)
    check_base(P.detect(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), model).collect())


def test_odd_and_very_long_texts(spark, model, odd_docs, no_docs):
    check_base(P.detect(odd_docs, model).collect())
    rng = random.Random(5)
    long = lambda n: ["1" * n, "a.b" * n, "a@" * n, "1.2." * n, "+1" + "(" * n, " ".join(["x.y@mail.example.com 10.0.0.1"] * (n // 50)), "x" * n + "@" + "y." * n, "x@y.z_" * n]
    check_base(P.detect(spark.createDataFrame([(t,) for t in [*long(1000), " ".join(corpus(rng, 300))]], "text string"), model).collect())
    counts = {r.text[:9]: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) for r in P.detect(spark.createDataFrame([(t,) for t in long(20_000)], "text string"), model).collect()}
    assert counts == {"1" * 9: (0, 0, 0, 0, 0), "a.ba.ba.b": (0, 0, 0, 0, 0), "a@a@a@a@a": (0, 0, 0, 0, 0), "1.2.1.2.1": (0, 10_000, 0, 0, 0), "+1" + "(" * 7: (0, 0, 0, 0, 0), "x.y@mail.": (400, 400, 0, 0, 0), "x" * 9: (1, 0, 0, 0, 0), "x@y.z_x@y": (20_000, 0, 0, 0, 0)}
    assert P.detect(no_docs, model).count() == 0 and P.fit(no_docs).weights == {}


def test_columns_of_the_same_names(spark, model):
    df = spark.createDataFrame([(1, "call +1 (212) 555-0100 now", "mine", 7, "kept")], "doc_id long, text string, found string, spans int, found_raw_email0 string")
    (r,) = P.detect(df, model).collect()
    assert (r.found, r.found_raw_email0, r.spans) == ("mine", "kept", "phone:5:22")


def test_candidates_beside_the_base_spans(spark, model):
    good = card(random.Random(3))
    cases = {
        f"call +1 (269) 555-3296 {good} and": ["phone:5:22", f"card:23:{23 + 16}"],
        f"und {good} 38.253.197.126 ein": ["card:4:20", "ip:21:35"],
        "nothing here but 12 words at 3 dot 4": [],
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" of 2024-11-28': [],
        "version 7.5 build 1234567890123456 is out": [],
    }
    rows = {r.text: r.spans.split(",") if r.spans else [] for r in P.detect(spark.createDataFrame([(t,) for t in cases], "text string"), model).collect()}
    assert rows == cases


def plain_em(patterns):
    """The same model with plain loops: a share and three shares a labeler and class."""
    labelers, share = range(len(P.LABELERS)), 0.5
    total = sum(P.PRIOR)
    table = {c: [[v / total for v in (P.PRIOR if c else P.PRIOR[::-1])] for _ in labelers] for c in (1, 0)}

    def likely(votes):
        w = {1: share, 0: 1 - share}
        for c in w:
            for i in labelers:
                w[c] *= table[c][i][1 - votes[i]]
        return w[1] / (w[0] + w[1])

    for _ in range(P.ROUNDS):
        p = [likely(v) for v, _ in patterns]
        for c in (1, 0):
            w = [n * (x if c else 1 - x) for x, (_, n) in zip(p, patterns, strict=True)]
            prior = P.PRIOR if c else P.PRIOR[::-1]
            fresh = [[(sum(x for x, (v, _) in zip(w, patterns, strict=True) if v[i] == 1 - j) + prior[j]) / (sum(w) + total) for j in range(3)] for i in labelers]
            table[c] = fresh
        share = (sum(n * x for x, (_, n) in zip(p, patterns, strict=True)) + 1) / (sum(n for _, n in patterns) + 2)
    return {v: likely(v) for v, _ in patterns}


def test_expectation_maximisation_matches_plain_loops(spark):
    rng = random.Random(6)
    reliability = [0.9, 0.8, 0.6, 0.95, 0.55]
    counts, truth = {}, {}
    for _ in range(3000):
        good = rng.random() < 0.6
        votes = tuple(0 if rng.random() < 0.2 else (1 if good else -1) * (1 if rng.random() < r else -1) for r in reliability)
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(good)
    patterns = sorted(counts.items())
    df = spark.createDataFrame([("ip", list(v), n) for v, n in patterns], "kind string, votes array<int>, n long")
    got = {tuple(r.votes): r.p for r in P.reliabilities(df).collect()}
    want = plain_em(patterns)
    assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) < 1e-9
    right = sum(sum(g == (got[v] > 0.5) for g in goods) for v, goods in truth.items())
    majority = sum(sum(g == (sum(v) > 0) for g in goods) for v, goods in truth.items())
    assert right > majority and right / 3000 > 0.9


def test_no_python_on_the_main_path(spark, model):
    plan = P.detect(spark.createDataFrame([("x",)], "text string"), model)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
