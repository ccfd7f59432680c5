"""Personal data: base spans against Python's patterns, expectation-maximisation against planted reliabilities, added spans by hand."""

import hashlib
import random
import re
from collections import Counter

import pytest

from courierlake.llm import pii_spans as ps

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(figures):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(figures)))) % 10 == 0


def passes(kind, what):
    figures = re.sub("[^0-9]", "", what)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in what.split("."))
    return 12 <= len(figures) <= 19 and luhn(figures) if kind == "card" else 9 <= len(figures) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(found)


def held(rows, got):
    """Base counts and digests as told, base spans among all spans."""
    for text, r in zip(rows, got, strict=True):
        want = brute(text)
        shown = [f"{kind}:{a}:{z}" for a, _, z, kind in want]
        counts = Counter(kind for *_, kind in want)
        assert tuple(r[f"n_{k}"] for k in PATTERNS) == tuple(counts[k] for k in PATTERNS), text
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest(), text
        assert set(shown) <= set(r["spans"].split(",")) | {""}


def ordered(df):
    return sorted(df.collect(), key=lambda r: r["doc_id"])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    held([r["text"] for r in rows], ordered(ps.digests(ps.find(docs))))


HARD = [
    "a@b.c@d.e", "a@b@d.e", "a@b.c._x@d.e", "a@b..c", "a@b.", "x.@y.z.", "a@b.c.@x.y", ".@a.b", "é@a.b ü@x-.y", "a" * 300 + "@" + "b." * 300 + "c",
    "1.2.3.4.5.6.7.8", "0255.1.01.000", "256.1.1.1", "1.1.1.256 1.1.1.1", "00000000000000000000000000000000000000000255.0.0.1", "9" * 60 + ".1.1.1", "1..2.3.4",
    "4111 1111 1111 1111", "4111  1111 1111 1111", "4111-1111-1111-1111-", "4111 1111 1111 1112", "0" * 12, "0" * 20, "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "5500000000000004x378282246310005", "😀4111111111111111😀 4111111111111111",
    "+1 (555) 123-4567", "+1 (555) 123-4567)", "+12", "+123", "++49 30 1234567", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+49 30 1234567...", "+49 (0)30/1234567", "+4" + " " * 50 + "912345678",
    "", None, "5 " * 5000, "+1 (555) 123-4567 " * 700, "1" * 100_000, "a@" * 2000, "." * 5000 + "@x.y", "1.1.1.1" * 900, "4111111111111111 " * 700,
]


def test_hard_texts(spark):
    rng = random.Random(2)
    made = ["".join(rng.choice("01239.-+@ ()aé") for _ in range(rng.randrange(60))) for _ in range(1500)]
    made += ["".join(rng.choice(["12", "4111 1111", " ", "-", ".", "@", "a", "+1", "(", ")", "9"]) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts = HARD + made
    df = spark.createDataFrame([(i, t, "clash", "c") for i, t in enumerate(texts)], "doc_id long, text string, spans string, base string").repartition(4)
    held(texts, ordered(ps.digests(ps.find(df))))


def test_rows(spark):
    df = spark.createDataFrame([(None, "a@b.co"), (1, "a@b.co"), (1, "a@b.co"), (1, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["spans"]) for r in ps.digests(ps.find(df)).collect())
    assert got == {(None, "email:0:6"): 1, (1, "email:0:6"): 2, (1, ""): 1}
    assert ps.digests(ps.find(df.limit(0))).count() == 0
    assert ps.find(spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")).collect()[0]["spans"] == []


MARKED = [
    ("Please call me at {(212) 555-0187} or tel. {415-555-2671} today", "phone"),
    ("phone: {0044 20 7946 0958} after six", "phone"),
    ("write to {jane (at) example (dot) org} now", "email"),
    ("mail {bob at acme dot com} please", "email"),
    ("server {2001:0db8:85a3:0000:0000:8a2e:0370:7334} is up", "ip"),
    ("card {4111.1111.1111.1111} ok", "card"),
    ("my visa card number is {4111 1111 1111 1112}", "card"),
    ("order 123-456-7890 shipped", ""),
    ("look at home. The dot is small", ""),
    ("the number 9870157079875996 of the list", ""),
    ("of nt 0054994038693466 the", ""),
    ("section 111-222-3333 of part 4", ""),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" with', ""),
]


def test_added_spans(spark):
    texts = [re.sub("[{}]", "", t) for t, _ in MARKED]
    found = ordered(ps.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for (marked, kind), text, r in zip(MARKED, texts, found, strict=True):
        want = [(kind, m) for m in re.findall(r"\{([^}]*)\}", marked)]
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] == want, text
        assert all(not s["base"] and s["probability"] >= ps.LEAST_PROBABILITY for s in r["spans"])


def test_reliabilities_are_found():
    rng = random.Random(4)
    trust = [0.95, 0.85, 0.7, 0.9, 0.6]  # how often a labeler that votes is right; each abstains in a third
    counts, truth = Counter(), {}
    for _ in range(20_000):
        y = rng.random() < 0.3
        pattern = 0
        for t in trust:
            v = 1 if rng.random() < 1 / 3 else (2 if y == (rng.random() < t) else 0)
            pattern = 3 * pattern + v
        counts[pattern] += 1
        truth.setdefault(pattern, []).append(y)
    right, rates = ps.expectation_maximisation(dict(counts))
    for t, (wrong, good) in zip(trust, rates):
        assert abs(good[2] / (good[0] + good[2]) - t) < 0.04 and abs(wrong[0] / (wrong[0] + wrong[2]) - t) < 0.04
    hits = sum((right[p] >= 0.5) == y for p, ys in truth.items() for y in ys)
    assert hits / 20_000 > 0.9


@pytest.mark.parametrize("sizes", [[], [3], [1, 2, 3], list(range(1000))])
def test_running_sums(spark, sizes):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(sizes,)], "sizes array<int>")
    assert df.select(ps.running(F.col("sizes")).alias("x")).collect()[0]["x"] == [sum(sizes[:i]) for i in range(len(sizes))]
