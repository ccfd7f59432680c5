"""Spelling variants against brute force over full neighbourhoods."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from courierlake.llm import spelling_variants as sv

LOWER = str.maketrans(sv.UPPER, sv.UPPER.lower())


def brute(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    alphabet = {c for w in words for c in w}

    def near(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for c in alphabet:
            out |= {w[:i] + c + w[i:] for i in range(len(w) + 1)} | {w[:i] + c + w[i + 1 :] for i in range(len(w))}
        return [x for x in out - {w} if x in words]

    told = {}
    for w, n in words.items():
        found = near(w)
        best = min(((-words[x], x) for x in found), default=None)
        form = best[1] if best and -best[0] >= 2 * n else None
        told[w] = (n, len(found), form, words[form] if form else None)

    def root(w):
        while told[w][2]:
            w = told[w][2]
        return w

    return {w: (*x, root(w)) for w, x in told.items()}


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    assert got(sv.variants(spark.read.parquet(path))) == brute(rows)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    long = "".join(rng.choice("abcdeé") for _ in range(150))
    words = ["aabbcc", "aabbc", "abbcc", "aaabbcc", "aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÿ×÷", "àéÿ×÷", "river", "rivre", "rivers", "revers", "short"]
    words += ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 8))) for _ in range(150)]
    words += [long[:k] for k in (63, 64, 65, 66)] + [long, long[:70] + "x" + long[70:], long[:70] + "x" + long[71:], long[1:], long[:-1], "é" + long]
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(60)]
    rows += [(4, " ".join(words)), (4, " ".join(words)), (5, f"{long[:64]}, {long}? " * 4), (6, None), (7, ""), (8, "1234 ---")]
    return rows


def test_made_words(spark, made):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in made], "doc_id long, text string, word string, n int").repartition(3)
    want = brute(made)
    assert {len(w) for w in want} >= {64, 65, 66, 150, 151} and sum(x[2] is not None for x in want.values()) > 20
    assert got(sv.variants(df)) == want
    assert sv.variants(df.limit(0)).count() == 0


def test_a_very_long_word(spark):
    word = "ab" * 20_000
    df = spark.createDataFrame([(1, f"{word} {word} {word} {word}"), (2, f"{word[1:]} {word[1:]} {word[1:]}")], "doc_id long, text string")
    out = got(sv.variants(df))
    assert {len(w): x[1] for w, x in out.items()} == {40_000: 1, 39_999: 1}


def test_chains_of_forms(spark):
    chain = [("a" * 5 + "b" * k, 3 * 2**k) for k in range(12)]
    words = spark.createDataFrame([(w, n, w) for w, n in chain], "word string, n long, name string")
    out = got(sv.grouped(words))
    assert {x[4] for x in out.values()} == {chain[-1][0]} and out[chain[0][0]][2] == chain[1][0]
