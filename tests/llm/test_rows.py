"""Rows that repeat a doc_id, in the operators that cut text out of documents, held by digest against brute force; scratch tables of calls side by side."""

import hashlib
import random
import re
import threading
from collections import Counter

import pytest

import corpus_pipeline
from courierlake.llm import bwt_dedup, cover_dedup
from courierlake.llm.shared import scratch_dir, settled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60)) + " end"


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def brute_words(rows):
    """Digests of each row's kept words: a window goes if a smaller doc_id has it, or the row itself earlier."""
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 19):
            q = tuple(w[k : k + 20])
            if d is not None:
                first[q] = min(first.get(q, d), d)
    out = []
    for d, t in rows:
        w, own = WORD.findall(t or ""), set()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            q = tuple(w[k : k + 20])
            if d is not None and (first[q] < d or q in own):
                gone[k : k + 20] = [True] * 20
            own.add(q)
        out.append((d, sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return Counter(out)


def brute_bytes(rows, characters=False):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if d is not None:
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if d is not None and first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        if characters:
            at = 0
            for c in t or "":
                n = len(c.encode())
                if any(gone[at : at + n]):
                    gone[at : at + n] = b"\1" * n
                at += n
        out.append((d, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return Counter(out)


def repeats():
    rng = random.Random(3)
    rows = [(1, A), (5, A), (5, B), (None, A), (7, None), (7, ""), (7, B), (7, B), (8, B + " " + A), (8, A + " " + A), (8, A + " " + A)]
    shared = [" ".join(rng.choice(["alpha", "beta", "gamma", "é", "ü"]) + str(rng.randrange(9)) for _ in range(30)) for _ in range(6)]
    for _ in range(60):
        rows.append((rng.randrange(9, 16), " ".join([rng.choice(shared), f"own{rng.randrange(40)}", rng.choice(shared)])))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in repeats()], "doc_id long, text string, twin string, again int").repartition(3)


def test_words_of_rows_that_repeat_an_id(spark, table):
    got = Counter((r["doc_id"], r["kept_sha256"]) for r in cover_dedup.remove_repeats_digest(table).collect())
    assert got == brute_words(repeats())


@pytest.mark.parametrize("hot", [bwt_dedup.HOT, 1])
def test_bytes_of_rows_that_repeat_an_id(spark, table, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    got = Counter((r["doc_id"], r["kept_sha256"]) for r in bwt_dedup.remove_common_digest(table).collect())
    assert got == brute_bytes(repeats())


def test_whole_characters_go(spark, table):
    got = Counter((r["doc_id"], sha(bytes(r["kept"]))) for r in bwt_dedup.remove_common(table, characters=True).collect())
    assert got == brute_bytes(repeats(), characters=True)


def test_nothing_goes_that_no_other_document_has(spark):
    df = spark.createDataFrame([(1, A), (5, A), (5, B)], "doc_id long, text string")
    kept = {(r["doc_id"], bytes(r["kept"])) for r in cover_dedup.remove_repeats(df).collect()}
    assert kept == {(1, A.encode()), (5, b""), (5, B.encode())}
    kept = {(r["doc_id"], bytes(r["kept"])) for r in bwt_dedup.remove_common(df).collect()}
    assert kept == {(1, A.encode()), (5, b""), (5, B.encode())}


def test_many_equal_rows_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.range(5000).selectExpr("cast(3 as long) as doc_id", f"'{text}' as text").repartition(8)
    assert {(r["n_removed"], r["kept_sha256"]) for r in cover_dedup.remove_repeats_digest(df).collect()} == {(0, sha(text.encode()))}
    got = bwt_dedup.remove_common_digest(df).collect()
    assert len(got) == 5000 and {(r["n_removed"], r["kept_sha256"]) for r in got} == {(0, sha(text.encode()))}


def test_pipeline_stages_by_row(spark, tmp_path):
    item = "How many grams of salt does the old mill by the river sell in seven winter weeks to the people of the town"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sign = f"bad � sign {A} é"
    docs = spark.createDataFrame([(1, A, "en", "s", 1), (2, sign, "en", "s", 2), (5, A, "en", "s", 3), (5, B, "en", "s", 4)], schema)
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.common_strings(spark, docs, str(tmp_path)).collect()}
    assert got == {(1, A), (2, "bad � sign  é"), (5, ""), (5, B)}
    docs = spark.createDataFrame([(1, f"{B} {item} {A}", "en", "s", 1), (1, B, "en", "s", 2), (None, item, "en", "s", 3)], schema)
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()}
    assert got == {(1, B), (None, item)}


def test_calls_side_by_side_leave_each_other_alone(spark, table):
    done, wait = {}, threading.Barrier(2)

    def run(name, make):
        def begun():
            wait.wait()
            return make()

        done[name] = Counter((r["doc_id"], r["kept_sha256"]) for r in settled(spark, begun).collect())

    both = [threading.Thread(target=run, args=x) for x in (("words", lambda: cover_dedup.remove_repeats_digest(table)), ("bytes", lambda: bwt_dedup.remove_common_digest(table)))]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert done == {"words": brute_words(repeats()), "bytes": brute_bytes(repeats())}


def test_scratch_goes_when_a_call_fails(spark, table):
    from pathlib import Path

    folder = Path(scratch_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())

    def fails():
        cover_dedup.remove_repeats_digest(table)
        raise ValueError("no")

    with pytest.raises(ValueError):
        settled(spark, fails)
    assert set(folder.iterdir()) == before
