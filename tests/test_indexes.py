"""Text search, substring search, vector cells and range joins against brute force."""

import math
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courierlake.operators import rangejoin, textindex, vectorindex
from courierlake.plans import catalogue

SCHEMA = "doc_id long, text string, term string, block int"


def made(rng, n, first=0):
    words = ["the", "mill", "river", "Stone", "bread", "Über", "x1"] + [f"w{i}" for i in range(300)]
    weights = [40, 9, 6, 4, 2, 2, 1] + [0.3] * 300
    return [(first + i * 37 % (n * 3), " ".join(rng.choices(words, weights, k=rng.randrange(60))), "clash", 1) for i in range(n)]


def brute_scores(rows, query, limit, match_all=False):
    docs = defaultdict(Counter)
    for d, t, *_ in rows:
        if d is not None:
            docs[d].update(re.findall(r"[^\W_]+", (t or "").lower()))
    terms = set(re.findall(r"[^\W_]+", query.lower()))
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = {t: sum(t in c for c in docs.values()) for t in terms}
    out = []
    for d, c in docs.items():
        held = [t for t in terms if c[t]]
        if held and (not match_all or len(held) == len(terms)):
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in held)
            out.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(out)[:limit]]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Two appends, with repeated ids, nulls and empty texts."""
    rng = random.Random(1)
    one = [*made(rng, 3000), (7, "the the mill", "c", 1), (None, "river", "c", 1), (20_001, None, "c", 1), (20_002, "", "c", 1)]
    two = made(rng, 1500, 50_000)
    path = str(tmp_path_factory.mktemp("index"))
    for rows in (one, two):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        textindex.append_words(df, f"{path}/words")
        textindex.append_grams(df, f"{path}/grams")
    return path, one + two


@pytest.mark.parametrize("query, limit, match_all", [("mill", 10, False), ("The MILL, river!", 10, False), ("the mill river stone", 500, False), ("über x1", 5, False), ("w5 w17 none", 20, False), ("the mill river", 10, True), ("mill none", 10, True), ("none", 10, False), ("!", 10, False), ("the", 10_000, False)])
def test_ranked_search(spark, indexed, query, limit, match_all):
    path, rows = indexed
    got = [tuple(r) for r in textindex.search_words(spark, f"{path}/words", query, limit, match_all).collect()]
    assert got == brute_scores(rows, query, limit, match_all)


def shuffled(spark):
    """Rows written to shuffles by the session so far."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("append", [textindex.append_words, textindex.append_grams])
def test_no_row_for_each_word_is_shuffled(spark, tmp_path, append):
    """Rows of documents, and of terms in blocks; not of words or grams in documents."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(100)), "c", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = shuffled(spark)
    append(df, str(tmp_path))
    assert shuffled(spark) - before < 60_000  # words in documents are 300,000


def bytes_shuffled(spark):
    """Bytes written to shuffles by the session so far."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rare_words_are_shuffled_in_streams(spark, tmp_path):
    """A row for each of 180,000 words of one document would be more bytes than the documents."""
    rows = [(i, " ".join(f"w{i * 60 + j:07}" for j in range(60)), "c", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = bytes_shuffled(spark)
    textindex.append_words(df, str(tmp_path))
    assert bytes_shuffled(spark) - before < 1.6 * sum(len(t) for _, t, *_ in rows)  # documents and postings
    assert tuple(spark.read.parquet(f"{tmp_path}/postings").agg(F.sum("n"), F.count("*")).first()) == (180_000, 180_000)


def test_shared_bodies(spark, tmp_path):
    """Messages of the same body score as if each had its own, and postings of bodies do not grow with messages."""
    rng = random.Random(9)
    bodies = [(i, t) for i, t, *_ in made(rng, 60)] + [(-5, None), (-6, "")]
    heads = [(i, rng.choice(bodies)[0], rng.choice(["the mill", "Stone w5", "", None, "x1 x1"])) for i in range(-20, 3000)]
    for part in (heads[:1000], heads[1000:]):  # bodies of a second append are its own
        first = 0 if part[0] == heads[0] else 10_000
        m = spark.createDataFrame([(d, b + first, t) for d, b, t in part], "doc long, body long, text string").repartition(3)
        textindex.append_shared(m, spark.createDataFrame([(b + first, t) for b, t in bodies], "body long, text string"), str(tmp_path))
    whole = dict(bodies)
    rows = [(d, f"{t or ''} {whole[b] or ''}") for d, b, t in heads]
    for query, limit, match_all in (("the mill river stone", 40, False), ("x1 w5 none", 4000, False), ("the mill", 30, True), ("mill none", 5, True), ("!", 5, False)):
        got = [tuple(r) for r in textindex.search_shared(spark, str(tmp_path), query, limit, match_all).collect()]
        assert got == brute_scores(rows, query, limit, match_all)
    assert spark.read.parquet(f"{tmp_path}/bodies/postings").agg(F.sum("n")).first()[0] <= 2 * sum(len(set((t or "").lower().split())) for _, t in bodies)


def test_a_rare_word_reads_little(spark, indexed):
    path, _ = indexed
    rows = textindex.postings_of(spark, f"{path}/words", ["x1"])
    scan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan
    assert "PushedFilters: [" in scan and "term" in scan.split("PushedFilters")[1].split("]")[0]
    every = spark.read.parquet(f"{path}/words/postings")
    assert len(set(rows.inputFiles())) <= len(set(every.inputFiles())) and {r["bucket"] for r in rows.select("bucket").distinct().collect()} == {r["b"] for r in spark.sql("select 'x1' as term").select(textindex.bucket_of(F.col("term")).alias("b")).collect()}


@pytest.mark.parametrize("pattern", ["mill riv", "ÜBER", "w29", "one w", "st", "", "none of these", "e  ", "the the mill"])
def test_substrings(spark, indexed, pattern):
    path, rows = indexed
    got = sorted((r["doc"], r["text"]) for r in textindex.holding(spark, f"{path}/grams", pattern).collect())
    assert got == sorted((d, t or "") for d, t, *_ in rows if d is not None and pattern.lower() in (t or "").lower())


def test_substrings_in_many_blocks(spark, indexed, monkeypatch):
    path, rows = indexed
    monkeypatch.setattr(textindex, "NAMED", 1)
    got = textindex.holding(spark, f"{path}/grams", "mill the").count()
    assert got == sum("mill the" in t.lower() for d, t, *_ in rows if d is not None and t)


def test_a_rare_substring_reads_few_texts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["mill", "river", "stone", "bread"], k=30)), "c", 1) for i in range(20_000)] + [(9_000, "zebra crossing", "c", 1)]
    # a table of this size would be one file with one row group
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        textindex.append_grams(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/grams")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = textindex.holding(spark, f"{tmp_path}/grams", "ZEBRA CROSS")
    assert [r["doc"] for r in found.collect()] == [9_000]
    assert scanned(found)["numOutputRows"] < 20_000 / 2  # of texts and postings together


def test_grams_of_a_long_text(spark, tmp_path):
    """Work in proportion to the text: taking each run from the start of the text costs the square."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh \U0001f600\0É", k=1_500_000))
    rows = [(-1, long), (2**60 + 1, "abc"), (2**60 + 1, "ABCABC"), (3, long[700_000:700_040])]
    started = time.monotonic()
    textindex.append_grams(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/grams")
    assert time.monotonic() - started < 60
    for pattern in (long[700_000:700_030], "ABC", "c\0é", "\0É", "b"):
        got = sorted(r["doc"] for r in textindex.holding(spark, f"{tmp_path}/grams", pattern).collect())
        assert got == sorted(d for d, t in rows if pattern.lower() in t.lower())


@pytest.mark.parametrize("pattern, made", [("m", False), ("ÜB", False), ("#", False), ("", False), ("\U0001f600c", False), ("ill", True)])
def test_a_pattern_without_a_gram_makes_no_index(spark, tmp_path, monkeypatch, pattern, made):
    """Its rows are those of the indexed table, tested in the table itself: nothing is written or shuffled."""
    rows = [(1, "the Mill #"), (1, "über m"), (2, None), (3, ""), (None, "mill #"), (-4, "\U0001f600C"), (2000, "ill")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr("courierlake.scratch.scratch_dir", lambda _: f"file://{tmp_path}/shared")
    before = shuffled(spark)
    got = sorted(tuple(r) for r in catalogue.substring_search(pattern)(spark, f"{tmp_path}/in").collect())
    assert got == sorted((d, len(t or "")) for d, t in rows if d is not None and pattern.lower() in (t or "").lower())
    assert (tmp_path / "shared").exists() == made and (shuffled(spark) > before) == made


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    textindex.append_words(df, f"{tmp_path}/words")
    textindex.append_grams(df, f"{tmp_path}/grams")
    assert textindex.search_words(spark, f"{tmp_path}/words", "the").count() == 0


def neighbours(rows, asked, limit):
    kept = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and not math.isnan(x) for x in v) and any(v)]
    out = {}
    for i, q in ((i, v) for i, v in kept if i in asked):
        told = sorted((-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 6), j) for j, v in kept)[:limit]
        out[i] = [(j, -s + 0.0) for s, j in told]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(2)
    centres = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.6) for x in rng.choice(centres)]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]  # a hot vector
    return rows + [(3000, None), (3001, [0.0] * 8), (3002, [1.0]), (3003, [float("nan")] * 8), (3004, [None] * 8)]


def by_query(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["query"]].append((r["vec_id"], r["cosine"]))
    return {q: sorted(v, key=lambda x: (-x[1], x[0])) for q, v in out.items()}


@pytest.mark.parametrize("part", [vectorindex.PART, 64])
def test_vector_cells(spark, vectors, tmp_path, monkeypatch, part):
    monkeypatch.setattr(vectorindex, "PART", part)
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, cell int").repartition(3)
    asked = df.where("vec_id % 50 = 0")
    truth = neighbours(vectors, {i for i, _ in vectors if i % 50 == 0}, 10)
    assert by_query(vectorindex.exact(df, asked)) == truth
    vectorindex.build(df, f"{tmp_path}/cells")
    assert by_query(vectorindex.search(spark, f"{tmp_path}/cells", asked, probe=10_000)) == truth  # all cells: exact
    few = by_query(vectorindex.search(spark, f"{tmp_path}/cells", asked))
    assert sum(len({i for i, _ in few[q]} & {i for i, _ in t}) for q, t in truth.items()) >= 0.9 * sum(map(len, truth.values()))


def test_a_part_is_compared_in_steps():
    """Memory of a task: 2,000 queries against a part of 4,096, ties and all, in less than their table of cosines (66 MB)."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(vectorindex.PART, 8))
    v[100:2000] = v[100]  # equal vectors, of which the smallest ids count
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = rng.permutation(vectorindex.PART)
    stored, asked = pd.DataFrame({"vec_id": ids, "v": list(v)}), pd.DataFrame({"query": np.arange(2000), "q": list(v[:2000])})
    tracemalloc.start()
    got = vectorindex.best_of(asked, stored, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2000 * vectorindex.PART * 8 and len(got) == 20_000
    by_id = v[np.argsort(ids)]
    for q in (0, 150, 1999):
        cosine = np.round(by_id @ v[q], 6)
        assert got[got["query"] == q]["vec_id"].tolist() == np.lexsort((np.arange(len(ids)), -cosine))[:10].tolist()


def test_empty_vectors(spark, tmp_path):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    vectorindex.build(df, f"{tmp_path}/cells")
    assert vectorindex.search(spark, f"{tmp_path}/cells", df).count() == 0 and vectorindex.exact(df, df).count() == 0


def test_range_joins(spark):
    rng = random.Random(3)
    ranges = [(i, low := rng.choice([rng.randrange(-500, 500), 40]), low + rng.choice([-3, 0, 1, 2, 7, 8, 100, 3000])) for i in range(300)] + [(900, None, 3), (901, 3, None), (902, -(2**40), 2**40), (903, 40, 40), (903, 40, 40)]
    points = [(i, rng.choice([rng.randrange(-600, 600), 40])) for i in range(300)] + [(900, None)]
    r = spark.createDataFrame(ranges, "r long, low long, high long").repartition(2)
    p = spark.createDataFrame(points, "p long, at long").repartition(2)
    joined = rangejoin.points_in_ranges(p, r, "at", "low", "high")
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()
    assert Counter((x["p"], x["r"]) for x in joined.collect()) == Counter((i, j) for i, at in points for j, low, high in ranges if None not in (at, low, high) and low <= at <= high)
    most = rangejoin.with_bins(r, "low", "high").groupBy("r", "low", "high").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 2  # two bins for each row; one range is there twice
    other = [(i, low, low + rng.choice([0, 1, 5, 60])) for i, low in ((i, rng.randrange(-500, 500)) for i in range(200))]
    o = spark.createDataFrame(other, "o long, b long, y long")
    got = Counter((x["r"], x["o"]) for x in rangejoin.overlaps(r, o, ("low", "high"), ("b", "y")).collect())
    assert got == Counter((i, j) for i, a, z in ranges for j, b, y in other if None not in (a, z) and a <= z and b <= y and a <= y and b <= z)
    assert rangejoin.points_in_ranges(p, r.limit(0), "at", "low", "high").count() == 0


def test_counts_of_pairs(spark):
    """The same counts as from all pairs, of which there are too many here to make (16 thousand million)."""
    rng = random.Random(4)
    points = [(rng.choice("xy"), rng.choice([5, 5, 9, 30, None])) for _ in range(400)] + [(None, 5)]
    ranges = [(rng.choice("fg"), low, low + rng.choice([-1, 0, 3, 40])) for low in (rng.randrange(-5, 12) for _ in range(400))] + [("f", None, 9), (None, 5, 5)]
    p, r = spark.createDataFrame(points, "p string, at long"), spark.createDataFrame(ranges, "r string, low long, high long")
    args = ("at", "low", "high")
    want = Counter((a, b) for a, at in points for b, low, high in ranges if None not in (at, low, high) and low <= at <= high)
    assert {(x["p"], x["r"]): x["pairs"] for x in rangejoin.paired_counts(p, r, *args, "p", "r").collect()} == want
    times = spark.range(1000).select(F.col("id").alias("n"))
    many = rangejoin.paired_counts(p.crossJoin(times), r.crossJoin(times), *args, "p", "r")
    assert {(x["p"], x["r"]): x["pairs"] for x in many.collect()} == {k: n * 1_000_000 for k, n in want.items()}
    left = [(i % 50, low, high) for i, (_, low, high) in enumerate(ranges)]
    right = [(i, b, b + rng.choice([-2, 0, 7])) for i, b in enumerate(rng.randrange(-9, 50) for _ in range(100))]
    told = rangejoin.overlap_counts(spark.createDataFrame(left, "k long, a long, z long"), spark.createDataFrame(right, "v long, b long, y long"), ("a", "z"), ("b", "y"), "k", "v")
    pairs = defaultdict(list)
    for k, a, z in left:
        pairs[k] += [v for v, b, y in right if a is not None and a <= z and b <= y and a <= y and b <= z]
    assert {x["k"]: (x["pairs"], x["least"]) for x in told.collect()} == {k: (len(v), min(v)) for k, v in pairs.items() if v}


def test_recall_of_the_table(spark):
    row = catalogue.queries()["vector_cells_recall"](spark, "/root/testdata/sf0.01").first()
    assert row["reached"] and row["wanted"] == 100


def scanned(df):
    """Files and rows that the scans of a query read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, found = [plan], {"numFiles": 0, "numOutputRows": 0}
    while leaves:
        node = leaves.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            leaves.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            leaves.append(node.plan())
            continue
        children = node.children()
        leaves += [children.apply(i) for i in range(children.size())]
        if kind == "FileSourceScanExec":
            for name in found:
                found[name] += node.metrics().apply(name).value()
    return found


def test_lookups_read_little(spark, tmp_path):
    from courierlake.operators import lookup, retrieval
    from courierlake.plans.emails import emails

    e = emails(spark, "/root/testdata/sf0.001").select(*[c for c in emails(spark, "/root/testdata/sf0.001").columns if c not in ("plain_text", "markdown", "raw")])
    path = str(tmp_path / "days")
    lookup.append(e, path)
    whole = scanned(lookup.read(spark, path))
    assert whole["numOutputRows"] == e.count() and whole["numFiles"] >= 20
    first, last = 1704412800, 1704672000
    few = retrieval.get_emails_by_date_range(lookup.read(spark, path, first, last), "2024-01-05", "2024-01-08")
    read = scanned(few)
    assert 0 < read["numFiles"] <= 6 < whole["numFiles"] and read["numOutputRows"] < whole["numOutputRows"] / 4
    thread = retrieval.get_email_thread(lookup.read(spark, path), x_gm_thrid="1203")
    want = sorted(map(str, retrieval.get_email_thread(e, x_gm_thrid="1203").collect()))
    assert scanned(thread)["numOutputRows"] < whole["numOutputRows"] / 2 and sorted(map(str, thread.collect())) == want and want
    assert scanned(lookup.read(spark, path).where("message_id = 'none'"))["numOutputRows"] < whole["numOutputRows"] / 10


def test_lookups_copy_no_bodies(spark, tmp_path):
    """The copy grows with the number of messages, not with their texts."""
    from courierlake.operators import lookup, retrieval
    from courierlake.plans.emails import emails

    e = emails(spark, "/root/testdata/sf0.001")
    lookup.append(e, str(tmp_path / "days"))
    stored = lookup.read(spark, str(tmp_path / "days"))
    assert set(stored.columns) == set(e.columns) - {"raw", "plain_text", "markdown"} and stored.count() == e.count()
    assert retrieval.get_email_thread(stored, x_gm_thrid="1203").collect() == retrieval.get_email_thread(e, x_gm_thrid="1203").collect()
    ends = {"start_date": "2024-01-05", "end_date": "2024-01-20"}
    assert retrieval.get_emails_by_date_range(stored, **ends).collect() == retrieval.get_emails_by_date_range(e, **ends).collect()


def test_filters_of_lookups_are_as_large_as_their_values_need(spark, tmp_path):
    """Days of few messages have no filters for 20,000 values; a row group with as many has filters that tell."""
    from courierlake.operators import lookup

    def stored(name, n, seconds):
        path = tmp_path / name
        rows = spark.range(n).selectExpr("id", f"id * {seconds} AS internaldate_epoch", "concat('m', id) AS message_id", "concat('u', id) AS from_email", "id AS x_gm_thrid", "id AS x_gm_msgid")
        lookup.append(rows.coalesce(1), str(path))
        return lookup.read(spark, str(path)), len(list(path.glob("day=*"))), sum(f.stat().st_size for f in path.rglob("*.parquet"))

    many, days, size = stored("many", 200, 43_200)
    assert days == 100 and size < 100 * 20_000 and many.count() == 200
    one, days, _ = stored("one", 20_000, 4)
    assert days == 1 and scanned(one)["numOutputRows"] == 20_000
    # names between the least and the greatest of a row group
    assert sum(scanned(one.where(f"message_id = 'm{i}x'"))["numOutputRows"] for i in range(1000, 2000, 50)) <= 2 * 20_000
    assert [one.where(f"message_id = 'm{i}' AND x_gm_thrid = {i}").count() for i in (0, 7, 19_999)] == [1] * 3


def test_lateral_plan(spark):
    plan = catalogue.queries()["join_lateral"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
