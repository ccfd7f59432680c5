"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import io
import os
import re
import zlib
from collections import Counter

import pytest

from courierlake.llm import bpe_sentencepiece, bwt_dedup, chat_spans, cover_dedup, decontaminate, html_blocks, ngram_join, quality_fm, quality_rules, warc_normalise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the river of stones runs to the old mill and a man in grey was on his way for it that is said by the people who live there all year with their sheep"
LONG = " ".join(f"w{i * i % 9973}" for i in range(6000))
TEXTS = {
    0: PROSE + " " + LONG[:900],
    1: PROSE,
    2: None,
    3: "",
    4: PROSE.replace("grey", "blue"),
    5: "intro " + PROSE + " outro\n" + PROSE,
    6: LONG,
    7: LONG[100:20000] + " é ü " + LONG[:300],
    8: "a b c",
    9: "a  b\tc",
    10: "x " * 400,
    11: PROSE,
    12: "!!! ### " * 90,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, 1, "clash", "clash", "clash") for i, t in TEXTS.items()] + [(None, PROSE, None, None, None, None, None, None), (1, PROSE, "en", None, 1, "c", "c", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, words string, place string").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def same(got, want):
    assert set(got) == {*want, None}
    assert {k: v for k, v in got.items() if k is not None} == want


def test_cover_meets_every_difference():
    d = cover_dedup.COVER
    assert {(a - b) % cover_dedup.PERIOD for a in d for b in d} == set(range(cover_dedup.PERIOD))


def test_repeated_windows(docs):
    seen, want = set(), {}
    for i in sorted(TEXTS):
        w = WORD.findall(TEXTS[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            q = tuple(w[k : k + 20])
            if q in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(q)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = by_id(cover_dedup.remove_repeats_digest(docs))
    same({k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()}, want)


def brute_bytes():
    seen, want = set(), {}
    for i in sorted(TEXTS):
        b = (TEXTS[i] or "").encode()
        gone, own = bytearray(len(b)), set()
        for k in range(len(b) - 49):
            own.add(b[k : k + 50])
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= own
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize("hot", [bwt_dedup.HOT, 1, 2])
def test_common_bytes(docs, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    got = by_id(bwt_dedup.remove_common_digest(docs))
    same({k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()}, brute_bytes())


def test_interval_flags():
    import numpy as np

    pieces = [b"abcabcabd", b"xxabcabq", b"zzz", b"abcabcabd"]
    docs = np.array([5, 3, 1, 2])
    flags = bwt_dedup.flags(pieces, docs, least=4)
    for p, d, mask in zip(pieces, docs, flags):
        want = [any(p[i : i + 4] in q for q, e in zip(pieces, docs) if e < d) for i in range(len(p) - 3)]
        assert [bool(mask >> i & 1) for i in range(len(p) - 3)] == want


def grams(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 1])
def test_jaccard(docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    g = {i: grams(t) for i, t in TEXTS.items()}
    root = {i: i for i in g}
    links = Counter()
    for i in g:
        for j in g:
            one = g[i] | g[j]
            if i < j and ((one and 5 * len(g[i] & g[j]) >= 4 * len(one)) or not one):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    got = by_id(ngram_join.jaccard_classes(docs))
    assert {k: (r["class_id"], r["n_links"]) for k, r in got.items() if k is not None} == {i: (root[i], links[i]) for i in g}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark):
    rounds = []
    found = ngram_join.components(spark.range(4000).selectExpr("id as a", "id + 1 as b"), rounds)
    assert found.where("root = 0").count() == 4000 and len(rounds) <= 20


def thue_morse(n, zero, one):
    """Two sequences that polynomials modulo a power of two cannot tell apart, whatever their multiplier."""
    return tuple(" ".join((one if bin(i).count("1") + flip & 1 else zero) for i in range(n)) for flip in (0, 1))


def test_hashes_tell_thue_morse_sequences_apart(spark):
    one, other = thue_morse(1024, "to", "be")
    long_one, long_other = (x.replace(" ", "") for x in thue_morse(1024, "a", "b"))
    tail = " " + " ".join(f"t{i}" for i in range(19))
    rows = spark.createDataFrame([(1, one), (2, other), (3, long_one + tail), (4, long_other + tail)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.jaccard_classes(rows).collect()}
    assert got[2]["rep"] == 2
    assert {r["doc_id"]: r["n_removed"] for r in cover_dedup.remove_repeats_digest(rows).where("doc_id > 2").collect()} == {3: 0, 4: 0}


def test_jaccard_keeps_rows_that_repeat_an_id(spark):
    near = PROSE.replace("grey", "blue")
    texts = [(1, PROSE), (1, "another text of one two three four words that has its own row"), (5, near + " x"), (5, near + " x"), (9, "another text of one two three four words that has its own row")]
    got = ngram_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["rep"], r["n_links"], r["first"], r["rows"]) for r in got if r["doc_id"] != 1) == [(5, 5, 5, 0, True, 2), (5, 5, 5, 0, True, 2), (9, 1, 1, 1, False, 1)]
    assert sorted(r["n_links"] for r in got if r["doc_id"] == 1) == [0, 1]


def test_jaccard_of_rows_that_repeat_often(spark):
    near = PROSE.replace("grey", "blue")
    rows = [(1, PROSE)] * 300 + [(2, near)] * 200 + [(3, near + " x")]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    g = {i: grams(t) for i, t in set(rows)}
    linked = {i: sum(5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j]) for j in g if j != i) for i in g}
    assert Counter((r["doc_id"], r["n_links"], r["rows"]) for r in got) == {(1, linked[1], 300): 300, (2, linked[2], 200): 200, (3, linked[3], 1): 1}


def test_jaccard_recall(spark):
    """Links of documents with ids divisible by 50, by brute force over all rows of the table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    g = {r["doc_id"]: grams(r["text"]) for r in docs.collect()}
    links = {i: sum(bool(g[i] | g[j]) and 5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j]) or g[i] == g[j] for j in g if j != i) for i in g if i % 50 == 0}
    got = by_id(ngram_join.jaccard_classes(docs))
    assert sum(got[i]["n_links"] for i in links) >= 0.99 * sum(links.values()) > 0
    assert all(got[i]["n_links"] <= n for i, n in links.items())


@pytest.mark.parametrize("rows", [1, 300])
def test_one_hot_line(spark, monkeypatch, rows):
    """A line in all documents, with other neighbours in each."""
    monkeypatch.setattr(bwt_dedup, "HOT", 16)
    line = "this very line of eighty characters stands in each of the documents of the table"
    texts = {i: f"{i * 7919 % 104729} before it {line} {i * 104729 % 7919} after it " + "z" * (i % 3) for i in range(rows)}
    seen, want = set(), {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        windows = [t[k : k + 50] for k in range(len(t) - 49)]
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(windows)
        want[i] = hashlib.sha256("".join(c for c, x in zip(t, gone) if not x).encode()).hexdigest()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["kept_sha256"] for r in bwt_dedup.remove_common_digest(df).collect()} == want


@pytest.mark.parametrize("operator", [cover_dedup.remove_repeats_digest, bwt_dedup.remove_common_digest, ngram_join.jaccard_classes])
def test_empty_tables(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_band_shape_reaches_recall():
    b, r = ngram_join.band_shape()
    assert 1 - (1 - 0.8**r) ** b >= ngram_join.RECALL


def test_decontamination(spark):
    item = "If a train leaves Boston at 40 km per hour and 40 km later it stops, how long did the driver need to reach the station of the town?"
    other = item.replace("40", "65").replace("Boston", "Lisbon")
    mixed = item.replace("40 km per", "65 km per").replace("40 km later", "70 km later")
    docs = spark.createDataFrame([(1, f"Some words first. {item} And more."), (2, f"Some words first. {other} And more."), (3, PROSE), (4, None), (5, ""), (None, item), (6, "Before. Short one here. After."), (7, mixed)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "Short one here"), (12, None), (13, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert {(1, 10), (2, 10), (6, 11)} <= got and not {d for d, _ in got} & {3, 4, 5, None}
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_judges_each_occurrence(spark):
    item = "If a train leaves Boston at 40 km per hour and 55 minutes later it stops, how long did the driver Miller need to reach the station of the town?"
    variants = [item.replace("40", n).replace("55", m).replace("Boston", c).replace("Miller", d) for n, m, c, d in (("65", "12", "Lisbon", "Jones"), ("70", "31", "Madrid", "Smith"))]
    again = "So Ann has 3 red apples and Bob has 4 red apples and Cid has 5 red apples and Dan has 6 red apples in all"
    docs = spark.createDataFrame([(1, f"Before. {item} Then. {variants[0]} After."), (2, f"Sheet. {' Next. '.join(variants)} End."), (3, f"Before. {again} After."), (4, PROSE)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, spark.createDataFrame([(10, item), (11, again)], "item_id long, text string")).collect()}
    assert set(got) == {(1, 10), (2, 10), (3, 11)}
    assert all(r["consistent"] == 1 and r["n_found"] == r["n_windows"] for r in got.values())


def test_decontamination_of_items_rich_in_slots(spark):
    series = "12 15 18 21 24 27 30 33 what comes next"
    names = "Invited are Alice Bob Carol Dave Eve Frank Grace Heidi Ivan Judy"
    mixed = "the box of Ann Bob Cid Dan Eve Fay holds the red stones and the old coins that were lost by the sea"
    changed = mixed.replace("Ann Bob Cid Dan Eve Fay", "Kim Leo Max Ned Oda Pia")
    docs = spark.createDataFrame([(1, f"Some words first: {series}? And more."), (2, f"Some words first. {names}. And more."), (3, PROSE), (4, "1 2 3 4 5 6 7 8 9 10 11 12 what"), (5, f"Before. {changed}. After.")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, series), (11, names), (12, mixed)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 10), (2, 11), (5, 12)}


def test_items_that_say_nothing_match_nothing(spark):
    docs = spark.createDataFrame([(1, "It weighed 3 kg and cost 42 in all. Yes, it did."), (2, PROSE), (3, "the capital of France")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "42"), (2, "5 kg"), (3, "Yes"), (4, "12 kg 13"), (5, "The capital of France")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(3, 5)}


def test_decontamination_of_repeats_and_clashing_columns(spark):
    item = "How many of the 14 red stones did the old miller of the valley keep for the winter that year?"
    rows = [(1, PROSE, 1, 1, "x", "x"), (1, f"Before. {item} After.", 1, 1, "x", "x"), (1, f"Before. {item} After.", 1, 1, "x", "x"), (2, LONG * 8 + f" {item} " + LONG * 8, 2, 2, "y", "y"), (3, None, 3, 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, c_id long, h string, hits string").repartition(3)
    bench = spark.createDataFrame([(7, item, 1, "h"), (7, item, 2, "h"), (7, "another question of nine words that nobody has asked", 3, "h")], "item_id long, text string, doc_id long, place string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and all(r["n_found"] == r["n_windows"] for r in got.values())


def plain_leaks(texts, items):
    """Items whose words (without marks and case) stand in a text word for word."""
    bare = {i: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " " for i, t in texts.items()}
    return {(d, i) for i, q in items.items() for d, t in bare.items() if len(q.split()) >= 3 and " " + " ".join(re.findall(r"[^\W_]+", q.lower())) + " " in t}


def test_decontamination_finds_every_verbatim_item(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_leaks({r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["item_id"]: r["text"] for r in bench.collect()})
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert want and want <= got and len(got) <= len(want) + 2


def test_decontamination_without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"{i} " + PROSE) for i in range(40)], "doc_id long, text string")
        assert decontaminate.leaks(docs, spark.createDataFrame([(4, PROSE)], "item_id long, text string")).count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_tables_go(spark):
    import glob

    from courierlake.llm import queries, shared

    base = shared.scratch_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{base}/*"))
    for name in ("op1_template_leaks", "op8_ngram_jaccard", "op10_warc_normaliser"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert len(set(glob.glob(f"{base}/*")) - before) == 3


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from courierlake.llm import shared

    class Session:
        def __init__(self, master):
            self.said = {"spark.master": master}
            self.conf = self

        def get(self, key, default=None):
            return self.said.get(key, default)

        def set(self, key, value):
            self.said[key] = value

    with pytest.raises(RuntimeError):
        shared.scratch_dir(Session("spark://host:7077"))
    local = Session("local[4]")
    assert shared.scratch_dir(local) == shared.scratch_dir(local)


def test_quality_rules(docs):
    got = by_id(quality_rules.quality_rules(docs))
    for i, t in TEXTS.items():
        w = WORD.findall(t or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert got[1]["kept"] and not got[12]["kept"]
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    # fewer than 50 words of junk fail too: the guard is a minimum length, not a pass
    junk = quality_rules.quality_rules(docs.sparkSession.createDataFrame([(1, " ".join(f"###{i}" for i in range(49)))], "doc_id long, text string")).first()
    assert not junk["base_failed"] and not junk["kept"]


def test_bpe_equals_ranks():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe_sentencepiece.codec(path, p.PATTERN)
    import numpy as np

    for t in ["", "a" * 3000, "\x1c\x1d a\x1fb", "▁▁ x▁", "日本語🎉", "  \n\n x", "<unk> </s>", "é\x00 'LL", *filter(None, TEXTS.values())]:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == own.encode_ordinary(t)
        assert c.decode(c.encode(t)) == t.encode()
    assert all(len(t) <= bpe_sentencepiece.LONG for t in c.cache)


def test_classifier(spark):
    good = [(i, f"{PROSE} number {i}", 1) for i in range(0, 120, 2)]
    bad = [(i, f"!!! ### BUY {i} " * 20, 0) for i in range(1, 120, 2)]
    rows = spark.createDataFrame([*good, *bad, (500, None, None), (None, PROSE, 1)], "doc_id long, text string, quality int")
    got = by_id(quality_fm.classify(rows.drop("quality"), rows.select("doc_id", "quality")))
    held = [(got[i]["score"], q) for i, _, q in good + bad if got[i]["held_out"]]
    assert held and all((s >= 0.7) == bool(q) for s, q in held)
    assert 0 <= got[500]["score"] <= 1
    assert quality_fm.classify(rows.drop("quality").limit(0), rows.select("doc_id", "quality").limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [(r["predicted"], told[r["doc_id"]]) for r in quality_fm.classify(docs, labels).collect() if r["held_out"] and r["doc_id"] in told]
    assert len(got) > 50 and sum(a == b for a, b in got) >= 0.95 * len(got)


def test_classifier_rows(spark):
    rows = [(1, PROSE, "c", 9), (1, "other", "c", 9), (1, PROSE, "c", 9), (2, None, None, None), (3, "", None, None), (4, "x" * 3_000_000 + " y", "c", 9), (None, "a b", "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, quality long").repartition(3)
    labels = spark.createDataFrame([(1, 1, "c"), (1, 0, "c"), (4, 0, "c"), (2, None, "c"), (None, 1, "c"), (77, 1, "c")], "doc_id long, quality int, text string")
    got = quality_fm.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality_fm.classify(docs, labels.limit(0)).where("score != 0.5").count() == 0


def test_sum_of_squares():
    import numpy as np

    rng = np.random.default_rng(1)
    assert quality_fm.FEATURES == quality_fm.BUCKETS + quality_fm.STRUCTURE + quality_fm.METADATA
    m = quality_fm.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = rng.normal(size=9)
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(9) for j in range(i))
    assert abs(m.raw(np.arange(9), x) - (0.3 + m.linear @ x + pairs)) < 1e-9


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><header>Site</header>
    <div class="cookie-notice">We use cookies on this site.</div><aside>Other</aside><main><article><h1>A &amp; B</h1><p><b>One<br>two &lt;x&gt;
    <p>Die.</p><script>var a="</p>";</script><form>Name <input></form><!-- no --><p>Last</p></article><section class="comments"><p>First!</p></section></main><footer>(c)</footer>"""
    assert html_blocks.main_text(page) == "A & B\nOne two <x>\nDie.\nLast"
    assert html_blocks.main_text("") == "" and html_blocks.main_text("<p") == html_blocks.main_text("<p")
    plain = f"<div><a href=a>Menu item</a></div><div>{PROSE} {PROSE}</div><div>Short.</div>"
    assert html_blocks.main_text(plain) == f"{PROSE} {PROSE}\nShort."


@pytest.mark.parametrize("around", ['<body class="single has-sidebar">{}', '<div class="content with-sidebar">{}</div>', '<body class="header-fixed">{}', '<form id="aspnetForm">{}</form>', '<div class="sidebar-left">{}</div>'])
def test_html_article_inside_layout(around):
    article = f"<nav>Menu</nav><article><h1>Title</h1><p>{PROSE} {PROSE}</p><section class='comments'><article>First!</article></section></article>"
    for inner in (article, article.replace("article>", "main>")):
        assert html_blocks.main_text(around.format(inner)) == f"Title\n{PROSE} {PROSE}"
    if "left" not in around:
        assert html_blocks.main_text(around.format(f"<p>{PROSE} {PROSE}</p>")) == f"{PROSE} {PROSE}"
    assert html_blocks.main_text(f"<article><p>{PROSE}</p></article><form>Name</form><aside><article>Other</article></aside>") == PROSE


@pytest.mark.parametrize("head", ["<head><meta charset=utf-8><script>var a='<p>no</p>'</script><title>t</title>", "<head><title>t", "<head><title>t</title></head><body><noscript>", "<body><svg>", "<body><object>", "<body><iframe src=x>", "<body><template>"])
def test_html_unclosed_elements(head):
    assert html_blocks.main_text(f"<html>{head}<body><article><p>One</p><svg><text>no</text></svg><iframe>no</iframe><p>Two</p></article>").split("\n") == ["One", "Two"]
    assert html_blocks.main_text("<p>One</p><script>var a = 1; <p>Two</p>") == html_blocks.main_text("<p>One</p>")


def test_html_links_inside_article():
    page = f"<a href=m>Menu</a><article><h2><a href=t>A title as permalink</a></h2><p>{PROSE} {PROSE}</p><p><a href=q>{PROSE}</a></p><ul><li><a href=1>Source one</a><li><a href=2>Source two</a></ul></article>"
    assert html_blocks.main_text(page) == f"A title as permalink\n{PROSE} {PROSE}\n{PROSE}\nSource one\nSource two"
    assert html_blocks.main_text("<article><h2><a href=t>Title</a></h2><p><a href=q>Quoted</a></p></article>") == "Title\nQuoted"


def test_html_without_article_container():
    assert html_blocks.main_text("<body><h1>Title</h1><p>short</p><p>short</p></body>") == "Title\nshort\nshort"
    assert html_blocks.main_text("<body><div><a href=a>Menu item</a></div><h1>Title</h1><p>short <a href=b>link</a> here</p></body>") == "Title\nshort link here"
    for text in ("Questa mattina molte persone hanno visto quattro grandi navi bianche entrare lentamente nel porto della vecchia cittadina " * 2, "Сегодня утром жители старого города увидели четыре больших белых корабля, медленно входящих в гавань " * 2, "今天早上老城的居民看到四艘白色大船缓缓驶入港口" * 9):
        assert html_blocks.main_text(f"<body><div><a href=a>Menu item</a></div><p>{text}</p>") == " ".join(text.split())
    assert html_blocks.main_text(f"<body><p>{PROSE} {PROSE}</p><p>{'buy cheap shoes now ' * 10}</p>") == f"{PROSE} {PROSE}"


MARKED = [
    (f"<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><{{0}}><h1>The mill</h1><p>{PROSE}</p><p>{PROSE} {PROSE}</p><p>Short one.</p></{{0}}><footer>(c) 2024 by us</footer>", ["The mill", PROSE, f"{PROSE} {PROSE}", "Short one."]),
    (f"<header>Site name</header><div class=ad>{PROSE}</div><{{0}}><p>{PROSE} {PROSE}</p><blockquote>Said so.</blockquote></{{0}}><section id=comments><p>{PROSE} {PROSE}</p></section>", [f"{PROSE} {PROSE}", "Said so."]),
    (f"<{{0}}><p>{PROSE} {PROSE}<p><a href=x>Read more of this</a> <a href=y>and of that</a></p></{{0}}><aside><p>{PROSE} {PROSE}</p></aside><form><p>Your name</p></form>", [f"{PROSE} {PROSE}"]),
]


@pytest.mark.parametrize("page, want", MARKED)
def test_html_by_densities(page, want):
    assert html_blocks.main_text(page.format("div")) == "\n".join(want)
    assert html_blocks.main_text(page.format("article")).startswith("\n".join(want))


def test_html_rules(spark):
    """Densities decide long blocks, in article containers too; without these, two pages lose a block that has no stop word."""
    rules, other = Counter(), 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        rules.update(rule for _, rule in html_blocks.first_pass(html_blocks.scan(r["html"])))
        bare = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r["html"])
        text, want = html_blocks.main_text(bare).split("\n"), html_blocks.main_text(r["html"]).split("\n")
        other += text != want
        assert not Counter(text) - Counter(want)
    assert other <= 2
    assert rules["stop words"] > 1000 and rules["stop words"] > 10 * (rules["length"] + rules["few stop words"]) and not rules["outside"]


@pytest.mark.parametrize("bad", ['<p class="x>t ', "<b>x ", "<a>x ", "<i><p><b>", "<svg ", "<form>x", "<aside><article>x", "a < b <", "<!-- x", "<p a=b c =\"d\" e = f\">x", "<div><div class=nav>"])
def test_html_broken_pages_take_linear_time(bad):
    import time

    took = []
    for n in (50_000, 400_000):
        t = time.process_time()
        html_blocks.main_text(bad * (n // len(bad)))
        took.append(time.process_time() - t)
    assert took[1] < 24 * took[0] + 0.5


def test_html_attributes():
    assert html_blocks.main_text('<p class=x">One</p><p title="a > b">Two</p><p "stray>Three</p><p a=\'b\'c>Four</p><p>5 < 6 & 7 > 2') == "One\nTwo\nThree\nFour\n5 < 6 & 7 > 2"
    assert html_blocks.main_text("<p>One<p><!-- <p>no</p> -->Two<!DOCTYPE x></ >Three<p style='display: none'>no</p><p cl") == "One\nTwoThree"


def test_html_rows(spark):
    rows = [(1, "u", f"<p>{PROSE}</p>", "c", "c"), (1, "u", f"<p>{PROSE}</p>", "c", "c"), (2, None, None, None, None), (None, "v", "", None, None), (3, "w", f"<article>{'<p>' + PROSE + '</p>' + chr(10) * 9}</article>" * 9000, "c", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string").repartition(3)
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html_blocks.extract(pages).collect()))
    long = "\n".join([PROSE] * 9000)
    assert got == [(0, "v", "", 0), (1, "u", PROSE, len(PROSE)), (1, "u", PROSE, len(PROSE)), (2, "", "", 0), (3, "w", long, len(long))]
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "Hi \\### x: </turn>\n"), (1, 1, "assistant", "</turn> ok\\"), (1, 1, "assistant", "</turn> ok\\"), (2, 0, None, None), (None, 3, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_spans.format_chats(df)
    got = {r["conv_id"]: r for r in chat_spans.digests(chats).collect()}
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3])
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[1]["loss_chars"] == 2 * len("</turn> ok\\") and got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    assert all(r["rewrites_at"] == -1 for r in chats.collect())


def test_chat_edges(spark):
    every = "".join(map(chr, range(0xE000, 0xF900)))
    rows = [(1, 0, "user", every + "\ue000" * 3, "c", "c"), (1, 1, "assistant", "yes" + every, "c", "c"), (2, None, "assistant", "b " * 2_000_000, "c", "c"), (2, None, "assistant", "a", "c", "c"), (3, 0, "a: </turn>\n### b", ": x", None, None), (3, 1, None, "", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, formatted string").repartition(3)
    got = {r["conv_id"]: r for r in chat_spans.digests(chat_spans.format_chats(df)).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(("yes" + every).encode()).hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(("a" + "b " * 2_000_000).encode()).hexdigest()
    assert got[3]["turns_sha256"] == hashlib.sha256("a: </turn>\n### b\n: x\n\n\n".encode()).hexdigest()
    assert chat_spans.format_chats(df.limit(0)).count() == 0


def test_rewriting_template_is_found():
    last_only = lambda turns: "".join(f"[{r}]" + (t if i == len(turns) - 1 else "...") for i, (r, t) in enumerate(turns))
    assert chat_spans.render([("user", "one"), ("assistant", "two")], last_only).rewrites_at == 1


def payload_digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("parts", [1, 5])
def test_warc(spark, parts):
    rows = [(3, "u3", "same"), (1, "u\r\n1", "same"), (2, None, None), (4, "u4", ""), (5, "u5", "x" * 3_000_000), (6, "u6", "é"), (None, "u", "same"), (1, "u1", "same"), (7, "u7", "own"), (7, "u7", "own"), (7, "u7", "own"), (8, "", "own"), (8, "u8", "other"), (8, "u8", "another")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, d string, refers_to long").repartition(parts)
    got = warc_normalise.round_trip(pages).collect()
    assert sorted((r["page_id"] or -1, r["payload_digest"]) for r in got) == sorted((i or -1, payload_digest(h)) for i, _, h in rows)
    assert sorted((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == [(1, 1), (3, 1), (4, 2), (7, 7), (7, 7), (8, 7)]
    assert warc_normalise.round_trip(pages.limit(0)).count() == 0
    longer = warc_normalise.round_trip(pages, 4).collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in longer if r["record_type"] == "revisit") == [(1, 1), (3, 1)]


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 3} {LONG}") for i in range(9)], "page_id long, url string, html string")
    first, second = (f"file://{tmp_path}/{x}" for x in ("whole", "cut"))
    index = warc_normalise.cut(warc_normalise.normalised(warc_normalise.cut(warc_normalise.write_archives(pages, first)), second)).collect()
    assert sum(r["records"] for r in index) == 9
    for r in index:
        data = open(r["archive"].removeprefix("file://"), "rb").read()
        places = [tuple(map(int, line.split())) for line in open(r["index"].removeprefix("file://"))]
        assert len(places) == r["records"] and sum(n for _, n in places) == len(data)
        for at, n in places:
            raw = zlib.decompress(data[at : at + n], 31)
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert not [f for d in ("whole", "cut") for f in os.listdir(tmp_path / d) if f.endswith(".part")]


@pytest.mark.parametrize("raw", [b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\n\r\n"])
def test_warc_broken(raw):
    with pytest.raises(ValueError):
        warc_normalise.normalise(io.BytesIO(warc_normalise.member(raw)), io.BytesIO())
    with pytest.raises(ValueError):
        warc_normalise.normalise(io.BytesIO(warc_normalise.member(raw * 9)[:-9]), io.BytesIO())


def test_warc_of_mixed_members():
    records = [warc_normalise.record_bytes(i, "u", b"p" * 9 * i, "d", None) for i in range(300)]
    mixed = warc_normalise.member(b"".join(records[:200])) + b"".join(map(warc_normalise.member, records[200:]))
    out = io.BytesIO()
    index = warc_normalise.normalise(io.BytesIO(mixed), out)
    assert [zlib.decompress(out.getvalue()[at : at + n], 31) for at, n in index] == records


def brute_pipeline(rows, items):
    """Texts left by each stage, in plain Python; rules stand as the operator tells them, for they are tested above."""
    left = {}
    for i, t in sorted(rows):
        left.setdefault((i, t), 1)
    g = {k: grams(k[1]) for k in left}
    root = {k: k for k in left}
    for k in left:
        for j in left:
            one = g[k] | g[j]
            if k < j and 5 * len(g[k] & g[j]) >= 4 * len(one):
                a, b = sorted((root[k], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    left = {i: t for i, t in left if root[i, t] == (i, t)}
    seen, cut = set(), {}
    for i, t in sorted(left.items()):
        b = t.encode()
        gone, own = bytearray(len(b)), set()
        for k in range(len(b) - 49):
            own.add(b[k : k + 50])
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= own
        cut[i] = bytes(c for c, x in zip(b, gone) if not x).decode("utf-8", "ignore")
    bad = {d for d, _ in plain_leaks(cut, items)}
    return {i: t for i, t in cut.items() if i not in bad}


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline
    import public_tokenizers as p
    import tiktoken

    random.seed(5)
    usual = PROSE.split()
    prose = lambda n: " ".join(random.choice(usual) for _ in range(n)) + "."
    item = "How many of the 14 red stones did the old miller of the valley keep for the winter that year?"
    shared = prose(30)
    base = prose(90)
    rows = [(i, f"{prose(70)} é{i} {shared if i % 5 == 0 else ''} ü {prose(40)}") for i in range(20)]
    rows += [(40, base), (41, base + " and more"), (42, base), (42, base), (43, f"{prose(60)} {item} {prose(40)}"), (44, "!!! ### " * 200), (45, ""), (46, "short"), (47, base.replace(" ", "  "))]
    rows += [(50, prose(80)), (51, " ".join(prose(50) for _ in range(600)))]
    docs = spark.createDataFrame([(*r, "en", None, len(r[1]), "clash") for r in rows] + [(60, None, "en", None, None, "c"), (None, prose(80), "en", "s", 1, "c")], "doc_id long, text string, lang string, source string, n_chars long, m string").repartition(4)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert {*range(20), 40, 42, 43, 50, 51} <= kept and not kept & {44, 45, 46, 60}
    want = brute_pipeline([r for r in rows if r[0] in kept], {1: item})
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*want, None}
    assert {i: got[i]["decoded_sha256"] for i in want} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert {i: got[i]["n_tokens"] for i in want} == {i: len(own.encode_ordinary(t)) for i, t in want.items()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    again = spark.createDataFrame([(1, base, "en", None, 1), (1, prose(90), "en", None, 1), (1, base, "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_duplicates(spark, again, str(tmp_path)).count() == 2
    assert corpus_pipeline.common_strings(spark, again, str(tmp_path)).count() == 3


def test_bpe_rows(spark):
    import public_tokenizers as p

    rows = [(1, None, "c"), (1, "", "c"), (2, "a b", "c"), (2, "a b", "c"), (None, "é" * 1_000_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe_sentencepiece.round_trip_digests(df, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in got) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert bpe_sentencepiece.round_trip_digests(df.limit(0), p.path("byte_bpe_50k.tiktoken"), p.PATTERN).count() == 0
    back = bpe_sentencepiece.decode(bpe_sentencepiece.encode(df, p.path("byte_bpe_50k.tiktoken"), p.PATTERN), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    assert {bytes(r["decoded"]) for r in back.collect()} == {(t or "").encode() for _, t, _ in rows}
