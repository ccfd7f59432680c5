"""Spelling variant grouping by full neighbourhood generation.

Words are counted over all documents. Each word's neighbourhood is every
distinct string that one deletion, replacement or insertion over the observed
alphabet makes of it; a neighbour that is a word too is near, and needs no
check of the distance.

The join of neighbourhoods and vocabulary is dealt by what an edit leaves as it
is. The positions of a word are cut into windows of WINDOW; an edit lies in one
of them, so a word and its neighbour agree before and after it. Every word
goes to the bucket of each of its windows (all of it but the window), once with
its own length and once as the word that is longer by one. In a bucket only
the window's characters differ: there the edits of this window are emitted, over
the characters that the bucket has there (others can't meet a word of it), and
looked up among its words by hash. A string that several edits give (`aab` from
`ab`) is emitted by the first only, so no pair is found twice.

A bucket's words differ in at most WINDOW + 1 characters of an alphabet of 90,
so it has at most 90**2 + 90**3 of them, whatever the corpus; the rows of a word
are about as many as its characters, each of the word's size up to LONG
characters and of fixed size beyond it (digests stand for what lies outside
the window and for the word).

A word's form is the near word of largest count, if that is at least twice its
own. Roots follow by pointer jumping: as counts double with each step, chains
are shorter than the logarithm of the largest count.

Defined results: a null or empty text has no words; the key of a null doc_id is
empty; rows that repeat count again; very long texts are read whole, words of
any length are compared; ties go to the smallest word in code-point order; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, id_text

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_CHARS, LEAST_COUNT = 5, 3
WINDOW = 2
LONG = 64
MARK = "#"
BATCH_ROWS = 1 << 14
DAMAGED_ONE_IN = 97


def damaged(run: Column, doc_id: Column) -> Column:
    """The run without one code point, where the checksum of `<doc_id>:<run>` says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGED_ONE_IN == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n and name, of all words of LEAST_CHARS code points and LEAST_COUNT occurrences.

    The name stands for the word in the rows of its buckets: the word itself, or a digest if it is long.
    """
    text = F.translate(F.col("text"), UPPER, UPPER.lower())
    runs = id_text(docs).select("doc_id", F.explode(F.split(text, r"[^a-zÀ-ÿ]+")).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_CHARS)
    words = runs.select(damaged(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return counted.select("word", "n", F.when(F.length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit(MARK), F.sha2("word", 256))).alias("name"))


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"|".join(parts), digest_size=16).digest()


def told(text: str) -> list[bytes]:
    """Digests of all prefixes of text, at its even lengths; of the whole text last."""
    running, out = hashlib.blake2b(digest_size=16), []
    for i in range(0, len(text), WINDOW):
        out.append(running.digest())
        running.update(text[i : i + WINDOW].encode())
    return [*out, running.digest()]


def buckets_of(word: str, longer: bool) -> Iterator[tuple[bytes, str, str, bool]]:
    """For each window: the bucket's key, the characters inside, the one before, and whether the window ends the word.

    longer: the word belongs to the buckets of words shorter by one, whose windows hold one more of its characters.
    """
    size = len(word) - longer
    name = f"{size}:".encode()
    if size <= LONG:
        for low in range(0, size, WINDOW):
            high = min(low + WINDOW, size)
            key = name + f"{low}:{word[:low]}*{word[high + longer :]}".encode()
            yield key, word[low : high + longer], word[low - 1 : low], high == size
        return
    before = told(word)
    # suffixes read backwards; they start at every character, so digests are taken at each
    running, after = hashlib.blake2b(digest_size=16), [hashlib.blake2b(digest_size=16).digest()]
    for c in reversed(word):
        running.update(c.encode())
        after.append(running.digest())
    for low in range(0, size, WINDOW):
        high = min(low + WINDOW, size)
        key = b"\x00" + digest(name, str(low).encode(), before[low // WINDOW], after[len(word) - high - longer])
        yield key, word[low : high + longer], word[low - 1 : low], high == size


DEALT = "key binary, longer boolean, inside string, before string, last boolean, name string, n long"
DEALT_SCHEMA = pa.schema([("key", pa.binary()), ("longer", pa.bool_()), ("inside", pa.string()), ("before", pa.string()), ("last", pa.bool_()), ("name", pa.string()), ("n", pa.int64())])
FOUND = "name string, near string, near_n long"
FOUND_SCHEMA = pa.schema([("name", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of BATCH_ROWS at most."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of all words."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for word, name, n in zip(*(b.column(c).to_pylist() for c in ("word", "name", "n")), strict=True):
                for longer in (False, True):
                    for key, inside, before, last in buckets_of(word, longer):
                        yield key, longer, inside, before, last, name, n

    return batches_of(rows(), DEALT_SCHEMA)


def neighbours(own: dict[str, tuple[str, int]], longer: dict[str, tuple[str, int]], before: str, last: bool) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its count) of one bucket: every replacement, insertion and deletion in the window, looked up by hash."""
    alphabet = sorted(set().union(*own, *longer))
    for inside, (word, _) in own.items():
        for i, c in enumerate(inside):
            for x in alphabet:
                if x != c and (found := own.get(inside[:i] + x + inside[i + 1 :])):
                    yield word, *found
        if longer:
            for i in range(len(inside) + last):
                previous = inside[i - 1] if i else before
                for x in alphabet:
                    if x != previous and (found := longer.get(inside[:i] + x + inside[i:])):
                        yield word, *found
    if own:
        for inside, (word, _) in longer.items():
            for i in range(len(inside) - 1 + last):
                if inside[i] != (inside[i - 1] if i else before) and (found := own.get(inside[:i] + inside[i + 1 :])):
                    yield word, *found


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, from rows sorted by bucket; one bucket is held at a time."""

    def rows() -> Iterator[tuple[str, str, int]]:
        key, own, longer, around = None, {}, {}, ("", False)
        for b in batches:
            for at, over, inside, before, last, word, n in zip(*(b.column(c).to_pylist() for c in DEALT_SCHEMA.names), strict=True):
                if at != key:
                    if len(own) + len(longer) > 1:
                        yield from neighbours(own, longer, *around)
                    key, own, longer, around = at, {}, {}, (before, last)
                (longer if over else own)[inside] = word, n
        if len(own) + len(longer) > 1:
            yield from neighbours(own, longer, *around)

    return batches_of(rows(), FOUND_SCHEMA)


def near_words(words: DataFrame) -> DataFrame:
    """name, near and near_n: each pair of near words in both directions, once."""
    dealt = words.select("word", "name", "n").mapInArrow(deal, DEALT)
    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(joined, FOUND)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """word and root of all words that have a form, by pointer jumping."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(at)
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def grouped(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root, from a table of word, n and name."""
    found = cut(near_words(words))
    spelt = words.where(F.length("word") > LONG).select(F.col("name").alias("near"), F.col("word").alias("near_word"))
    is_long = F.col("near").startswith(MARK)
    near = found.where(~is_long).select("name", F.col("near").alias("near_word"), "near_n")
    near = near.unionByName(found.where(is_long).join(spelt, "near").select("name", "near_word", "near_n"))
    best = near.groupBy("name").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("near"))).alias("best"))
    told = words.join(best, "name", "left")
    has = -F.col("best.less") >= 2 * F.col("n")
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    drop(found)
    followed = roots(told.where("form is not null"))
    return told.join(followed, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words of the documents."""
    return grouped(cut(vocabulary(docs)))
