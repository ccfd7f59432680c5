"""Substring deduplication with difference-cover anchors.

A window is WINDOW consecutive words of one document. Sub-windows of
ANCHOR = WINDOW - PERIOD + 1 words are hashed only at positions whose
remainder modulo PERIOD is in COVER. Every difference modulo PERIOD is a
difference of two members of the cover, so two equal windows share an anchor at
the same offset from their starts, whatever their positions.

1. Count anchor hashes (combined before the shuffle); keep those found twice.
2. Bring the anchors of kept hashes back to their documents.
3. Extend each anchor to the windows around it. Count these by a 64-bit hash and
   keep the windows found twice, with 128-bit hashes: most windows around a
   shared anchor occur once and are not worth storing or sorting.
4. Find each window's first document (smallest doc_id). Occurrences in others,
   and those that come later in their own text, are flagged, gathered by
   document, and their words removed.

Each phase ends in a table in the shared folder. Phases 2, 3 and 4 join by hash
with nothing hashed before, so the adaptive planner can split a hash that a
third of all documents share; every aggregate before a shuffle is a partial
one, and what a document gathers is bounded by its own length.

Defined results: a null or empty text has no words; a null doc_id is left as it
is and matches nothing; rows that repeat a doc_id with another text are
documents of their own, neither earlier than the other; equal rows are one
document, and each comes back; very long texts are read whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import KEY, cut, drop, rows_of, slices, told_apart

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1


def anchors(texts: pa.Array, cover: tuple[int, ...] = COVER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position) of all anchors of texts that hold a window."""
    data, offsets = wh.flat(texts)
    start, end, first = wh.words(data, offsets)
    n = np.diff(first)
    sums = wh.prefix(wh.word_hashes(data, start, end))
    at = wh.ranges(first[:-1], np.where(n >= WINDOW, first[1:] - ANCHOR + 1, first[:-1]))
    text = np.searchsorted(first, at, side="right") - 1
    place = at - first[text]
    keep = np.isin(place % PERIOD, cover)
    at, text, place = at[keep], text[keep], place[keep]
    return wh.windows(sums, at, at + ANCHOR), text, place


def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64())])
    for b in slices(batches):
        yield rows_of(schema, h=wh.signed(anchors(b.column("text"))[0]))


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("place", pa.int32())])
    for b in slices(batches):
        h, text, place = anchors(b.column("text"))
        yield rows_of(schema, h=wh.signed(h), doc_id=b.column("doc_id").to_numpy()[text], twin=b.column("twin").to_numpy()[text], place=place.astype(np.int32))


def around(b: pa.RecordBatch, which: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes by each multiplier, text number, start) of all windows around shared anchors."""
    data, offsets = wh.flat(b.column("text"))
    start, end, first = wh.words(data, offsets)
    n = np.diff(first)
    lists = b.column("places")
    text = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    place = np.minimum(lists.flatten().to_numpy(), n[text])
    wanted = np.zeros(len(start) + 1, dtype=bool)
    low, high = np.maximum(place - PERIOD + 1, 0), np.minimum(place, n[text] - WINDOW)
    wanted[wh.ranges(first[text] + low, first[text] + high + 1)] = True
    at = np.flatnonzero(wanted)
    owner = np.searchsorted(first, at, side="right") - 1
    return [wh.signed(wh.windows(wh.prefix(wh.word_hashes(data, start, end, k), k), at, at + WINDOW, k)) for k in which], owner, at - first[owner]


def window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64-bit hashes of all windows around shared anchors."""
    schema = pa.schema([("k1", pa.int64())])
    for b in slices(batches):
        yield rows_of(schema, k1=around(b, (0,))[0][0])


def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes and places of all windows around shared anchors; a start is less than 0 (by one more) if its text has the window before."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("start", pa.int32())])
    for b in slices(batches):
        (k1, k2), owner, start = around(b, (0, 1))
        own = k1 ^ wh.signed(wh.finish(owner.astype(np.uint64)))
        order = np.lexsort((k2, own))  # stable: equal windows of a text stay in order
        again = np.zeros(len(order), dtype=bool)
        again[order[1:]] = (own[order[1:]] == own[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
        start = np.where(again, -1 - start, start)
        yield rows_of(schema, k1=k1, k2=k2, doc_id=b.column("doc_id").to_numpy()[owner], twin=b.column("twin").to_numpy()[owner], start=start.astype(np.int32))


def flagged_starts(known: DataFrame) -> DataFrame:
    """KEY and the sorted starts of its windows whose words also start earlier, of rows that are told apart."""
    kept = cut(known.select("text").mapInArrow(hashes, "h long").groupBy("h").count().where("count > 1").select("h"))
    found = known.mapInArrow(places, "h long, doc_id long, twin long, place int").join(kept, "h", "left_semi")
    shared = cut(found.groupBy(*KEY).agg(F.collect_list("place").alias("places")))
    drop(kept)
    texts = cut(known.join(shared, KEY))
    drop(shared)
    twice = cut(texts.mapInArrow(window_hashes, "k1 long").groupBy("k1").count().where("count > 1").select("k1"))
    windows = cut(texts.mapInArrow(extended, "k1 long, k2 long, doc_id long, twin long, start int").join(twice, "k1", "left_semi"))
    drop(texts)
    drop(twice)
    first = cut(windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = windows.join(first, ["k1", "k2"]).where("doc_id > first_doc or start < 0")
    start = F.when(F.col("start") < 0, -1 - F.col("start")).otherwise(F.col("start"))
    out = cut(later.groupBy(*KEY).agg(F.array_sort(F.collect_list(start)).alias("starts")))
    drop(windows)
    drop(first)
    return out


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that flagged windows cover."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
    for b in slices(batches):
        data, offsets = wh.flat(b.column("text"))
        start, end, first = wh.words(data, offsets)
        raw = data.tobytes()
        n_words, n_removed, kept = [], [], []
        for i, starts in enumerate(b.column("starts")):
            a, z = first[i], first[i + 1]
            n = int(z - a)
            stay = np.ones(n, dtype=bool)
            if starts.is_valid:
                s = starts.values.to_numpy()
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + WINDOW, -1)
                stay = np.cumsum(edge)[:n] == 0
            n_words.append(n)
            n_removed.append(n - int(stay.sum()))
            kept.append(b" ".join([raw[x:y] for x, y in zip(start[a:z][stay].tolist(), end[a:z][stay].tolist(), strict=True)]))
        yield rows_of(schema, doc_id=b.column("doc_id"), n_words=n_words, n_removed=n_removed, kept=kept)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space, in UTF-8)."""
    own, known = told_apart(docs)
    return own.join(flagged_starts(known), KEY, "left").mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept binary")


def remove_repeats_digest(docs: DataFrame) -> DataFrame:
    """As remove_repeats(), with the SHA-256 of what is kept, made where the words are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        for b in removed(batches):
            digests = [hashlib.sha256(k.as_buffer()).hexdigest() for k in b.column("kept")]
            yield rows_of(schema, doc_id=b.column("doc_id"), n_words=b.column("n_words"), n_removed=b.column("n_removed"), kept_sha256=digests)

    own, known = told_apart(docs)
    return own.join(flagged_starts(known), KEY, "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
