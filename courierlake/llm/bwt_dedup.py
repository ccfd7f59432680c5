"""Suffix-array deduplication by threshold-bounded interval expansion.

A byte is removed if a LEAST-byte string that covers it also starts in a
document with a smaller doc_id.

Sharding. Of the K-byte grams of each LEAST-byte window the smallest by hash
(the leftmost of equals) is its anchor. That choice depends on the window's
bytes only, so equal windows have equal anchors, and the windows of one anchor
occurrence are consecutive: they form a segment of less than 2 * LEAST bytes.

1. Count anchors by hash, once a document; keep those of two documents.
2. Keep the segments of kept anchors, as (anchor, segment hash, place).
3. Aggregate equal segments to their smallest doc_id. In any later document
   such a segment goes as a whole.
4. Where an anchor has several different segments, one text of each goes to the
   shard of its anchor. There the Burrows-Wheeler transform of the shard's
   segments, sorted by a few codes more than LEAST, is expanded breadth-first:
   level by level, boundaries of intervals with a common prefix of n bytes are
   extended backward by one byte through the transform and give those of n + 1,
   stopping at LEAST. What is then still together shares LEAST bytes; a start is
   flagged if its interval has a smaller doc_id.
5. Flags go back to all occurrences by a join and are gathered by document.

A shard batch is closed at SHARD_BYTES. An anchor with more than HOT different
segments (a line in a third of all documents with other neighbours each time) is
split, so that no shard must hold them all: a window has 0 to LEAST - K bytes
before its anchor, and windows that differ in that number are never equal. Each
segment gives one part with the lower half of these numbers and one with the
upper half; the windows of a part have more bytes than the anchor in common,
and parts go to the shard of those bytes. Equal parts are aggregated as equal
segments are, parts of a hot shard are split again, and after five halvings a
part is one window and a shard holds one string. All shards are expanded in the
same way. Hash joins read plain tables, so hot keys can be split.

Defined results: a null or empty text has no bytes; a null doc_id is left as it
is and matches nothing; rows that repeat a doc_id with another text are
documents of their own, neither earlier than the other; equal rows are one
document, and each comes back; very long texts are read whole, cut into segments
piece by piece; an empty table gives no rows; other columns are not read.
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

LEAST = 50
K = 20
SPAN = LEAST - K + 1
HOT = 2048
SHARD_BYTES = 1 << 18
#: Codes in the first sort key of suffixes.
FIRST_CODES = 7
PIECE = 1 << 22
PLACE_BITS = 24


def segments(data: np.ndarray, offsets: np.ndarray, named: bool = True) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash if named, text number, first start in the text, number of starts) of all segments."""
    sums = wh.prefix(data.astype(np.uint64) + np.uint64(1))
    _, inverse = wh.powers(0, len(sums))
    sizes = np.diff(offsets)
    # a start is whole if LEAST bytes of its text follow; in a text too short for one none is
    whole = np.repeat(sizes >= LEAST, sizes)
    tails = np.minimum(sizes, LEAST - 1)
    whole[wh.ranges(offsets[1:] - tails, offsets[1:])] = False
    found = []
    for low in range(0, max(1, len(data) - LEAST + 1), PIECE):
        high = min(low + PIECE, len(data) - LEAST + 1)
        if high <= low:
            break
        end = high + SPAN - 1
        h = wh.finish((sums[low + K : end + K] - sums[low:end]) * inverse[low:end])  # of the grams that begin from low to end
        key = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(end - low, dtype=np.uint64)
        for width in (1, 2, 4, 8):
            key = np.minimum(key[:-width], key[width:])
        key = np.minimum(key[: len(key) - 15], key[15:])  # minima over SPAN = 16 + 15 grams
        good = whole[low:high]
        new = good.copy()
        new[1:] &= (key[1:] != key[:-1]) | ~good[:-1]  # between texts lie starts that are not whole
        run = np.flatnonzero(new)
        if not len(run):
            continue
        count = np.add.reduceat(good, run, dtype=np.int64)
        anchor = (key[run] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        found.append((h[anchor], run + low, np.searchsorted(offsets, run + low, side="right") - 1, count))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h, start, text, count = (np.concatenate(x) for x in zip(*found, strict=True))
    own = h
    if named:  # of both multipliers; with the anchor's hash it stands for the segment
        other = wh.windows(wh.prefix(data.astype(np.uint64) + np.uint64(1), 1), start, start + count + LEAST - 1, 1)
        own = wh.finish(wh.windows(sums, start, start + count + LEAST - 1) + (other << np.uint64(32) | other >> np.uint64(32)))
    return h, own, text, start - offsets[text], count


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor hashes, each once a document."""
    schema = pa.schema([("h", pa.int64())])
    for b in slices(batches):
        h, _, text, _, _ = segments(*wh.flat(b.column("text")), named=False)
        _, once = np.unique(h + wh.finish(text.astype(np.uint64)), return_index=True)
        yield rows_of(schema, h=wh.signed(h[once]))


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments: anchor hash h, own hash k, document, and start * 64 + number of starts."""
    schema = pa.schema([(n, pa.int64()) for n in ("h", "k", *KEY, "at")])
    for b in slices(batches):
        h, k, text, start, count = segments(*wh.flat(b.column("text")))
        yield rows_of(schema, h=wh.signed(h), k=wh.signed(k), **{n: b.column(n).to_numpy()[text] for n in KEY}, at=start * 64 + count)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments, and whether their anchor is hot."""
    schema = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("segment", pa.binary()), ("hot", pa.bool_())])
    for b in slices(batches):
        data, offsets = wh.flat(b.column("text"))
        raw, ids = data.tobytes(), b.column("doc_id").to_numpy()
        wanted = b.column("wanted")
        flat = wanted.flatten()
        text = np.repeat(np.arange(b.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
        at = flat.field("at").to_numpy()
        start, count = offsets[text] + at // 64, at % 64
        pieces = [raw[a : a + n] for a, n in zip(start.tolist(), (count + LEAST - 1).tolist(), strict=True)]
        yield rows_of(schema, h=flat.field("h"), k=flat.field("k"), doc_id=ids[text], segment=pieces, hot=flat.field("hot"))


def anchor_place(h: int, segment: bytes) -> int:
    """Where the anchor of hash h begins in its segment."""
    data = np.frombuffer(segment, dtype=np.uint8)
    at = np.arange(len(data) - K + 1)
    return int(np.argmax(wh.signed(wh.windows(wh.prefix(data.astype(np.uint64) + np.uint64(1)), at, at + K)) == h))


def short_hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"|".join(parts), digest_size=8).digest(), "little", signed=True)


PARTS = "h long, k long, doc_id long, shift int, part_h long, part_k long, segment binary, anchor int, low int, high int"


def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two parts of each segment: its windows with `low` to the middle, and with more up to `high`, bytes before the anchor."""
    numbers = {"h": pa.int64(), "k": pa.int64(), "doc_id": pa.int64(), "shift": pa.int32(), "part_h": pa.int64(), "part_k": pa.int64(), "segment": pa.binary(), "anchor": pa.int32(), "low": pa.int32(), "high": pa.int32()}
    schema = pa.schema(list(numbers.items()))
    for b in slices(batches, "segment"):
        out = []
        for row in b.to_pylist():
            segment, anchor = row["segment"], row["anchor"]
            if anchor is None:
                anchor = anchor_place(row["h"], segment)
            middle = (row["low"] + row["high"]) // 2
            for low, high in ((row["low"], middle), (middle + 1, row["high"])):
                first, last = max(0, anchor - high), min(len(segment) - LEAST, anchor - low)
                if first > last:
                    continue
                common, own = segment[anchor - low : anchor - high + LEAST], segment[first : last + LEAST]
                key = f"{low},{high},{anchor - first}".encode()
                part_h = short_hash(str(row["h"]).encode(), f"{low},{high}".encode(), common)
                out.append((row["h"], row["k"], row["doc_id"], first, part_h, short_hash(key, own), own, anchor - first, low, high))
        if out:
            yield rows_of(schema, **dict(zip(numbers, map(list, zip(*out)), strict=True)))


def suffix_array(codes: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` codes or more, and which of them share less than `width` codes with the one before it.

    By prefix doubling from keys of `width` nine-bit codes; the last code is the only 0.

    Suffixes that agree that far may stand in any order: the expansion stops
    before it could tell. Each round sorts only those that still agree with a
    neighbour.
    """
    n = len(codes)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(width, dtype=np.int64)])
    key = padded[:n].copy()
    for j in range(1, width):
        key = key << 9 | padded[j : j + n]
    order = np.argsort(key)
    ordered = key[order]
    first = np.ones(n, dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.full(n + 1, -1, dtype=np.int64)  # where the suffix's group begins; -1 past the end
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    apart = first.copy()
    step = width
    while step < depth:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            break
        some = order[tied]
        key = rank[some] * (n + 1) + rank[np.minimum(some + step, n)] + 1
        by = np.argsort(key)
        order[tied], key = some[by], key[by]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first[tied] = new
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2
    return order, apart


def interval_starts(order: np.ndarray, apart: np.ndarray, codes: np.ndarray, width: int, least: int) -> np.ndarray:
    """True where a suffix shares less than `least` codes with the one before it; apart: where less than `width`, with which the expansion begins.

    A boundary between neighbours that begin with the same code c lies, one
    backward step earlier, between two successive occurrences of c in the
    transform; it has a common prefix one longer than the least boundary
    between those. Level by level, boundaries of the level just found decide
    the next; what is open after `least` levels shares `least` codes.
    """
    n = len(order)
    transform = codes[order - 1]
    by_code = np.argsort(transform, kind="stable").astype(np.int32)
    left, right = by_code[:-1], by_code[1:]
    decided, level = apart.copy(), apart
    open_ = np.flatnonzero(~apart[1:]).astype(np.int32)
    left, right, open_ = left[open_], right[open_], open_ + 1
    for _ in range(least - width):
        decided |= level
        passed = np.cumsum(level, dtype=np.int32)
        hit = passed[right] != passed[left]
        level = np.zeros(n, dtype=bool)
        level[open_[hit]] = True
        if not hit.any():  # no boundary of this level: none of a later one
            break
        rest = ~hit
        open_, left, right = open_[rest], left[rest], right[rest]
        if not len(open_):
            break
    return decided | level


def flags(pieces: list[bytes], docs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each segment, bit i is set if its start i opens a `least`-byte string that a segment of a smaller doc_id has too."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    place = np.arange(len(data)) + owner
    codes = np.ones(len(data) + len(pieces) + 1, dtype=np.int16)
    codes[place] = data.astype(np.int16) + 2
    codes[-1] = 0
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    inside = np.arange(len(data)) - begins[owner]
    whole = inside + least <= sizes[owner]
    doc = np.full(len(codes), np.iinfo(np.int64).max)
    doc[place[whole]] = docs[owner[whole]]
    width = min(FIRST_CODES, least - 1)
    order, apart = suffix_array(codes, least + 1, width)
    new = interval_starts(order, apart, codes, width, least)
    ordered = doc[order]
    smallest = np.minimum.reduceat(ordered, np.flatnonzero(new))
    flagged = np.zeros(len(codes), dtype=bool)
    flagged[order] = (ordered > smallest[np.cumsum(new) - 1]) & (ordered != np.iinfo(np.int64).max)
    hit = np.flatnonzero(flagged[place])
    return np.bincount(owner[hit], weights=2.0 ** inside[hit], minlength=len(pieces)).astype(np.int64)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come sorted by anchor; a batch ends between anchors, at SHARD_BYTES."""
    schema = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("mask", pa.int64())])
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def done() -> pa.RecordBatch:
        masks = flags([x[3] for x in held], np.array([x[2] for x in held], dtype=np.int64))
        return rows_of(schema, h=[x[0] for x in held], k=[x[1] for x in held], mask=masks)

    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in ("h", "k", "doc_id", "segment")), strict=True):
            if size >= SHARD_BYTES and held[-1][0] != row[0]:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield done()


def expanded(pieces: DataFrame) -> DataFrame:
    """(h, k, mask) of different pieces (h, k, doc_id, segment) by the shards of h."""
    return pieces.select("h", "k", "doc_id", "segment").repartition("h").sortWithinPartitions("h").mapInArrow(shards, "h long, k long, mask long")


def split(hot: DataFrame, least: int) -> DataFrame:
    """(h, k, mask) of pieces (h, k, doc_id, segment, anchor, low, high) whose shards would hold more than `least` of them."""
    parts = cut(hot.mapInArrow(halves, PARTS))
    first = parts.groupBy("part_h", "part_k").agg(F.min(F.struct("doc_id", "segment", "anchor", "low", "high")).alias("first"))
    first = cut(first.select(F.col("part_h").alias("h"), F.col("part_k").alias("k"), "first.*"))
    several = cut(first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    masks = expanded(first.join(several.where(F.col("n") <= least), "h", "left_semi"))
    if not several.where(F.col("n") > least).isEmpty():
        masks = masks.unionByName(split(first.join(several.where(F.col("n") > least), "h", "left_semi"), least))
    told = first.select(F.col("h").alias("part_h"), F.col("k").alias("part_k"), F.col("doc_id").alias("first_doc"))
    # a plain table, so that the merge with the parts of a common string can be split
    told = cut(told.join(masks.select(F.col("h").alias("part_h"), F.col("k").alias("part_k"), "mask"), ["part_h", "part_k"], "left"))
    for done in (first, several):
        drop(done)
    inside = F.expr("shiftleft(1L, length(segment) - {}) - 1".format(LEAST - 1))
    own = F.when(F.col("doc_id") > F.col("first_doc"), inside).otherwise(F.coalesce("mask", F.lit(0).cast("long")))
    marked = parts.join(told, ["part_h", "part_k"]).select("h", "k", own.alias("own"), "shift").where("own != 0")
    out = cut(marked.select("h", "k", F.expr("shiftleft(own, shift)").alias("mask")))
    for done in (parts, told):
        drop(done)
    return out


def flagged_spans(known: DataFrame) -> DataFrame:
    """KEY and spans of rows that are told apart: (at, mask), at = start * 64 + number of starts, bit i of mask: the string at start + i goes."""
    kept = cut(known.select("text").mapInArrow(anchors, "h long").groupBy("h").count().where("count > 1").select("h"))
    found = cut(known.mapInArrow(places, "h long, k long, doc_id long, twin long, at long").join(kept.hint("shuffle_hash"), "h", "left_semi"))
    drop(kept)
    first = cut(found.groupBy("h", "k").agg(F.min(F.struct(*KEY, "at")).alias("first")).select("h", "k", "first.*"))
    several = cut(first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = first.join(several, "h").groupBy(*KEY).agg(F.collect_list(F.struct("h", "k", "at", (F.col("n") > HOT).alias("hot"))).alias("wanted"))
    pieces = cut(known.join(wanted, KEY).mapInArrow(texts_of, "h long, k long, doc_id long, segment binary, hot boolean"))
    masks = expanded(pieces.where("not hot"))
    if not several.where(F.col("n") > HOT).isEmpty():
        whole = pieces.where("hot").select("h", "k", "doc_id", "segment", F.lit(None).cast("int").alias("anchor"), F.lit(0).alias("low"), F.lit(LEAST - K).alias("high"))
        masks = masks.unionByName(split(whole, HOT))
    masks = cut(masks.where("mask != 0").groupBy("h", "k").agg(F.bit_or("mask").alias("mask")))
    drop(several)
    drop(pieces)
    told = cut(first.select("h", "k", F.col("doc_id").alias("first_doc")).join(masks, ["h", "k"], "left"))
    drop(first)
    drop(masks)
    spans = found.join(told, ["h", "k"]).select(*KEY, "at", F.when(F.col("doc_id") > F.col("first_doc"), F.lit(-1).cast("long")).otherwise(F.col("mask")).alias("mask")).where("mask is not null")
    out = cut(spans.groupBy(*KEY).agg(F.collect_list(F.struct("at", "mask")).alias("spans")))
    drop(found)
    drop(told)
    return out


def of_characters(own: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, spread to all bytes of each character that loses one."""
    owner = np.cumsum((own & 0xC0) != 0x80)
    hit = np.zeros(len(own) + 2, dtype=bool)
    hit[owner[gone]] = True
    return hit[owner]


def cut_out(batches: Iterator[pa.RecordBatch], characters: bool = False) -> Iterator[pa.RecordBatch]:
    """Texts without the flagged bytes; a cut may fall inside a character unless whole characters go. What comes before doc_id is carried along."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
    bits = np.arange(SPAN)
    for b in slices(batches):
        data, offsets = wh.flat(b.column("text"))
        n_removed, n_spans, kept = [], [], []
        for i, spans in enumerate(b.column("spans")):
            own = data[offsets[i] : offsets[i + 1]]
            if not spans.is_valid:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(own.tobytes())
                continue
            at, mask = (spans.values.field(n).to_numpy() for n in ("at", "mask"))
            count = at % 64
            hit = (mask[:, None] >> bits & 1).astype(bool) & (bits < count[:, None])
            start = (at[:, None] // 64 + bits)[hit]
            edge = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + LEAST, -1)
            gone = np.cumsum(edge)[:-1] > 0
            if characters:
                gone = of_characters(own, gone)
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(own[~gone].tobytes())
        carried = {f.name: b.column(f.name) for f in b.schema if f.name not in (*KEY, "text", "spans")}
        schema = pa.schema([*((n, c.type) for n, c in carried.items()), *fields])
        yield rows_of(schema, **carried, doc_id=b.column("doc_id"), n_bytes=np.diff(offsets), n_removed=n_removed, n_spans=n_spans, kept=kept)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long"


def remove_common(docs: DataFrame, carry: str | None = None, characters: bool = False) -> DataFrame:
    """The column to carry along if any, doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes).

    characters: a character that loses a byte goes as a whole, so that what is kept is text.
    """
    own, known = told_apart(docs, carry)
    joined = own.join(flagged_spans(known), KEY, "left")
    if carry:
        joined = joined.select(carry, *(c for c in joined.columns if c != carry))
    before = f"`{carry}` {docs.schema[carry].dataType.simpleString()}, " if carry else ""
    return joined.mapInArrow(lambda batches: cut_out(batches, characters), f"{before}{CUT}, kept binary")


def remove_common_digest(docs: DataFrame) -> DataFrame:
    """As remove_common(), with the SHA-256 of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        for b in cut_out(batches):
            same = {n: b.column(n) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")}
            yield rows_of(schema, **same, kept_sha256=[hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column("kept")])

    own, known = told_apart(docs)
    return own.join(flagged_spans(known), KEY, "left").mapInArrow(run, f"{CUT}, kept_sha256 string")
