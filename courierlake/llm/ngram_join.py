"""N-gram Jaccard join by MinHash banding.

Texts are sets of N-word n-grams; two texts are linked if the Jaccard
similarity of their sets is at least 4/5. Band and row counts are chosen for a
target recall at that threshold.

1. Every text gets a MinHash signature, cut into band hashes.
2. Texts of equal word sequence (by 128 bits of BLAKE2b) form a class; its
   smallest row represents it (an aggregate combined before the shuffle, so a
   text copied to a third of all rows is one representative).
3. Representatives are shuffled on band hashes. A bucket that holds more than
   BLOCK texts or BLOCK_GRAMS n-grams is dealt into blocks and each pair of
   blocks is a group of its own, so no bucket must fit one task. A pair belongs
   to the first band in which it agrees; a representative goes on in a group
   only if it has such a pair there.
4. Texts are joined to the groups they go on in, and each pair is verified on
   its full n-gram sets. A group returns each member's links and one edge to the
   smallest member it is connected with, never the pairs.
5. Connected components by alternating large-star and small-star steps, in
   shared tables.

Cost of a hot bucket: the number of links of each of M different near copies
is asked for, so M * M / 2 pairs are verified, in tasks of two blocks; a text is
read by M / BLOCK of them. Copies of one word sequence cost nothing there.

Defined results: a document is a row's doc_id and text. Rows that repeat both
are one document and each get its row; rows that repeat a doc_id with another
text are documents of their own, ordered by doc_id and then MD5 of the text. A
text of one to N - 1 words has all of them as its one n-gram; a null or empty
text has none, shares a class with other such texts and is linked to none
besides. A null doc_id is its own class, with no links. Very long texts are
read whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import cut, drop, id_text, rows_of, slices

N = 5
THRESHOLD = (4, 5)
RECALL = 0.9999
MAX_HASHES = 96
BLOCK = 1024
BLOCK_GRAMS = 1 << 20
COLUMNS = 1 << 12


def band_shape(threshold: float = THRESHOLD[0] / THRESHOLD[1], recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance candidates, that reach the recall within `most` hashes."""
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("the recall needs more hashes")


BANDS, ROWS = band_shape()
#: Odd multipliers of the hash functions, from a fixed seed.
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, first n-gram of each text, first word of each text)."""
    start, end, first = wh.words(data, offsets)
    n = np.diff(first)
    sums = wh.prefix(wh.word_hashes(data, start, end))
    grams = np.where(n >= N, n - N + 1, np.minimum(n, 1))
    at = wh.ranges(first[:-1], first[:-1] + grams)
    owner = np.repeat(np.arange(len(n)), grams)
    return wh.windows(sums, at, np.minimum(at + N, first[1:][owner])), np.concatenate([[0], np.cumsum(grams)]), first


def signed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word sequence's 128-bit hash, the number of n-grams and the band hashes (none without words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("m", pa.binary()), ("t1", pa.int64()), ("t2", pa.int64()), ("grams", pa.int64()), ("bands", pa.list_(pa.int64()))])
    for b in slices(batches):
        data, offsets = wh.flat(b.column("text"))
        grams, at, _ = gram_hashes(data, offsets)
        whole = wh.texts(data, offsets)
        some = np.flatnonzero(np.diff(at))
        least = np.empty((len(some), len(FACTORS)), dtype=np.uint64)
        if len(some):
            for j, f in enumerate(FACTORS):
                least[:, j] = np.minimum.reduceat(grams * f, at[some])
        bands = np.zeros((len(some), BANDS), dtype=np.uint64)
        for i in range(BANDS):
            for j in range(ROWS):
                bands[:, i] = wh.finish(bands[:, i] + least[:, i * ROWS + j] + np.uint64(i + 1))
        sizes = np.zeros(b.num_rows + 1, dtype=np.int32)
        sizes[some + 1] = BANDS
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), type=pa.int32()), pa.array(wh.signed(bands.reshape(-1))))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("m"), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(np.diff(at)), lists], schema=schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys of sorted rows, one table each; only a run is held."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        new = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(edges, edges[1:], strict=False):
            key = tuple(c[x] for c in columns)
            if held and key != last:
                yield joined(held)
                held = []
            last = key
            held.append(b.slice(x, y - x))
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def own_pairs(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of the group's rows that agree in its band and in none before it; across the two blocks if it has two."""
    band, one, other = (group.column(n)[0].as_py() for n in ("band", "one", "other"))
    bands = group.column("bands").flatten().to_numpy().reshape(group.num_rows, BANDS)
    if one == other:
        left, right = np.arange(len(bands)), np.arange(len(bands))
    else:
        block = group.column("block").to_numpy()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == other)
    fits = np.ones((len(left), len(right)), dtype=bool)
    if one == other:
        fits = np.triu(fits, 1)
    for i in range(band):
        fits &= bands[left, i][:, None] != bands[right, i][None, :]
    a, b = np.nonzero(fits)
    return left[a], right[b]


GROUP = ("bucket", "one", "other")


def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group that have a pair of its own."""
    for group in grouped(batches, GROUP):
        if group.num_rows > 1:
            a, b = own_pairs(group)
            if len(a):
                yield group.take(pa.array(np.union1d(a, b)))


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of each pair."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = found > 1  # an n-gram of one text is in no intersection
    inside = shared[column]
    owner, column = owner[inside], (np.cumsum(shared) - 1)[column[inside]]
    by_column = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[by_column], np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
        chosen = by_column[x:y]
        m = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        m[owner[chosen], column[chosen] - i * COLUMNS] = 1
        total += m @ m.T
    return np.rint(total[a, b]).astype(np.int64)


def smallest_linked(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each member the smallest id that its links in the group reach."""
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        if (root == before).all():
            return root


def once(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without those that repeat the keys of the row before, so that a document whose row repeats is held once."""
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = False
        for k in keys:
            c = b.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        first, end = (tuple(b.column(k)[i].as_py() for k in keys) for i in (0, b.num_rows - 1))
        new[0] = first != last
        last = end
        if new.any():
            yield b if new.all() else b.filter(pa.array(new))


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A representative (rep, m), its links found in a group (texts, and documents behind them), and the smallest member reached."""
    schema = pa.schema([("rep", pa.int64()), ("m", pa.binary()), ("texts", pa.int64()), ("documents", pa.int64()), ("root", pa.int64()), ("root_m", pa.binary())])
    up, down = THRESHOLD
    for group in grouped(once(batches, (*GROUP, "rep", "m")), GROUP):
        if group.num_rows < 2:
            continue
        # rows are in order of (rep, m), so their numbers stand for them
        a, b = own_pairs(group)
        grams, at, _ = gram_hashes(*wh.flat(group.column("text")))
        sets = [np.unique(grams[x:y]) for x, y in zip(at, at[1:], strict=False)]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        near = np.minimum(size[a], size[b]) * down >= np.maximum(size[a], size[b]) * up
        a, b = a[near], b[near]
        common = overlaps(sets, a, b)
        linked = common * down >= (size[a] + size[b] - common) * up
        a, b = a[linked], b[linked]
        if not len(a):
            continue
        n, copies = group.num_rows, group.column("copies").to_numpy()
        texts = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        behind = (np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)).astype(np.int64)
        some = np.flatnonzero(texts)
        mine, root = pa.array(some), pa.array(smallest_linked(np.arange(n), a, b)[some])
        rep, m = group.column("rep"), group.column("m")
        yield rows_of(schema, rep=rep.take(mine), m=m.take(mine), texts=texts[some], documents=behind[some], root=rep.take(root), root_m=m.take(root))


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over distinct edges (a, b) with a > b: every node joins neighbours to the smallest of them and itself.

    With `larger` those above it, else those below it. Each step keeps what is
    connected; the minimum is an aggregate combined before the shuffle, and a
    node with very many neighbours is a skewed join that can be split.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "node")
        made = both.join(least, both["a"] == least["node"]).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node")
        made = edges.join(least, edges["a"] == least["node"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*")
    return cut(made.where("a != b").distinct())


def components(edges: DataFrame, told: list[int] | None = None) -> DataFrame:
    """(node, root) of every node of edges (a, b): the smallest node connected with it.

    Large-star and small-star steps in turn until nothing changes, when every
    edge joins a node to its root. They halve the depth of a path with each
    round, so rounds grow with the logarithm of the nodes. `told` gets the
    number of edges after each round.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    rounds: list[int] = [] if told is None else told
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == before or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        large = star(edges, True)
        drop(edges)
        edges = star(large, False)
        drop(large)
        rounds.append(now["n"])


def rows_with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, text and m, the MD5 of the text: a document's identity is doc_id and m."""
    return id_text(docs).withColumn("m", F.unhex(F.md5(F.encode("text", "UTF-8"))))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id it is linked with, directly or through others), rep (the smallest doc_id of its word sequence), n_links (documents linked to it directly, copies included), n_text_links (different texts), m (MD5 of the text), first (whether it is the first document of its group) and rows (equal rows of the table)."""
    known = rows_with_digest(docs)
    lone = known.where("doc_id is null").select("doc_id", "m")
    known = known.where("doc_id is not null")
    signed = known.mapInArrow(signed_texts, "doc_id long, m binary, t1 long, t2 long, grams long, bands array<long>")
    signed = cut(signed.groupBy("doc_id", "m").agg(F.count("*").alias("rows"), *(F.min(c).alias(c) for c in ("t1", "t2", "grams", "bands"))))
    classes = signed.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "m")).alias("first"), F.count("*").alias("copies"), F.min("grams").alias("grams"), F.min("bands").alias("bands"))
    classes = cut(classes.select("t1", "t2", F.col("first.doc_id").alias("rep"), F.col("first.m").alias("m"), "copies", "grams", "bands"))
    buckets = classes.select("rep", "m", "grams", F.posexplode("bands").alias("band", "bucket"))
    sizes = cut(buckets.groupBy("bucket", "band").agg(F.count("*").alias("count"), F.sum("grams").alias("total")).where("count > 1"))
    # merged at every size, and without the lists of bands: only members of shared buckets fetch theirs
    shared = buckets.drop("grams").join(sizes.hint("merge"), ["bucket", "band"])
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("total") / BLOCK_GRAMS))
    dealt = shared.join(classes.select("rep", "m", "copies", "bands").hint("merge"), ["rep", "m"]).withColumn("blocks", blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", "m"), F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "block", "band", "rep", "m", "copies", "bands")
    fields = "bucket long, one long, other long, block long, band int, rep long, m binary, copies long, bands array<long>"
    member = cut(dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(needed, fields))
    drop(sizes)
    # merged at every size: texts are shuffled once, whether or not the members would fit a broadcast
    texts = known.select(F.col("doc_id").alias("rep"), "m", "text")
    with_text = member.hint("merge").join(texts, ["rep", "m"]).select(*member.columns, "text")
    found = cut(with_text.repartition(*GROUP).sortWithinPartitions(*GROUP, "rep", "m").mapInArrow(verified, "rep long, m binary, texts long, documents long, root long, root_m binary"))
    drop(member)
    links = found.groupBy("rep", "m").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    node, root = F.struct(F.col("rep").alias("id"), F.col("m").alias("m")), F.struct(F.col("root").alias("id"), F.col("root_m").alias("m"))
    roots = components(found.where("rep != root or m != root_m").select(node.alias("a"), root.alias("b")))
    roots = roots.select(F.col("node.id").alias("rep"), F.col("node.m").alias("m"), "root")
    told = classes.select("t1", "t2", "rep", "m", "copies").join(links, ["rep", "m"], "left").join(roots, ["rep", "m"], "left")
    told = told.select("t1", "t2", "rep", F.coalesce("root", F.struct(F.col("rep").alias("id"), F.col("m").alias("m"))).alias("root"), (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    told = cut(told)
    drop(found)
    drop(classes)
    per_doc = signed.select("doc_id", "m", "t1", "t2", "rows").join(told, ["t1", "t2"])
    first = (F.col("doc_id") == F.col("root.id")) & (F.col("m") == F.col("root.m"))
    per_doc = per_doc.select("doc_id", F.col("root.id").alias("class_id"), "rep", "n_links", "n_text_links", "m", first.alias("first"), "rows")
    per_row = per_doc.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("row")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    return per_row.unionByName(lone.select("doc_id", none.alias("class_id"), none.alias("rep"), zero.alias("n_links"), zero.alias("n_text_links"), "m", F.lit(True).alias("first"), F.lit(1).cast("long").alias("rows")))
