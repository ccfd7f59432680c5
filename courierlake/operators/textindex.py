"""Inverted indexes: ranked text search, and substring filters that read candidates only.

An index is a folder of tables that grow by appending:

- postings: a row for each term and block of BLOCK document ids, with the ids' places
  in the block, how often each holds the term, the lengths of the documents, and from
  these the greatest count and the least length. Rows are sorted by term within a
  directory for each bucket of terms, so a query opens the directories of its
  terms and of these the row groups whose range holds them. A term that all
  documents share is many rows, dealt to many tasks.
- stats: for each append, the number of documents and their total length.
- texts (substring index only): the documents themselves, sorted by block.

Postings are made from documents dealt by block: a task has all ids of its blocks,
so what is shuffled after that is a row for each term and block, ids as their
places in the block, and no row for each word or gram of a document. Most of these
rows have a few ids, so they are shuffled as compressed Arrow streams of many
rows, one for each bucket of terms. Streams go to tasks by bucket and by the group
of GROUP tasks that made them, which bounds a hot term's share.
A term and block may have rows of several, as with appends.

Ranked search (BM25) goes by score bounds. A block's bound is the sum over the
terms of what the greatest count in the shortest document would score; those
columns alone are read first. The documents of the best few blocks give a score
that the k-th hit has at least, and only blocks with a bound that high are
opened.

Messages whose bodies are shared are indexed in parts (append_shared): one index of
heads, one of bodies with each once, and members, a row for each message with its
body and whole length. A message's count of a term is the sum of both. So texts
are dealt once for each body; a search reads all members, a few bytes a message.

Substring search looks up the pattern's three-character grams, keeps the
documents that hold all of them, and tests the pattern on these. A shorter pattern
has no gram: all documents are tested, and none need be indexed for it (holding_short).

Defined results: a null or empty text has no terms; a null id is not indexed;
rows that repeat an id are one document with the terms of all; scores are
rounded to six places and ties go by id; an empty index finds nothing; a pattern
of fewer than three characters has no gram and is tested on all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the tables of an index; kept indexes of another are made anew.
VERSION = 3
#: 2**SHIFT ids.
SHIFT = 10
BLOCK = 1 << SHIFT
#: Tasks whose postings of a bucket one task sorts.
GROUP = 32
BUCKETS = 64
#: Bytes of postings that a task holds before it makes streams of them.
HELD = 16 << 20
K1, B = 1.2, 0.75
#: Blocks that are scored first, to learn a score to beat.
FIRST = 8
#: As many blocks of texts are named in a filter that reaches the scan; more are joined.
NAMED = 500
WORD = r"[\p{L}\p{N}]+"
GRAM = 3


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def block_of(doc: Column) -> Column:
    return F.shiftright(doc, SHIFT)


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def sorted_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by range of the keys and sorted, so that a hot first key spreads over tasks."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def by_block(docs: DataFrame) -> DataFrame:
    """Documents with those of a block in one task, sorted by id."""
    return docs.repartition("block").sortWithinPartitions("block", "doc")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a term as compressed streams, one for each bucket that they are of."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        buckets = np.array([zlib.crc32(t) % BUCKETS for t in rows["term"].cast(pa.binary()).to_pylist()], np.int32)
        order = np.argsort(buckets, kind="stable")
        rows, (found, starts) = rows.take(pa.array(order)), np.unique(buckets[order], return_index=True)
        streams = []
        for low, high in zip(starts, np.append(starts[1:], len(order))):
            stream = pa.BufferOutputStream()
            with pa.ipc.new_stream(stream, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows[low:high].combine_chunks())
            streams.append(stream.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(streams, pa.binary())], ["bucket", "stream"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield told(held)
            held, size = [], 0
    if held:
        yield told(held)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of streams, with their bucket."""
    for batch in batches:
        for bucket, stream in zip(batch["bucket"], batch["stream"]):
            for rows in pa.ipc.open_stream(stream.as_buffer()):
                yield rows.append_column("bucket", pa.repeat(bucket, len(rows)))


def write_postings(docs: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, path: str) -> None:
    """Append the rows that make() makes of documents dealt by block, sorted by term within the directory of a bucket."""
    streams = docs.mapInArrow(lambda batches: packed(make(batches)), "bucket int, stream binary").withColumn("group", F.floor(F.spark_partition_id() / GROUP))
    # so many tasks whatever the streams' bytes, of which their rows have several times as many
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = streams.repartition(tasks, "bucket", "group").select("bucket", "stream").mapInArrow(unpacked, f"{schema}, bucket int")
    rows.sortWithinPartitions("bucket", "term", "block").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def cuts(blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most BLOCK rows that end where a block does, if any of them can."""
    low, edges = 0, np.append(np.flatnonzero(np.diff(blocks)) + 1, len(blocks))
    while low < len(blocks):
        at = np.searchsorted(edges, low + BLOCK, "right") - 1
        high = int(edges[at]) if at >= 0 and edges[at] > low else min(low + BLOCK, len(blocks))
        yield low, high
        low = high


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    found = np.ones(len(columns[0]), bool)
    if len(found):
        found[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return found


def listed(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def counted(docs: np.ndarray, terms: pa.StringArray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.StringArray, np.ndarray]:
    """Sums of tf for each term and document, in the order of terms' codes, then of documents: ids, codes, the terms by code, sums."""
    coded = terms.dictionary_encode()
    ids, place = np.unique(docs, return_inverse=True)
    key = coded.indices.to_numpy().astype(np.int64) * len(ids) + place
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(changes(key[order]))
    key = key[order[starts]]
    return ids[key % len(ids)], key // len(ids), coded.dictionary, np.add.reduceat(tf[order], starts)


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term and block of documents that come sorted by id; rows of one id are one document."""

    def told(docs: np.ndarray, codes: np.ndarray, terms: pa.StringArray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(docs):
            ids, place = np.unique(docs, return_inverse=True)
            lengths = np.bincount(place, tf).astype(np.int64)[place]
            blocks = docs >> SHIFT
            starts = np.flatnonzero(changes(codes, blocks))
            columns = {
                "term": terms.take(pa.array(codes[starts])),
                "block": pa.array(blocks[starts]),
                "n": pa.array(np.diff(np.append(starts, len(docs))).astype(np.int32)),
                "max_tf": pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)),
                "min_len": pa.array(np.minimum.reduceat(lengths, starts)),
                "at": listed(starts, (docs & (BLOCK - 1)).astype(np.int16)),
                "tf": listed(starts, tf.astype(np.int32)),
                "len": listed(starts, lengths),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    # the words of the last document so far, which may go on
    held = np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    for batch in batches:
        every = batch["doc"].to_numpy()
        for low, high in cuts(every >> SHIFT):
            words_, n = batch["terms"][low:high], every[low:high]
            docs = np.append(held[0], np.repeat(n, words_.value_lengths().to_numpy()))
            terms = pa.concat_arrays([held[1], words_.flatten().cast(pa.string())])
            if not len(docs):
                continue
            docs, codes, known, tf = counted(docs, terms, np.append(held[2], np.ones(len(docs) - len(held[2]), np.int64)))
            last = docs == n[-1]
            held = docs[last], known.take(pa.array(codes[last])), tf[last]
            yield from told(docs[~last], codes[~last], known, tf[~last])
    if len(held[0]):
        yield from told(*counted(*held))


ROWS = "term string, block long, n int, max_tf int, min_len long, at array<smallint>, tf array<int>, len array<long>"


def append_words(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Add documents to the index for ranked search at path; their ids must be new to it."""
    own = docs.select(docs[key].cast("long").alias("doc"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).where("doc is not null")
    length = F.regexp_count(F.lower("text"), F.lit(WORD))
    own.agg(F.count_distinct("doc").alias("docs"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("length")).write.mode("append").parquet(f"{path}/stats")
    dealt = by_block(own.withColumn("block", block_of(F.col("doc"))))
    write_postings(dealt.select("doc", words(F.col("text")).alias("terms")), word_rows, ROWS, path)


def score(tf: Column, length: Column, idf: Column, average: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def postings_of(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Rows of the terms, from their directories alone."""
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path}/postings")
    known = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term")).alias("b")).collect()
    return rows.where(F.col("bucket").isin(*{r["b"] for r in known}) & F.col("term").isin(*terms))


EMPTY = "doc long, score double"


def search_words(spark: SparkSession, path: str, query: str, limit: int = 10, match_all: bool = False) -> DataFrame:
    """doc and score of the documents that score most for the words of the query; with match_all only those that hold all of them."""
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    size = spark.read.parquet(f"{path}/stats").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
    if not terms or not size["length"]:
        return spark.createDataFrame([], EMPTY)
    average = size["length"] / size["docs"]
    rows = postings_of(spark, path, terms)
    found = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    if not found or match_all and len(found) < len(terms):
        return spark.createDataFrame([], EMPTY)
    weights = {t: math.log(1 + (size["docs"] - df + 0.5) / (df + 0.5)) for t, df in found.items()}
    idf = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("term"))
    per_term = rows.select("term", "block", score(F.col("max_tf"), F.col("min_len"), idf, average).alias("most")).groupBy("term", "block").agg(F.max("most").alias("most"))
    bounds = per_term.groupBy("block").agg(F.sum("most").alias("bound"), F.count("*").alias("terms"))
    if match_all:
        bounds = bounds.where(F.col("terms") == len(terms))

    def scored(some: DataFrame) -> DataFrame:
        hits = some.select("term", "block", F.inline(F.arrays_zip("at", "tf", "len"))).select((F.col("block") * BLOCK + F.col("at")).alias("doc"), score(F.col("tf"), F.col("len"), idf, average).alias("part"))
        told = hits.groupBy("doc").agg(F.sum("part").alias("score"), F.count("*").alias("terms"))
        if match_all:
            told = told.where(F.col("terms") == len(terms))
        return told.select("doc", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)

    best = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
    seen = [r["score"] for r in scored(rows.where(F.col("block").isin(*best))).collect()] if best else []
    least = seen[-1] - 2e-6 if len(seen) == limit else 0.0
    open_ = bounds.where(F.col("bound") >= least).select("block")
    return scored(rows.join(open_, "block", "left_semi"))


def append_shared(messages: DataFrame, bodies: DataFrame, path: str) -> None:
    """Add messages (doc, body, text: the head) and the bodies they name (body, text) to the index at path; ids must be new to it and not repeat, every body must be there."""
    own = messages.select(F.col("doc").cast("long"), F.col("body").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    append_words(own, f"{path}/heads", "doc")
    append_words(bodies, f"{path}/bodies", "body")
    length = F.regexp_count(F.lower("text"), F.lit(WORD)).cast("long")
    long = bodies.select(F.col("body").cast("long"), F.coalesce(F.regexp_count(F.lower("text"), F.lit(WORD)).cast("long"), F.lit(0)).alias("more"))
    members = own.select("doc", "body", length.alias("len")).join(long, "body").select("doc", "body", (F.col("len") + F.col("more")).alias("len"))
    members.write.mode("append").parquet(f"{path}/members")


def search_shared(spark: SparkSession, path: str, query: str, limit: int = 10, match_all: bool = False) -> DataFrame:
    """As search_words(), of an index made by append_shared()."""
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    members = spark.read.parquet(f"{path}/members")
    size = members.agg(F.count("*").alias("docs"), F.sum("len").alias("length")).first()
    if not terms or not size["length"]:
        return spark.createDataFrame([], EMPTY)
    average = size["length"] / size["docs"]
    names = range(len(terms))

    def counts(part: str, key: str) -> DataFrame:
        """A row for each id of a part that holds a term, with how often it holds each."""
        hits = postings_of(spark, f"{path}/{part}", terms).select("term", "block", F.inline(F.arrays_zip("at", "tf")))
        hits = hits.withColumn(key, F.col("block") * BLOCK + F.col("at"))
        return hits.groupBy(key).agg(*(F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"{part}{i}") for i, t in zip(names, terms)))

    told = members.join(counts("bodies", "body"), "body", "left").join(counts("heads", "doc"), "doc", "left")
    told = told.select("doc", "len", *((F.coalesce(f"bodies{i}", F.lit(0)) + F.coalesce(f"heads{i}", F.lit(0))).alias(f"tf{i}") for i in names))
    df = told.agg(*(F.count_if(F.col(f"tf{i}") > 0) for i in names)).first()
    if match_all and 0 in df:
        return spark.createDataFrame([], EMPTY)
    held = [F.col(f"tf{i}") > 0 for i in names]
    found = told.where(F.forall(F.array(*held), lambda x: x) if match_all else F.exists(F.array(*held), lambda x: x))
    parts = (score(F.col(f"tf{i}"), F.col("len"), F.lit(math.log(1 + (size["docs"] - df[i] + 0.5) / (df[i] + 0.5))), average) for i in names)
    return found.select("doc", F.round(sum(parts, F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of GRAM characters and block, with the places of the documents that hold it."""
    for batch in batches:
        docs = batch["doc"].to_numpy()
        for low, high in cuts(docs >> SHIFT):
            own = []
            for text in batch["text"][low:high].to_pylist():
                c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                own.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) >= GRAM else c[:0])
            doc, gram = np.repeat(docs[low:high], [len(g) for g in own]), np.concatenate(own)
            order = np.argsort(gram, kind="stable")
            doc, gram = doc[order], gram[order]
            again = np.zeros(len(gram), bool)  # a repeated id has its grams once
            again[1:] = (gram[1:] == gram[:-1]) & (doc[1:] == doc[:-1])
            doc, gram = doc[~again], gram[~again]
            starts = np.flatnonzero(changes(gram, doc >> SHIFT))
            if len(starts):
                told = gram[starts]
                every = np.stack([told >> 42, told >> 21 & 0x1FFFFF, told & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le")
                terms = [every[i : i + GRAM] for i in range(0, len(every), GRAM)]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(doc[starts] >> SHIFT), listed(starts, (doc & (BLOCK - 1)).astype(np.int16))], ["term", "block", "at"])


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """block, doc and text of documents, as the substring index holds them."""
    own = docs.select(docs[key].cast("long").alias("doc"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).where("doc is not null")
    return own.select(block_of(F.col("doc")).alias("block"), "doc", "text")


def append_grams(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Add documents to the substring index at path; their ids must be new to it."""
    texts = texts_of(docs, key, text)
    sorted_by(texts, "block", "doc").write.mode("append").option("parquet.block.size", 1 << 22).parquet(f"{path}/texts")
    write_postings(by_block(texts).select("doc", F.lower("text").alias("text")), gram_rows, "term string, block long, at array<smallint>", path)


def grams_of(pattern: str) -> list[str]:
    low = pattern.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def tested(texts: DataFrame, pattern: str) -> DataFrame:
    return texts.where(F.contains(F.lower("text"), F.lit(pattern.lower())))


def holding_short(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As holding(), of a pattern without grams and of documents that need no index."""
    return tested(texts_of(docs, key, text), pattern)


def holding(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """block, doc and text of the documents that hold the pattern, whatever its case."""
    texts, wanted = spark.read.parquet(f"{path}/texts"), grams_of(pattern)
    if not wanted:
        return tested(texts, pattern)
    rows = postings_of(spark, path, wanted)
    # blocks that hold all grams first: of the others no ids are read
    full = rows.select("term", "block").distinct().groupBy("block").count().where(F.col("count") == len(wanted)).select("block")
    ids = rows.join(full, "block", "left_semi").select("term", "block", F.explode("at").alias("at")).withColumn("doc", F.col("block") * BLOCK + F.col("at"))
    ids = ids.groupBy("block", "doc").agg(F.count_distinct("term").alias("count")).where(F.col("count") == len(wanted)).select("block", "doc")
    blocks = [r["block"] for r in ids.select("block").distinct().limit(NAMED + 1).collect()]
    if not blocks:
        return texts.where(F.lit(False))
    if len(blocks) <= NAMED:
        texts = texts.where(F.col("block").isin(*blocks))
    return tested(texts.join(ids, ["block", "doc"], "left_semi"), pattern)
