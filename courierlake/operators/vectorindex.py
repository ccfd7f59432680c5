"""Approximate nearest vectors by a coarse quantiser; vector_topk() in extensions.py is the exact way.

Vectors are scaled to length one, so cosine and distance give one order. The
quantiser is Spark's own distributed k-means, fitted on at most SAMPLE vectors,
chosen by a hash of their ids; every vector is then assigned to a cell and
written by (cell, part), where a part holds about PART vectors, so that a cell of
very many near or equal vectors is many groups.

A search sends each query to the `probe` cells whose centres are nearest, meets
the parts of these cells, and keeps the best of each part before the best of all
are chosen. What is compared is queries times vectors in the probed cells. How
many cells are probed is measured when the index is built: for TUNED vectors,
chosen by hash, the true neighbours are found by the exact way, and as many cells
are probed as hold TARGET of them. Vectors in groups need few; those without any
order (random ones of 64 numbers) need half of all.

Defined results: vectors that are null, of another size than the first, or
without length are not indexed and find nothing; ties go by id; rows that repeat an
id are indexed each, and an id is found once for each; an empty table gives an
empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of the tables of an index; kept indexes of another are made anew.
VERSION = 1
#: Vectors that the quantiser is fitted on, at most.
SAMPLE = 100_000
PART = 4096
#: Cells are the root of the number of vectors, up to so many: centres go to all tasks, at most CELLS times the vector's size.
CELLS = 4096
SEED = 7
#: Vectors whose true neighbours are found to choose how many cells are probed, and the share of these to be found.
TUNED, TARGET, NEIGHBOURS = 200, 0.95, 10
#: Rows that a task compares with a part, or with the centres, at once: what numpy holds is STEP times PART or CELLS numbers.
STEP = 128
FOUND = "query long, vec_id long, cosine double"


def scaled(v: Column) -> Column:
    """The vector over its length; null if it has none."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def usable(vectors: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """vec_id and v, scaled, of vectors that can be compared."""
    own = vectors.select(vectors[key].cast("long").alias("vec_id"), scaled(F.col(column)).alias("v"))
    return own.where((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def nearest(centres: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each row the n nearest centres, nearest first."""
    d = (centres**2).sum(1) - 2 * v @ centres.T
    some = np.argpartition(d, min(n, d.shape[1]) - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(v), 1))
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def nearest_by_steps(centres: np.ndarray, vectors: pd.Series, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """As nearest(), for STEP rows at a time, with the rows that these are."""
    for low in range(0, len(vectors), STEP):
        some = slice(low, min(low + STEP, len(vectors)))
        yield some, nearest(centres, np.stack(vectors.iloc[some].to_numpy()), n)


def best_of(asked: pd.DataFrame, stored: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The `limit` nearest of stored (vec_id, v) to each of asked (query, q); ties go by id."""
    out = [pd.DataFrame({"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "cosine": np.zeros(0)})]
    if not len(asked) or not len(stored):
        return out[0]
    stored = stored.sort_values("vec_id", kind="stable")
    ids, v = stored["vec_id"].to_numpy(), np.stack(stored["v"].to_numpy()).T
    n = min(limit, len(ids))
    for low in range(0, len(asked), STEP):
        some = asked.iloc[low : low + STEP]
        cosine = np.round(np.stack(some["q"].to_numpy()) @ v, 6)
        least = np.partition(cosine, len(ids) - n, axis=1)[:, len(ids) - n]
        rows, at = np.nonzero(cosine >= least[:, None])  # n of each row, and ties with the last of them
        told = cosine[rows, at]
        order = np.lexsort((at, -told, rows))
        rows, at, told = rows[order], at[order], told[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
        out.append(pd.DataFrame({"query": some["query"].to_numpy()[rows[kept]], "vec_id": ids[at[kept]], "cosine": told[kept]}))
    return pd.concat(out)


def build(vectors: DataFrame, path: str, key: str = "vec_id", column: str = "embedding", cells: int | None = None) -> None:
    """Write the index of vectors to path: centres, and vectors by cell and part."""
    spark = vectors.sparkSession
    first = vectors.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).limit(1).collect()
    own = usable(vectors, key, column, first[0]["n"] if first else 0)
    n = own.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * share)).select(array_to_vector("v").alias("features"))
    k = max(1, min(cells or CELLS, CELLS, round(n**0.5)))
    centres = np.zeros((1, 1))
    if n and not sample.isEmpty():
        centres = np.array(KMeans(k=k, seed=SEED, maxIter=15, featuresCol="features").fit(sample).clusterCenters())
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] if n else [], "cell int, centre array<double>").write.parquet(f"{path}/centres")

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["cell"] = np.concatenate([near[:, 0] for _, near in nearest_by_steps(centres, b["v"], 1)]).astype(np.int32)
                yield b

    dealt = own.mapInPandas(assigned, "vec_id long, v array<double>, cell int")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sizes.write.parquet(f"{path}/cells")
    sizes = spark.read.parquet(f"{path}/cells")  # at most CELLS rows
    placed = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")).drop("parts")
    placed.repartitionByRange("cell", "part", "vec_id").sortWithinPartitions("cell", "part", "vec_id").write.parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    some = stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNED).select("vec_id", "v")

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some, cells in nearest_by_steps(centres, b["v"], len(centres)):
                yield pd.DataFrame({"query": np.repeat(b["vec_id"].to_numpy()[some], cells.shape[1]), "cell": cells.ravel().astype(np.int32), "rank": np.tile(np.arange(cells.shape[1], dtype=np.int32), len(cells))})

    truth = exact(stored, some, column="v", limit=NEIGHBOURS).join(stored.select("vec_id", "cell"), "vec_id")
    ranks = truth.join(some.mapInPandas(ranked, "query long, cell int, rank int"), ["query", "cell"]).groupBy("rank").count()
    probe, held, counts = 1, 0, sorted((r["rank"], r["count"]) for r in ranks.collect())  # at most CELLS
    for rank, count in counts:
        if held < TARGET * sum(n for _, n in counts):
            probe, held = rank + 1, held + count
    spark.createDataFrame([(probe,)], "probe int").write.parquet(f"{path}/tuned")


def search(spark: SparkSession, path: str, queries: DataFrame, key: str = "vec_id", column: str = "embedding", limit: int = 10, probe: int | None = None) -> DataFrame:
    """query, vec_id and cosine of the `limit` nearest vectors to each query, of those in its `probe` nearest cells (as measured, if not given); a query finds itself too."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most CELLS
    if not rows:
        return spark.createDataFrame([], FOUND)
    centres = np.array([r["centre"] for r in rows])
    probe = probe or spark.read.parquet(f"{path}/tuned").first()["probe"]

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some, cells in nearest_by_steps(centres, b["v"], probe):
                yield pd.DataFrame({"query": b["vec_id"].to_numpy()[some], "q": b["v"].to_numpy()[some], "cells": list(cells.astype(np.int32))})

    asked = usable(queries, key, column, centres.shape[1]).mapInPandas(probed, "query long, q array<double>, cells array<int>")
    # a task holds a part of the vectors and of the queries
    sides = max(1, -(-queries.count() // PART))
    asked = asked.withColumn("a", F.pmod(F.xxhash64("query"), F.lit(sides))).select("query", "q", "a", F.explode("cells").alias("cell"))
    parts = spark.read.parquet(f"{path}/cells").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = asked.join(F.broadcast(parts), "cell")  # a row for each part, at most the vectors over PART plus CELLS
    stored = spark.read.parquet(f"{path}/vectors").withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_of(left, right, limit)

    found = asked.groupBy("cell", "part", "a").cogroup(stored.groupBy("cell", "part", "a")).applyInPandas(best, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "vec_id", "cosine")


def exact(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", limit: int = 10) -> DataFrame:
    """As search(), over all vectors: blocks of queries against blocks of vectors."""
    first = vectors.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).limit(1).collect()
    size = first[0]["n"] if first else 0
    left = usable(queries, key, column, size).select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    right = usable(vectors, key, column, size)
    blocks = max(1, -(-right.count() // PART))
    sides = max(1, -(-left.count() // PART))
    left = left.withColumn("a", F.pmod(F.xxhash64("query"), F.lit(sides))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))))

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        return best_of(qs, vs, limit)

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(best, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "vec_id", "cosine")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how many true neighbours there are, and how many of them were found."""
    hits = truth.join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return hits.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
