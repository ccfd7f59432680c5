"""Quality classifier: a factorisation machine.

A text becomes a sparse vector: its words hashed into BUCKETS (log counts,
length one), structure statistics (shares of character kinds, repeated lines
and words, word lengths) and metadata: what a record says of a text without its
words, as one feature each for the class of its size in characters, of its
number of lines, and of its bytes per character. A pair of a word and a size
class has an interaction of its own. The machine scores it with a
bias, linear weights and rank-RANK pairwise interactions, in linear time by
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

Training takes at most SAMPLE labelled texts, the ones with the smallest hash
of doc_id, so the bound is fixed and the choice repeatable; their features (not
their texts) come to the driver, and weights of a fixed size go back. Scoring
reads each text once, without a shuffle. Labels, lang, source and doc_id are no
features.

Defined results: a null or empty text has the empty vector with its structure
statistics and gets a score; labels that are null or of unknown documents are
not used; of labels or texts that repeat a doc_id the smallest is learned from;
with no usable label the score is 0.5; repeated rows repeat; very long texts are
read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_text, rows_of, slices

BUCKETS, RANK, SAMPLE, EPOCHS, SEED = 1 << 13, 4, 4000, 12, 7
THRESHOLD = 0.7
SYMBOLS = re.compile(r"[#*$%&|<>]")
CAPITALS = re.compile(r"[^\W\d_a-zà-öø-ÿß]")
DIGITS = re.compile(r"\d")
POINTS = re.compile(r"[!?]")
STOPS = re.compile(r"[.,;:]")
STRUCTURE = 12
#: Classes of size in characters and of lines (powers of two), and of bytes per character (quarters).
SIZES, LINES, WIDTHS = 24, 16, 13
METADATA = SIZES + LINES + WIDTHS
FEATURES = BUCKETS + STRUCTURE + METADATA


def metadata(text: str) -> list[int]:
    """Places of the three features that hold, counted from the first of metadata."""
    n = len(text)
    lines = text.count("\n") + 1
    width = 4 * len(text.encode("utf-8", "replace")) // max(1, n)
    return [min(n.bit_length(), SIZES - 1), SIZES + min(lines.bit_length(), LINES - 1), SIZES + LINES + min(max(width - 4, 0), WIDTHS - 1)]


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Shares between 0 and 1, and logarithms scaled to about that."""
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = list(zip(words, words[1:], words[2:]))
    return [
        min(1.0, 8 * len(SYMBOLS.findall(text)) / n),
        min(1.0, 2 * len(CAPITALS.findall(text)) / n),
        min(1.0, 8 * len(DIGITS.findall(text)) / n),
        min(1.0, 16 * len(POINTS.findall(text)) / n),
        min(1.0, 10 * len(STOPS.findall(text)) / n),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(counts) / w,
        1 - len(set(pairs)) / max(1, len(pairs)),
        min(1.0, n / w / 20),
        np.log1p(w) / 10,
        np.log1p(len(lines)) / 8,
        float(not words),
    ]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array([self.raw(*r) for r in rows]), -30, 30)))

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[index] * x[:, None]
        s = v.sum(0)
        return float(self.bias + self.linear[index] @ x + (s @ s - (v * v).sum()) / 2)


class Featuriser:
    """Sparse vectors of texts; buckets of words are remembered up to a bound."""

    def __init__(self) -> None:
        self.buckets: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        known = self.buckets
        if len(known) > 500_000:
            known.clear()
        for w in [w for w in counts if w not in known]:
            known[w] = zlib.crc32(w.lower().strip(".,;:!?\"'()").encode("utf-8", "replace")) % BUCKETS
        at = np.fromiter(map(known.__getitem__, counts), dtype=np.int64, count=len(counts))
        n = np.bincount(at, weights=np.fromiter(counts.values(), dtype=np.float64, count=len(counts))) if len(at) else np.zeros(0)
        index = np.flatnonzero(n)
        x = np.log1p(n[index])
        x /= max(1e-9, float(np.sqrt(x @ x)))
        told = BUCKETS + STRUCTURE + np.array(metadata(text))
        return np.concatenate([index, np.arange(BUCKETS, BUCKETS + STRUCTURE), told]), np.concatenate([x, structure(text, words, counts), np.full(3, 0.5)]).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Machine:
    """Logistic loss by AdaGrad, one text at a time in a seeded order."""
    random = np.random.default_rng(SEED)
    size = FEATURES
    m = Machine(0.0, np.zeros(size), random.normal(0, 0.05, (size, RANK)))
    if not rows:
        return Machine(0.0, np.zeros(size), np.zeros((size, RANK)))
    y = np.array(labels, dtype=np.float64)
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y) if 0 < y.sum() < len(y) else np.ones(len(y))
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    for _ in range(EPOCHS):
        for k in random.permutation(len(rows)):
            index, x = rows[k]
            v = m.factors[index]
            vx = v * x[:, None]
            s = vx.sum(0)
            raw = m.bias + m.linear[index] @ x + (s @ s - (vx * vx).sum()) / 2
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[k]) * weight[k]
            g_linear = g * x + 1e-5 * m.linear[index]
            g_factors = g * x[:, None] * (s - vx) + 1e-5 * v
            seen_bias += g * g
            seen_linear[index] += g_linear**2
            seen_factors[index] += g_factors**2
            m.bias -= 0.1 * g / np.sqrt(seen_bias)
            m.linear[index] -= 0.1 * g_linear / np.sqrt(seen_linear[index])
            m.factors[index] -= 0.05 * g_factors / np.sqrt(seen_factors[index])
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Features and labels of the bounded sample; the labels are cut first, so at most `sample` ids are joined to the texts."""
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).dropna()
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("quality", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])
        make = Featuriser()
        for b in slices(batches):
            made = [make(t) for t in b.column("text").to_pylist()]
            yield rows_of(schema, quality=b.column("quality"), at=[i.astype(np.int32).tobytes() for i, _ in made], x=[x.tobytes() for _, x in made])

    # a sample of ids is small by its bound, whatever the tables are
    texts = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    got = texts.orderBy("doc_id").select("text", "quality").mapInArrow(run, "quality int, at binary, x binary").collect()
    return [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got], [int(r["quality"] > 0) for r in got]


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    m = fit(*training_rows(docs, labels, sample))
    weights = docs.sparkSession.sparkContext.broadcast((m.bias, m.linear.astype(np.float32), m.factors.astype(np.float32)))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, make = Machine(*weights.value), Featuriser()
        for b in slices(batches):
            yield rows_of(schema, doc_id=b.column("doc_id"), score=machine.scores([make(t) for t in b.column("text").to_pylist()]))

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
