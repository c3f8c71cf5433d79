"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters and digits (case kept), runs of other printing characters and line
breaks, so menus, shouting and runs of signs are words like any other; a token that repeats the one
before it becomes the word AGAIN. A token's hash names one of BUCKETS words. Every word has a fixed
sparse index vector of +1 and -1 drawn from its number; its context vector is the sum of the index
vectors of its neighbours up to WINDOW places away, over every text of the corpus. These sums are whole numbers, added up in each task, then by Spark, so
they do not depend on how documents are dealt out. BUCKETS * DIMS numbers reach the driver and every
task, whatever the corpus holds; words that share a bucket share a vector.

A document is the mean of its tokens' unit context vectors, each less the mean direction of all
words, and the same mean over frequent and rare words apart: words are weighed by ALPHA / (ALPHA + their share of
all tokens), and by the rest. These pooled vectors are written once.

The network (HIDDEN tanh units, one logistic output) is fitted with numpy to a sample of labelled documents,
SAMPLE_DOCS in expectation, a fifth of which is kept back to find the temperature that its logits
are divided by.

Defined results: a null text counts as empty, and an empty one has the zero vector and so one score of
its own; rows without a doc_id are scored, not learned from; repeated rows are scored alike; a doc_id
with several labels teaches each of them; without labels of both kinds the score is the
smoothed share of label 1; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import text
from gridpanel.llm.scratch import materialise

BUCKETS = 1 << 15
DIMS = 32
NONZERO = 4
WINDOW = 2
ALPHA = 1e-3
HIDDEN = 24
SAMPLE_DOCS = 20_000
THRESHOLD = 0.3
#: The word that a token becomes that repeats the one before it.
AGAIN = 0
#: Tokens worked on at once.
LOT = 1 << 17


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables of words and of signs; every byte outside of both stands between tokens."""
    word, sign = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80:
            word[b] = b
        elif b > 0x20 and b != 0x7F or b == 0x0A:
            sign[b] = b
    return word, sign


WORD, SIGN = _kinds()


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """(buckets + 1, dims) of NONZERO entries +1 or -1 a row, which add up where they meet, and a last row of zeros."""
    number = np.arange(buckets * NONZERO, dtype=np.uint64) + np.uint64(1)
    drawn = text.mix(number * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((buckets, dims), np.int16)
    row = np.repeat(np.arange(buckets), NONZERO)
    np.add.at(out, (row, (drawn % np.uint64(dims)).astype(np.int64)), np.where(drawn >> np.uint64(63), 1, -1).astype(np.int16))
    return np.concatenate([out, np.zeros((1, dims), np.int16)])


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bucket of every token, ends): tokens of several texts in order, ends[i] behind the i-th text's last."""
    everything, offsets = text.column_bytes(column)
    for lo, hi in text.groups_of_texts(offsets, 1 << 20):
        data = everything[offsets[lo] : offsets[hi]]
        local = offsets[lo : hi + 1] - offsets[lo]
        words, signs = text.words(data, local, WORD), text.words(data, local, SIGN)
        start = np.concatenate([words.start, signs.start])
        order = np.argsort(start, kind="stable")
        hashes = np.concatenate([words.hash, signs.hash])[order]
        ends = words.first[1:] + signs.first[1:]
        tokens = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16)
        again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        tokens[again[~np.isin(again, ends)]] = AGAIN
        yield lo, tokens, ends


def add_contexts(sums: np.ndarray, counts: np.ndarray, tokens: np.ndarray, ends: np.ndarray, index: np.ndarray) -> None:
    """Add to every token's row of `sums` the index vectors of its neighbours in the same text.

    `index` has one row more than there are words, of zeros, for the places between texts.
    """
    counts += np.bincount(tokens, minlength=len(counts))
    apart = len(index) - 1
    place = np.arange(len(tokens)) + WINDOW * (1 + np.searchsorted(ends, np.arange(len(tokens)), side="right"))
    padded = np.full(place[-1] + WINDOW + 1, apart, np.uint16)
    padded[place] = tokens
    for at in range(WINDOW, len(padded) - WINDOW, LOT):
        to = min(at + LOT, len(padded) - WINDOW)
        near = index[padded[at - WINDOW : to + WINDOW]]
        around = np.zeros((to - at, index.shape[1]), np.int16)
        for shift in range(2 * WINDOW + 1):
            if shift != WINDOW:
                around += near[shift : shift + to - at]
        order = np.argsort(padded[at:to], kind="stable")
        found, begin = np.unique(padded[at:to][order], return_index=True)
        added = np.add.reduceat(around[order], begin, axis=0, dtype=np.int64)
        sums[found[found < apart]] += added[found < apart]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n, c0, c1, ...) of the words of one task."""
    index = index_vectors()
    sums, counts = np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, tokens, ends in _tokens(batch.column(0)):
            if len(tokens):
                add_contexts(sums, counts, tokens, ends, index)
    found = np.flatnonzero(counts)
    for at in range(0, len(found), 4096):
        some = found[at : at + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), *[pa.array(sums[some, k]) for k in range(DIMS)]],
            names=["bucket", "n", *[f"c{k}" for k in range(DIMS)]],
        )


@dataclass
class Vectors:
    """A unit vector for each word, and how much it weighs among frequent and rare words."""

    unit: np.ndarray
    rare: np.ndarray

    def pooled(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(texts, 2 * DIMS): weighted means over each text's tokens; zeros for a text without any."""
        out = np.zeros((len(ends), 2 * self.unit.shape[1]), np.float64)
        since = np.concatenate([[0], ends[:-1]])
        for i in np.flatnonzero(ends > since):
            found, n = np.unique(tokens[since[i] : ends[i]], return_counts=True)
            unit, rare = self.unit[found], self.rare[found] * n
            total = n.sum()
            out[i] = np.concatenate([rare @ unit, (n - rare) @ unit]) / total
        return out


def vectors_of(sums: np.ndarray, counts: np.ndarray) -> Vectors:
    """Context vectors as unit vectors around the mean direction of all tokens."""
    total = max(counts.sum(), 1)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.where(length > 0, length, 1.0)
    unit = np.where(counts[:, None] > 0, unit - counts @ unit / total, 0.0)
    return Vectors(unit.astype(np.float32), ALPHA / (ALPHA + counts / total))


def word_vectors(docs: DataFrame) -> Vectors:
    """Vectors from every text; BUCKETS rows reach the driver at most."""
    columns = [f"c{k}" for k in range(DIMS)]
    kinds = ", ".join(["bucket int", "n bigint", *[f"{c} bigint" for c in columns]])
    rows = (
        docs.select("text")
        .mapInArrow(_contexts, kinds)
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
        .toPandas()
    )
    sums, counts = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    sums[rows["bucket"]] = rows[columns].to_numpy(np.float64)
    counts[rows["bucket"]] = rows["n"]
    return vectors_of(sums, counts)


def pool(docs: DataFrame, vectors: Vectors) -> DataFrame:
    """(doc_id, vector) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, tokens, ends in _tokens(batch.column(1)):
                rows = vectors.pooled(tokens, ends).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(ends)),
                        text.nested(rows.ravel(), np.full(len(rows), rows.shape[1]), pa.float32()),
                    ],
                    names=["doc_id", "vector"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, vector array<float>")


@dataclass
class Network:
    """Two layers over standardised inputs; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Network:
    """Adam over batches of 256 rows on the mean cross-entropy."""
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0)
    net = Network(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), None, None, None, 0.0)
    z = (x - net.mean) / net.scale
    n, d = z.shape
    p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        rows = rng.integers(0, n, min(n, 256))
        hidden = np.tanh(z[rows] @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50))) - y[rows]) / len(rows)
        back = np.outer(error, p[2]) * (1 - hidden**2)
        grads = [z[rows].T @ back + decay * p[0], back.sum(axis=0), hidden.T @ error + decay * p[2], error.sum(keepdims=True)]
        now = rate * (1 - step / (steps + 1))
        for a, g, m, v in zip(p, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least cross-entropy on rows the network has not seen, from 1/8 to 8."""
    if not len(y):
        return 1.0
    grid = 2.0 ** np.linspace(-3, 3, 97)
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def _unit(column: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column.cast("string"), F.lit(seed)), 11) / float(1 << 53)


def fit(pooled: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | float:
    """A calibrated network from (doc_id, vector) and labels (doc_id, quality); a constant score without both labels."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    marked = materialise(pooled.join(marked, "doc_id"), "labelled")
    sizes = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    rate = sample_docs / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    sample = marked.where(_unit(F.col("doc_id"), 5) < rate).select(
        "doc_id", "quality", "vector", (_unit(F.col("doc_id"), 6) < 0.2).alias("kept_back")
    )
    rows = sample.toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x, y = np.array(rows["vector"].tolist(), np.float64), rows["quality"].to_numpy(np.float64)
    back = rows["kept_back"].to_numpy(bool)
    if len(np.unique(y[~back])) < 2:
        return (sizes[1] + 1) / (sizes[0] + sizes[1] + 2)
    net = train(x[~back], y[~back])
    net.temperature = temperature(net.logits(x[back]), y[back])
    return net


def scores(pooled: DataFrame, net: Network | float, *columns: str) -> DataFrame:
    """`columns` of the pooled rows, and `score`."""
    if not isinstance(net, Network):
        return pooled.select(*columns, F.lit(float(net)).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(net.mean)
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(net.score(x.astype(np.float64)))], names=[*columns, "score"]
            )

    kinds = [f"{c} {pooled.schema[c].dataType.simpleString()}" for c in columns]
    return pooled.select(*columns, "vector").mapInArrow(run, ", ".join([*kinds, "score double"]))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of held-out rows are not learned from."""
    docs = docs.select("doc_id", "text")
    pooled = materialise(pool(docs, word_vectors(docs)), "pooled")
    net = fit(pooled, labels.where(~held_out()), sample_docs)
    scored = scores(pooled, net, "doc_id")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
