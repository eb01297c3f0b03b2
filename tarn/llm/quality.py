"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document is the mean of learned vectors of its words (the bytes as they stand, hashed) and of its character
n-grams (3 and 4 bytes, hashed); a softmax layer turns it into class probabilities. Because both the mean and the layer are
linear, scoring needs one number per hash bucket: the difference of its two logits. That table, of a
fixed size, is what workers get; each then makes one pass over whole texts.

Training takes at most `per_class` labelled documents of each class, those of smallest seeded hash, whole.
The classes weigh alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import durable, give_back, ready, trim
from ._words import U, Words, steps

BUCKET_BITS = 17


def _ngrams(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every feature of some texts."""
    d = words.data.astype(np.uint32)
    n = len(d)
    shift = np.uint32(32 - bits)
    ends = words.offsets
    ids, docs = [], []
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends))
    for size, salt in ((3, 0x01000193), (4, 0x9E3779B1)):
        m = n - size + 1
        if m <= 0:
            continue
        g = d[:m].copy()
        for k in range(1, size):
            g |= d[k : k + m] << np.uint32(8 * k)
        if size == 3:
            g ^= np.uint32(0x5B000000)
        g *= np.uint32(salt)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA6B)
        inside = owner[:m] == owner[size - 1 :]
        ids.append((g >> shift)[inside])
        docs.append(owner[:m][inside])
    ids.append((words.hashes >> U(64 - bits)).astype(np.uint32))
    docs.append(np.repeat(np.arange(len(words), dtype=np.int32), np.diff(words.first)))
    return np.concatenate(ids), np.concatenate(docs)


@dataclass
class Model:
    """Logit difference per bucket and a bias; score = 1 / (1 + exp(-(bias + mean)))."""

    table: np.ndarray
    bias: float
    bits: int = BUCKET_BITS

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for at, to, words in steps(column, lower=False):
            ids, docs = _ngrams(words, self.bits)
            total = np.bincount(docs, weights=self.table[ids], minlength=to - at)
            count = np.bincount(docs, minlength=to - at)
            out[at:to] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-(out + self.bias)))


def train(texts: list[str | None], labels: list[int], dim: int = 8, epochs: int = 12, rate: float = 0.5, batch: int = 32, bits: int = BUCKET_BITS, seed: int = 5) -> Model:
    """Embeddings and a two-class softmax layer. Without texts of both classes the score is constant (0.5 with none)."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for _, to_at, words in steps(pa.array(texts, pa.string()), lower=False):
        ids, docs = _ngrams(words, bits)
        pairs, counts = np.unique(docs.astype(np.int64) << 32 | ids, return_counts=True)
        edges = np.searchsorted(pairs >> 32, np.arange(len(words) + 1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            bags.append(((pairs[a:b] & 0xFFFFFFFF).astype(np.int32), (counts[a:b] / max(1, counts[a:b].sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    weight = (len(y) / (2 * np.bincount(y, minlength=2))).astype(np.float32)
    steps_in_all = epochs * -(-len(y) // batch)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            ids = np.concatenate([bags[k][0] for k in own])
            share = np.concatenate([bags[k][1] for k in own])
            lens = np.array([len(bags[k][0]) for k in own])
            row = np.repeat(np.arange(len(own)), lens)
            x = vectors[ids]
            hidden = np.zeros((len(own), dim), np.float32)
            scaled = x * share[:, None]
            for j in range(dim):
                hidden[:, j] = np.bincount(row, weights=scaled[:, j], minlength=len(own))
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= weight[y[own]][:, None]
            step = rate * (1 - done / steps_in_all)
            back = p @ layer.T
            layer -= step * hidden.T @ p / 4
            bias -= step * p.mean(axis=0)
            # a document's features share its gradient; sized so that the mean moves by `step`
            np.add.at(vectors, ids, -step * 4 * (share * np.sqrt(lens)[row])[:, None] * back[row])
            done += 1
    margin = layer[:, 1] - layer[:, 0]
    return Model((vectors @ margin).astype(np.float32), float(bias[1] - bias[0]), bits)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int, folds: int, held_out: int, seed: int) -> tuple[list[str | None], list[int]]:
    """Texts and labels of at most per_class rows of each class, none of them held out. Null labels and ids teach nothing."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_out)).select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).distinct()
    picked = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = durable(picked)  # 2 * per_class rows at most, so it may be broadcast
    found = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(picked), "__id").orderBy("__id", "__y", "__text").collect()
    return [r["__text"] for r in found], [r["__y"] for r in found]


def fold(ids, folds: int):
    """crc32 of an id's decimal text, modulo folds; of a null id, null."""
    return F.pmod(F.crc32(ids.cast("long").cast("string").cast("binary")), F.lit(folds))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000, folds: int = 5, held_out: int = 0, threshold: float = 0.3, seed: int = 5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    held_out: crc32 of the id's text modulo `folds` equals `held_out`; false for a null id. Only the text enters a score.
    Empty and null texts score by the bias alone. Rows of equal ids each get a row. Without labels all score 0.5.
    Texts of any length are scored whole; empty tables give an empty result; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    texts, known = training_rows(docs, labels, label_col, id_col, text_col, per_class, folds, held_out, seed)
    model = spark.sparkContext.broadcast(train(texts, known))
    del texts, known
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ids = F.col(id_col).cast("long")
    rows = docs.select(ids.alias("doc_id"), F.coalesce(fold(ids, folds) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without the rows that the classifier rejects, in one pass over them. params are those of quality_scores.

    Null and empty texts score by the bias alone. Rows are judged one by one, so repeated ids may differ. Without labels all score 0.5
    and stay. An empty table gives an empty result; the columns of docs stay, whatever their names.
    """
    spark = ready(docs.sparkSession)
    settings = {"label_col": "quality", "per_class": 2000, "folds": 5, "held_out": 0, "seed": 5} | params
    threshold = settings.pop("threshold", 0.3)
    texts, known = training_rows(docs, labels, id_col=id_col, text_col=text_col, **settings)
    model = spark.sparkContext.broadcast(train(texts, known))
    del texts, known
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(batch.column(batch.schema.get_field_index(text_col))) >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)
