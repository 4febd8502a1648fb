"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every token has a fixed sparse random index vector. A token's word vector is the sum of the index vectors of the tokens around
it, over the whole corpus: integer counts, summed over tasks without loss. Tokens are of two streams, words (lower-cased) and
shapes of white-space separated strings (letter case, digits, signs, whether it repeats the string before), each hashed into
BUCKETS rows, so that the table has one size for any corpus. A document is the mean of its tokens' unit vectors, by stream.

The network - one hidden layer of tanh units, then a logistic unit - is fitted with numpy on the driver over at most about
``most`` labelled rows, drawn at random with a fixed seed; a fifth of them is left out to fit the temperature that its
logits are divided by. All other steps cover every row.

Defined cases: a null or empty text has a zero vector and is scored like any other; labels of null id or class, and labels
without a document, teach nothing; with labels of one class or none the score is that class's, or 0.5, which counts as class 1;
very long texts are pooled whole; repeated rows count as often as they come. Extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, with_fields
from .vectext import chunks, find_words, mix, powers

BUCKETS = 8192
DIMS = 32
#: Places of a token's index vector that are not zero, half of them -1.
PLACES = 4
STREAMS = 2
#: Rows of the table that one record of its sum holds.
RECORD = 512
#: Tasks whose tables are added up first.
FAN = 256

_SHAPE = np.zeros(256, np.uint8)
for _c in range(256):
    _SHAPE[_c] = 0 if _c in (9, 10, 11, 12, 13, 32) else 1 if 0x61 <= _c <= 0x7A else 2 if 0x41 <= _c <= 0x5A else 3 if 0x30 <= _c <= 0x39 else 4 if _c >= 0x80 else _c
_SHAPE[_SHAPE == 4] = 1


def shapes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shapes of a chunk's strings, and the row offsets into them. A run of one class of characters counts once."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    kind = _SHAPE[raw]
    inside = kind != 0
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.concatenate([[False], inside[:-1]])
    before[first[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[first[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    turn = np.ones(n, bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[start] = True
    code = np.where(turn & inside, kind, 0).astype(np.uint64)
    nth = np.cumsum(turn & inside)  # turns so far, so that equal shapes have equal places
    up, _ = powers(n + 2)
    _, down = powers(n + 2)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[nth])])
    h = (total[end] - total[start]) * down[nth[start] - 1]
    plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * up[:n])])
    whole = (plain[end] - plain[start]) * down[start]
    ptr = np.searchsorted(start, offs)
    again = np.zeros(len(h), bool)
    again[1:] = whole[1:] == whole[:-1]
    heads = ptr[:-1][ptr[:-1] < len(h)]
    again[heads] = False
    return mix(h + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ptr


def streams(raw: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(table rows, row offsets) of each stream's tokens."""
    w = find_words(raw, offs)
    h, ptr = shapes(raw, offs)
    return [((w.h % np.uint64(BUCKETS)).astype(np.int64), w.ptr), ((h % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS, ptr)]


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each table row's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((STREAMS * BUCKETS, DIMS)), axis=1)[:, :PLACES]
    return places, np.where(np.arange(PLACES) % 2, -1, 1)


def word_vectors(docs: DataFrame, text_col: str = "text", reach: int = 2) -> np.ndarray:
    """The table of unit word vectors, from all texts."""
    src = docs.select(col(text_col).cast("string").alias("text"))
    rows, records = STREAMS * BUCKETS, STREAMS * BUCKETS // RECORD

    def count(batches):
        places, signs = index_vectors()
        table = np.zeros(rows * DIMS, np.int64)
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column(0)):
                for ids, ptr in streams(raw, offs):
                    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                    for d in range(1, reach + 1):
                        near = row[d:] == row[:-d]
                        a, b = ids[:-d][near], ids[d:][near]
                        for p in range(PLACES):
                            table += signs[p] * (np.bincount(a * DIMS + places[b, p], minlength=len(table)) + np.bincount(b * DIMS + places[a, p], minlength=len(table)))
        table = table.reshape(records, -1)
        used = np.flatnonzero(table.any(axis=1))
        part = np.full(len(used), TaskContext.get().partitionId() // FAN, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(part), pa.array([table[i].astype("<i8").tobytes() for i in used.tolist()], pa.binary())], names=["record", "part", "sums"])

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, part, b in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                x = np.frombuffer(b, "<i8")
                total[k, part] = total[k, part] + x if (k, part) in total else x
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([p for _, p in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["record", "part", "sums"])

    # sums of FAN tasks, then sums of those
    schema = "record int, part int, sums binary"
    parts = src.mapInArrow(count, schema).repartition("record", "part").mapInArrow(add, schema)
    parts = parts.select("record", F.lit(0).alias("part"), "sums").repartition("record").mapInArrow(add, schema).select("record", "sums").toArrow()
    table = np.zeros((records, RECORD * DIMS))
    for k, b in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        table[k] += np.frombuffer(b, "<i8")
    table = table.reshape(rows, DIMS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(table: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The vector of each text: by stream, the mean of its tokens' vectors."""
    out = np.zeros((len(offs) - 1, STREAMS * DIMS), np.float32)
    for s, (ids, ptr) in enumerate(streams(raw, offs)):
        full = np.flatnonzero(np.diff(ptr))
        if len(full):
            sums = np.add.reduceat(table[ids], ptr[:-1][full], axis=0)
            out[full, s * DIMS : (s + 1) * DIMS] = sums / np.diff(ptr)[full, None]
    return out


@dataclass
class Network:
    """x -> logistic((tanh((x - mean) / scale @ w1 + b1) @ w2 + b2) / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature on the rest."""
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        sure = 0.0 if not len(y) else 40.0 * (2 * y[0] - 1)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), sure, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    if len(np.unique(y[own])) < 2:
        held, own = order[:0], order
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-4
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            a = np.tanh(z[part] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - y[part]) / len(part)
            back = err[:, None] * p[2] * (1 - a * a)
            grads = [z[part].T @ back + decay * p[0], back.sum(axis=0), a.T @ err + decay * p[2], np.array([err.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(held):
        logit, sign = net.logits(x[held]), 2 * y[held] - 1
        net.temperature = min((float(np.logaddexp(0, -sign * logit / c).mean()), c) for c in np.geomspace(0.25, 8, 41).tolist())[1]
    return net


@dataclass
class Model:
    table: np.ndarray
    net: Network


def train(docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 12_000, seed: int = 3) -> Model:
    """The word vectors of all texts, and a network fitted to about ``most`` of the labels that are ``allowed``."""
    table = word_vectors(docs, text_col)
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y"), allowed.alias("ok")).filter("ok and id is not null and y is not null")
    n = known.count()
    some = known.filter(F.rand(seed) < min(1.0, most / max(1, n))).select("id", "y")
    # at most about ``most`` rows of a dozen bytes: a side of known size
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id").select("id", "text", "y")
    held = docs.sparkSession.sparkContext.broadcast(table)

    def vectors(batches):
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x.tobytes() for x in pooled(held.value, raw, offs)], pa.binary())], names=["id", "y", "x"])

    got = rows.mapInArrow(vectors, with_fields(rows.select("id"), "y int, x binary")).toArrow()
    order = np.argsort(np.array([f"{i}" for i in got.column("id").to_pylist()]), kind="stable") if len(got) else np.zeros(0, np.int64)
    x = np.array([np.frombuffer(b, np.float32) for b in got.column("x").to_pylist()], float).reshape(len(got), STREAMS * DIMS)[order]
    y = got.column("y").to_numpy().astype(float)[order]
    return Model(table, fit(x, y))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (the probability of label 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = with_fields(docs.select(col(id_col)), "score double")

    def run(batches):
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1)):
                p = held.value.net.probability(pooled(held.value.table, raw, offs).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], names=schema.names)

    return src.mapInArrow(run, schema)
