"""Quality classifier: a factorisation machine over hashed words, structure statistics
and the text's size.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so that all pairs of features interact at a cost linear in the features present.

It is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the smallest
hashes of the id), on the driver, and scores whole texts on the executors.  A null text is
an empty one and gets a score like any other.  Labels that are null take no part.  With no
labelled rows or one class alone, every score is that class's share (0.5 without rows).
Repeated rows get equal scores; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, slices, table, text_bytes
from .textkit import Words

BITS = 15
FACTORS = 8
SAMPLE_ROWS = 4000
THRESHOLD = 0.7
BLOCK_BYTES = 1 << 19
_GROUPS = [b"#%&*$^~@", b"!?", b"|", b"0123456789", b".,;:", b"\n", b"\"'()[]{}<>=+-/_", bytes(range(65, 91)), bytes(range(128, 256))]
_KIND = np.zeros(256, np.uint8)
for _i, _g in enumerate(_GROUPS, 1):
    _KIND[list(_g)] = _i
STATISTICS = len(_GROUPS) + 6


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, bucket, dense): the distinct word buckets of text i are
    ``bucket[first[i]:first[i+1]]``; ``dense`` has a row of statistics for each text."""
    words = Words(texts, lower=False)
    n = len(texts)
    h = words.hashes()
    key = np.unique((words.doc.astype(np.int64) << BITS) | (h & np.uint64((1 << BITS) - 1)).astype(np.int64))
    first = np.searchsorted(key >> BITS, np.arange(n + 1))
    bucket = key & ((1 << BITS) - 1)
    sizes = np.maximum(words.text_end - words.text_start - 1, 0)
    kinds = _KIND[words.data]
    dense = np.zeros((n, STATISTICS))
    whole = np.concatenate([words.text_start, [len(words.data)]])
    for k in range(1, len(_GROUPS) + 1):
        there = np.concatenate([[0], np.cumsum(kinds == k)])
        dense[:, k - 1] = (there[whole[1:]] - there[whole[:-1]]) / np.maximum(sizes, 1)
    counts = np.diff(words.first)
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])]))])
    per = np.maximum(counts, 1)
    dense[:, -6] = (again[words.first[1:]] - again[words.first[:-1]]) / per
    dense[:, -5] = np.diff(first) / per
    dense[:, -4] = np.diff(first) / np.sqrt(per)
    dense[:, -3] = np.log1p(sizes)
    dense[:, -2] = np.log1p(counts)
    dense[:, -1] = sizes / per
    return first, bucket, dense


def _segments(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges that ``first`` bounds; empty ranges give 0."""
    total = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        total[full] = np.add.reduceat(values, first[full], axis=0)
    return total


class Machine:
    """Weights of the machine; words share one table, statistics follow it."""

    def __init__(self, constant: float | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.constant = constant
        self.bias = 0.0
        self.w = np.zeros((1 << BITS) + STATISTICS, np.float32)
        self.v = rng.normal(0, 0.02, ((1 << BITS) + STATISTICS, FACTORS)).astype(np.float32)
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4).astype(np.float32) / np.sqrt(STATISTICS).astype(np.float32)

    def margin(self, first: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score before the sigmoid, sums of v x by factor, x of a text's words)."""
        x = (1 / np.sqrt(np.maximum(np.diff(first), 1))).astype(np.float32)
        stats = 1 << BITS
        own = self.v[bucket]
        sums = _segments(own, first) * x[:, None] + dense @ self.v[stats:]
        squares = _segments(np.einsum("ij,ij->i", own, own), first) * x * x + (dense * dense) @ np.einsum("ij,ij->i", self.v[stats:], self.v[stats:])
        linear = self.bias + _segments(self.w[bucket], first) * x + dense @ self.w[stats:]
        return linear + 0.5 * (np.einsum("ij,ij->i", sums, sums) - squares), sums, x

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """In single precision inside, each row's result independent of its neighbours."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        first, bucket, dense = features(texts)
        return 1 / (1 + np.exp(-np.clip(self.margin(first, bucket, self.standard(dense))[0].astype(np.float64), -30, 30)))

    def fit(self, first: np.ndarray, bucket: np.ndarray, dense: np.ndarray, labels: np.ndarray, epochs: int = 14, rate: float = 0.08, decay: float = 2e-5, batch: int = 64, seed: int = 7) -> Machine:
        """Adagrad on the logistic loss, classes weighted to half each way between their
        shares and equality."""
        rng, stats, n = np.random.default_rng(seed), 1 << BITS, len(labels)
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        dense = self.standard(dense)
        share = labels.mean()
        weight = np.where(labels > 0, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
        gw, gv, gb = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                rows = order[lo : lo + batch]
                spans = [bucket[first[i] : first[i + 1]] for i in rows]
                cut = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
                ids, d = np.concatenate(spans), dense[rows]
                z, sums, x = self.margin(cut, ids, d)
                error = ((1 / (1 + np.exp(-z)) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                doc = np.repeat(np.arange(len(rows)), np.diff(cut))
                ex = (error * x)[doc]
                own, place = np.unique(ids, return_inverse=True)
                dw = np.bincount(place, ex, len(own)).astype(np.float32) + decay * self.w[own]
                dv = np.empty((len(own), FACTORS), np.float32)
                exx = np.bincount(place, (error * x * x)[doc], len(own)).astype(np.float32)
                for f in range(FACTORS):
                    dv[:, f] = np.bincount(place, ex * sums[doc, f], len(own))
                dv += -exx[:, None] * self.v[own] + decay * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= rate * dv / np.sqrt(gv[own])
                sw, sv = d.T @ error, d.T @ (error[:, None] * sums) - ((d * d).T @ error)[:, None] * self.v[stats:]
                gw[stats:] += sw * sw
                gv[stats:] += sv * sv
                self.w[stats:] -= rate * sw / np.sqrt(gw[stats:])
                self.v[stats:] -= rate * sv / np.sqrt(gv[stats:])
                b = float(error.sum())
                gb += b * b
                self.bias -= rate * b / gb**0.5
        return self


def remainder(id_col: str, modulus: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def fit_machine(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine learnt from the labelled documents given, at most ``sample_rows`` of them.

    The sample is drawn from ids and labels alone; its ids, at most ``sample_rows``, are
    broadcast to pick the texts, and the driver receives hashed features, not texts.
    """
    picked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_bytes(batch.column(1))
            for lo, hi in chunks([len(t) for t in texts], BLOCK_BYTES):
                first, bucket, dense = features(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([b.astype(np.int32).tobytes() for b in np.split(bucket, first[1:-1])], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())],
                    ["doc_id", "quality", "bucket", "dense"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, bucket binary, dense binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.quality, r.dense, r.bucket))
    y = np.array([r.quality for r in found], np.float64)
    if not len(y) or y.min() == y.max():
        return Machine(float(y.mean()) if len(y) else 0.5)
    buckets = [np.frombuffer(r.bucket, np.int32) for r in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in buckets])])
    return Machine().fit(first, np.concatenate(buckets), np.stack([np.frombuffer(r.dense) for r in found]), y)


def score_quality(df: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with a ``score_col`` (replaced if it is there), 0 to 1; nothing is shuffled."""
    kept = [f for f in df.schema.fields if f.name != score_col]
    at = [f.name for f in kept].index(text_col)
    fields = [*kept, T.StructField(score_col, T.DoubleType())]
    shared = df.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by BITS and FACTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_bytes(batch.column(at))
            found = [shared.value.scores(texts[lo:hi]) for lo, hi in chunks([len(t) for t in texts], BLOCK_BYTES)]
            score = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [f.name for f in fields])

    return df.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, T.StructType(fields))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learnt outside the held-out quarter."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = score_quality(documents, fit_machine(documents, labels))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_quality_fm": op3_quality_fm}
ORACLE_SQL: dict[str, str] = {}
