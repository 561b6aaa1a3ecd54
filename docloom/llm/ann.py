"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Euclidean distance is turned into an inner product: (q, 1) . (x, -|x|^2 / 2) is largest for
the nearest x.  The extended vectors are product-quantised in pairs of dimensions with 16
centres each; assignments and centres minimise |r|^2 + (eta - 1) (r . u)^2, where u is the
vector's direction, so that the part of the residual that changes large inner products costs
more.  A scan adds table entries, two codes a byte; of each block of ``SCAN_ROWS`` vectors
the ``SHORTLIST`` best of each query, and all others within ``MARGIN`` standard errors of the
k-th best so far, are compared exactly in double precision.

Vectors lie in cells around up to ``MAX_CELLS`` centres, about one for ``CELL_ROWS`` vectors.
Each query is sent to its ``probes`` nearest cells: as many as hold ``COVERED`` of the true
neighbours within the sample, where neighbours are further away, and so lie in more cells,
than among all vectors.  Vectors and queries are both rows that meet by an equi-join on (cell,
part, share): a cell with many vectors is dealt out in parts, one with many queries in
shares.  A task holds one part, and queries pass by it in blocks; the driver sees the sample
and one row a cell.

Codebook and cells are fitted on at most ``SAMPLE_ROWS`` vectors; every vector is indexed.
Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id or of another width than most of the sample; of rows with equal ids one counts
(the least vector).  Fewer candidates than ``k`` are all returned as far as their cells are
searched, ties by the smaller id; an empty table gives no row; other columns are left behind.
Of equal vectors in a block only the k + 1 with the smallest ids can matter, so copies do not
crowd others out of the shortlist.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SAMPLE_ROWS = 20_000
CENTRES = 16
THRESHOLD = 0.2
SCAN_ROWS = 4096
SHORTLIST = 48
MARGIN = 3.0
QUERY_BLOCK = 256
CELL_ROWS = 2000
MAX_CELLS = 1024
COVERED = 0.998
PART_ROWS = 65_536
LEAST_ROWS = 1024
SHARE_QUERIES = 65_536


class Codebook:
    """Product quantiser of extended vectors in pairs of dimensions."""

    def __init__(self, width: int):
        self.width = width
        self.parts = -(-(width + 1) // 2)
        self.centres = np.zeros((self.parts, CENTRES, 2))
        t = THRESHOLD**2
        self.error = 0.0
        self.eta = max(1.0, (width - 1) * t / (1 - t))

    def extend(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 2 * self.parts))
        out[:, : self.width] = x
        out[:, self.width] = -0.5 * np.einsum("ij,ij->i", x, x)
        return out

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.extend(x)
        u = e / np.linalg.norm(e, axis=1, keepdims=True)
        return e.reshape(len(x), self.parts, 2), u.reshape(len(x), self.parts, 2)

    def _assign(self, e: np.ndarray, u: np.ndarray, codes: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent on the score-aware loss, one pair of dimensions at a time."""
        rows = np.arange(len(e))
        parallel = np.einsum("nmi,nmi->nm", e - self.centres[np.arange(self.parts), codes], u)
        total = parallel.sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.parts):
                r = e[:, m, None, :] - self.centres[m]
                along = np.einsum("nci,ni->nc", r, u[:, m])
                rest = total - parallel[:, m]
                codes[:, m] = np.argmin(np.einsum("nci,nci->nc", r, r) + (self.eta - 1) * (rest[:, None] + along) ** 2, axis=1)
                parallel[:, m] = along[rows, codes[:, m]]
                total = rest + parallel[:, m]
        return codes

    def _nearest(self, e: np.ndarray) -> np.ndarray:
        return np.stack([((e[:, m, None, :] - self.centres[m]) ** 2).sum(axis=2).argmin(axis=1) for m in range(self.parts)], axis=1)

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 3) -> Codebook:
        rng = np.random.default_rng(seed)
        e, u = self._parts(x)
        start = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
        self.centres = np.ascontiguousarray(e[start].transpose(1, 0, 2)) + rng.normal(0, 1e-6, (self.parts, CENTRES, 2))
        for _ in range(rounds):
            codes = self._nearest(e)
            for m in range(self.parts):
                n = np.maximum(np.bincount(codes[:, m], minlength=CENTRES), 1e-9)
                mean = np.stack([np.bincount(codes[:, m], e[:, m, i], CENTRES) for i in (0, 1)], axis=1) / n[:, None]
                self.centres[m] = np.where(n[:, None] >= 1, mean, self.centres[m])
        for _ in range(3):
            codes = self._assign(e, u, self._nearest(e))
            for m in range(self.parts):
                self._update(m, e, u, codes)
        self.error = self._score_error(x[:4096])
        return self

    def _score_error(self, x: np.ndarray) -> float:
        """Root mean square error of the scores that are largest for some vectors as queries."""
        q, codes = x[:: max(1, len(x) // 128)], self.encode(x)
        exact = q @ x.T - 0.5 * np.einsum("ij,ij->i", x, x)
        tables = self.tables(q)
        score = sum(tables[j][:, codes[:, j]] for j in range(len(tables)))
        near = np.argsort(-exact, axis=1)[:, : min(100, len(x))]
        return float(np.sqrt(((np.take_along_axis(exact, near, axis=1) - np.take_along_axis(score, near, axis=1)) ** 2).mean()))

    def _update(self, m: int, e: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        """Least squares for the centres of one pair of dimensions, the others held."""
        parallel = np.einsum("nmi,nmi->nm", e - self.centres[np.arange(self.parts), codes], u)
        rest = parallel.sum(axis=1) - parallel[:, m]
        xm, um, c = e[:, m], u[:, m], codes[:, m]
        extra = self.eta - 1
        right = xm + extra * um * (rest + np.einsum("ni,ni->n", xm, um))[:, None]
        left = np.zeros((CENTRES, 2, 2))
        for i in (0, 1):
            for j in (0, 1):
                left[:, i, j] = extra * np.bincount(c, um[:, i] * um[:, j], CENTRES)
            left[:, i, i] += np.bincount(c, minlength=CENTRES)
        b = np.stack([np.bincount(c, right[:, i], CENTRES) for i in (0, 1)], axis=1)
        full = np.bincount(c, minlength=CENTRES) > 0
        self.centres[m][full] = np.linalg.solve(left[full], b[full][:, :, None])[:, :, 0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, bytes) codes, two to a byte."""
        e, u = self._parts(x)
        codes = self._assign(e, u, self._nearest(e)).astype(np.uint8)
        if self.parts % 2:
            codes = np.concatenate([codes, np.zeros((len(x), 1), np.uint8)], axis=1)
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, queries, 256) inner products of queries with every pair of centres."""
        e = np.zeros((len(q), 2 * self.parts))
        e[:, : self.width], e[:, self.width] = q, 1
        one = np.einsum("qmi,mci->mqc", e.reshape(len(q), self.parts, 2), self.centres)
        if self.parts % 2:
            one = np.concatenate([one, np.zeros((1, *one.shape[1:]))])
        return (one[0::2, :, None, :] + one[1::2, :, :, None]).reshape(len(one) // 2, len(q), CENTRES * CENTRES).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


class Cells:
    """Centres by k-means, and how many of the nearest ones a query must be sent to."""

    def __init__(self, x: np.ndarray, count: int, k: int, rounds: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres = x[rng.choice(len(x), min(count, len(x)), replace=False)]
        for _ in range(rounds if count > 1 else 0):
            own = self.order(x, 1)[:, 0]
            n = np.bincount(own, minlength=len(self.centres))
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)
        self.probes = self._probes(x, k)

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest cells of each vector, nearest first."""
        out = np.empty((len(x), most), np.int64)
        size = np.einsum("ij,ij->i", self.centres, self.centres)
        for lo in range(0, len(x), 4096):
            d = size - 2 * x[lo : lo + 4096] @ self.centres.T
            out[lo : lo + 4096] = np.argsort(d, axis=1, kind="stable")[:, :most] if most > 1 else d.argmin(axis=1)[:, None]
        return out

    def _probes(self, x: np.ndarray, k: int) -> int:
        """Cells to be searched so that they hold ``COVERED`` of the true neighbours in ``x``."""
        count = len(self.centres)
        if count == 1 or len(x) <= k:
            return count
        step = max(1, len(x) // 512)
        q, own = x[::step], self.order(x, 1)[:, 0]
        rank = np.argsort(self.order(q, count), axis=1)
        d = np.einsum("ij,ij->i", x, x) - 2 * q @ x.T
        d[np.arange(len(q)), np.arange(0, len(x), step)] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(COVERED * len(needed))))]) + 1


class Index(NamedTuple):
    """A written table (vec_id, vector, code, cell) and the models it was made with."""

    rows: DataFrame
    book: Codebook | None
    cells: Cells | None


class Part:
    """Vectors of a cell in blocks of ``SCAN_ROWS``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, book: Codebook, k: int, shortlist: int):
        self.book, self.k, self.shortlist = book, k, shortlist
        self.blocks = [self._block(ids[i : i + SCAN_ROWS], x[i : i + SCAN_ROWS], codes[i : i + SCAN_ROWS]) for i in range(0, len(ids), SCAN_ROWS)]

    def _block(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block by id, of equal vectors only the first k + 1."""
        order = np.argsort(ids, kind="stable")
        x = np.ascontiguousarray(x[order])
        ids, codes = ids[order], codes[order]
        _, inverse = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        run = np.arange(len(by)) - np.searchsorted(inverse[by], inverse[by])
        kept = np.sort(by[run <= self.k])
        return ids[kept], x[kept], codes[kept]

    def nearest(self, own: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), k of each, of the nearest here to queries ``q`` with ids ``own``."""
        best, best_id = np.full((len(own), self.k), np.inf), np.full((len(own), self.k), np.iinfo(np.int64).max)
        tables = self.book.tables(q)
        half = 0.5 * np.einsum("ij,ij->i", q, q)
        for ids, x, codes in self.blocks:
            score = np.zeros((len(q), len(ids)), np.float32)
            for j in range(len(tables)):
                score += tables[j][:, codes[:, j]]
            ahead = np.arange(len(ids)) * 1e-13  # equal scores: the smaller id first
            some = min(self.shortlist, len(ids))
            picked = np.argpartition(ahead - score, some - 1, axis=1)[:, :some] if some < len(ids) else np.broadcast_to(np.arange(len(ids)), score.shape)
            d = np.sqrt(((x[picked] - q[:, None, :]) ** 2).sum(axis=2))
            best, best_id = self._merge(best, best_id, own, d, ids[picked])
            if some == len(ids):
                continue
            more = score >= (half - 0.5 * best[:, -1] ** 2 - MARGIN * self.book.error)[:, None]
            np.put_along_axis(more, picked, False, axis=1)
            for i in np.flatnonzero(more.any(axis=1)):
                at = np.flatnonzero(more[i])
                d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                best[i : i + 1], best_id[i : i + 1] = self._merge(best[i : i + 1], best_id[i : i + 1], own[i : i + 1], d[None], ids[None, at])
        return best, best_id

    def _merge(self, best: np.ndarray, best_id: np.ndarray, own: np.ndarray, d: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.where(found == own[:, None], np.inf, d)
        distance = np.concatenate([best, d], axis=1)
        candidate = np.concatenate([best_id, np.where(np.isinf(d), np.iinfo(np.int64).max, found)], axis=1)
        top = np.lexsort((candidate, distance), axis=1)[:, : self.k]
        return np.take_along_axis(distance, top, axis=1), np.take_along_axis(candidate, top, axis=1)


def build_index(df: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, k: int = 10) -> Index:
    """The index of all usable rows; without any, one without models."""
    vector = F.col(vector_col).cast("array<double>")
    good = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    single = scratch.keep(good.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    sample = [r.vector for r in single.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").collect()]
    if not sample:
        return Index(single.withColumns({"code": F.lit(None).cast("binary"), "cell": F.lit(0)}), None, None)
    width = Counter(map(len, sample)).most_common(1)[0][0]
    x = np.array([v for v in sample if len(v) == width])
    book, cells = Codebook(width).fit(x), Cells(x, min(MAX_CELLS, -(-single.count() // cell_rows)), k)
    shared = df.sparkSession.sparkContext.broadcast((book, cells))  # their size is set by the width and MAX_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, places = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(lo, SCAN_ROWS)
                rows = _rows(part.column(1), width)
                columns = [part.column(0), part.column(1), pa.array([c.tobytes() for c in own.encode(rows)], pa.binary()), pa.array(places.order(rows, 1)[:, 0].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "code", "cell"])

    rows = scratch.keep(single.where(F.size("vector") == width).mapInArrow(run, "vec_id long, vector array<double>, code binary, cell int"))
    scratch.drop(single)
    return Index(rows, book, cells)


def _meet(batches: Iterator[pa.RecordBatch], book: Codebook, k: int, shortlist: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, share, role, id, vector, code) in that order: of each triple the
    vectors (role 0), which are held, then the queries, which pass in blocks."""
    key, held, part = None, [], None
    for batch in batches:
        triple = np.stack([np.asarray(batch.column(i)) for i in range(4)], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((triple[1:] != triple[:-1]).any(axis=1)) + 1, [batch.num_rows]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if tuple(triple[lo, :3]) != key:
                key, held, part = tuple(triple[lo, :3]), [], None
            rows = batch.slice(lo, hi - lo)
            ids, x = np.asarray(rows.column(4)), _rows(rows.column(5), book.width)
            if triple[lo, 3] == 0:
                held.append((ids, x, np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(len(ids), -1)))
                continue
            if part is None:
                part = Part(*(np.concatenate([h[i] for h in held]) for i in range(3)), book, k, shortlist) if held else Part(ids[:0], x[:0], np.zeros((0, 0), np.uint8), book, k, shortlist)
                held = []
            for i in range(0, len(ids), QUERY_BLOCK):
                own = ids[i : i + QUERY_BLOCK]
                best, best_id = part.nearest(own, x[i : i + QUERY_BLOCK])
                there = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, there.sum(axis=1))), pa.array(best_id[there]), pa.array(best[there])], ["query_id", "vec_id", "score"])


def search(index: Index, queries: DataFrame, k: int = 10, shortlist: int = SHORTLIST, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of the index to each row of
    ``queries`` (vec_id, vector), those with the query's own id left out.

    ``probes`` is the number of cells searched (None: that found with the sample).
    """
    rows, book, cells = index
    spark = rows.sparkSession
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast((book, cells))
    many = min(probes or cells.probes, len(cells.centres))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                to = shared.value[1].order(_rows(part.column(1), book.width), many)
                at = pa.array(np.repeat(np.arange(part.num_rows), many))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(to.ravel().astype(np.int32))], ["vec_id", "vector", "cell"])

    asked = queries.select("vec_id", "vector").where(F.size("vector") == book.width).mapInArrow(sent, "vec_id long, vector array<double>, cell int")
    # One row a cell, at most MAX_CELLS: how its vectors and queries are dealt out.
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    total = rows.count()
    part_rows = min(PART_ROWS, max(LEAST_ROWS, total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    deal = sizes.join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell").select("cell", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"), F.ceil(F.col("m") / SHARE_QUERIES).cast("int").alias("shares"))
    deal = F.broadcast(deal)
    copy = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    vectors = rows.join(deal, "cell").select("cell", own("parts").alias("part"), copy("shares").alias("share"), F.lit(0).alias("role"), "vec_id", "vector", "code")
    passing = asked.join(deal, "cell").select("cell", copy("parts").alias("part"), own("shares").alias("share"), F.lit(1).alias("role"), "vec_id", "vector", F.lit(None).cast("binary").alias("code"))
    met = vectors.unionByName(passing).repartition("cell", "part", "share").sortWithinPartitions("cell", "part", "share", "role", "vec_id")
    found = met.mapInArrow(lambda it: _meet(it, shared.value[0], k, shortlist), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors to each of ``embeddings`` whose id is divisible by 100."""
    index = build_index(table(spark, sf_dir, "embeddings"), Scratch(spark, "ann"))
    return search(index, index.rows.where("vec_id % 100 = 0"))


QUERIES = {"op8_anisotropic_ann": op8_anisotropic_ann}
ORACLE_SQL: dict[str, str] = {}
