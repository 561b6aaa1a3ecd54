"""Exact cosine retrieval, its filters, deduplication across queries, and pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The norm once a vector instead of once a pair."""
    return df.withColumn("_norm", F.sqrt(dot(F.col(vector), F.col(vector))))


def _nearest(batches: Iterator[pa.RecordBatch], k: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, part, share, role, id): of each triple the vectors (role 0),
    which are held as a matrix, then the queries, multiplied with it in blocks."""
    key, held, ids, units = None, [], np.zeros(0, np.int64), np.zeros((0, 0))
    for batch in batches:
        groups = batch.column(0).to_pylist()
        triple = np.stack([np.asarray(batch.column(i)) for i in (1, 2, 3)], axis=1)
        new = (triple[1:] != triple[:-1]).any(axis=1) | np.array([a != b for a, b in zip(groups[1:], groups[:-1], strict=True)], bool)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]]).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if (groups[lo], *triple[lo, :2]) != key:
                key, held, units = (groups[lo], *triple[lo, :2]), [], None
            own, x = np.asarray(batch.column(4).slice(lo, hi - lo)), np.asarray(batch.column(5).slice(lo, hi - lo).flatten(), np.float64).reshape(hi - lo, -1)
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            if triple[lo, 2] == 0:
                held.append((own, x))
                continue
            if units is None:
                if not held:
                    continue
                ids, units = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                held = []
            for i in range(0, len(own), 256):
                q = own[i : i + 256]
                distance = np.round(1 - x[i : i + 256] @ units.T, 9) + 0.0
                if skip_self:
                    distance[q[:, None] == ids[None]] = np.inf
                near = np.argpartition(distance, min(k, len(ids)) - 1, axis=1)[:, : min(k, len(ids))]
                edge = np.take_along_axis(distance, near, axis=1).max(axis=1)  # with all ties
                row, at = np.nonzero((distance <= edge[:, None]) & np.isfinite(distance))
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(ids[at]), pa.array(distance[row, at])], ["query_id", "vec_id", "distance"])


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, on: list[str] | None = None, skip_self: bool = True, part_rows: int = 8192, share_queries: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` nearest by cosine distance, rounded to 9
    places, ties by id; exact.

    ``vectors`` is (vec_id, embedding, *on), ``queries`` (query_id, embedding, *on).  Vectors
    are dealt out in parts and queries in shares; rows of both meet by an equi-join on (group,
    part, share), where the group is the width and the ``on`` columns (a metadata filter), and
    are multiplied as matrices, so that a task holds one part and sends about ``k`` rows a
    query.  A zero or null vector, or one with a null in it, has no distance and is not found.
    """
    keys = on or []
    parts = max(1, -(-vectors.count() // part_rows))
    shares = max(1, -(-queries.count() // share_queries))

    def rows(df: DataFrame, id_col: str, role: int) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        whole = df.where(F.col(id_col).isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull()))
        for c in keys:  # as in a join, null keys meet nothing
            whole = whole.where(F.col(c).isNotNull())
        group = F.to_json(F.struct(F.size("embedding").alias("_n"), *keys))
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
        part, share = (own(parts), copies(shares)) if role == 0 else (copies(parts), own(shares))
        return whole.select(group.alias("group"), part.alias("part"), share.alias("share"), F.lit(role).alias("role"), F.col(id_col).cast("long").alias("id"), v.alias("vector"))

    met = rows(vectors, "vec_id", 0).unionByName(rows(queries, "query_id", 1)).repartition("group", "part", "share").sortWithinPartitions("group", "part", "share", "role", "id")
    near = met.mapInArrow(lambda it: _nearest(it, k, skip_self), "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def quote_matches(texts: DataFrame, quotes: DataFrame, size: int = 4) -> DataFrame:
    """(item_id, doc_id) of the quotes (item_id, text), stripped and in small letters, that
    occur word for word in texts (doc_id, text).

    Words inside a quote, all but its first and last, stand whole in any text that holds it.
    So the longest run of up to ``size`` of them is the quote's key: texts are joined on the
    hashes of their runs, and what meets is compared.  Quotes of fewer than three words have
    no such run and are compared with every text.
    """
    clean = quotes.select("item_id", F.lower(F.trim("text")).alias("quote")).where("quote is not null")
    inner = clean.withColumn("_w", F.split("quote", r"\s+")).withColumn("_w", F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))
    run = F.least(F.size("_w"), F.lit(size))
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - run + 1), lambda i: F.array_join(F.slice("_w", i, run), " "))
    longest = F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r"))))[0]["r"]
    keyed = inner.where("size(_w) > 0").select("item_id", "quote", run.alias("n"), F.xxhash64(longest).alias("key"))
    low = texts.select("doc_id", F.lower("text").alias("low")).where("low is not null")
    words = low.withColumn("_w", F.split("low", r"\s+"))
    hashes = lambda n: F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, n), " ")))
    found = None
    for (n,) in keyed.select("n").distinct().collect():  # at most ``size`` numbers
        each = words.where(F.size("_w") >= n).select("doc_id", "low", F.explode(F.array_distinct(hashes(n))).alias("key"))
        hit = each.join(keyed.where(F.col("n") == n).drop("n"), "key").where(F.contains("low", F.col("quote"))).select("item_id", "doc_id")
        found = hit if found is None else found.unionByName(hit)
    short = low.join(inner.where("size(_w) = 0").select("item_id", "quote"), F.contains("low", F.col("quote"))).select("item_id", "doc_id")
    return short if found is None else found.unionByName(short)


def within(hits: DataFrame, most: float | None) -> DataFrame:
    """Hits up to a distance; a missing distance counts as 1, no limit keeps all."""
    return hits if most is None else hits.where(F.coalesce("distance", F.lit(1.0)) <= most)


def long_enough(hits: DataFrame, least: int = 20) -> DataFrame:
    """After the cut at k: hits with little text go, so that fewer than k may be left."""
    return hits.where(F.length(F.trim("text")) >= least)


def first_occurrences(hits: DataFrame, keys: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """Each chunk once per key, with the distance of the first query that found it (not the
    least distance)."""
    order = Window.partitionBy(*keys, "chunk_id").orderBy("query_idx", "rank")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], instructions: dict[str, str]) -> DataFrame:
    """Hits of the fields that have instructions, sorted by the scorer; others as they were."""
    told = F.lit(None).cast("string")
    for f, text in instructions.items():
        told = F.when(F.col("field") == f, F.lit(text)).otherwise(told)
    scored = hits.withColumn("rerank_score", F.when(told.isNotNull(), scorer(F.col("text"), told)))
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc_nulls_last("rerank_score"), "query_idx", "rank")
    return scored.withColumn("position", F.row_number().over(order))


def excerpts(hits: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, field, excerpts): the first ``most`` texts joined for a prompt."""
    texts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("position", "text"))), 1, most), lambda x: x["text"])
    return hits.where(F.col("position") <= most).groupBy("doc_id", "field").agg(F.array_join(texts, "\n---\n").alias("excerpts"))


def evidence(hits: DataFrame, chars: int = 300) -> DataFrame:
    row = F.struct("position", "page_number", "chunk_id", "distance", F.left("text", F.lit(chars)).alias("text"))
    return hits.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(row)).alias("evidence"))


def distance_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id", "field").agg(F.coalesce(F.min("distance"), F.lit(1.0)).alias("distance"), F.max("rerank_score").alias("rerank_score"))


def mean_vectors(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, position, mean): means by position.  Vectors of another length than the
    group's first are left out of the sum but count in the divisor.  Positions are summed
    before the shuffle, so that a large group costs one row a position and task."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"), F.min_by(F.size(vector), "ord").alias("_size"))
    each = df.select(group, F.size(vector).alias("_own"), F.posexplode(vector).alias("position", "x"))
    sums = each.groupBy(group, "_own", "position").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return sums.join(sizes, group).where("_own = _size").select(group, "position", (F.col("s") / F.col("_n")).alias("mean"))


def zero_vector(width: int = 768) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), width)


def self_retrieval(found: DataFrame) -> DataFrame:
    """(n, hits, rate) of (query_id, vec_id) rows: queries that found themselves."""
    per = found.groupBy("query_id").agg(F.max((F.col("query_id") == F.col("vec_id")).cast("int")).alias("hit"))
    return per.agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("rate"))


def search_report(hits: DataFrame, queries: DataFrame, most: float | None = None, top: int = 3) -> DataFrame:
    """(query_id, found, top): of each query whether anything was found, up to a distance, and
    its first hits (rank, vec_id, distance)."""
    rows = within(hits, most).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "distance"))), 1, top).alias("top"))
    return queries.select("query_id").join(rows, "query_id", "left").select("query_id", F.col("top").isNotNull().alias("found"), "top")


def probe_self(chunks: DataFrame, embed: Callable[[Column], Column], n: int = 5, words: int = 5, k: int = 2) -> DataFrame:
    """``self_retrieval`` with the first words of the first ``n`` chunks (vec_id, text,
    embedding) as queries."""
    queries = chunks.orderBy("vec_id").limit(n).select(F.col("vec_id").alias("query_id"), embed(first_words(F.col("text"), words)).alias("embedding"))
    return self_retrieval(cosine_topk(chunks.select("vec_id", "embedding"), queries, k=k, skip_self=False))
