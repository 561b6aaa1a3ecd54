"""Near duplicates by one-permutation MinHash with optimal densification.

One hash of each shingle fills ``BANDS * ROWS`` bins with their least values; an empty bin
copies the first filled bin of its own random order of bins.  Bands of bins are buckets.
Texts with one shingle set are one node.  Within a bucket every node is paired with that of
the smallest id alone (a star), and pairs are confirmed on whole shingle sets, first each
node's most frequent centre, then the stars' other edges between different components.
Buckets whose nodes then still belong to several components are searched so that a star
costs no link, without a look at every pair:

* An exact bound keeps few nodes: of two sets of n and m shingles, u and w of which at most
  ``RARE`` such texts hold, at most min(n - u, m - w) are shared, unless the two share one of
  those rare shingles.  Pairs that do are found by the shingle, which gives each no more than
  ``RARE``**2 / 2 pairs.
* Nodes confirmed with one centre are a cluster of known radius.  As one minus similarity is
  a metric, no node of one cluster can be linked with one of another if their centres are
  further apart than 1/4 plus both radii, and no node of one if they are further apart than
  1/4, its own distance and the other's radius.  So centres are compared first, and what
  they link needs no look.  Nodes of the smaller cluster that may still reach the larger one
  then meet its nodes: up to ``GUESTS`` of their whole sets are held by a task, past which
  the larger cluster's texts stream.  Pages of one template thus cost pairs of clusters, not
  pairs of pages, and no pairs of nodes are written.

A pair of similarity 0.75 shares no bucket with probability (1 - 0.75**7)**72 = 3e-5.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case.  Texts
without words (null, empty, white space) have no shingles and link with nothing; so do
rows without an id, whose component is null and which are kept.  Rows with equal ids are
one document as to links, whatever their texts: each text is a node, the nodes of one id
belong together, and all rows are returned, each with its own number of shingles.  Very long
texts are read whole.  An empty table gives no row; extra columns are left behind, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, slices, table, text_bytes
from .components import components
from .textkit import mix, shingle_sets

ROWS = 7
BANDS = 72
SHINGLE = 5
PERCENT = 75
STAR_CHUNK = 64
RARE = 24
GUESTS = 512
HOSTED = 16_384
BLOCK_BYTES = 1 << 19
BROADCAST_IDS = 2_000_000


class Sketcher:
    """Bands of a one-permutation sketch."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.int32)
        self.edges = np.array([-(-(i << 32) // self.bins) << 32 for i in range(self.bins)], np.uint64)
        self.salt = rng.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """Bin values of a sorted, non-empty set of hashes, all bins filled."""
        at = np.searchsorted(shingles, self.edges)
        end = np.append(at[1:], len(shingles))
        filled = at < end
        source = np.arange(self.bins)
        empty = np.flatnonzero(~filled)
        for step in range(16):
            if not len(empty):
                break
            tried = self.order[empty, step]
            good = filled[tried]
            source[empty[good]] = tried[good]
            empty = empty[~good]
        if len(empty):
            order = self.order[empty]
            source[empty] = order[np.arange(len(empty)), np.argmax(filled[order], axis=1)]
        return shingles[at[source]]

    def band_keys(self, sketches: np.ndarray) -> np.ndarray:
        """(texts, bands) bucket keys of (texts, bins) sketches."""
        x = sketches.reshape(-1, self.bands, self.rows)
        key = np.zeros(x.shape[:2], np.uint64)
        for j in range(self.rows):
            key = mix(key + (x[:, :, j] ^ self.salt[:, j]) * self.salt[:, j])
        return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], bands: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    sketcher = Sketcher(bands, rows)
    for batch in slices(batches):
        texts = text_bytes(batch.column(1))
        for lo, hi in chunks([len(t) for t in texts], BLOCK_BYTES):
            sets = shingle_sets(texts[lo:hi], size)
            there = [i for i, s in enumerate(sets) if len(s)]
            keys = sketcher.band_keys(np.stack([sketcher.sketch(sets[i]) for i in there])) if there else np.zeros((0, bands), np.int64)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            low = np.array([d & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64)
            high = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
            offsets = np.zeros(hi - lo + 1, np.int32)
            offsets[1:] = np.cumsum([bands if len(s) else 0 for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high), lists],
                ["doc_id", "text_hash", "n_shingles", "low", "high", "bands"],
            )


def _confirm(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, chunk, role): a centre's text, then those of its partners.  Only
    the centre's set is held from row to row.  Gives (a, b, common, total) of every pair."""
    centre, centre_set = None, np.zeros(0, np.uint64)
    for batch in slices(batches):
        a, chunk, role, b = (batch.column(i).to_pylist() for i in range(4))
        texts = text_bytes(batch.column(4))
        for lo, hi in chunks([len(t) for t in texts], BLOCK_BYTES):
            sets = shingle_sets(texts[lo:hi], size)
            found = []
            for i in range(lo, hi):
                s = sets[i - lo]
                if role[i] == 0:
                    centre, centre_set = (a[i], chunk[i]), s
                elif centre == (a[i], chunk[i]):
                    total = len(np.union1d(s, centre_set))
                    found.append((a[i], b[i], len(s) + len(centre_set) - total, total))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(4)], ["a", "b", "common", "total"])


def _shingles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = text_bytes(batch.column(1))
        for lo, hi in chunks([len(t) for t in texts], BLOCK_BYTES):
            sets = shingle_sets(texts[lo:hi], size)
            bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["node", "shingles"])


def _meet(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, part, share, role): texts of guests, whose sets are held as one
    sorted array, then those of the nodes that they meet, each counted against all guests at
    once.  Gives the pairs (a, b) that are similar enough."""
    key, held, names = None, [], []
    hashes, owner, sizes, own = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in slices(batches):
        place = [tuple(x) for x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        role, node, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist(), text_bytes(batch.column(5))
        for lo, hi in chunks([len(t) for t in texts], BLOCK_BYTES):
            sets, found = shingle_sets(texts[lo:hi], size), []
            for i in range(lo, hi):
                if place[i] != key:
                    key, held, names, own = place[i], [], [], None
                if role[i] == 0:
                    held.append(sets[i - lo])
                    names.append(node[i])
                    continue
                if not held:
                    continue
                if own is None:
                    own, sizes = np.array(names, np.int64), np.array([len(s) for s in held])
                    hashes, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(hashes, kind="stable")
                    hashes, owner = hashes[order], owner[order]
                s = sets[i - lo]
                first, last = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
                runs = last - first
                at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first, runs)
                common = np.bincount(owner[at], minlength=len(own))
                alike = (100 * common >= percent * (sizes + len(s) - common)) & (own != node[i])
                found += [(x, node[i]) for x in own[alike].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def rare_shingles(texts: DataFrame, scratch: Scratch, size: int = SHINGLE, most: int = RARE) -> DataFrame:
    """(node, shingle, holders) of the shingles that at most ``most`` of the texts hold.
    Holders are counted before the shuffle; the join drops frequent shingles."""
    rows = texts.mapInArrow(lambda it: _shingles(it, size), "node long, shingles array<long>").select("node", F.explode("shingles").alias("shingle"))
    held = scratch.keep(rows)
    few = scratch.keep(held.groupBy("shingle").agg(F.count("*").alias("holders")).where(F.col("holders") <= most))
    return scratch.keep(held.join(few, "shingle"))


def confirm(pairs: DataFrame, texts: DataFrame, scratch: Scratch, size: int = SHINGLE) -> DataFrame:
    """(a, b, common, total) of the written ``pairs`` (a, b): shingles in both sets, in either.

    A centre with many partners is dealt out in chunks of about ``STAR_CHUNK`` partners,
    each with its own copy of the centre's text.
    """
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > STAR_CHUNK)
    many = F.ceil(F.coalesce("n", F.lit(1)) / STAR_CHUNK)
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), many).cast("int").alias("chunk"))
    centres = dealt.select("a", "chunk").distinct().join(texts.toDF("a", "text"), "a").select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    partners = dealt.join(texts.toDF("b", "text"), "b").select("a", "chunk", F.lit(1).alias("role"), "b", "text")
    rows = centres.unionByName(partners).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return scratch.keep(rows.mapInArrow(lambda it: _confirm(it, size), "a long, b long, common long, total long"))


class Links:
    """Compares pairs of nodes, and keeps the labels that the links found so far give."""

    def __init__(self, texts: DataFrame, scratch: Scratch, size: int, percent: int, labels: DataFrame):
        self.texts, self.scratch, self.size, self.percent = texts, scratch, size, percent
        self.labels = labels

    def check(self, pairs: DataFrame) -> DataFrame | None:
        """(a, b, common, total) of pairs (a, b) whose nodes are in different components; the
        similar ones become links."""
        known = self.labels.select("node", "label")
        sides = pairs.select("a", "b").join(known.toDF("a", "la"), "a", "left").join(known.toDF("b", "lb"), "b", "left")
        apart = self.scratch.keep(sides.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b").distinct())
        if apart.isEmpty():
            return None
        found = confirm(apart, self.texts, self.scratch, self.size)
        self.labels = components(self.similar(found), self.scratch, self.labels)
        return found

    def similar(self, found: DataFrame) -> DataFrame:
        return found.where(100 * F.col("common") >= self.percent * F.col("total"))


def _distance(found: DataFrame) -> DataFrame:
    return found.select("a", "b", (1 - F.col("common") / F.col("total")).alias("d"))


def search_mixed(members: DataFrame, leaders: DataFrame, links: Links, scratch: Scratch, size: int, percent: int) -> None:
    """Finds the links that the stars of buckets with several components have missed.

    ``members`` is (band, node, n), ``leaders`` (node, pivot, d): a centre that a node was
    confirmed with, and their distance.
    """
    label = links.labels
    labelled = scratch.keep(members.join(label, "node", "left").select("band", "node", "n", F.coalesce("label", "node").alias("label")))
    mixed = scratch.keep(labelled.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("band"))
    if mixed.isEmpty():
        return
    held = scratch.keep(labelled.join(mixed, "band"))
    nodes = scratch.keep(held.select("node", "n").distinct())
    rare = rare_shingles(links.texts.join(nodes.select("node"), "node", "left_semi"), scratch, size)
    counts = scratch.keep(rare.groupBy("node").agg(F.count("*").alias("rare"), F.count_if(F.col("holders") == 1).alias("own")))

    def enough(spent: str) -> DataFrame:
        """(node, n, free) of the nodes whose shingles but the ``spent`` ones could do."""
        free = nodes.join(counts, "node", "left").select("node", "n", (F.col("n") - F.coalesce(spent, F.lit(0))).alias("free"))
        return free.where(100 * F.col("free") >= percent * F.col("n"))

    # Pairs that share a rare shingle.
    own = rare.where("holders > 1").select("node", "shingle").join(enough("own"), "node")
    left, right = own.toDF("a", "shingle", "na", "fa"), own.toDF("b", "shingle", "nb", "fb")
    bound = (100 + percent) * F.least("fa", "fb") >= percent * (F.col("na") + F.col("nb"))
    by_shingle = left.join(right, "shingle").where((F.col("a") < F.col("b")) & bound).select("a", "b")
    # Pairs that share others: between clusters, by way of their centres.
    rows = held.select("band", "node", "label").join(enough("rare"), "node").join(leaders, "node", "left")
    rows = scratch.keep(rows.select("band", "node", "n", "free", "label", F.coalesce("pivot", "node").alias("pivot"), F.coalesce("d", F.lit(0.0)).alias("d")))
    met = rows.groupBy("band", "pivot").agg(F.min("label").alias("label"), F.max("free").alias("free"), F.min("n").alias("n"))
    left, right = met.toDF("band", "p", "lp", "fp", "np"), met.toDF("band", "q", "lq", "fq", "nq")  # a cluster has one label
    bound = (100 + percent) * F.least("fp", "fq") >= percent * (F.col("np") + F.col("nq"))
    meet = scratch.keep(left.join(right, "band").where((F.col("p") < F.col("q")) & (F.col("lp") != F.col("lq")) & bound).select("band", "p", "q"))
    apart = links.check(meet.select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(by_shingle))
    if apart is None:
        return
    inside = scratch.keep(rows.groupBy("node", "pivot").agg(F.min("d").alias("d")))
    reach = 1 - percent / 100 + 1e-9
    sizes = scratch.keep(inside.groupBy("pivot").agg(F.max("d").alias("r"), F.count("*").alias("size")))
    near = _distance(apart).toDF("p", "q", "apart").join(sizes.toDF("p", "rp", "np"), "p").join(sizes.toDF("q", "rq", "nq"), "q")
    near = near.where((F.col("np") + F.col("nq") > 2) & (F.col("apart") <= reach + F.col("rp") + F.col("rq")))
    known = links.labels.select("node", "label")
    near = near.join(known.toDF("p", "lp"), "p", "left").join(known.toDF("q", "lq"), "q", "left").where(F.coalesce("lp", "p") != F.coalesce("lq", "q"))
    # The smaller cluster's nodes that may reach the larger one go and meet its nodes.
    down = F.struct("np", "p") <= F.struct("nq", "q")
    near = near.select(F.when(down, F.col("p")).otherwise(F.col("q")).alias("pivot"), F.when(down, F.col("q")).otherwise(F.col("p")).alias("host"), "apart", F.when(down, F.col("rq")).otherwise(F.col("rp")).alias("r"))
    guests = scratch.keep(near.join(inside, "pivot").where(F.col("apart") <= reach + F.col("d") + F.col("r")).select("host", "node").distinct())
    if guests.isEmpty():
        return
    deal = guests.groupBy("host").agg(F.count("*").alias("n")).join(sizes.select(F.col("pivot").alias("host"), "size"), "host")
    deal = scratch.keep(deal.select("host", F.ceil(F.col("n") / GUESTS).cast("int").alias("parts"), F.ceil(F.col("size") / HOSTED).cast("int").alias("shares")))
    copy = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    coming = guests.join(deal, "host").select("host", own("parts").alias("part"), copy("shares").alias("share"), F.lit(0).alias("role"), "node")
    there = inside.withColumnRenamed("pivot", "host").join(deal, "host").select("host", copy("parts").alias("part"), own("shares").alias("share"), F.lit(1).alias("role"), "node")
    met = coming.unionByName(there).join(links.texts, "node").select("host", "part", "share", "role", "node", "text")
    met = met.repartition("host", "part", "share").sortWithinPartitions("host", "part", "share", "role")
    links.labels = components(met.mapInArrow(lambda it: _meet(it, size, percent), "a long, b long"), scratch, links.labels)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``df``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "dedup")
    documents = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    schema = "doc_id long, text_hash long, n_shingles long, low long, high long, bands array<long>"
    signed = scratch.keep(documents.mapInArrow(lambda it: _signatures(it, bands, rows, size), schema), compression="none")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    # A node for each shingle set; written, so that its number stays.
    sets = linkable.groupBy("low", "high").agg(F.min(F.struct("doc_id", "text_hash")).alias("_row"), F.max("n_shingles").alias("n"))
    classes = scratch.keep(sets.select("low", "high", "_row.*", "n", F.monotonically_increasing_id().alias("node")))
    nodes = scratch.keep(linkable.join(classes, ["doc_id", "text_hash", "low", "high"]).select("node", "doc_id", "n", "bands").dropDuplicates(["node"]), compression="none")
    keyed = nodes.select("node", "doc_id", "n", F.explode("bands").alias("band"))
    # The centre has the smallest id: of a text and its edited copies mostly the text itself.
    order = F.struct("doc_id", "node")
    buckets = scratch.keep(keyed.groupBy("band").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first != last").select("band", F.col("first.node").alias("centre"), F.col("first.doc_id").alias("centre_id")))
    members = scratch.keep(keyed.join(buckets, "band").select("band", "node", "n", "centre", "centre_id"))
    scratch.drop(nodes)
    stars = scratch.keep(members.where("node != centre").groupBy(F.col("centre").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("hits"), F.min("centre_id").alias("id")))
    wanted = scratch.keep(members.select("node").distinct().join(classes.select("node", "doc_id", "text_hash"), "node"))
    few = wanted.count() <= BROADCAST_IDS
    texts = scratch.keep(documents.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]))
    # Ids that stand for several texts link these.
    several = linkable.groupBy("doc_id").agg(F.min(F.struct("low", "high")).alias("first"), F.max(F.struct("low", "high")).alias("last")).where("first != last").select("doc_id")
    shared = scratch.keep(linkable.select("doc_id", "low", "high").join(several, "doc_id", "left_semi").distinct().join(classes.select("low", "high", "node"), ["low", "high"]).select("doc_id", "node"))
    same = shared.join(shared.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))

    links = Links(texts, scratch, size, percent, components(same, scratch))
    # Each node's most frequent centre; then the other edges of the stars.
    first = links.check(stars.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("id"), -F.col("a"))).alias("a")).select("a", "b"))
    if first is not None:
        second = links.check(stars.select("a", "b").join(first.select("a", "b"), ["a", "b"], "left_anti"))
        near = _distance(links.similar(first if second is None else first.unionByName(second)))
        leaders = scratch.keep(near.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("d", "a")).alias("_l")).select("node", F.col("_l.a").alias("pivot"), "_l.d"))
        search_mixed(members.select("band", "node", "n"), leaders, links, scratch, size, percent)
    # Labels are nodes; a component goes by its least id.
    numbered = scratch.keep(classes.select("low", "high", "doc_id", "node").join(links.labels, "node", "left").select("low", "high", "doc_id", F.coalesce("label", "node").alias("label")))
    linked = scratch.keep(numbered.groupBy("label").agg(F.min("doc_id").alias("component"), F.count("*").alias("sets")).where("sets > 1").select("label", "component"))
    found = scratch.keep(numbered.join(linked, "label", "left").select("low", "high", F.coalesce("component", "doc_id").alias("component")))
    out = signed.select("doc_id", "n_shingles", "low", "high").join(found, ["low", "high"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    whole = out.select("doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate texts among all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
ORACLE_SQL = {
    "op2_minhash_dedup": """
with recursive t as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w
  from documents
), s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end) as g
  from t
), n as (
  select doc_id, count(*) as n from s group by doc_id
), e as (
  select a.doc_id as a, b.doc_id as b
  from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n
  having 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), sym as (
  select a, b from e union all select b, a from e
), r as (
  select doc_id as node, doc_id as label from documents
  union
  select sym.b, r.label from r join sym on r.node = sym.a where r.label < sym.b
), c as (
  select node, min(label) as label from r group by node
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.label as component_id, d.doc_id = c.label as kept
from documents d join c on c.node = d.doc_id left join n on n.doc_id = d.doc_id
"""
}
