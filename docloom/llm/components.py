"""Connected components of an edge list, by hooking to the least neighbour and contracting.

Each round every node takes its least neighbour as parent, four steps up that forest give
its image, and edges between different images go on.  Images of neighbours stay connected
and the least node of a component is always its own image, so that the images of all rounds,
one after the other, lead every node to it.  Edges and images stay in tables of the shared
folder; the driver sees only whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _up(images: DataFrame, more: DataFrame) -> DataFrame:
    """(node, image) with each image replaced by its own in ``more``, where it has one."""
    return images.join(more.toDF("image", "next"), "image", "left").select("node", F.coalesce("next", "image").alias("image"))


def components(links: DataFrame, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b) and of the ``labels`` that are already
    known: label is the least node of its component."""
    ends = links.select("a", "b")
    if labels is not None:
        known = labels.select("node", "label")
        ends = ends.join(known.toDF("a", "la"), "a", "left").join(known.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    edges = scratch.keep(ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        parents = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("image"))
        two = _up(parents, parents)
        image = scratch.keep(_up(two, two))
        rounds.append(image)
        left = edges.join(image.toDF("a", "ia"), "a").join(image.toDF("b", "ib"), "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
        shorter = scratch.keep(left.where("a != b").distinct())
        scratch.drop(edges)
        edges = shorter
    if not rounds:
        return labels if labels is not None else edges.toDF("node", "label")
    found = rounds[0]
    for more in rounds[1:]:
        found = _up(found, more)
    if labels is not None:
        found = _up(labels.toDF("node", "image"), found).unionByName(found.join(labels.select("node"), "node", "left_anti"))
    elif len(rounds) == 1:
        return found.toDF("node", "label")
    out = scratch.keep(found.toDF("node", "label"))
    scratch.drop(*rounds)
    return out
