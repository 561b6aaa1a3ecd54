"""Lexicon scores, winners with a margin, and presence counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..catalog import Pattern
from ..functions.confidence import quote_parts


#: A pattern that is one whole word.
_PLAIN = re.compile(r"\\b([^\W_]+)\\b")


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + pattern))


def label_scores(df: DataFrame, patterns: list[Pattern], text: str = "text", head: int = 2000, boost: float = 3.0, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, score, ord) for each label of a pattern table.

    Weighted hits in the whole lower-cased text, and ``boost`` times those in its first
    ``head`` characters.  The table becomes expressions in the row's own scan: no join and
    no shuffle, every pattern compiled once.
    """
    plain = {p: m[1] for p in patterns if (m := _PLAIN.fullmatch(p.pattern))}
    low = df.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("_low")).withColumn("_head", F.left("_low", F.lit(head)))
    if plain:  # whole words are looked for together, in one pass
        words = F.lit(r"(?U)\b(?:" + "|".join(dict.fromkeys(plain.values())) + r")\b")
        low = low.withColumns({"_words": F.regexp_extract_all("_low", words, 0), "_first": F.regexp_extract_all("_head", words, 0)})
    labels = list(dict.fromkeys(p.value for p in patterns))
    scores = []
    for i, label in enumerate(labels):
        total = F.lit(0.0)
        weights: dict[str, float] = {}
        for p in (p for p in patterns if p.value == label):
            if p in plain:
                weights[plain[p]] = weights.get(plain[p], 0.0) + p.weight
            else:
                total = total + hits(F.col("_low"), p.pattern) * p.weight + (boost * p.weight) * hits(F.col("_head"), p.pattern)
        if weights:
            table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
            own = lambda c, table=table: F.aggregate(c, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
            total = total + own("_words") + boost * own("_first")
        scores.append(F.struct(F.lit(label).alias("label"), total.alias("score"), F.lit(i).alias("ord")))
    return low.select("doc_id", F.explode(F.array(*scores)).alias("_s")).select("doc_id", "_s.label", "_s.score", "_s.ord")


def lexicon_scores(df: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The same from a lexicon table (label, pattern, weight), for vocabularies too large for
    one expression: a broadcast join, so the table must be a bounded one."""
    low = df.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    pairs = low.join(F.broadcast(lexicon), F.lit(True))
    return pairs.groupBy("doc_id", "label").agg(F.sum(F.expr("regexp_count(_low, pattern)") * F.col("weight")).alias("score"), F.min("ord").alias("ord"))


def winner(scores: DataFrame, margin: float = 3.0, ratio: float = 2.0) -> DataFrame:
    """(doc_id, label, confidence) of the best label: none if its score is 0, or if its lead
    is under ``margin`` while the next is positive and within ``ratio``.  Ties keep the
    labels' order.  Best and next are two aggregates of one shuffle on the document."""
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ord", "label"))), 1, 2)
    best = scores.groupBy("doc_id").agg(ranked.alias("_r"))
    top, second = -F.col("_r")[0]["neg"], F.coalesce(-F.try_element_at("_r", F.lit(2))["neg"], F.lit(0.0))
    gap = top - second
    close = (gap < margin) & (second > 0) & (top / second < ratio)
    return best.where((top > 0) & ~close).select("doc_id", F.col("_r")[0]["label"].alias("label"), F.least(F.lit(1.0), 0.60 + gap / 30.0).alias("confidence"))


def best_pattern(text: Column, patterns: list[Pattern]) -> Column:
    """STRUCT(value, confidence) of the pattern with the largest weighted count, in text order of ties."""
    low = F.lower(text)
    options = F.array(*[F.struct((-(hits(low, p.pattern) * p.weight)).alias("neg"), F.lit(i).alias("ord"), F.lit(p.value).alias("value")) for i, p in enumerate(patterns)])
    best = F.array_sort(options)[0]
    return F.when(best["neg"] < 0, F.struct(best["value"].alias("value"), F.least(F.lit(1.0), 0.70 - best["neg"] / 50.0).alias("confidence")))


def reading_score(text: Column, terms: list[str]) -> Column:
    """How many of the terms a reading holds, plus up to 3 for its length."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(0.0)
    for t in terms:
        score = score + F.contains(low, F.lit(t)).cast("double")
    return score + F.least(F.length(low) / 100.0, F.lit(3.0))


def text_candidate(df: DataFrame, terms: list[str], group: str = "doc_id") -> DataFrame:
    """(group, text, score) of the best reading; ties keep their order."""
    scored = df.withColumn("score", reading_score(F.col("text"), terms))
    return scored.groupBy(group).agg(F.max_by("text", F.struct("score", -F.col("ord"))).alias("text"), F.max("score").alias("score"))


def longest_values(df: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, field, value): the longest reading of each field, the better ranked of equals."""
    return df.where("value is not null").groupBy(group, "field").agg(F.max_by("value", F.struct(F.length("value"), -F.col("ord"))).alias("value"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))


def top_labels(scores: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` best labels of each document, ranked."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "label", "score", "rank")


def quote_scores(groups: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, item_id, score): ``confidence.quote_score`` of every whole quote of
    (item_id, quote), a bounded table that is broadcast, with the chunks of every group of
    (id, chunks).

    Each distinct word is looked for once a chunk, and not once a quote; nothing is shuffled.
    """
    q, words = quote_parts(F.col("quote"))
    rows = quotes.select("item_id", q.alias("q"), words.alias("words")).collect()
    place: dict[str, int] = {}
    holders: list[list[int]] = []  # of each distinct word: its quotes, as often as they have it
    for i, r in enumerate(rows):
        for w in r.words or []:
            if place.setdefault(w, len(place)) == len(holders):
                holders.append([])
            holders[place[w]].append(i)
    n = len(rows)
    id_type = quotes.schema["item_id"].dataType.simpleString()
    shared = groups.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.q or "" for r in rows], list(place), [np.array(x) for x in holders], np.array([len(r.words or []) for r in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, whole, distinct, owners, sizes = shared.value
        long_enough = np.array([len(x) >= 2 for x in whole], bool)
        for batch in batches:
            for g in range(batch.num_rows):
                score, exact = np.zeros(n), np.zeros(n, bool)
                for chunk in batch.column(1)[g].as_py() or []:
                    if chunk is None:
                        continue
                    there = [owners[k] for k, w in enumerate(distinct) if w in chunk]
                    found = np.bincount(np.concatenate(there), minlength=n) if there else np.zeros(n)
                    share = found / np.maximum(sizes, 1)
                    score = np.where(share > score, 0.75 * share, score)
                    exact |= [x in chunk for x in whole]
                score = np.where(long_enough, np.where(exact, 1.0, score), 0.0)
                one = batch.column(0).slice(g, 1).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([one, pa.array(ids, item_type), pa.array(score)], ["id", "item_id", "score"])

    item_type = to_arrow_type(quotes.schema["item_id"].dataType)
    low = groups.select("id", F.transform("chunks", lambda c: F.lower(c)).alias("chunks"))
    return low.mapInArrow(run, f"id {groups.schema['id'].dataType.simpleString()}, item_id {id_type}, score double")
