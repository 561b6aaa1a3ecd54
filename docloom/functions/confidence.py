"""Evidence signals and their blend into one confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Weights of distance, quote, value quality, model and rerank.
WEIGHTS = (0.35, 0.25, 0.20, 0.10, 0.10)
FAR = 0.70


def value_quality(v: Column, kind: Column, in_options: Column) -> Column:
    """How good a value looks by itself."""
    s = strip(v)
    low = F.lower(s)
    return (
        F.when(v.isNull(), 0.0).when(kind == "boolean", 0.85).when(kind == "number", 0.80).when(s == "", 0.0).when(low == "autre", 0.20)
        .when(F.startswith(low, F.lit("autre:")), 0.45).when(F.coalesce(in_options, F.lit(False)), 0.90).when(F.length(s) < 2, 0.20).when(F.length(s) > 200, 0.50).otherwise(0.80)
    )


def quote_parts(quote: Column) -> tuple[Column, Column]:
    """The quote as it is looked for, and its longer words."""
    q = F.lower(strip(quote))
    return q, F.filter(F.split(q, r"\s+"), lambda w: F.length(w) > 2)


def quote_score(quote: Column, chunks: Column) -> Column:
    """1.0 if a chunk holds the quote; else a fold over the chunks' shares of its longer
    words, in which a larger share counts three quarters (so that their order matters)."""
    q, words = quote_parts(quote)
    texts = F.transform(chunks, lambda c: F.lower(c))
    share = lambda c: F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(c, w))) / F.size(words)).otherwise(0.0)
    fold = F.aggregate(F.transform(texts, share), F.lit(0.0), lambda a, p: F.when(p > a, 0.75 * p).otherwise(a))
    return F.when(F.length(F.coalesce(q, F.lit(""))) < 2, 0.0).when(F.exists(texts, lambda c: F.contains(c, q)), 1.0).otherwise(fold)


def distance_score(distance: Column) -> Column:
    """1 at distance 0, 0 from ``FAR`` on; a missing distance is 1."""
    return F.greatest(F.lit(0.0), 1 - F.coalesce(distance, F.lit(1.0)) / FAR)


def rerank_score(rerank: Column, distance: Column) -> Column:
    return F.when(rerank.isNotNull(), 1 / (1 + F.exp(-rerank / 3))).otherwise(distance_score(distance))


def model_score(model: Column) -> Column:
    """The model's own confidence, drawn towards the middle."""
    return 0.5 + (F.when(F.coalesce(model, F.lit(0.0)) == 0, 0.5).otherwise(model) - 0.5) * 0.4


def blend(quality: Column, quote: Column, model: Column, distance: Column, rerank: Column, has_value: Column, bare_other: Column) -> Column:
    """Weighted sum, 0 without a value, at most 0.45 for a bare "other", 4 decimals."""
    signals = (distance_score(distance), quote, quality, model_score(model), rerank_score(rerank, distance))
    total = F.lit(0.0)
    for w, s in zip(WEIGHTS, signals, strict=True):
        total = total + w * s
    capped = F.when(bare_other, F.least(total, F.lit(0.45))).otherwise(total)
    return F.when(has_value, F.round(F.least(F.greatest(capped, F.lit(0.0)), F.lit(1.0)), 4)).otherwise(0.0)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "green").when(confidence >= 0.6, "amber").otherwise("red")
