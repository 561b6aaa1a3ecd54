"""Ports for model-backed steps, and stand-ins for tests.

A port is a function on columns or frames; a real one calls a model in Arrow batches.  The
stand-ins are deterministic and say nothing about model quality.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import catalog as C
from ..functions.text import char_windows, ocr_text

Embedder = Callable[[list[str]], list[list[float]]]


def embedding_port(embed: Embedder, width: int = 768, window: int = 6000, overlap: int = 200) -> Callable[[Column], Column]:
    """A column function text -> vector.  Blank texts give zeros.  A batch that fails, or
    comes back of the wrong count, is embedded text by text, long texts as the mean of their
    windows; what still fails gives zeros."""

    def windows(text: str) -> list[str]:
        if len(text) <= window:
            return [text]
        return [text[i : i + window] for i in range(0, max(len(text) - overlap, 1), window - overlap)]

    def one(text: str) -> list[float]:
        try:
            parts = [v for w in windows(text) for v in embed([w])]
            same = [v for v in parts if len(v) == len(parts[0])]
            return (np.sum(same, axis=0) / len(parts)).tolist()
        except Exception:
            return [0.0] * width

    @pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.fillna("")
            full = [t for t in texts if t.strip()]
            try:
                vectors = embed(full)
                if len(vectors) != len(full) or not all(vectors):
                    raise ValueError("wrong count")
            except Exception:
                vectors = [one(t) for t in full]
            left = iter(vectors)
            yield pd.Series([next(left) if t.strip() else [0.0] * width for t in texts])

    return run


def hashing_embedder(width: int = 64) -> Embedder:
    """Stand-in: signed word counts in hashed positions."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1.0 if h & 0x10000 else -1.0
            out.append(v)
        return out

    return embed


def overlap_reranker(text: Column, instruction: Column) -> Column:
    """Stand-in: how many of the instruction's words the text holds."""
    words = F.filter(F.split(F.lower(instruction), r"\W+"), lambda w: F.length(w) > 2)
    return F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))).cast("double")


def probe_width(embed: Embedder, fallback: int = 768) -> int:
    """The width of an embedder's vectors, by one short text."""
    try:
        return len(embed(["probe"])[0]) or fallback
    except Exception:
        return fallback


def render_port(render: Callable[[bytes, int], bytes]) -> Callable[[DataFrame], DataFrame]:
    """A frame function (path, content, page_number) -> (path, page_number, image): pages as
    base64 images, empty where rendering fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = []
            for content, n in zip(b["content"], b["page_number"], strict=True):
                try:
                    images.append(base64.b64encode(render(content, int(n))).decode())
                except Exception:
                    images.append("")
            yield pd.DataFrame({"path": b["path"], "page_number": b["page_number"], "image": images})

    return lambda pages: pages.select("path", "content", "page_number").mapInPandas(run, "path string, page_number int, image string")


def vision_port(read: Callable[[bytes], str], most: int = 12_000) -> Callable[[Column], Column]:
    """A column function base64 image -> its text, tidied, at most ``most`` characters; empty
    for no image and for failures."""

    @pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for images in batches:
            texts = []
            for image in images:
                try:
                    texts.append(read(base64.b64decode(image)) if image else "")
                except Exception:
                    texts.append("")
            yield pd.Series(texts, dtype=object)

    return lambda image: F.left(ocr_text(run(image)), F.lit(most))


def label_port(prepare: Callable[[bytes], dict[str, bytes]], read: Callable[[bytes], str]) -> Callable[[DataFrame], DataFrame]:
    """A frame function (path, content) -> (doc_id, ord, text): the readings of an image's
    prepared variants, in their order, as ``read_labels`` takes them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, i, read(image)) for i, image in enumerate(prepare(content).values())]
                except Exception:
                    rows.append((path, 0, ""))
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "text"])

    return lambda files: files.select("path", "content").mapInPandas(run, "doc_id string, ord int, text string")


def extraction_port(ask: Callable[[str], str], limit: float = 30.0) -> Callable[[DataFrame], DataFrame]:
    """A frame function (doc_id, field, prompt) -> (doc_id, field, value, kind, confidence, quote,
    error).  The answer is a JSON object; a call that fails or takes longer than ``limit``
    seconds, and broken JSON, give null and 0."""
    schema = "doc_id string, field string, answer string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = ThreadPoolExecutor(1)
        for b in batches:
            rows = []
            for d, f, p in zip(b["doc_id"], b["field"], b["prompt"], strict=True):
                try:
                    rows.append((d, f, calls.submit(ask, p).result(limit), None))
                except Exception as e:
                    if isinstance(e, TimeoutError):  # the late call keeps its thread
                        calls.shutdown(wait=False)
                        calls = ThreadPoolExecutor(1)
                    rows.append((d, f, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "field", "answer", "error"])
        calls.shutdown(wait=False)

    def apply(prompts: DataFrame) -> DataFrame:
        answered = prompts.select(F.col("doc_id").cast("string").alias("doc_id"), "field", "prompt").mapInPandas(run, schema)
        return parse_answers(answered)

    return apply


def pattern_answerer(patterns: dict[str, str]) -> Callable[[str], str]:
    """Stand-in: answers with the first group of a field's pattern in the excerpts."""
    import json
    import re

    def ask(prompt: str) -> str:
        field = re.search(r"^Field: (.*)$", prompt, re.M)[1]
        m = re.search(patterns[field], prompt.partition("\nExcerpts:\n")[2]) if field in patterns else None
        return json.dumps({"value": m and m[1], "confidence": 0.9 if m else 0.0, "quote": m and m[0]})

    return ask


def parse_answers(answers: DataFrame) -> DataFrame:
    """(doc_id, field, value, kind, confidence, quote, error) of JSON answers; lists are joined
    by ``|``; broken ones give null, 0 and a reason."""
    parsed = F.try_parse_json("answer")
    get = lambda k, t: F.try_variant_get(parsed, f"$.{k}", t)
    bad = parsed.isNull() & F.col("error").isNull()
    name = F.schema_of_variant(get("value", "variant"))
    kind = F.when(F.startswith(name, F.lit("ARRAY")), "list").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").when(name.isNotNull() & (name != "VOID"), "number")
    value = F.when(kind == "list", F.array_join(get("value", "array<string>"), "|")).otherwise(get("value", "string"))
    return answers.select(
        "doc_id", "field", value.alias("value"), kind.alias("kind"), F.coalesce(get("confidence", "double"), F.lit(0.0)).alias("confidence"), get("quote", "string").alias("quote"), F.when(bad, "invalid JSON").otherwise(F.col("error")).alias("error")
    )


def prompts(fields: DataFrame, excerpts: DataFrame, catalog: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, prompt) from the field's rule, allowed values, what is known of the
    document (a ``context`` column of ``fields``, if there), past corrections and excerpts."""
    rows = fields.join(excerpts, ["doc_id", "field"], "left").join(F.broadcast(catalog.select("field", "allowed_values")), "field", "left")
    if corrections is not None:
        line = F.format_string("AI: %s -> user: %s%s", F.coalesce("ai_value", F.lit("null")), F.coalesce("user_value", F.lit("null")), F.coalesce(F.concat(F.lit(" (rule: "), F.col("rule"), F.lit(")")), F.lit("")))
        past = corrections.groupBy(F.col("field_name").alias("field")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("past"))
        rows = rows.join(past, "field", "left")
    else:
        rows = rows.withColumn("past", F.lit(None).cast("string"))
    told = F.create_map(*[F.lit(x) for pair in C.FIELD_RULES.items() for x in pair])
    rule = F.concat(F.lit("\nRule: "), F.coalesce(F.try_element_at(told, F.col("field")), F.lit("The value as it stands.")))
    options = F.when(F.col("allowed_values").isNotNull(), F.concat(F.lit("\nAllowed: "), F.array_join("allowed_values", ", "))).otherwise(F.lit(""))
    context = F.coalesce(F.concat(F.lit("\nKnown: "), F.nullif("context", F.lit(""))), F.lit("")) if "context" in fields.columns else F.lit("")
    history = F.when(F.col("past").isNotNull(), F.concat(F.lit("\nPast corrections:\n"), F.col("past"))).otherwise(F.lit(""))
    text = F.concat(F.lit("Field: "), F.col("field"), rule, options, context, history, F.lit('\nAnswer as JSON {"value", "confidence", "quote"}, null where the excerpts do not say it.\nExcerpts:\n'), F.coalesce("excerpts", F.lit("")))
    return rows.select("doc_id", "field", text.alias("prompt"))


def split_for_embedding(df: DataFrame) -> DataFrame:
    """(doc_id, part_no, part) as the embedding port cuts long texts."""
    return df.select("doc_id", F.posexplode(char_windows(F.col("text"))).alias("part_no", "part"))
