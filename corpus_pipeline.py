"""Corpus pipeline: quality, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; the driver
of the pipeline writes a stage's result as Parquet and rereads it for the next.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, table
from docloom.llm.dedup import near_duplicates
from docloom.llm.langid import UNKNOWN, fit_chain, identify
from docloom.llm.packing import pack
from docloom.llm.pii import pseudonymise, session_key
from docloom.llm.quality import THRESHOLD, fit_machine, remainder, score_quality

#: Languages that the pipeline keeps (None: every learnt one), and the least score: half of the words.
LANGUAGES: Collection[str] | None = None
LEAST_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least ``THRESHOLD``; learns from the
    labelled ones among them outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = score_quality(docs, fit_machine(docs, labels), score_col="_quality")
    return scored.where(F.col("_quality") >= THRESHOLD).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: Collection[str] | None = LANGUAGES, least: float = LEAST_SCORE) -> DataFrame:
    """Keeps documents whose language is among the ``wanted`` ones (None: all that could be
    learnt) and whose words bear it out to ``least``, the mean share of their marginals:
    texts without letters go, and so do those that are a mixture or fit no language."""
    chain = fit_chain(docs.select("doc_id", "text", "lang").where(remainder("doc_id", 5) != 0))
    found = identify(docs, chain, lang_col="_lang", score_col="_score")
    ok = F.col("_lang") != UNKNOWN if wanted is None else F.col("_lang").isin(list(wanted))
    return found.where(ok & (F.col("_score") >= least)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id.  Of
    rows equal in id and text one stays (which one is open if other columns differ); rows that
    share an id but not a text are different documents, and stay or go with their id.  Only
    ids of what goes, and of ids that repeat, are joined."""
    scratch = Scratch(spark, "pipeline-dedup")
    found = scratch.keep(near_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    repeated = scratch.keep(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = docs.join(scratch.keep(gone), "doc_id", "left_anti")
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by format-preserving pseudonyms under the session's key; every
    document stays."""
    done = pseudonymise(docs, spans_col=None, key=session_key(spark))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return done.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into length buckets and batches."""
    return pack(docs, Scratch(spark, "pipeline-packing"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fitted models and MinHash have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
