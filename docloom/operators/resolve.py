"""Candidates to one record per document: applicability, priorities, guards, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C

#: Sources by priority: a tag overrides the classifier, a model only fills gaps.
PRIORITY = {"isa_tag": 0, "classifier": 1, "model": 2}


def applicable(field: Column, category: Column, kind: Column, has_threshold: Column, supply: Column) -> Column:
    """Whether a field applies in a context; an empty context excludes nothing."""
    known = category.isNotNull() | kind.isNotNull() | has_threshold.isNotNull() | supply.isNotNull()
    wrong = (
        (F.coalesce(category == C.CATEGORIES[1], F.lit(False)) & field.isin(C.TRANSMITTER_FIELDS))
        | (F.coalesce(category == C.CATEGORIES[0], F.lit(False)) & field.isin(C.ACTUATOR_FIELDS))
        | (field.isin(C.THRESHOLD_FIELDS) & ~F.coalesce(has_threshold, F.lit(False)))
        | ((field == "matériauMembrane") & F.coalesce(~kind.isin(C.MEMBRANE_TYPES), F.lit(False)))
        | ((field == "communication") & F.coalesce(supply == "boucle", F.lit(False)))
    )
    return ~known | ~wrong


def visible(field: Column, category: Column, kind: Column, has_threshold: Column, supply: Column) -> Column:
    """Whether the form shows a field; unlike ``applicable``, an unknown category hides the
    fields of both, and loop supply goes by its label."""
    transmitter, actuator = (F.coalesce(category == c, F.lit(False)) for c in C.CATEGORIES)
    return ~(
        (field.isin(C.FORM_TRANSMITTER) & ~transmitter)
        | (field.isin(C.FORM_ACTUATOR) & ~actuator)
        | (field.isin(C.THRESHOLD_FIELDS) & ~F.coalesce(has_threshold, F.lit(False)))
        | ((field == "matériauMembrane") & ~F.coalesce(kind.isin(C.MEMBRANE_TYPES), F.lit(False)))
        | ((field == "communication") & F.coalesce(supply == C.LOOP_LABEL, F.lit(False)))
    )


def open_fields(contexts: DataFrame, catalog: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(doc_id, field) still to be asked for: those an extractor fills, that apply, and that
    are not resolved yet (a null result counts as resolved)."""
    ask = contexts.join(F.broadcast(catalog.where("ai_fills")), F.lit(True))
    rule = applicable(F.col("field"), F.col("category"), F.col("typeMesure"), F.col("sortieTOR"), F.col("alimentation"))
    left = ask.where(rule).select("doc_id", "field")
    return left if resolved is None else left.join(resolved.select("doc_id", "field").distinct(), ["doc_id", "field"], "left_anti")


def resolve(candidates: DataFrame) -> DataFrame:
    """One row per (doc_id, field): the candidate of least priority.  Nulls of a model are no
    candidates; a null of another source blocks later ones."""
    order = F.lit(99)
    for k, v in PRIORITY.items():
        order = F.when(F.col("source") == k, v).otherwise(order)
    usable = candidates.where(~((F.col("source") == "model") & F.col("value").isNull()))
    best = usable.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "confidence", "source"), order).alias("_c"))
    return best.select("doc_id", "field", "_c.*")


def wide_records(resolved: DataFrame) -> DataFrame:
    """One typed row per document; actuator columns only for actuators; lists are joined by ``|``."""
    wide = resolved.groupBy("doc_id").pivot("field", [f for f, _, _ in C.FIELDS]).agg(F.first("value"))
    actuator = F.col("category") == C.CATEGORIES[1]
    columns = []
    for f, kind, _ in C.FIELDS:
        listed = F.when(F.col(f) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(f), r"\|"))
        c = listed if kind == "array<string>" else F.col(f).try_cast(kind)
        columns.append((F.when(actuator, c) if f in C.ACTUATOR_FIELDS else c).alias(f))
    return wide.select("doc_id", *columns)


def guard_records(wide: DataFrame, technologies: DataFrame) -> DataFrame:
    """A signal that names HART sets it; a technology that its type does not list becomes other."""
    valid = technologies.groupBy(F.col("type").alias("typeMesure")).agg(F.collect_set("technology").alias("_valid"))
    hart = F.when(F.contains(F.upper(F.coalesce("signalSortie", F.lit(""))), F.lit("HART")), True).otherwise(F.col("hart"))
    wrong = F.col("_valid").isNotNull() & F.col("technologie").isNotNull() & ~F.startswith("technologie", F.lit("Autre")) & ~F.array_contains("_valid", F.col("technologie"))
    fixed = F.when(wrong, F.concat(F.lit("Autre: "), F.col("technologie"))).otherwise(F.col("technologie"))
    return wide.join(F.broadcast(valid), "typeMesure", "left").withColumns({"hart": hart, "technologie": fixed}).drop("_valid").select(*wide.columns)


def maps(resolved: DataFrame) -> DataFrame:
    """(doc_id, data, confidence) as maps by field, for the edge of the system."""
    pair = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", c))))
    return resolved.groupBy("doc_id").agg(pair("value").alias("data"), pair("confidence").alias("confidence"))


def merge_files(fields: DataFrame, first_unrecorded: bool = False) -> DataFrame:
    """(record_id, field, value, confidence) over the files of a record: the largest
    confidence, the earlier file of equals.  ``first_unrecorded``: the first file's
    confidences count as 0, so that any later one above 0 wins."""
    weight = F.when(F.lit(first_unrecorded) & (F.col("file_ord") == 0), 0.0).otherwise(F.col("confidence"))
    best = fields.where("value is not null").groupBy("record_id", "field").agg(F.max_by(F.struct("value", "confidence"), F.struct(weight, -F.col("file_ord"))).alias("_b"))
    return best.select("record_id", "field", "_b.*")


def value_diff(ai: DataFrame, user: DataFrame) -> DataFrame:
    """(doc_id, field, ai_value, user_value) where the two differ, nulls included."""
    both = ai.withColumnRenamed("value", "ai_value").join(user.withColumnRenamed("value", "user_value"), ["doc_id", "field"], "full_outer")
    return both.where(~F.col("ai_value").eqNullSafe(F.col("user_value")))


def completeness(fields: DataFrame) -> DataFrame:
    """(doc_id, filled, confirmed, uncertain, empty, pct) of (doc_id, field, value, confidence)."""
    filled = F.coalesce(F.col("value") != "", F.lit(False))
    return fields.groupBy("doc_id").agg(
        F.count_if(filled).alias("filled"), F.count_if(filled & (F.col("confidence") >= 0.9)).alias("confirmed"),
        F.count_if(filled & (F.col("confidence") >= 0.01) & (F.col("confidence") < 0.9)).alias("uncertain"), F.count_if(~filled).alias("empty"),
        F.round(100 * F.count_if(filled) / F.count("*")).cast("long").alias("pct"),
    )


def child_options(records: DataFrame, options: DataFrame, parent: str, key: str) -> DataFrame:
    """Cascading options: the child values that a record's parent value offers."""
    return records.join(F.broadcast(options), F.col(parent) == F.col(key), "left").drop(key)


def technology_violations(records: DataFrame, technologies: DataFrame) -> DataFrame:
    """Records whose technology is not among those of their type."""
    pairs = technologies.toDF("typeMesure", "technologie", "ord").select("typeMesure", "technologie")
    return records.where("technologie is not null").join(pairs, ["typeMesure", "technologie"], "left_anti")


def latest(df: DataFrame, by: str, order: str, n: int = 5) -> DataFrame:
    """The last ``n`` rows of each key, oldest first in ``position``."""
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    kept = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(order))).drop("_n")
