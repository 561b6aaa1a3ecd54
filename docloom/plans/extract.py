"""Composite plans: classification of a corpus, retrieval for all fields, extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import confidence as K
from ..functions import rules as R
from ..functions.normalize import normalize
from ..functions.text import strip, substitute
from ..operators import resolve as V
from ..operators import retrieve as Q
from ..operators import scoring as S
from ..operators.chunks import table_chunks, text_chunks
from ..operators.lines import clean_pages, full_texts, repeating_edges
from ..sources import ports


def classify(documents: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, source) by the classifier, all its fields at once.

    ``documents`` is (doc_id, text).  Quantity scores are made in the row, so that the only
    shuffle is the one for the winner.
    """
    best = S.winner(S.label_scores(documents, C.QUANTITY_LEXICON)).withColumnsRenamed({"label": "_kind", "confidence": "_sure"})
    rows = documents.join(best, "doc_id", "left")
    text = F.col("text")
    entry = lambda name, s: F.struct(F.lit(name).alias("field"), s["value"].cast("string").alias("value"), s["confidence"].alias("confidence"))
    made = lambda v, c: F.struct(v.alias("value"), c.alias("confidence"))
    hart = R.classify_hart(text)
    certificates = R.classify_certificates(text)
    found = F.array(
        entry("typeMesure", made(F.col("_kind"), F.col("_sure"))), entry("code", R.classify_code(text, F.col("_kind"))), entry("technologie", S.best_pattern(text, C.TECHNOLOGY_LEXICON)), entry("marque", R.classify_brand(text)),
        entry("signalSortie", R.first_match(text, C.CLASSIFIER_SIGNALS)), entry("hart", made(hart.cast("string"), F.lit(1.0))), entry("alimentation", R.first_match(text, C.CLASSIFIER_SUPPLIES)), entry("indiceIP", R.classify_protection(text)),
        entry("températureProcess", R.first_match(text, C.PROCESS_TEMPERATURES)), entry("certificats", made(F.array_join(certificates, "|"), F.when(F.size(certificates) > 0, 0.95).otherwise(0.80))),
    )
    each = rows.select("doc_id", F.explode(F.filter(found, lambda x: x["value"].isNotNull())).alias("_f"))
    return each.select("doc_id", "_f.*", F.lit("classifier").alias("source"))


def tag_fields(documents: DataFrame) -> DataFrame:
    """Category, code and quantity of the first loop tag; the quantity may be null and then
    still blocks other sources."""
    tagged = documents.select("doc_id", R.tag_info(F.col("text")).alias("_t")).where("_t is not null")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_t.{k}").alias("value")) for f, k in (("category", "category"), ("code", "code"), ("typeMesure", "type"))])
    return tagged.select("doc_id", F.explode(rows).alias("_f")).select("doc_id", "_f.*", F.lit(1.0).alias("confidence"), F.lit("isa_tag").alias("source"))


def regex_fields(documents: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, source) by the rule extractors.

    The model is looked up with the maker found in the text; an order number that proves the
    maker overrides it afterwards, and names a panel where no model was found.  Categories,
    quantities and ranges are not guessed for controller data sheets.
    """
    t, c = F.col("text"), F.col
    # In steps, so that each match is made once and not again wherever it is used.
    rows = documents.select("doc_id", "text").withColumns({"_brand": R.brand(t), "reference": R.reference(t), "_range": R.measuring_range(t), "_free": ~R.is_plc_datasheet(t)})
    rows = rows.withColumn("_model", R.model(t, c("_brand.value")))
    number = F.upper(F.regexp_replace(F.coalesce(c("reference.value"), F.lit("")), r"(?U)\s+", ""))
    locked = F.lit(False)
    for p in C.SIEMENS_PREFIXES:
        locked = locked | F.startswith(number, F.lit(p))
    siemens = F.struct(F.lit("Siemens").alias("value"), F.lit(1.0).alias("confidence"), c("reference.value").alias("quote"))
    value = F.format_string("%s..%s %s", c("_range.min").cast("string"), c("_range.max").cast("string"), c("_range.unit"))
    rows = rows.withColumns({
        "typeSignal": R.first_match(t, C.REGEX_SIGNALS), "communication": R.guarded_match(t, C.REGEX_PROTOCOLS, C.NEGATORS), "alimentation": R.first_match(t, C.REGEX_SUPPLIES, tidy=True), "nbFils": R.first_match(t, C.REGEX_WIRES),
        "indiceIP": R.protection(t), "marque": F.when(locked, siemens).otherwise(c("_brand")), "reperage": R.first_match(t, C.REGEX_TAGS), "equipmentName": R.first_match(t, C.REGEX_NAMES, tidy=True),
        "modele": F.coalesce(c("_model"), F.when(locked, R.panel(t))), "categorie": F.when(c("_free"), R.category(t)), "typeMesure": F.when(c("_free"), R.simple_quantity(t)),
        "plageMesure": F.when(c("_free") & c("_range").isNotNull(), F.struct(value.alias("value"), F.lit(0.85).alias("confidence"))),
    })
    names = [n for n in rows.columns if n not in ("doc_id", "text") and not n.startswith("_")]
    pick = [F.struct(F.lit(n).alias("field"), c(f"{n}.value").alias("value"), c(f"{n}.confidence").alias("confidence")) for n in names]
    each = rows.select("doc_id", F.explode(F.filter(F.array(*pick), lambda x: x["value"].isNotNull())).alias("_f"))
    return each.select("doc_id", "_f.*", F.lit("regex").alias("source"))


def retrieve_fields(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Hits of all fields of all documents in one plan: (doc_id, field, query_idx, rank,
    chunk_id, distance), each chunk once per field.

    ``vectors`` is (doc_id, chunk_id, embedding), ``queries`` (field, query_idx, embedding):
    the catalogue's queries, a bounded table, so it is broadcast.
    """
    q = Q.with_norm(queries).withColumnsRenamed({"embedding": "_q", "_norm": "_qn"})
    pairs = Q.with_norm(vectors).join(F.broadcast(q), F.lit(True))
    distance = F.when((F.col("_norm") > 0) & (F.col("_qn") > 0), 1 - Q.dot(F.col("embedding"), F.col("_q")) / (F.col("_norm") * F.col("_qn")))
    near = pairs.select("doc_id", "field", "query_idx", "chunk_id", F.round(distance, 9).alias("distance")).where("distance is not null")
    rank = F.row_number().over(Window.partitionBy("doc_id", "field", "query_idx").orderBy("distance", "chunk_id"))
    return Q.first_occurrences(near.withColumn("rank", rank).where(F.col("rank") <= k))


def extract(documents: DataFrame, technologies: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """One guarded, typed record per document from tags, classifier and model candidates."""
    parts = tag_fields(documents).unionByName(classify(documents))
    if model is not None:
        parts = parts.unionByName(model.select("doc_id", "field", "value", "confidence", F.lit("model").alias("source")))
    return V.guard_records(V.wide_records(V.resolve(parts)), technologies)


def contexts(documents: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc_id, category, typeMesure, sortieTOR, alimentation, context): what is known of each
    document, the whole of it as JSON for prompts."""
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))
    known = resolved.groupBy("doc_id").agg(value("category").alias("category"), value("typeMesure").alias("typeMesure"), (value("sortieTOR") == "true").alias("sortieTOR"), value("alimentation").alias("alimentation"), F.to_json(pairs).alias("context"))
    return documents.select("doc_id").join(known, "doc_id", "left")


def ask_fields(known: DataFrame, fields: DataFrame, hits: DataFrame, catalog: DataFrame, ask: Callable[[DataFrame], DataFrame], corrections: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, value, confidence, model_confidence, quote, reason) of each document
    of ``known`` (see ``contexts``) and each field of ``fields``.

    Fields that only people fill, and those that do not apply, are null with a reason and
    are not asked.  The others go through the model's port with the excerpts of their
    ``hits`` (doc_id, field, position, text, distance, rerank_score); the answer is
    normalised and its confidence blended from quote, distance, value and model.  An error
    gives null, 0 and its text.
    """
    pairs = known.join(F.broadcast(fields.join(catalog, "field")), F.lit(True))
    rule = V.applicable(F.col("field"), F.col("category"), F.col("typeMesure"), F.col("sortieTOR"), F.col("alimentation"))
    gate = F.when(~F.col("ai_fills"), "manual only").when(~rule, "not applicable")
    marked = pairs.withColumn("reason", gate)
    shut = marked.where("reason is not null").select("doc_id", "field", F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("model_confidence"), F.lit(None).cast("string").alias("quote"), "reason")
    asked = marked.where("reason is null").select("doc_id", "field", "context")
    answers = ask(ports.prompts(asked, Q.excerpts(hits), catalog, corrections))
    seen = hits.groupBy("doc_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("chunks"), F.min("distance").alias("distance"), F.max("rerank_score").alias("rerank"))
    rows = answers.join(seen, ["doc_id", "field"], "left").join(F.broadcast(catalog.select("field", F.col("allowed_values").isNotNull().alias("listed"))), "field", "left")
    rows = rows.withColumn("normal", normalize(F.col("field"), F.col("value"), F.col("kind")))
    bare = F.coalesce(F.lower(F.trim("normal")) == "autre", F.lit(False))
    quality = K.value_quality(F.col("normal"), F.when(F.col("kind").isin("number", "boolean"), F.col("kind")).otherwise("string"), F.col("listed"))
    blended = K.blend(quality, K.quote_score(F.col("quote"), F.coalesce("chunks", F.array().cast("array<string>"))), F.col("confidence"), F.col("distance"), F.col("rerank"), F.col("normal").isNotNull(), bare)
    told = rows.select("doc_id", "field", F.col("normal").alias("value"), F.when(F.col("error").isNull(), blended).otherwise(0.0).alias("confidence"), F.col("confidence").alias("model_confidence"), "quote", F.col("error").alias("reason"))
    return shut.unionByName(told)


def extract_with_model(documents: DataFrame, hits: DataFrame, technologies: DataFrame, catalog: DataFrame, ask: Callable[[DataFrame], DataFrame], corrections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, evidence): tags and classifier first, then the fields that decide which
    others apply, then the rest, each only where nothing is known yet."""
    sure = V.resolve(tag_fields(documents).unionByName(classify(documents))).persist()  # read at every step
    parts, proof = sure, sure.select("doc_id", "field", F.concat_ws(": ", "source", "value").alias("text"), "confidence", "source")
    for first in (True, False):
        fields = catalog.where(F.col("field").isin(C.FIRST_FIELDS) == first).select("field")
        answers = ask_fields(contexts(documents, parts), fields, hits, catalog, ask, corrections).join(parts.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
        found = answers.where("value is not null").withColumn("source", F.lit("model")).persist()  # asked once
        parts = parts.unionByName(found.select(*parts.columns))
        proof = proof.unionByName(found.select("doc_id", "field", F.col("quote").alias("text"), "confidence", "source"))
    return V.guard_records(V.wide_records(parts), technologies), proof


def write_results(records: DataFrame, evidence: DataFrame, prefix: str, mode: str = "errorifexists") -> None:
    """Records and evidence, one JSON object a document, under ``prefix``."""
    records.write.mode(mode).json(f"{prefix}_extracted")
    row = F.struct("text", "confidence", "source")
    per = evidence.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    per.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "rows")))).alias("evidence")).write.mode(mode).json(f"{prefix}_evidence")


def label_text(text: Column) -> Column:
    """A label's reading with known misreadings put right."""
    fixed = substitute(text, C.OCR_FIXES)
    return F.regexp_replace(F.regexp_replace(fixed, "VDG", "VDC"), "(?i)psa", "IP66")


def ocr_label(text: Column) -> dict[str, Column]:
    """Fields of a label's text, the first match of each; protection classes are sorted."""
    x = lambda p, g=1: F.nullif(strip(F.regexp_extract(text, "(?iU)" + p, g)), F.lit(""))
    found = {k: x(p) for k, p in C.LABEL_FIELDS.items()}
    calibration = found["factory_calibration"]
    sensor = F.nullif(F.regexp_extract(calibration, "(?iU)" + C.LABEL_SENSOR, 1), F.lit(""))
    classes = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)(IP\d{2})"), 1), F.upper)))
    return found | {
        "brand": F.upper(found["brand"]), "type": F.upper(F.concat_ws(" ", x(C.LABEL_KIND, 1), x(C.LABEL_KIND, 2))), "protocol": F.when(text.rlike("(?i)HART"), "HART"), "factory_calibration": F.coalesce(sensor, calibration),
        "output": F.coalesce(found["output"], x(C.LABEL_OUTPUT)), "wires": F.concat(found["wires"], F.lit("-wire")), "ip_rating": F.nullif(F.array_join(classes, ", "), F.lit("")),
    }


def read_labels(readings: DataFrame) -> DataFrame:
    """(doc_id, field, value) of label readings (doc_id, ord, text): the three best readings
    of each image by keywords and length are put right and parsed, and of each field the
    longest value stays."""
    scored = readings.withColumn("score", S.reading_score(F.col("text"), C.OCR_KEYWORDS))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord"))
    best = scored.withColumn("ord", rank).where("ord <= 3").select("doc_id", "ord", label_text(F.col("text")).alias("text"))
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.nullif(c, F.lit("")).alias("value")) for k, c in ocr_label(F.col("text")).items()])
    return S.longest_values(best.select("doc_id", "ord", F.explode(fields).alias("_f")).select("doc_id", "ord", "_f.*"))


def field_queries(catalog: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(field, query_idx, query): the given queries of each field, else two general ones."""
    general = F.array(F.format_string("Quelle est la valeur pour '%s' ?", "field"), F.format_string("'%s'", "field"))
    rows = catalog.select("field") if known is None else catalog.select("field").join(F.broadcast(known), "field", "left")
    queries = general if known is None else F.coalesce("queries", general)
    return rows.select("field", F.posexplode(queries).alias("query_idx", "query"))


def run_corpus(pages: DataFrame, store, collection: str, embed, technologies: DataFrame) -> DataFrame:
    """Documents that are not indexed yet: cleaned, chunked, embedded and stored, tables (a
    ``tables`` column of cells, if there) as chunks of their own; then the extraction over
    all pages given.  One plan for the whole corpus."""
    fresh = pages.join(store.missing(collection, pages.select("doc_id").distinct()), "doc_id", "left_semi")
    clean = clean_pages(fresh, repeating_edges(fresh))
    found = text_chunks(clean)
    if "tables" in pages.columns:
        cells = fresh.select("doc_id", "page_number", F.posexplode("tables").alias("table_no", "cells"))
        found = found.unionByName(table_chunks(cells), allowMissingColumns=True)
    store.add(collection, found, embed)
    return extract(full_texts(pages).select("doc_id", F.col("full_text").alias("text")), technologies)
