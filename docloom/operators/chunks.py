"""Texts to retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TABLE_MARK, char_windows, merge_units, sentence_units, strip, table_markdown

TARGET = 2000
OVERLAP = 80


def page_units(pages: DataFrame, small: int = 40) -> DataFrame:
    """(doc_id, page_number, unit_no, unit): sentences, tiny ones merged with the next."""
    units = merge_units(sentence_units(F.col("text")), small)
    return pages.select("doc_id", "page_number", F.posexplode(units).alias("unit_no", "unit"))


def window_chunks(units: DataFrame, target: int = TARGET, overlap: int = OVERLAP, keys: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Chunks of ordered units: the longest prefix within ``target`` characters, then for each
    later unit the frame of it and the ``overlap`` units before it.

    (keys, chunk_index, first_unit, last_unit, text).  A frame is at most ``overlap`` + 1 units.
    """
    order = Window.partitionBy(*keys).orderBy("unit_no")
    size = F.sum(F.length("unit")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(order) - 1
    marked = units.withColumn("_at", F.row_number().over(order) - 1).withColumn("_fits", size <= target)
    frame = marked.withColumn("_text", F.array_join(F.collect_list("unit").over(order.rowsBetween(-overlap, 0)), "\n"))
    before = F.lead("_fits").over(order)
    # The prefix ends at the last unit that fits (or the first unit, however long).
    closes = ((F.col("_fits") | (F.col("_at") == 0)) & (F.coalesce(before, F.lit(False)) == F.lit(False))) | (~F.col("_fits") & (F.col("_at") > 0))
    ends = frame.withColumn("_close", closes).where("_close")
    whole = Window.partitionBy(*keys).orderBy("unit_no")
    first = F.greatest(F.lit(0), F.col("_at") - overlap)
    return ends.select(*keys, (F.row_number().over(whole) - 1).alias("chunk_index"), first.alias("first_unit"), F.col("_at").alias("last_unit"), F.col("_text").alias("text"))


def segmented_chunks(units: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """``window_chunks`` with oversized table units standing alone: each ends a segment."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("unit_no")
    big = F.contains("unit", F.lit(TABLE_MARK)) & (F.length("unit") > target)
    marked = units.withColumn("_big", big).withColumn("_seg", F.sum(big.cast("int")).over(order) * 2 - big.cast("int"))
    small = window_chunks(marked.where("not _big"), target, overlap, ("doc_id", "page_number", "_seg"))
    alone = marked.where("_big").select("doc_id", "page_number", "_seg", F.lit(0).alias("chunk_index"), F.lit(0).alias("first_unit"), F.lit(0).alias("last_unit"), F.col("unit").alias("text"))
    whole = Window.partitionBy("doc_id", "page_number").orderBy("_seg", "chunk_index")
    return small.unionByName(alone).withColumn("chunk_index", F.row_number().over(whole) - 1).drop("_seg")


def chunk_id(doc: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s_p%d_c%d", doc.cast("string"), page.cast("int"), index.cast("int"))


def text_chunks(pages: DataFrame) -> DataFrame:
    """Chunk rows of pages with text; oversized table blocks in it stand alone."""
    found = segmented_chunks(page_units(pages.where(strip(F.col("text")) != "")))
    return found.select("doc_id", chunk_id(F.col("doc_id"), F.col("page_number"), F.col("chunk_index")).alias("chunk_id"), "text", "page_number", "chunk_index", F.lit("text").alias("chunk_type"))


def with_tables(pages: DataFrame) -> DataFrame:
    """Pages whose ``tables`` (texts) follow their text as one block."""
    block = F.concat(F.lit(f"\n\n{TABLE_MARK}\n"), F.array_join("tables", "\n"))
    return pages.withColumn("text", F.when(F.size("tables") > 0, F.concat(F.coalesce("text", F.lit("")), block)).otherwise(F.col("text")))


def table_chunks(tables: DataFrame) -> DataFrame:
    """Of (doc_id, page_number, table_no, cells): a summary chunk and one for each non-blank
    row; row indexes count blank ones."""
    parsed = tables.withColumn("_t", table_markdown(F.col("cells"))).where("_t is not null")
    base = F.format_string("%s_p%d_t%d", F.col("doc_id").cast("string"), F.col("page_number").cast("int"), F.col("table_no").cast("int"))
    summary = parsed.select("doc_id", F.concat(base, F.lit("_summary")).alias("chunk_id"), F.col("_t.markdown").alias("text"), "page_number", F.lit(None).cast("int").alias("row_index"), F.lit("table").alias("chunk_type"))
    rows = parsed.select("doc_id", base.alias("_b"), "page_number", F.posexplode("_t.row_texts").alias("row_index", "text")).where(strip(F.col("text")) != "")
    each = rows.select("doc_id", F.concat("_b", F.lit("_r"), F.col("row_index").cast("string")).alias("chunk_id"), "text", "page_number", "row_index", F.lit("table").alias("chunk_type"))
    return summary.unionByName(each)


def split_long(df: DataFrame, size: int = 6000, overlap: int = 200) -> DataFrame:
    """(doc_id, part_no, part): overlapping character windows of ``text``."""
    return df.select("doc_id", F.posexplode(char_windows(F.col("text"), size, overlap)).alias("part_no", "part"))
