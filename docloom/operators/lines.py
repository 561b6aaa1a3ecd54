"""Pages to lines and back: repeated edges, cleaning, full texts, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_page_number, limit_blank_runs, line_key, strip


def explode_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, line) in the order of the text."""
    return pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def repeating_edges(pages: DataFrame, first_pages: int = 5, edge: int = 2, least: int = 3, shortest: int = 4) -> DataFrame:
    """(doc_id, key, n): keys of the first and last non-blank lines of a document's first
    pages that occur at least ``least`` times.  Lines are taken inside each page's array, so
    only edges are shuffled, and counts combine before that."""
    lines = F.filter(F.split("text", "\n"), lambda x: strip(x) != "")
    edges = F.concat(F.slice(lines, 1, edge), F.slice(lines, F.greatest(F.size(lines) - edge + 1, F.lit(1)), F.lit(edge)))
    keys = pages.where(F.col("page_number") <= first_pages).select("doc_id", F.explode(F.transform(edges, line_key)).alias("key"))
    return keys.where(F.length("key") >= shortest).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def clean_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages without page-number lines, repeated edges and long blank runs.

    A document's keys are few (at most 4 a page of 5), so they are gathered per document
    and joined once; lines never leave their page's row.
    """
    keys = edges.groupBy("doc_id").agg(F.collect_set("key").alias("_keys"))
    joined = pages.join(keys, "doc_id", "left")
    keep = lambda x: ~is_page_number(x) & ~F.coalesce(F.array_contains(F.col("_keys"), line_key(x)), F.lit(False))
    text = limit_blank_runs(F.array_join(F.filter(F.split("text", "\n"), keep), "\n"))
    return joined.withColumn("text", text).drop("_keys")


def full_texts(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, full_text, n_pages): pages joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    parts = F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit("")))
    return pages.groupBy("doc_id").agg(F.array_join(parts, separator).alias("full_text"), F.count("*").alias("n_pages"))


def layout_metrics(blocks: DataFrame, pages: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, image_count, drawing_count, text_area_ratio, max_image_area_ratio,
    max_drawing_area_ratio) of blocks (doc_id, page_number, x0, y0, x1, y1, text, block_type)
    and drawings (doc_id, page_number, x0, y0, x1, y1); zeros for pages without area."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    key = ["doc_id", "page_number"]
    kinds = blocks.select(*key, area.alias("area"), "block_type")
    if drawings is not None:
        kinds = kinds.unionByName(drawings.select(*key, area.alias("area"), F.lit(-1).alias("block_type")))
    of = lambda k: F.when(F.col("block_type") == k, F.col("area"))
    sums = kinds.groupBy(*key).agg(
        F.sum(of(0)).alias("_text"), F.count_if(F.col("block_type") == 1).alias("_images"), F.max(of(1)).alias("_image"), F.count_if(F.col("block_type") == -1).alias("_drawings"), F.max(of(-1)).alias("_drawing")
    )
    page = F.col("width") * F.col("height")
    ratio = lambda x: F.coalesce(F.when(page > 0, F.col(x) / page), F.lit(0.0))
    number = lambda x: F.coalesce(F.when(page > 0, F.col(x)), F.lit(0))
    return pages.join(sums, key, "left").select(
        *key, number("_images").alias("image_count"), number("_drawings").alias("drawing_count"), ratio("_text").alias("text_area_ratio"), ratio("_image").alias("max_image_area_ratio"), ratio("_drawing").alias("max_drawing_area_ratio")
    )


def group_rows(blocks: DataFrame, tolerance: float = 5.0, least: int = 2) -> DataFrame:
    """(doc_id, page_number, row_no, row_text): blocks in reading order, a new row where the
    step down from the block before is ``tolerance`` or more; rows of one cell go, and so do
    pages that have less than ``least`` others."""
    page = Window.partitionBy("doc_id", "page_number")
    order = page.orderBy("y0", "x0")
    jump = F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(order)) >= tolerance).cast("int"), F.lit(0))
    rows = blocks.withColumn("_jump", jump).withColumn("row_no", F.sum("_jump").over(order))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda c: strip(c["text"]))
    grouped = rows.groupBy("doc_id", "page_number", "row_no").agg(F.array_join(cells, " | ").alias("row_text"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return grouped.withColumn("_rows", F.count("*").over(page)).where(F.col("_rows") >= least).drop("_rows")
