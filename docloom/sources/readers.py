"""Sources: binary documents through pluggable parsers, HTML pages, JSON logs, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

PAGE_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("has_images", T.BooleanType()), T.StructField("image_count", T.IntegerType()), T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))), T.StructField("error", T.StringType())]
)
CORRECTION_SCHEMA = "pdf_id string, field_name string, ai_value string, user_value string, category string, type_mesure string, ts timestamp, accepted boolean, rule string"

#: A parser gives (text, image_count, tables) for each page of a document's bytes; tables may
#: also be a function that gives them, which may fail without loss of the page.
Parser = Callable[[bytes], Iterator[tuple[str, int, list | Callable[[], list]]]]


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf", streaming: bool = False) -> DataFrame:
    """Binary files (path, modificationTime, length, content); only names that fit the pattern."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def parse_pages(files: DataFrame, parser: Parser) -> DataFrame:
    """One row per page; where a document fails, the pages before stay and one row has the
    error and no text.  Tables that fail are an empty list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                i = 0
                try:
                    for text, images, tables in parser(content):
                        i += 1
                        rows.append((path, i, text, images > 0, images, _tables(tables), None))
                except Exception as e:  # a broken file must not stop the corpus
                    rows.append((path, i + 1 if i else None, None, False, 0, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=PAGE_SCHEMA.names)

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def _tables(tables: list | Callable[[], list]) -> list:
    try:
        return tables() if callable(tables) else tables
    except Exception:
        return []


def plain_text_parser(content: bytes) -> Iterator[tuple[str, int, list]]:
    """A stand-in parser: UTF-8 text with form feeds between pages.  Not a PDF parser."""
    for page in content.decode("utf-8").split("\f"):
        yield page, 0, []


def page_counts(pages: DataFrame) -> DataFrame:
    """(path, n_pages) of parsed pages; a document that could not be opened has none."""
    return pages.groupBy("path").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n_pages"))


# --- HTML --------------------------------------------------------------------------

_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_entities(c: Column) -> Column:
    for code, char in _ENTITIES:
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def html_text(html: Column) -> Column:
    """Text of a page: no comments, scripts or styles, block ends as line ends, tags gone,
    entities decoded, runs of space collapsed."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    t = F.regexp_replace(t, r"(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|title|article|ul)>", "\n")
    t = decode_entities(F.regexp_replace(t, r"<[^>]*>", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def html_title(html: Column) -> Column:
    return decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, text, n_links) of raw pages."""
    links = F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href="))
    return pages.select("page_id", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"), F.coalesce(links, F.lit(0)).alias("n_links"))


# --- JSON --------------------------------------------------------------------------


def json_log(spark: SparkSession, path: str, schema: str = CORRECTION_SCHEMA) -> DataFrame:
    """A JSON list or lines; broken records and a missing path give no rows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(conf).globStatus(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Appends, never rewriting what is there."""
    df.write.mode("append").json(path)


def schema_fields(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Top-level keys of JSON objects, one row each."""
    return df.select(F.explode(F.json_object_keys(json_col)).alias("field"))


def newest_files(spark: SparkSession, path: str, n: int = 2) -> DataFrame:
    """The newest files by modification time."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return files.orderBy(F.desc("modificationTime"), "path").limit(n)


def field_meta(spark: SparkSession, path: str, n: int = 2) -> DataFrame:
    """(path, doc_id, field, rows) of the newest evidence files."""
    newest = [r.path for r in newest_files(spark, path, n).collect()]  # ``n`` names
    if not newest:
        return spark.createDataFrame([], "path string, doc_id string, field string, rows string")
    rows = spark.read.schema("doc_id string, evidence map<string, string>").json(newest)
    return rows.select(F.col("_metadata.file_path").alias("path"), "doc_id", F.explode("evidence").alias("field", "rows"))


def wipe(spark: SparkSession, *paths: str) -> None:
    """Deletes stores, logs and outputs; what is not there is no error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


# --- chunk store -------------------------------------------------------------------


class Store:
    """Collections of chunk vectors as Parquet folders partitioned by collection."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, collection: str) -> str:
        return f"{self.root}/collection={collection}"

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(conf), path

    def collections(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(s.getPath().getName().removeprefix("collection=") for s in fs.listStatus(path(self.root)) if s.getPath().getName().startswith("collection="))

    def add(self, collection: str, chunks: DataFrame, embed: Callable[[Column], Column] | None = None, shortest: int = 0) -> None:
        """Appends chunks; null metadata entries are dropped, short texts are not indexed."""
        rows = chunks.where(F.length(strip(F.col("text"))) > shortest)
        if embed is not None:
            rows = rows.withColumn("embedding", embed(F.col("text")))
        if "meta" in rows.columns:
            rows = rows.withColumn("meta", F.map_filter("meta", lambda k, v: v.isNotNull()))
        rows.write.mode("append").parquet(self._path(collection))

    def read(self, collection: str) -> DataFrame:
        return self.spark.read.parquet(self._path(collection))

    def replace(self, collection: str, chunks: DataFrame, embed: Callable[[Column], Column] | None = None, shortest: int = 0) -> None:
        """A collection with these chunks alone."""
        self.clear(collection)
        self.add(collection, chunks, embed, shortest)

    def clear(self, collection: str) -> None:
        """Delete best effort: a missing collection is no error."""
        fs, path = self._fs()
        fs.delete(path(self._path(collection)), True)

    def missing(self, collection: str, documents: DataFrame) -> DataFrame:
        """Documents that are not indexed yet."""
        if collection not in self.collections():
            return documents
        return documents.join(self.read(collection).select("doc_id").distinct(), "doc_id", "left_anti")
