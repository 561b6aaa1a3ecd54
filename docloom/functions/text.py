"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def line_key(line: Column) -> Column:
    """Stripped, lower case, single spaces, each digit run ``#``."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(line)), r"\s+", " "), r"\d+", "#")


def is_page_number(line: Column) -> Column:
    """A line that holds nothing but a page number."""
    return strip(line).rlike(r"^(?i:page|p\.|seite)\s*\d+$")


def limit_blank_runs(text: Column, most: int = 2) -> Column:
    """Lines stripped, at most ``most`` blank ones in a row, the whole stripped."""
    lines = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    return strip(F.regexp_replace(lines, r"\n{%d,}" % (most + 2), "\n" * (most + 1)))


def ocr_text(text: Column) -> Column:
    """Unix line ends, no zero-width characters, single spaces, at most one blank line in a row, stripped."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, "[​‌‍﻿]", "")
    t = F.array_join(F.transform(F.split(F.regexp_replace(t, r"[ \t]+", " "), "\n"), lambda x: F.trim(x)), "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def preview(text: Column, size: int = 220) -> Column:
    """First characters on one line."""
    return F.left(F.translate(text, "\n", " "), F.lit(size))


def first_words(text: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(F.split(strip(text), r"\s+"), 1, n), " ")


def substitute(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered, case-insensitive dictionary substitution of literal strings."""
    for old, new in pairs:
        text = F.regexp_replace(text, r"(?iu)\Q" + old + r"\E", new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def char_windows(text: Column, size: int = 6000, overlap: int = 200) -> Column:
    """Overlapping windows; the last ends with the text, which has one if it is short."""
    n, step = F.length(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(n <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


TABLE_MARK = "[TABLE DATA]"


def sentence_units(text: Column, smallest: int = 1) -> Column:
    """Paragraphs (at blank lines), then sentences before a capital, accented capital or
    digit.  A table block is set off from the text before it, and its paragraph stays whole."""
    before = strip(F.substring_index(text, TABLE_MARK, 1))
    block = strip(F.substring(text, F.instr(text, TABLE_MARK) + len(TABLE_MARK), F.length(text)))
    text = F.when(F.contains(text, F.lit(TABLE_MARK)) & (before != ""), F.concat(before, F.lit(f"\n\n{TABLE_MARK}\n"), block)).otherwise(text)
    sentences = lambda p: F.when(F.contains(p, F.lit(TABLE_MARK)), F.array(p)).otherwise(F.split(p, r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ0-9])"))
    units = F.flatten(F.transform(F.split(text, r"\n\s*\n"), lambda p: sentences(strip(p))))
    return F.filter(F.transform(units, strip), lambda s: F.length(s) >= smallest)


def merge_units(units: Column, small: int = 40, block: int = 64) -> Column:
    """A unit joins the one before it with a space while that is shorter than ``small`` and no
    table.  The fold fills lists of ``block`` units, so that a step copies no long list."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("own"))

    def step(seen: Column, unit: Column) -> Column:
        done, own = seen["done"], seen["own"]
        last = F.try_element_at(own, F.lit(-1))
        joins = (F.size(own) > 0) & (F.length(last) < small) & ~F.contains(last, F.lit(TABLE_MARK))
        full = F.size(own) >= block
        joined = F.concat(F.slice(own, 1, F.size(own) - 1), F.array(strip(F.concat_ws(" ", last, unit))))
        return F.struct(
            F.when(full & ~joins, F.concat(done, F.array(own))).otherwise(done).alias("done"), F.when(joins, joined).when(full, F.array(unit)).otherwise(F.concat(own, F.array(unit))).alias("own")
        )

    return F.aggregate(units, start, step, lambda seen: F.concat(F.flatten(seen["done"]), seen["own"]))


def table_markdown(cells: Column) -> Column:
    """STRUCT(markdown, row_texts) of ARRAY<ARRAY<STRING>>: blank rows go, the first row is
    the header, others are padded or cut to its width, ``|`` is escaped."""
    clean = F.transform(cells, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    rows = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    header = F.try_element_at(rows, F.lit(1))
    width = F.size(header)
    fit = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    markdown = F.array_join(F.concat(F.array(line(header), rule), F.transform(fit, line)), "\n")
    pairs = lambda r: F.filter(F.zip_with(header, r, lambda h, v: F.when((h != "") | (v != ""), F.concat(h, F.lit(" = "), v))), lambda x: x.isNotNull())
    texts = F.transform(fit, lambda r: F.concat(F.lit("TABLE ROW: "), F.array_join(pairs(r), " | ")))
    return F.when(F.size(rows) > 0, F.struct(markdown.alias("markdown"), texts.alias("row_texts")))
