"""Titles from the text spans of a PDF's first page.

A page holds a few hundred spans, so a page's spans may be gathered into one row; everything after that is expressions over
arrays. Where a rule refers to what was built before (a line is compared with where it began, not with the line before),
it is an ``aggregate`` over the sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import title as T

# --- fixed values -----------------------------------------------------------------------------------------------
TOP_OF_PAGE = 0.55
SAME_SIZE = 0.5
SAME_LINE = 5
NEW_BLOCK = 30
LEAST_TITLE = 20
ADDRESS_WORDS = ["department", "university", "school of", "hospital", "institute", "corresponding author"]
# ----------------------------------------------------------------------------------------------------------------


def _lines(spans: Column) -> Column:
    """Sorted (y, text) put together to lines: a span belongs to a line if it is not lower than where that one began."""
    empty = F.array().cast("array<struct<y:double,text:string>>")

    def add(lines: Column, s: Column) -> Column:
        y = F.rint(s["y"] / 2) * 2
        last = F.try_element_at(lines, F.lit(-1))
        longer = F.struct(last["y"].alias("y"), F.concat(last["text"], F.lit(" "), s["text"]).alias("text"))
        new = F.struct(y.alias("y"), s["text"].alias("text"))
        joins = last.isNotNull() & (F.abs(y - last["y"]) <= SAME_LINE)
        return F.when(joins, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(longer))).otherwise(F.concat(lines, F.array(new)))

    return F.aggregate(spans, empty, add)


def _blocks(lines: Column) -> Column:
    """Lines put together to blocks: a gap of ``NEW_BLOCK`` begins a new one. Each block is its lines' texts."""
    empty = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<array<string>>").alias("blocks"))

    def add(acc: Column, line: Column) -> Column:
        text = F.array(F.trim(line["text"]))
        same = acc["y"].isNotNull() & (line["y"] - acc["y"] < NEW_BLOCK)
        n = F.size(acc["blocks"])
        grown = F.concat(F.slice(acc["blocks"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc["blocks"], F.lit(-1)), text)))
        return F.struct(line["y"].alias("y"), F.when(same, grown).otherwise(F.concat(acc["blocks"], F.array(text))).alias("blocks"))

    return F.aggregate(lines, empty, add)["blocks"]


def flat_title(spans: Column) -> Column:
    """Title of a page with one size of letters: the longest block that names no status, DOI, degree or address; the first
    one of equals, null if there is none."""
    def good(block: Column) -> Column:
        all_text = F.lower(F.array_join(block, " "))
        bad = all_text.rlike(T.DOI_IN_TITLE) | all_text.rlike(T.AUTHOR_WITH_DEGREE)
        for word in [*T.STATUS_MARKERS, *ADDRESS_WORDS]:
            bad = bad | F.contains(all_text, F.lit(word))
        return ~bad & (F.length(all_text) >= LEAST_TITLE)

    blocks = F.filter(_blocks(_lines(spans)), good)
    size = lambda b: F.aggregate(b, F.lit(0), lambda n, t: n + F.length(t))
    sizes = F.transform(blocks, size)
    return F.array_join(F.get(blocks, (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int")), " ")


def first_page_titles(spans: DataFrame) -> DataFrame:
    """(pdf_id, title) from ``spans(pdf_id, size, text, x, y, page_h)`` of first pages.

    Of the sizes of letters, from large to small, the first whose spans in the upper part of the page, each text once, make
    a title that is long enough and no junk. With one size only, blocks are told by the gaps between lines first.
    """
    clean = spans.withColumn("text", F.trim("text")).filter(F.length("text") > 1)
    sizes = clean.select("pdf_id", "size").distinct()
    counts = sizes.groupBy("pdf_id").agg(F.count("*").alias("n_sizes"))
    upper = clean.filter(F.col("y") < F.col("page_h") * TOP_OF_PAGE).select("pdf_id", F.col("size").alias("own"), "y", "x", "text")
    near = sizes.join(upper, "pdf_id").filter(F.abs(F.col("own") - F.col("size")) < SAME_SIZE)
    rows = near.groupBy("pdf_id", "size").agg(F.array_sort(F.collect_list(F.struct("y", "x", "text"))).alias("s")).join(counts, "pdf_id")
    once = F.filter("s", lambda r, i: F.array_position(F.transform(F.col("s"), lambda q: F.lower(q["text"])), F.lower(r["text"])) == i + 1)
    joined = F.array_join(F.transform(once, lambda r: r["text"]), " ")
    by_size = F.when((F.length(joined) > LEAST_TITLE) & ~T.is_junk(joined), joined)
    flat = F.when(F.col("n_sizes") == 1, flat_title(F.transform("s", lambda r: F.struct(r["y"].alias("y"), r["text"].alias("text")))))
    found = rows.select("pdf_id", "size", F.coalesce(F.nullif(flat, F.lit("")), by_size).alias("title")).filter("title IS NOT NULL")
    return found.groupBy("pdf_id").agg(F.max_by("title", "size").alias("title"))
