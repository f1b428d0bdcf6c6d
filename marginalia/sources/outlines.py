"""Outlines, sections and figures of documents that were extracted before: bookmarks, TeX texts, boxes on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The leading number of a bookmark's title, a numbered heading of a page, and TeX sections with a label.
NUMBERED_TITLE, PAGE_HEADING = r"^([0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)*)\.?\s+(\S.*)$", r"^([0-9]+(?:\.[0-9]+)*)\s+([A-Z][^\n]{2,80})$"
LABELLED_SECTION = r"\\(section|subsection)\{([^}]+)\}\s*\\label\{([^}]+)\}"
# A caption of a figure, the size of text where none is measured, and bounds in points of what counts as a figure.
FIGURE_CAPTION, DEFAULT_SIZE = r"(?s)^(Figure|Fig\.)\s+([0-9]+(?:\.[0-9]+)*)\s*(?::|\.\s)\s*(.*)", 11.0

_MARK = "\u0003"


def bookmark_units(bookmarks: DataFrame) -> DataFrame:
    """``doc_id, ord, level, number, title, page`` of bookmarks (doc_id, ord, level, title, page); a leading number is split off."""
    title = F.trim("title")
    numbered = title.rlike(NUMBERED_TITLE)
    return bookmarks.select("doc_id", "ord", "level", F.when(numbered, F.regexp_extract(title, NUMBERED_TITLE, 1)).alias("number"), F.when(numbered, F.regexp_extract(title, NUMBERED_TITLE, 2)).otherwise(title).alias("title"), "page")


def heading_units(lines: DataFrame) -> DataFrame:
    """``doc_id, ord, level, title, page``: the same for documents without bookmarks, from numbered headings outside of tables of contents."""
    text = F.trim("text")
    found = lines.where(text.rlike(PAGE_HEADING) & ~F.col("text").rlike(r"\.{3,}"))
    return found.select("doc_id", "ord", F.size(F.split(F.regexp_extract(text, PAGE_HEADING, 1), r"\.")).alias("level"), F.concat_ws(" ", F.regexp_extract(text, PAGE_HEADING, 1), F.trim(F.regexp_extract(text, PAGE_HEADING, 2))).alias("title"), "page")


def outline(bookmarks: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id, ord, level, title, page``: bookmarks where a document has any, headings where not."""
    own = bookmarks.where("page > 0").select("doc_id", "ord", "level", F.trim("title").alias("title"), "page")
    return own.unionByName(heading_units(lines).join(own.select("doc_id").distinct(), "doc_id", "left_anti"))


def labelled_sections(texts: DataFrame) -> DataFrame:
    """``doc_id, location, kind, name, label, text`` of TeX texts (doc_id, text): where sections start, and what stands up to the next one.

    Matches are parted from what stands between them, and lengths summed up in order.
    """
    parted = F.split(F.regexp_replace("text", LABELLED_SECTION, f"{_MARK}$0{_MARK}"), _MARK)
    rows = texts.select("doc_id", F.posexplode(parted).alias("i", "part"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("location", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))).withColumn("after", F.lead("part", 1, "").over(Window.partitionBy("doc_id").orderBy("i")))
    found = rows.where("i % 2 = 1")
    piece = lambda k: F.regexp_extract("part", LABELLED_SECTION, k)
    return found.select("doc_id", F.col("location").cast("int").alias("location"), piece(1).alias("kind"), piece(2).alias("name"), piece(3).alias("label"), F.concat("part", "after").alias("text"))


def text_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, ix, page, text, is_caption, is_reference``: blocks (doc_id, ord, page, text) that aren't blank, numbered from 0."""
    rows = blocks.withColumn("text", F.trim("text")).where("text <> ''")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return rows.select("doc_id", place.alias("ix"), "page", "text", F.col("text").rlike(r"(?i)^(Figure|Fig\.|Table|Algorithm|Listing)\s+[0-9]").alias("is_caption"), F.col("text").rlike(r"^\[\s*[0-9]+\s*\]").alias("is_reference"))


def body_size(spans: DataFrame, pages: int = 30, least: int = 20) -> DataFrame:
    """``doc_id, size``: the upper median of the sizes of longer spans (doc_id, page, text, size) on the first pages."""
    kept = spans.withColumn("long", (F.length(F.trim("text")) > least) & (F.col("page") <= pages))
    counts = kept.groupBy("doc_id", F.when(F.col("long"), F.round("size", 1)).alias("s")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id")
    some = counts.where("s is not null").withColumn("upto", F.sum("n").over(w.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    found = some.where("upto > all div 2").groupBy("doc_id").agg(F.min("s").alias("size"))
    return spans.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("size", F.lit(DEFAULT_SIZE)).alias("size"))


def figure_regions(blocks: DataFrame, images: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page, figure, x0, y0, x1, y1, dpi``: where the figures above captions are, and the least resolution of their rasters.

    ``blocks``: doc_id, page, text and a box; ``images``: a box and pixels (px); ``drawings``: a box; ``pages``: width, height. A figure reaches up to
    the last long text above its caption. Without images or drawings there it is the space between.
    """
    where = ["doc_id", "page"]
    caption = F.trim("text").rlike(FIGURE_CAPTION)
    heads = blocks.where(caption).select(*where, F.regexp_extract(F.trim("text"), FIGURE_CAPTION, 2).alias("figure"), F.col("y0").alias("c0"))
    texts = blocks.where(~caption & (F.length(F.trim("text")) > 60)).select(*where, F.col("y1").alias("t1"))
    keys = [*where, "figure", "c0"]
    tops = heads.join(texts, where, "left").groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("t1") <= F.col("c0") - 4, F.col("t1"))), F.lit(0.0)).alias("top"))
    above = F.col("y1") <= F.col("c0") + 8
    rasters = tops.join(images, where).where(above & (F.col("y0") >= F.col("top") - 30) & (F.col("y1") > F.col("top")) & (F.col("y0") < F.col("c0")))
    rasters = rasters.select(*keys, "x0", "y0", "x1", "y1", F.when(F.col("x1") - F.col("x0") > 8, F.col("px") / ((F.col("x1") - F.col("x0")) / 72.0)).alias("dpi"))
    lines = tops.join(drawings, where).where(above & (F.col("y0") >= F.col("top") - 10) & (F.col("x1") - F.col("x0") > 20) & (F.col("y1") - F.col("y0") > 20))
    boxes = rasters.unionByName(lines.select(*keys, "x0", "y0", "x1", "y1", F.lit(None).cast("double").alias("dpi")))
    region = boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("dpi").alias("dpi"))
    rows = tops.join(region, keys, "left").join(pages.select(*where, "width", "height"), where)
    small = F.col("x0").isNull() | (F.col("x1") - F.col("x0") < 40) | (F.col("y1") - F.col("y0") < 30)
    space = {"x0": F.lit(36.0), "y0": F.greatest("top", F.lit(36.0)), "x1": F.col("width") - 36, "y1": F.col("c0") - 2}
    rows = rows.select(*where, "figure", "dpi", "width", "height", *[F.when(small, v).otherwise(F.col(c)).alias(c) for c, v in space.items()]).where("y1 - y0 >= 30")
    inside = {"x0": F.greatest("x0", F.lit(0.0)), "y0": F.greatest("y0", F.lit(0.0)), "x1": F.least("x1", "width"), "y1": F.least("y1", "height")}
    return rows.select(*where, "figure", *[v.alias(c) for c, v in inside.items()], "dpi")
