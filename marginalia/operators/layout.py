"""Operators over positional lines: ``doc_id, ord, page, y, bottom, x0, text, bold``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.relations import parents

# A gap in points that parts paragraphs, the share of the width right of which a tag is an equation's.
GAP, TAG_SHARE = 14.0, 0.55
CAPTION_HEAD, HEADING, EQUATION_TAG = r"^(Figure|Fig\.|Table|Algorithm|Listing)\s+([0-9]+(?:\.[0-9]+)*)\s*[:.]", r"^[0-9]+(?:\.[0-9]+)*\s+[A-Z]", r"^\(([0-9]+(?:\.[0-9]+)*)\)$"


def page_range(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of an inclusive range of pages, given either way round."""
    return rows.where(F.col("page").between(min(first, last), max(first, last)))


def gap_paragraphs(lines: DataFrame, gap: float = GAP) -> DataFrame:
    """``doc_id, page, para, text``: lines of a page until the next one begins more than ``gap`` below."""
    w = Window.partitionBy("doc_id", "page").orderBy("y", "ord")
    starts = lines.withColumn("start", F.when(F.col("y") - F.lag("bottom").over(w) > gap, 1).otherwise(0))
    runs = starts.withColumn("para", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("y", "ord", "text"))), lambda x: x["text"])
    return runs.groupBy("doc_id", "page", "para").agg(F.array_join(parts, " ").alias("text"))


def line_kind(width: Column) -> Column:
    """What a line is: a caption, an equation's tag, a heading (numbered and bold), or text; the first that holds."""
    text = F.trim("text")
    return F.when(text.rlike(CAPTION_HEAD), "caption").when(text.rlike(EQUATION_TAG) & (F.col("x0") > TAG_SHARE * width), "equation").when(text.rlike(HEADING) & F.col("bold"), "heading").otherwise("text")


def lines_of_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, ord, page, x0, x1, text, bold, kind, num, height`` of lines given as spans (doc_id, ord, page, i, text, x0, x1, bold).

    A line is bold if one of its spans is. It is the caption of a float, else that of an equation if the right-most span that is a number in
    brackets ends right of TAG_SHARE of the page's width, else a heading if bold and numbered. ``pages``: doc_id, page, width, height, of which
    the median counts.
    """
    tag = F.regexp_extract(F.trim("text"), EQUATION_TAG, 1)
    wide = spans.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"])
    tagged = F.when((tag != "") & (F.col("x1") > TAG_SHARE * F.col("width")), tag)
    whole = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), ""))
    rows = wide.groupBy("doc_id", "ord", "page").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), whole.alias("text"), F.max("bold").alias("bold"), F.max_by(tagged, F.when(tagged.isNotNull(), F.col("x1"))).alias("tag")).where("text <> ''")
    floats = {"figure": "figure", "fig.": "figure", "table": "table", "algorithm": "algorithm", "listing": "listing"}
    kinds = F.create_map(*[F.lit(x) for kv in floats.items() for x in kv])
    caption = F.col("text").rlike(CAPTION_HEAD)
    heading = F.col("bold") & (F.length("text") <= 120) & F.col("text").rlike(HEADING)
    kind = F.when(caption, kinds[F.lower(F.regexp_extract("text", CAPTION_HEAD, 1))]).when(F.col("tag").isNotNull(), "equation").when(heading, "section").otherwise("")
    num = F.when(caption, F.regexp_extract("text", CAPTION_HEAD, 2)).when(F.col("tag").isNotNull(), F.col("tag")).when(heading, F.regexp_extract("text", r"^([0-9]+(?:\.[0-9]+)*)", 1)).otherwise("")
    high = pages.groupBy("doc_id").agg(F.median("height").alias("height"))
    return rows.withColumn("kind", kind).withColumn("num", num).drop("tag").join(high, "doc_id")


def page_marked_text(lines: DataFrame, most: int) -> DataFrame:
    """``doc_id, text``: lines with a marker wherever the page changes, the first ``most`` characters."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    turn = F.lag("page").over(w).eqNullSafe(F.col("page"))
    marked = lines.withColumn("line", F.when(turn, F.col("text")).otherwise(F.concat(F.lit("[p. "), F.col("page").cast("string"), F.lit("] "), F.col("text"))))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return marked.groupBy("doc_id").agg(F.left(F.array_join(parts, "\n"), F.lit(most)).alias("text"))


def first_spellings(rows: DataFrame, term: str, *keys: str, order: str = "ord") -> DataFrame:
    """One row for each term of a key, whatever its case; the first as it was written."""
    w = Window.partitionBy(*keys, F.lower(F.trim(term))).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def natural_order(number: Column) -> Column:
    """A key that sorts A.2 before A.10: prefix, whole part, rest."""
    part = lambda i: F.coalesce(F.regexp_extract(number, r"^([A-Z]*)\.?([0-9]+)(?:\.([0-9]+))?", i).try_cast("int"), F.lit(0))
    return F.struct(F.regexp_extract(number, r"^([A-Z]*)", 1).alias("a"), part(2).alias("b"), part(3).alias("c"))


def children(units: DataFrame) -> DataFrame:
    """``doc_id, ord, title, children``: direct children of each unit, in order, for units that have any."""
    own = parents(units).where("parent is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"])
    found = own.groupBy("doc_id", F.col("parent.ord").alias("at"), F.col("parent.title").alias("name")).agg(listed.alias("children"))
    return found.select("doc_id", F.col("at").alias("ord"), F.col("name").alias("title"), "children")


def bare_equations(lines: DataFrame, defs: DataFrame) -> DataFrame:
    """``doc_id, ord, num``: numbers in brackets that an equation has, unless the line names the equation by word."""
    bare = lines.select("doc_id", "ord", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\(([0-9]{1,3})\)"), 1))).alias("num"))
    named = lines.select("doc_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:Equations?|Eqs?\.)\s*\(?([0-9]+)\)?"), 1)).alias("num"))
    known = defs.where("kind = 'equation'").select("doc_id", "num").distinct()
    return bare.join(known, ["doc_id", "num"], "left_semi").join(named, ["doc_id", "ord", "num"], "left_anti").select("doc_id", "ord", "num")
