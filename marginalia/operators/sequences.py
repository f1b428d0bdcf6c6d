"""Order-dependent operators over rows (doc_id, ord, ...): every window is within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import is_toc_line

# Headings of reference lists, bare, and with the first entry on the same line; caption starts.
REFERENCES, REFERENCES_OR_FIRST = r"(?i)^(References|Bibliography)\s*$", r"(?i)^(References|Bibliography)\s*(\[1\]|$)"
CAPTION = r"^(Figure|Fig\.|Table|Tab\.|Algorithm|Listing)\s+([0-9]+(?:\.[0-9]+)*)\s*[:.]\s*(.*)"


def so_far(doc: str = "doc_id", order: str = "ord") -> Window:
    return Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def sticky(flag: Column, doc: str = "doc_id", order: str = "ord") -> Column:
    """Whether the flag has held for this or an earlier row of the document."""
    return F.coalesce(F.max(flag).over(so_far(doc, order)), F.lit(False))


def last_state(state: Column, doc: str = "doc_id", order: str = "ord") -> Column:
    """The last state that isn't null so far."""
    return F.last(state, ignorenulls=True).over(so_far(doc, order))


def body_lines(lines: DataFrame, heading: str = REFERENCES) -> DataFrame:
    """Lines outside of tables of contents and before the reference list."""
    kept = lines.where(~is_toc_line(F.col("text")))
    return kept.withColumn("in_refs", sticky(F.trim("text").rlike(heading))).where("not in_refs").drop("in_refs")


def paragraphs(lines: DataFrame) -> DataFrame:
    """``doc_id, para, first_ord, text``: runs of lines that aren't blank, joined by spaces."""
    blank = F.trim("text") == ""
    marked = lines.withColumn("para", F.sum(F.when(blank, 1).otherwise(0)).over(so_far())).where(~blank)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("text")))), lambda x: x["text"])
    found = marked.groupBy("doc_id", "para").agg(F.min("ord").alias("first_ord"), F.array_join(parts, " ").alias("text"))
    return found.withColumn("para", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_ord")) - 1)


def captions(lines: DataFrame, follow: int = 5) -> DataFrame:
    """``doc_id, ord, kind, num, caption``: a caption line and up to ``follow`` lines that go on with it."""
    text = F.trim("text")
    starts = lines.withColumn("text", text).withColumn("start", text.rlike(CAPTION) & ~is_toc_line(text))
    runs = starts.withColumn("at", last_state(F.when(F.col("start"), F.col("ord"))))
    runs = runs.where("at is not null")
    within = Window.partitionBy("doc_id", "at").orderBy("ord")
    runs = runs.withColumn("i", F.row_number().over(within) - 1).withColumn("gap", F.max(F.col("text") == "").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.where(~F.col("gap") & (F.col("i") <= follow))
    piece = F.when(F.col("start"), F.regexp_extract("text", CAPTION, 3)).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("p")))), lambda x: x["p"])
    kind, num = F.min_by(F.regexp_extract("text", CAPTION, 1), "i"), F.min_by(F.regexp_extract("text", CAPTION, 2), "i")
    return runs.groupBy("doc_id", F.col("at").alias("ord")).agg(kind.alias("kind"), num.alias("num"), F.trim(F.array_join(parts, " ")).alias("caption"))


def reference_entries(lines: DataFrame, appendix: bool = False) -> DataFrame:
    """``doc_id, entry, ord, text``: numbered entries after the last reference heading, wrapped lines joined.

    ``appendix``: an appendix that begins more than 100 characters after the heading ends the list.
    """
    text = F.trim("text")
    heads = lines.withColumn("text", text)
    start = F.max(F.when(text.rlike(REFERENCES), F.col("ord"))).over(Window.partitionBy("doc_id"))
    after = heads.withColumn("start", start).where("ord > start and text <> ''")
    if appendix:
        read = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
        after = after.withColumn("read", read).withColumn("stop", sticky(F.col("text").rlike(r"^(?:A\s+)?Appendix\b") & (F.coalesce("read", F.lit(0)) > 100))).where("not stop")
    after = after.withColumn("entry", F.sum(F.col("text").rlike(r"^\[[0-9]+\]\s+").cast("int")).over(so_far())).where("entry > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return after.groupBy("doc_id", "entry").agg(F.min("ord").alias("ord"), F.array_join(parts, " ").alias("text"))


def next_text(text: str = "text", ahead: int = 3) -> Column:
    """The first text that isn't blank among the next rows."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, ahead)
    return F.first(F.nullif(F.trim(text), F.lit("")), ignorenulls=True).over(w)


def overlapping_windows(rows: DataFrame, size: int, step: int, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds ``window``: rows belong to windows of ``size`` that start every ``step`` rows; none starts at the last row."""
    w = Window.partitionBy(doc)
    out = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)).cast("int")
    out = out.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("i") / step).cast("int"))))
    return out.where((F.col("window") * step < F.col("n") - 1) | (F.col("n") == 1) & (F.col("window") == 0)).drop("n")


def greedy_chunks(rows: DataFrame, limit: int, doc: str = "doc_id", order: str = "ord", text: str = "text") -> DataFrame:
    """Adds ``chunk``: texts are gathered until their lengths reach ``limit``, then a new chunk begins.

    A fold over a document's lengths, in order; the array is as long as the document.
    """
    pair = F.struct(F.col(order).alias("o"), F.length(text).cast("int").alias("l"))
    lengths = rows.groupBy(doc).agg(F.array_sort(F.collect_list(pair)).alias("a"))
    start = "named_struct('s', 0, 'c', 0, 'out', cast(array() as array<struct<o:int,c:int>>))"
    step = f"named_struct('s', if(z.s + x.l >= {limit}, 0, z.s + x.l), 'c', if(z.s + x.l >= {limit}, z.c + 1, z.c), 'out', concat(z.out, array(named_struct('o', cast(x.o as int), 'c', z.c))))"
    folded = lengths.select(doc, F.explode(F.expr(f"aggregate(a, {start}, (z, x) -> {step}).out")).alias("e"))
    return rows.join(folded.select(doc, F.col("e.o").alias(order), F.col("e.c").alias("chunk")), [doc, order])


def batches(rows: DataFrame, size: int, doc: str, order: str) -> DataFrame:
    """Adds ``batch``: consecutive rows, ``size`` at a time."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1) / size))


def with_depth(rows: DataFrame, delta: Column, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds ``depth``: a running sum that never falls below zero."""
    summed = rows.withColumn("raw", F.sum(delta).over(so_far(doc, order)))
    lowest = F.least(F.lit(0), F.min("raw").over(so_far(doc, order)))
    return summed.withColumn("depth", F.col("raw") - lowest).drop("raw")


def introduced_before(paras: DataFrame) -> DataFrame:
    """``doc_id, ix, term``: terms used that no strictly earlier paragraph introduces; a plural s doesn't matter."""
    from marginalia.functions.text import stem_plural

    norm = lambda c: stem_plural(F.lower(F.trim(c)))
    intro = paras.select("doc_id", F.col("ix").alias("at"), F.explode("introduced").alias("t")).select("doc_id", "at", norm(F.col("t")).alias("key"))
    used = paras.select("doc_id", "ix", F.explode("used").alias("term")).withColumn("key", norm(F.col("term")))
    cond = [used.doc_id == intro.doc_id, used.key == intro.key, intro["at"] < used.ix]
    return used.join(intro, cond, "left_anti").select("doc_id", "ix", "term")
