"""Relational operators: what is defined, referenced, judged or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unreferenced(entities: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Entities that nothing refers to."""
    return entities.join(refs.select(*keys), keys, "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def forward_references(defs: DataFrame, refs: DataFrame, page_height: float, threshold: float) -> DataFrame:
    """References that come before their definition by more than ``threshold`` pages.

    Of several definitions the first counts; of references that agree in page and rounded place, too.
    """
    first = first_of(defs, ["doc_id", "kind", "num"], [F.col("page"), F.col("y")])
    d, r = first.alias("d"), refs.alias("r")
    later = (F.col("d.doc_id") == F.col("r.doc_id")) & (F.col("d.kind") == F.col("r.kind")) & (F.col("d.num") == F.col("r.num"))
    later &= F.struct("d.page", "d.y") > F.struct("r.page", "r.y")
    distance = (F.col("d.page") - F.col("r.page")) + (F.col("d.y") - F.col("r.y")) / page_height
    found = r.join(d, later).select("r.doc_id", "r.kind", "r.num", "r.page", "r.y", "r.ord", F.col("d.page").alias("def_page"), distance.alias("distance"))
    found = found.where(F.col("distance") > threshold).withColumn("place", F.round("y"))
    return first_of(found, ["doc_id", "kind", "num", "page", "place"], [F.col("ord")]).drop("place", "y")


#: Levels of units that are told apart, from 0 on.
LEVELS = 12


def parents(units: DataFrame) -> DataFrame:
    """Adds ``parent`` (ord, level, title): the unit one level above that a unit stands in, null without one.

    The last unit so far of a level above is the one that a unit stands in: a running state for each of LEVELS levels.
    """
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    unit = F.struct("ord", "level", "title")
    last = F.array(*[F.last(F.when(F.col("level") <= k, unit), ignorenulls=True).over(before) for k in range(LEVELS)])
    above = F.when(F.col("level") > 0, F.get(F.col("_last"), F.col("level") - 1))
    return units.withColumn("_last", last).withColumn("parent", F.when(above["level"] == F.col("level") - 1, above)).drop("_last")


def lone_children(units: DataFrame) -> DataFrame:
    """Units with exactly one direct child before the next unit of their level or above."""
    found = parents(units).where("parent is not null").groupBy("doc_id", F.col("parent.ord").alias("ord"), F.col("parent.title").alias("parent_title"))
    found = found.agg(F.count("*").alias("n"), F.min("title").alias("child")).where("n = 1")
    return found.select("doc_id", "ord", F.col("parent_title").alias("title"), "child")


def label_graph(sections: DataFrame) -> DataFrame:
    """``doc_id, source, target, weight``: how often a section's text, up to the next one, refers to another's label."""
    refs = sections.select("doc_id", F.col("label").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"\\ref\{([^}]*)\}"), 1)).alias("target"))
    labels = sections.select("doc_id", F.col("label").alias("target")).distinct()
    return refs.join(labels, ["doc_id", "target"], "left_semi").groupBy("doc_id", "source", "target").agg(F.count("*").alias("weight"))


def manifest_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file, change``: changed, added or missing."""
    both = old.select("file", F.col("sha").alias("a")).join(new.select("file", F.col("sha").alias("b")), "file", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("changed")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", change.alias("change"))


def with_default(items: DataFrame, results: DataFrame, key: str, order: str, **defaults: str) -> DataFrame:
    """Every item with its result, the last of several; missing values become defaults."""
    last = first_of(results, [key], [F.desc(order)]).drop(order)
    out = items.join(last, key, "left")
    return out.select(*items.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The candidate of each entry with the most similar title; of equals the first."""
    return first_of(candidates, ["bib_id"], [F.desc("sim"), F.col("ord")])


def inverted_text(words: DataFrame) -> DataFrame:
    """``id, text`` from words and their positions; positions without a word leave no gap."""
    placed = words.select("id", "word", F.explode("positions").alias("at"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return placed.groupBy("id").agg(F.array_join(parts, " ").alias("text"))


def concept_uses(paras: DataFrame, words: int = 6, least: int = 4) -> DataFrame:
    """``doc_id, term, ix, at``: paragraphs that use a term before the paragraph ``at`` that introduces it first.

    Texts become runs of up to ``words`` words, as they stand and without a plural s, which are joined with terms in the singular;
    captions don't count, nor do terms of fewer than ``least`` letters. Only runs of as many words as a term of the document has are made.
    """
    from marginalia.functions.text import stem_plural

    intro = paras.select("doc_id", "ix", F.explode("introduced").alias("term")).where(F.length("term") >= least)
    intro = intro.groupBy("doc_id", "term").agg(F.min("ix").alias("at")).withColumn("t", F.split(F.lower("term"), " ")).withColumn("n", F.size("t")).where(F.col("n") <= words)
    intro = intro.withColumn("run", F.concat_ws(" ", F.expr("slice(t, 1, n - 1)"), stem_plural(F.element_at("t", -1)))).drop("t")
    sizes = intro.groupBy("doc_id").agg(F.collect_set("n").alias("sizes"))
    split = F.filter(F.split(F.lower("text"), r"[^a-z0-9\-]+"), lambda w: w != "")
    rows = paras.where("not is_caption").select("doc_id", "ix", split.alias("w")).join(sizes, "doc_id")
    rows = rows.select("doc_id", "ix", "w", F.explode("sizes").alias("n")).where("size(w) >= n")
    runs = rows.select("doc_id", "ix", F.explode(F.expr("array_distinct(transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')))")).alias("run"))
    runs = runs.select("doc_id", "ix", F.explode(F.array_distinct(F.array("run", F.regexp_replace("run", "s$", "")))).alias("run"))
    return runs.join(intro, ["doc_id", "run"]).where("ix < at").select("doc_id", "term", "ix", "at").distinct()


def not_cited(found: DataFrame, cited: DataFrame) -> DataFrame:
    """Rows of ``found`` (doc_id, title) whose title is part of no title that their document cites (doc_id, title)."""
    c, f = cited.select("doc_id", F.lower("title").alias("c_title")).alias("c"), found.alias("f")
    return f.join(c, F.expr("f.doc_id = c.doc_id and contains(c.c_title, lower(f.title))"), "left_anti")
