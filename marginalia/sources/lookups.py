"""Answers of bibliographic services as candidates ``bib_id, ord, source, title, authors, venue, year, type, doi``.

An answer is a row ``bib_id, body``; requests are made elsewhere. Authors are surnames; at most MOST candidates of an answer count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 5
_COLUMNS = ("title", "authors", "venue", "year", "type", "doi")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _first(c: Column) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))


def _surname(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def _candidates(rows: DataFrame, source: str, **fields: Column) -> DataFrame:
    numbered = rows.where(F.col("i") < MOST)
    return numbered.select("bib_id", (F.col("i") + 1).alias("ord"), F.lit(source).alias("source"), *[fields[c].alias(c) for c in _COLUMNS])


def crossref(answers: DataFrame) -> DataFrame:
    """Works found by title: the container is the venue, else the publisher."""
    item = "title array<string>, author array<struct<family string>>, `container-title` array<string>, publisher string, issued struct<`date-parts` array<array<int>>>, type string, DOI string"
    body = F.from_json("body", f"message struct<items array<struct<{item}>>>")
    rows = answers.select("bib_id", F.posexplode(body["message"]["items"]).alias("i", "e"))
    e = F.col("e")
    venue = F.coalesce(F.nullif(_first(e["container-title"]), F.lit("")), _text(e["publisher"]))
    year = _text(F.try_element_at(F.try_element_at(e["issued"]["date-parts"], F.lit(1)), F.lit(1)))
    authors = F.transform(F.coalesce(e["author"], F.array().cast("array<struct<family string>>")), lambda a: _text(a["family"]))
    return _candidates(rows, "crossref", title=_first(e["title"]), authors=authors, venue=venue, year=year, type=_text(e["type"]), doi=_text(e["DOI"]))


def dblp(answers: DataFrame) -> DataFrame:
    """Publications found by title; a single author may stand without a list, and numbers that part homonyms go."""
    listed = "info struct<title string, venue string, year string, type string, doi string, authors struct<author array<struct<text string>>>>"
    alone = "info struct<authors struct<author struct<text string>>>"
    hits = F.get_json_object("body", "$.result.hits.hit")
    rows = answers.select("bib_id", F.posexplode(F.from_json(hits, "array<string>")).alias("i", "h"))
    rows = rows.select("bib_id", "i", F.from_json("h", listed)["info"].alias("e"), F.from_json("h", alone)["info"]["authors"]["author"]["text"].alias("one"), F.get_json_object("h", "$.info.title").alias("title"), *[F.get_json_object("h", f"$.info.{c}").alias(f"e_{c}") for c in ("venue", "year", "type", "doi")])
    names = F.coalesce(F.when(F.col("one").isNotNull(), F.array("one")), F.transform(F.col("e")["authors"]["author"], lambda a: a["text"]), F.array().cast("array<string>"))
    authors = F.transform(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), lambda n: _surname(F.regexp_replace(n, r"\s+[0-9]{4}$", "")))
    return _candidates(rows, "dblp", title=_text(F.col("title")), authors=authors, venue=_text(F.col("e_venue")), year=_text(F.col("e_year")), type=_text(F.col("e_type")), doi=_text(F.col("e_doi")))


def semantic_scholar(answers: DataFrame) -> DataFrame:
    """The published record of a preprint's number; an answer without a title is none."""
    e = F.from_json("body", "title string, venue string, year int, authors array<struct<name string>>, externalIds struct<DOI string>")
    rows = answers.select("bib_id", F.lit(0).alias("i"), e.alias("e")).where("e.title is not null")
    e = F.col("e")
    authors = F.transform(F.filter(F.coalesce(e["authors"], F.array().cast("array<struct<name string>>")), lambda a: F.coalesce(a["name"], F.lit("")) != ""), lambda a: _surname(a["name"]))
    return _candidates(rows, "s2", title=_text(e["title"]), authors=authors, venue=_text(e["venue"]), year=_text(e["year"]), type=F.lit("record"), doi=_text(e["externalIds"]["DOI"]))


def arxiv(answers: DataFrame) -> DataFrame:
    """The first entry of an Atom feed; one whose title is 'error' is none."""
    entry = F.regexp_extract("body", r"(?s)<entry>(.*?)</entry>", 1)
    rows = answers.select("bib_id", F.lit(0).alias("i"), entry.alias("e"))
    rows = rows.withColumn("title", F.trim(F.regexp_replace(F.regexp_extract("e", r"(?s)<title>(.*?)</title>", 1), r"\s+", " "))).where("title <> '' and lower(title) <> 'error'")
    authors = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<author>\s*<name>(.*?)</name>"), 1), _surname)
    return _candidates(rows, "arxiv", title=F.col("title"), authors=authors, venue=F.lit("arXiv"), year=F.regexp_extract("e", r"<published>([0-9]{4})", 1), type=F.lit("preprint"), doi=F.lit(""))


def openalex(answers: DataFrame) -> DataFrame:
    """``bib_id, ord, title, abstract, year``: works found by title, the abstract rebuilt from its inverted index."""
    body = F.from_json("body", "results array<struct<title string, publication_year int, abstract_inverted_index map<string, array<int>>>>")
    rows = answers.select("bib_id", F.posexplode(body["results"]).alias("i", "e"))
    pairs = F.flatten(F.transform(F.map_entries(F.coalesce(F.col("e")["abstract_inverted_index"], F.create_map().cast("map<string, array<int>>"))), lambda x: F.transform(x["value"], lambda at: F.struct(at.alias("at"), x["key"].alias("word")))))
    words = F.transform(F.array_sort(pairs), lambda x: x["word"])
    return rows.select("bib_id", (F.col("i") + 1).alias("ord"), F.trim(_text(F.col("e")["title"])).alias("title"), F.array_join(words, " ").alias("abstract"), F.col("e")["publication_year"].alias("year"))
