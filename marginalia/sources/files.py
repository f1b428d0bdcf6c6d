"""Readers: catalogs, TeX sources, page texts, manifests, transcripts. Order is always an explicit column."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of the two catalogs.
THESES = "number int, author string, title string, university string, status string, date string, industry string, url string, recording string"
TOPICS = "id int, title string, area string, data_source string, difficulty string, status string, description string, url string, references string"


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, doubled quotes and line ends within quotes; empty cells are empty texts, ``ord`` counts rows."""
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")
    return rows.fillna("").withColumn("ord", F.monotonically_increasing_id())  # a file read as a whole keeps its order


def read_theses(spark: SparkSession, path: str) -> DataFrame:
    return read_catalog(spark, path, THESES)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return read_catalog(spark, path, TOPICS)


def read_tex(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``file, doc_id, ord, line_no, text`` of all .tex files below a folder, or of one.

    A file is a document; if ``whole``, all of them are one document, in the order of their paths.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").text(path, wholetext=True)
    files = files.select(F.input_file_name().alias("file"), F.col("value"))
    doc = F.xxhash64(F.lit(path)) if whole else F.xxhash64("file")
    lines = files.select("file", doc.alias("doc_id"), F.posexplode(F.split("value", "\r?\n")).alias("i", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("file", "i"))
    return lines.select("file", "doc_id", place.alias("ord"), (F.col("i") + 1).alias("line_no"), "text")


def read_lines(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, str]:
    """(lines, mode): TeX files and folders as one document, or extracted texts with form feeds between pages, a document each.

    ValueError for a mix of both, for none, and for inputs without any text.
    """
    tex = [p for p in paths if p.endswith(".tex") or not os.path.splitext(p.rstrip("/"))[1]]
    if not paths or 0 < len(tex) < len(paths):
        raise ValueError("inputs must be TeX files and folders, or extracted texts, and some")
    if tex:
        parts = [read_tex(spark, p, whole=True).withColumn("part", F.lit(i)) for i, p in enumerate(tex)]
        lines = parts[0]
        for p in parts[1:]:
            lines = lines.unionByName(p)
        lines = lines.withColumn("doc_id", F.xxhash64(F.lit("\n".join(tex))))
        lines = lines.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "ord"))).withColumn("page", F.lit(None).cast("int")).drop("part")
    else:
        texts = spark.read.text(paths, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))
        lines = page_lines(texts)
    if lines.where(F.trim("text") != "").isEmpty():
        raise ValueError("no text in the inputs")
    return lines, "tex" if tex else "pdf"


def page_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ord, page, line_no, text`` of page texts parted by form feeds; each page ends with a blank line."""
    pages = texts.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\f")).alias("p", "page_text"))
    lines = pages.select("doc_id", (F.col("p") + 1).alias("page"), F.posexplode(F.concat(F.split("page_text", "\n"), F.array(F.lit("")))).alias("i", "text"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "i"))
    return lines.withColumn("line_no", F.col("i") + 1).withColumn("ord", order).drop("i")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha`` of lines '<digest>  <file>'."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(1)).alias("file"), F.get(parts, F.lit(0)).alias("sha"))


def digest_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, sha`` of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha"))


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cached answers, one JSON object a line; malformed lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_answers(rows: DataFrame, path: str) -> None:
    """Adds answers to a folder of JSON lines; what is there stays, whatever becomes of the run."""
    rows.write.mode("append").json(path)


def rewrite_answers(rows: DataFrame, path: str, schema: str) -> DataFrame:
    """Writes the final answers as a whole to a folder of their own, and gives what was written."""
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(schema).json(path)


def transcript_sections(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, i, script, body``: the parts of a transcript after banners '>>> script.py'."""
    parts = F.filter(F.split(text, r"(?m)^>>> "), lambda p: p.rlike(r"^\S+\.py"))
    rows = texts.select(F.col(key).alias("doc_id"), F.posexplode(parts).alias("i", "part"))
    return rows.select("doc_id", "i", F.regexp_extract("part", r"^(\S+)\.py", 1).alias("script"), F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def tex_units(lines: DataFrame) -> DataFrame:
    """``doc_id, ord, level, title``: numbered sectioning commands; the shallowest of a document has level 1."""
    levels = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}
    pattern = r"\\(part|chapter|section|subsection|subsubsection)(?:\[[^\]]*\])?\{([^}]*)\}"
    names = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("c"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("t"))
    units = lines.select("doc_id", (F.col("ord") * 1000).alias("base"), F.posexplode(found).alias("i", "u"))
    units = units.select("doc_id", (F.col("base") + F.col("i")).cast("int").alias("ord"), names[F.col("u.c")].alias("depth"), F.trim("u.t").alias("title"))
    return units.withColumn("level", F.col("depth") - F.min("depth").over(Window.partitionBy("doc_id")) + 1).drop("depth")


def scanned_units(lines: DataFrame, most: int = 40) -> DataFrame:
    """``doc_id, ord, number, level, title``: numbered headings of plain text, the first of each number.

    A heading below the top counts only after one that counts as its parent; this cascades by depth.
    """
    pattern = r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+([A-Z].{0,80})$"
    text = F.col("text")
    rows = lines.where(text.rlike(pattern)).select("doc_id", "ord", F.regexp_extract(text, pattern, 1).alias("number"), F.trim(F.regexp_extract(text, pattern, 2)).alias("title"))
    rows = rows.withColumn("level", F.size(F.split("number", r"\."))).where(F.split("number", r"\.")[0].cast("int") <= most)
    first = Window.partitionBy("doc_id", "number").orderBy("ord")
    kept = rows.where("level = 1").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    out = kept
    for level in (2, 3, 4):
        parent = kept.select("doc_id", F.col("number").alias("parent"), F.col("ord").alias("at"))
        below = rows.where(F.col("level") == level).withColumn("parent", F.regexp_replace("number", r"\.[0-9]+$", ""))
        kept = below.join(parent, ["doc_id", "parent"]).where("at < ord").drop("at", "parent").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k").select(*rows.columns)
        out = out.unionByName(kept)
    return out
