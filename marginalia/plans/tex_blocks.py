"""Rules over blocks of TeX: displayed formulas with what follows them, and floats with their captions.

A document's lines are joined, each behind a marker with its number, so that one pattern finds blocks and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import strip_tex_comment, word_count
from marginalia.operators.sequences import REFERENCES, sticky
from marginalia.plans.rules import finding, together

# Environments of displayed formulas, words with which a sentence goes on, and ends of formulas.
DISPLAYS = ("equation", "align", "gather", "multline", "eqnarray", "alignat", "flalign", "displaymath")
GOES_ON = r"(?i)^(where|with|and|for|such|which|whose|so|then|i\.e|e\.g)\b"
PUNCTUATED = r"[.,;:!?]\s*$"

_MARK = "\u0001"
_LINE = rf"{_MARK}([0-9]+){_MARK}[^\n]*?"


def marked_text(lines: DataFrame, text: Column) -> DataFrame:
    """``doc_id, whole``: a document's lines, each behind its marked number."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", text.alias("t"))))
    joined = F.array_join(F.transform(pairs, lambda x: F.concat(F.lit(_MARK), x["ord"].cast("string"), F.lit(_MARK), x["t"])), "\n")
    return lines.groupBy("doc_id").agg(joined.alias("whole"))


def matches(rows: DataFrame, pattern: str, **groups: int) -> DataFrame:
    """``doc_id`` and the named groups of every match."""
    parts = F.arrays_zip(*[F.regexp_extract_all("whole", F.lit(pattern), i).alias(n) for n, i in groups.items()])
    return rows.select("doc_id", F.explode(parts).alias("m")).select("doc_id", *[F.col(f"m.{n}").alias(n) for n in groups])


def unmarked(c: Column) -> Column:
    return F.regexp_replace(c, f"{_MARK}[0-9]+{_MARK}", "")


def displays(tex: DataFrame) -> DataFrame:
    """``doc_id, ord, body, follow``: displayed formulas without labels, and the first text of the three lines after."""
    names = "|".join(DISPLAYS)
    pattern = rf"(?s){_LINE}(?:\\begin\{{({names})\*?\}}(.*?)\\end\{{\2\*?\}}|\\\[(.*?)\\\])(?=[^\n]*((?:\n[^\n]*){{0,3}}))"
    found = matches(marked_text(tex, strip_tex_comment(F.col("text"))), pattern, ord=1, env=3, bracket=4, after=5)
    body = unmarked(F.concat_ws("", "env", "bracket"))
    for p in (r"\\label\{[^}]+\}", r"\\(nonumber|notag|qedhere)\b", r"\\\\(\[[^\]]*\])?\s*$"):
        body = F.regexp_replace(body, p, "")
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    return found.select("doc_id", F.col("ord").cast("int").alias("ord"), trimmed.alias("body"), F.regexp_extract(unmarked(F.col("after")), r"(\S[^\n]*)", 1).alias("follow"))


def formulas(tex: DataFrame, most: int = 80) -> DataFrame:
    """Long inline formulas, and displayed ones without punctuation at their end."""
    inline = F.explode(F.regexp_extract_all(strip_tex_comment(F.col("text")), F.lit(r"(?<!\\)\$([^$]+)(?<!\\)\$"), 1))
    long = tex.select("doc_id", "ord", inline.alias("b"))
    bare = displays(tex).where((F.col("body") != "") & ~F.col("body").rlike(PUNCTUATED))
    new = F.col("follow").rlike("^[A-Z]") & ~F.col("follow").rlike(GOES_ON)
    return together(
        finding(long.where(F.length(F.trim("b")) > most), "LONG-INLINE", "WARN", F.length(F.trim("b"))),
        finding(bare.where(new), "EQ-NO-PUNCT", "WARN", F.left("follow", F.lit(40))),
        finding(bare.where(~new), "EQ-PUNCT-CHECK", "INFO", F.left("follow", F.lit(40))),
    )


def tex_captions(tex: DataFrame, min_words: int = 6, listed: bool = False) -> DataFrame:
    """Floats without a caption or with a short one, and all others if ``listed``; comments count, as they stand."""
    pattern = rf"(?s){_LINE}\\begin\{{(figure|table)\*?\}}(.*?)\\end\{{\2\*?\}}"
    found = matches(marked_text(tex, F.col("text")), pattern, ord=1, env=2, body=3)
    inner = r"[^{}\\]++|\\."
    caption = rf"(?s)\\caption(?:\[[^\]]*\])?\{{((?:{inner}|\{{(?:{inner}|\{{(?:{inner})*\}})*\}})*)\}}"
    text = F.regexp_replace(F.regexp_extract(unmarked(F.col("body")), caption, 1), r"\\[A-Za-z]+\*?(\[[^\]]*\])?|\{|\}", " ")
    rows = found.withColumn("has", F.col("body").rlike(r"\\caption(?:\[[^\]]*\])?\{")).withColumn("words", word_count(text))
    parts = [finding(rows.where("not has"), "NO-CAPTION", "WARN", F.col("env")), finding(rows.where(F.col("has") & (F.col("words") < min_words)), "SHORT-CAPTION", "WARN", F.col("words"))]
    if listed:
        parts.append(finding(rows.where(F.col("has") & (F.col("words") >= min_words)), "CAPTION", "INFO", F.col("words")))
    return together(*parts)


def author_year_citations(lines: DataFrame, most: int = 3) -> DataFrame:
    """Documents that cite by author and year before their references."""
    pattern = r"\([A-Z][a-zA-Z]+(?:\s+(?:and|&)\s+[A-Z][a-zA-Z]+|\s+et\s+al\.?)?,?\s+(?:19|20)[0-9]{2}[a-z]?\)"
    body = lines.withColumn("refs", sticky(F.trim("text").rlike(REFERENCES))).where("not refs")
    counted = body.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(pattern))).alias("n"), F.min("ord").alias("ord"))
    return finding(counted.where(F.col("n") > most), "CITE-STYLE", "INFO", F.col("n"))
