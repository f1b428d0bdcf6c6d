"""The suite: applicable linters over one set of lines, their findings united, a status for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans import rules, tex_blocks
from marginalia.sources.files import scanned_units, tex_units

BOTH, THESIS = ("thesis", "paper"), ("thesis",)
Linter = Callable[[DataFrame, str], DataFrame]

#: name: (group, modes, profiles, linter over lines and a profile)
LINTERS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], Linter]] = {
    "structure": ("Structure", ("pdf",), BOTH, lambda lines, profile: rules.lone_children(scanned_units(lines), profile)),
    "structure_tex": ("Structure", ("tex",), BOTH, lambda lines, profile: rules.lone_children(tex_units(lines), profile)),
    "numbers": ("Floats", ("pdf",), BOTH, lambda lines, _: rules.unreferenced_numbers(lines)),
    "labels": ("Floats", ("tex",), BOTH, lambda lines, _: rules.unreferenced_tex(lines)),
    "crossref": ("Floats", ("pdf",), BOTH, lambda lines, _: rules.forward_floats(lines)),
    "concepts": ("Prose", ("pdf",), BOTH, lambda lines, _: rules.forward_concepts(lines)),
    "acronyms": ("Prose", ("pdf",), BOTH, lambda lines, _: rules.acronyms(lines)),
    "acronyms_tex": ("Prose", ("tex",), BOTH, lambda lines, _: rules.acronyms(lines, mode="tex")),
    "prose": ("Prose", ("pdf", "tex"), BOTH, lambda lines, _: rules.prose(rules.sentence_rows(lines))),
    "companions": ("References", ("pdf", "tex"), BOTH, lambda lines, _: rules.companions(rules.sentence_rows(lines))),
    "codes": ("References", ("pdf", "tex"), BOTH, lambda lines, _: rules.codes(lines)),
    "terminology": ("Prose", ("pdf", "tex"), BOTH, lambda lines, _: rules.terminology(lines)),
    "eqref": ("Math", ("tex",), BOTH, lambda lines, _: rules.eqref(lines)),
    "formulas": ("Math", ("tex",), BOTH, lambda lines, _: tex_blocks.formulas(lines)),
    "captions": ("Floats", ("pdf",), BOTH, lambda lines, _: rules.short_captions(lines)),
    "captions_tex": ("Floats", ("tex",), BOTH, lambda lines, _: tex_blocks.tex_captions(lines)),
    "citations": ("References", ("pdf",), BOTH, lambda lines, _: rules.citation_style(lines)),
    "citations_tex": ("References", ("tex",), BOTH, lambda lines, _: rules.citation_style_tex(lines)),
    "author_year": ("References", ("pdf",), BOTH, lambda lines, _: tex_blocks.author_year_citations(lines)),
    "ai": ("Disclosure", ("pdf",), THESIS, lambda lines, _: rules.ai_disclosure(lines)),
    "ai_tex": ("Disclosure", ("tex",), THESIS, lambda lines, _: rules.ai_disclosure(lines, mode="tex")),
}


def _applicable(mode: str, profile: str) -> dict[str, tuple]:
    if mode not in ("pdf", "tex") or profile not in BOTH:
        raise ValueError("mode must be pdf or tex, profile thesis or paper")
    return {n: x for n, x in LINTERS.items() if mode in x[1] and profile in x[2]}


@contextmanager
def run_suite(lines: DataFrame, mode: str = "pdf", profile: str = "thesis", bib: DataFrame | None = None, candidates: DataFrame | None = None, lookups: DataFrame | None = None) -> Iterator[DataFrame]:
    """``linter, doc_id, code, severity, ord, subject`` of all linters for this mode and profile; lines are kept until the context ends.

    With ``bib`` and ``candidates`` (see ``rules.bibliography``) references are checked, too; the entry's id is the subject then.
    """
    chosen = _applicable(mode, profile)
    lines = lines.persist()
    try:
        parts = [f(lines, profile).select(F.lit(n).alias("linter"), "doc_id", "code", "severity", "ord", "subject") for n, (_, _, _, f) in chosen.items()]
        if bib is not None and candidates is not None:
            found = rules.bibliography(bib, candidates, lookups).where("code <> 'OK'")
            parts.append(found.select(F.lit("bibliography").alias("linter"), F.lit(None).cast(lines.schema["doc_id"].dataType).alias("doc_id"), "code", "severity", F.lit(None).cast("int").alias("ord"), F.col("id").alias("subject")))
        yield rules.together(*parts)
    finally:
        lines.unpersist()


def suite_status(spark: SparkSession, findings: DataFrame, mode: str = "pdf", profile: str = "thesis") -> DataFrame:
    """``script, grp, n, status`` of every applicable linter: 1 if it has errors or warnings."""
    known = spark.createDataFrame([(n, x[0]) for n, x in _applicable(mode, profile).items()], "script string, grp string")
    found = findings.groupBy(F.col("linter").alias("script")).agg(F.count("*").alias("n"), F.max(F.when(F.col("severity") != "INFO", 1).otherwise(0)).alias("status"))
    return known.join(found, "script", "left").select("script", "grp", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("status", F.lit(0)).alias("status"))
