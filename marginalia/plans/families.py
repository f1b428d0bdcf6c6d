"""The families of external judges: what is asked, and what their answers become; the judge itself is injected.

Answers are rows ``doc_id, ord, answer``; an answer is a JSON object, tolerantly read. Each family gives rows of its own, which
``judged_findings`` turns into findings by a table of codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import middle_cut, sentences, tolerant_json
from marginalia.operators import relations, sequences

# Items of the checklists of a thesis and of a paper, the venues that ask for a statement on ethics, and the checks of a data split.
THESIS_ITEMS = ("problem-formulation", "data-sources-eval", "loss-functions", "results-discussed", "baselines", "pseudocode", "model-diagnosis", "section-intros", "captions-informative")
PAPER_ITEMS = ("contribution-stated", "problem-formulation", "novelty-positioned", "claims-supported", "baselines", "results-answer-claims", "reproducibility", "limitations", "ethics-impact")
ETHICS_VENUES = ("neurips", "acl", "emnlp", "iclr")
SPLIT_CHECKS = ("train-set", "validation-set", "test-set", "diagnosis-on-split")
# Categories of the prose judge, criteria of captions, rules of figures with their glyphs, and levels of support, the weakest first.
PROSE_CATEGORIES = ("uncited-claim", "tense-drift", "dangling-reference", "vague-quantifier", "jargon", "synonym-switch", "unmotivated-section", "broken-idiom", "informal-register", "category-error", "empty-buzzword")
CAPTION_CRITERIA = ("states-what-shown", "defines-quantities", "self-contained", "sentence-form")
FIGURE_RULES = ("R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8", "R9", "R10")
GLYPHS = {"ok": "✓", "weak": "~", "bad": "✗", "na": "·", "?": "?"}
SUPPORT_LEVELS = ("ASSERTED", "UNSUPPORTED", "PARTIAL", "SUPPORTED")
# Verdicts and flags with the codes and severities that they become; the last of a family stands for all others.
CODES = {
    "research_questions": {"ANSWERED": ("ANSWERED", "INFO"), "PARTIALLY-ANSWERED": ("PARTIALLY-ANSWERED", "WARN"), "UNANSWERED": ("UNANSWERED", "WARN")},
    "question_quality": {"STRONG": ("STRONG-RQ", "INFO"), "ADEQUATE": ("ADEQUATE-RQ", "INFO"), "WEAK": ("WEAK-RQ", "WARN")},
    "section_intros": {"GOOD": ("GOOD-INTRO", "INFO"), "MISSING": ("MISSING-INTRO", "WARN"), "WEAK": ("WEAK-INTRO", "WARN")},
    "related_work": {"RELATION-MISSTATED": ("RELATION-MISSTATED", "WARN"), "NOVELTY-OVERSTATED": ("NOVELTY-OVERSTATED", "WARN"), "SHALLOW-POSITIONING": ("SHALLOW-POSITIONING", "INFO"), "FAITHFUL": ("FAITHFUL", "INFO"), "UNVERIFIABLE": ("UNVERIFIABLE", "INFO")},
    "types": {"TYPE-MISMATCH": ("TYPE-MISMATCH", "WARN"), "RANGE": ("RANGE", "WARN"), "DIMENSION": ("DIMENSION", "WARN"), "BRIDGE-LOOSE": ("BRIDGE-LOOSE", "INFO"), "UNCLEAR": ("UNCLEAR", "INFO")},
    "support": {"SUPPORTED": ("SUPPORTED", "INFO"), "PARTIAL": ("PARTIAL", "WARN"), "UNSUPPORTED": ("UNSUPPORTED", "WARN"), "ASSERTED": ("ASSERTED", "WARN")},
}
SCOPE = (("gap_identified", "GAP-IDENTIFIED"), ("delimitations_stated", "DELIMITATIONS"), ("aligned", "RQ-ALIGNMENT"), ("covers_aim", "AIM-COVERAGE"))
SKIPPED_TITLES = r"(?i)^(contents|abstract|references|bibliography|symbols|abbreviations|preface|acknowledg)"


def checked_names(names: str, known: tuple[str, ...]) -> list[str]:
    """The names of a list parted by commas; ValueError for one that isn't known."""
    found = [n.strip() for n in names.split(",") if n.strip()]
    if bad := [n for n in found if n not in known]:
        raise ValueError(f"unknown: {', '.join(bad)}")
    return found


def elements(answers: DataFrame, field: str, schema: str) -> DataFrame:
    """``doc_id, ord, i`` and the fields of every object of a list within an answer; what isn't an object is left out."""
    raw = tolerant_json(F.col("answer"), f"{field} array<string>")[field]
    found = answers.select("doc_id", "ord", F.posexplode(raw).alias("i", "raw")).where(F.trim("raw").startswith("{"))
    return found.select("doc_id", "ord", "i", F.from_json("raw", schema).alias("e")).select("doc_id", "ord", "i", "e.*")


def named(column: str, default: str) -> Column:
    return F.upper(F.trim(F.coalesce(column, F.lit(default))))


def coded(verdict: Column, family: str) -> tuple[Column, Column]:
    """(code, severity) of a verdict."""
    table = CODES[family]
    other = list(table.values())[-1]
    pick = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])]), verdict), F.lit(other[i]))
    return pick(0), pick(1)


def checklist_items(docs: DataFrame, profile: str = "thesis", venue: str = "") -> DataFrame:
    """``doc_id, item, place``: the items to judge for each document; ethics only where the venue asks for it."""
    items = [i for i in (PAPER_ITEMS if profile == "paper" else THESIS_ITEMS) if i != "ethics-impact" or venue.lower() in ETHICS_VENUES]
    return docs.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*map(F.lit, items))).alias("place", "item"))


def checklist(answers: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item, verdict, evidence, suggestion``: every item, the last answer counts; UNCLEAR without one."""
    found = elements(answers, "results", "id string, verdict string, evidence string, suggestion string")
    last = relations.first_of(found, ["doc_id", "id"], [F.desc("ord"), F.desc("i")]).withColumnRenamed("id", "item").drop("ord", "i")
    rows = items.join(last, ["doc_id", "item"], "left")
    return rows.select("doc_id", "item", named("verdict", "UNCLEAR").alias("verdict"), F.trim(F.coalesce("evidence", F.lit("no answer from model"))).alias("evidence"), F.trim(F.coalesce("suggestion", F.lit(""))).alias("suggestion"))


def data_split(answers: DataFrame) -> DataFrame:
    """``doc_id, method, item, verdict, evidence``: each method with all four checks of its data split."""
    methods = elements(answers, "methods", "name string, checks array<struct<id string, verdict string, evidence string>>")
    methods = methods.withColumn("method", F.trim(F.coalesce("name", F.lit("(unnamed method)"))))
    asked = methods.select("doc_id", "method", F.explode(F.array(*map(F.lit, SPLIT_CHECKS))).alias("item")).distinct()
    found = methods.select("doc_id", "method", F.posexplode("checks").alias("k", "c")).select("doc_id", "method", "k", F.col("c.id").alias("item"), "c.verdict", "c.evidence")
    last = relations.first_of(found, ["doc_id", "method", "item"], [F.desc("k")]).drop("k")
    rows = asked.join(last, ["doc_id", "method", "item"], "left")
    return rows.select("doc_id", "method", "item", named("verdict", "UNCLEAR").alias("verdict"), F.trim(F.coalesce("evidence", F.lit("no answer from model"))).alias("evidence"))


def with_none(rows: DataFrame, answers: DataFrame, code: str, severity: str) -> DataFrame:
    """Adds a row of this code for every document of ``answers`` that has no rows."""
    bare = answers.select("doc_id").distinct().join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.unionByName(bare.select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit("-").alias("subject")))


def research_questions(answers: DataFrame, profile: str = "thesis") -> DataFrame:
    """``doc_id, code, severity, subject``: whether each question is answered and, in a thesis, revisited."""
    rows = elements(answers, "research_questions", "id string, verdict string, revisited boolean").withColumn("subject", F.coalesce("id", F.lit("RQ?")))
    verdict = named("verdict", "UNANSWERED")
    code, severity = coded(verdict, "research_questions")
    out = rows.select("doc_id", code.alias("code"), severity.alias("severity"), "subject")
    again = rows.where((verdict == "ANSWERED") & ~F.coalesce("revisited", F.lit(False)) & F.lit(profile != "paper"))
    return with_none(out.unionByName(again.select("doc_id", F.lit("NOT-REVISITED").alias("code"), F.lit("WARN").alias("severity"), "subject")), answers, "NO-RQS", "WARN")


def question_quality(answers: DataFrame) -> DataFrame:
    """``doc_id, code, severity, subject``: how good each question is, and what the scope lacks."""
    rows = elements(answers, "questions", "id string, verdict string, criteria_violated array<string>")
    code, severity = coded(named("verdict", "WEAK"), "question_quality")
    subject = F.concat_ws(": ", F.coalesce("id", F.lit("RQ?")), F.nullif(F.array_join(F.coalesce("criteria_violated", F.array().cast("array<string>")), ", "), F.lit("")))
    out = with_none(rows.select("doc_id", code.alias("code"), severity.alias("severity"), subject.alias("subject")), answers, "NO-RQS", "WARN")
    scope = answers.select("doc_id", tolerant_json(F.col("answer"), "scope struct<" + ", ".join(f"{k} boolean" for k, _ in SCOPE) + ">")["scope"].alias("s"))
    flags = [F.struct(F.lit(c).alias("code"), F.coalesce(F.col("s")[k], F.lit(False)).alias("good")) for k, c in SCOPE]
    flags_rows = scope.select("doc_id", F.explode(F.array(*flags)).alias("f")).select("doc_id", "f.code", F.when(F.col("f.good"), "INFO").otherwise("WARN").alias("severity"), F.when(F.col("f.good"), "satisfied").otherwise("missing").alias("subject"))
    return out.unionByName(flags_rows)


def related_work(works: DataFrame, answers: DataFrame, abstracts: DataFrame) -> DataFrame:
    """``doc_id, title, code, severity, has_abstract``: the verdict on each related work (doc_id, title); UNVERIFIABLE without one.

    ``abstracts``: title, abstract, of which the first of a title counts.
    """
    found = elements(answers, "assessments", "title string, verdict string")
    last = relations.first_of(found, ["doc_id", "title"], [F.desc("ord"), F.desc("i")]).select("doc_id", "title", "verdict")
    known = abstracts.where("abstract <> ''").select("title").distinct().withColumn("has_abstract", F.lit(True))
    rows = works.select("doc_id", "title").join(last, ["doc_id", "title"], "left").join(known, "title", "left")
    code, severity = coded(named("verdict", "UNVERIFIABLE"), "related_work")
    return rows.select("doc_id", "title", code.alias("code"), severity.alias("severity"), F.coalesce("has_abstract", F.lit(False)).alias("has_abstract"))


def omitted_work(found: DataFrame, cited: DataFrame, answers: DataFrame) -> DataFrame:
    """``doc_id, title, code``: works that a search found (doc_id, title), the document doesn't cite, and the judge calls omitted."""
    said = elements(answers, "omissions", "title string").where("title <> ''").select("doc_id", "title").distinct()
    return relations.not_cited(found, cited).select("doc_id", "title").distinct().join(said, ["doc_id", "title"], "left_semi").withColumn("code", F.lit("RELATED-WORK-OMITTED"))


def section_intros(units: DataFrame, answers: DataFrame) -> DataFrame:
    """``doc_id, unit, code, severity``: the introduction of each unit (doc_id, unit); WEAK without an answer. A unit's answer is of its own."""
    found = elements(answers, "units", "id string, verdict string").where("i = 0")
    last = relations.first_of(found, ["doc_id", "id"], [F.desc("ord")]).select("doc_id", F.col("id").alias("unit"), "verdict")
    code, severity = coded(named("verdict", "WEAK"), "section_intros")
    return units.join(last, ["doc_id", "unit"], "left").select("doc_id", "unit", code.alias("code"), severity.alias("severity"))


def opaque_openers(answers: DataFrame) -> DataFrame:
    """``doc_id, ord, subject``: openers judged opaque."""
    said = tolerant_json(F.col("answer"), "verdict string, problem string")
    rows = answers.select("doc_id", "ord", said.alias("r")).where(F.upper("r.verdict") == "OPAQUE")
    return rows.select("doc_id", "ord", F.trim(F.coalesce("r.problem", F.lit(""))).alias("subject"))


def flow_breaks(answers: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, after, quote``: gaps between paragraphs, each once; one at a window's end belongs to the next window.

    ``windows``: doc_id, ord, first, last, the paragraphs that the answer of this number is about.
    """
    rows = elements(answers, "breaks", "after string, quote string").withColumn("after", F.col("after").try_cast("int"))
    rows = rows.join(windows, ["doc_id", "ord"]).where(F.col("after").isNotNull() & (F.col("after") >= F.col("first")) & (F.col("after") < F.col("last")))
    return relations.first_of(rows, ["doc_id", "after"], [F.col("ord"), F.col("i")]).select("doc_id", "after", F.left(F.trim(F.coalesce("quote", F.lit(""))), F.lit(90)).alias("quote"))


def prose_findings(answers: DataFrame, checks: str = ",".join(PROSE_CATEGORIES)) -> DataFrame:
    """``doc_id, ord, i, code, subject``: findings of the categories asked for, as codes in capitals."""
    rows = elements(answers, "findings", "category string, quote string").where(F.trim("category").isin(checked_names(checks, PROSE_CATEGORIES)))
    return rows.select("doc_id", "ord", "i", F.upper(F.trim("category")).alias("code"), F.left(F.trim(F.coalesce("quote", F.lit(""))), F.lit(100)).alias("subject"))


def weak_captions(captions: DataFrame, answers: DataFrame, size: int = 15) -> DataFrame:
    """``doc_id, ord, label, violated``: captions (doc_id, ord, label) judged weak; an answer's index counts from 1 within its batch."""
    batched = sequences.batches(captions, size, "doc_id", "ord").withColumn("index", F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("ord")))
    rows = elements(answers, "captions", "index string, verdict string, violated array<string>").where(F.upper("verdict") == "WEAK")
    rows = rows.select("doc_id", F.col("ord").alias("batch"), F.col("index").try_cast("int").alias("index"), F.array_join(F.filter("violated", lambda v: v.isin(*CAPTION_CRITERIA)), ", ").alias("violated"))
    return batched.join(rows, ["doc_id", "batch", "index"]).select("doc_id", "ord", "label", F.coalesce(F.nullif("violated", F.lit("")), F.lit("(unspecified)")).alias("violated"))


def type_findings(answers: DataFrame) -> DataFrame:
    """``doc_id, i, code, severity, subject``; an unknown code counts as UNCLEAR."""
    rows = elements(answers, "findings", "code string, claim string")
    code, severity = coded(named("code", "UNCLEAR"), "types")
    return rows.select("doc_id", "i", code.alias("code"), severity.alias("severity"), F.trim(F.coalesce("claim", F.lit(""))).alias("subject"))


def supported_claims(answers: DataFrame) -> DataFrame:
    """``doc_id, place, id, code, severity, claim``: claims, the weakest support first; an unknown level counts as ASSERTED."""
    rows = elements(answers, "claims", "id string, claim string, support string")
    code, severity = coded(named("support", "ASSERTED"), "support")
    rows = rows.select("doc_id", "i", F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat(F.lit("C"), (F.col("i") + 1).cast("string"))).alias("id"), code.alias("code"), severity.alias("severity"), F.trim(F.coalesce("claim", F.lit(""))).alias("claim"))
    rank = F.array_position(F.array(*map(F.lit, SUPPORT_LEVELS)), F.col("code"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "i"))).drop("i")


def figure_cells(figures: DataFrame, answers: DataFrame, max_white: float = 0.6, min_dpi: float = 150.0, empty: float = 0.985) -> DataFrame:
    """``figure, rule, verdict, note``: the cells of the ten rules of each figure; '?' where nothing was said.

    ``figures``: doc_id, ord, figure, white (share of white samples), dpi (the smallest of its rasters, or null). Of what is measured and what is
    judged the more severe counts, the measured one on ties. A figure that is nearly all white wasn't found and isn't judged.
    """
    severity = lambda v: F.when(v == "bad", 2).when(v == "weak", 1).otherwise(0)
    there = figures.where(F.col("white") < empty)
    blank = there.where(F.col("white") > max_white).select("figure", F.lit("R8").alias("rule"), F.lit("weak").alias("verdict"), F.format_string("%.0f%% blank", F.col("white") * 100).alias("note"))
    coarse = there.where(F.col("dpi") < min_dpi).select("figure", F.lit("R3").alias("rule"), F.lit("weak").alias("verdict"), F.format_string("%.0f dpi", "dpi").alias("note"))
    rules = ", ".join(f"{r} struct<v string, note string>" for r in FIGURE_RULES)
    said = answers.join(there.select("doc_id", "ord", "figure"), ["doc_id", "ord"]).select("figure", tolerant_json(F.col("answer"), f"rules struct<{rules}>")["rules"].alias("r"))
    cells = said.select("figure", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lower(F.trim(F.col("r")[r]["v"])).alias("verdict"), F.trim(F.coalesce(F.col("r")[r]["note"], F.lit(""))).alias("note")) for r in FIGURE_RULES])).alias("c"))
    cells = cells.select("figure", "c.*").where(F.col("verdict").isin("ok", "weak", "bad", "na"))
    both = blank.unionByName(coarse).withColumn("own", F.lit(1)).unionByName(cells.withColumn("own", F.lit(0)))
    best = relations.first_of(both, ["figure", "rule"], [F.desc(severity(F.col("verdict"))), F.desc("own"), F.col("note")]).drop("own")
    every = figures.select("figure", F.explode(F.array(*map(F.lit, FIGURE_RULES))).alias("rule"))
    return every.join(best, ["figure", "rule"], "left").select("figure", "rule", F.coalesce("verdict", F.lit("?")).alias("verdict"), F.coalesce("note", F.lit("")).alias("note"))


def figure_matrix(cells: DataFrame) -> DataFrame:
    """A row for each figure, a column for each of the ten rules, glyphs in the cells."""
    glyph = F.create_map(*[F.lit(x) for kv in GLYPHS.items() for x in kv])[F.col("verdict")]
    return cells.withColumn("glyph", glyph).groupBy("figure").pivot("rule", list(FIGURE_RULES)).agg(F.first("glyph"))


def white_share(samples: DataFrame, above: int = 245) -> DataFrame:
    """``figure, white``: the share of sampled pixels (figure, r, g, b) that are near white."""
    near = (F.col("r") > above) & (F.col("g") > above) & (F.col("b") > above)
    return samples.groupBy("figure").agg(F.avg(F.when(near, 1.0).otherwise(0.0)).alias("white"))


def token_sums(answers: DataFrame) -> DataFrame:
    """``doc_id, tokens``: what the answers say they used (a JSON object ``usage``); none where it isn't said."""
    used = F.from_json("usage", "total_tokens long")["total_tokens"]
    return answers.groupBy("doc_id").agg(F.sum(F.coalesce(used, F.lit(0))).alias("tokens"))


def chunk_requests(paras: DataFrame, limit: int = 9000, least: int = 60) -> DataFrame:
    """``doc_id, chunk, ord, prompt``: paragraphs (doc_id, ord, text) of more than ``least`` characters, gathered until they have ``limit``."""
    long = paras.where(F.length("text") > least).withColumn("ord", F.col("ord").cast("int"))
    rows = sequences.greedy_chunks(long, limit)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "chunk").agg(F.min("ord").alias("ord"), F.array_join(parts, "\n\n").alias("prompt"))


def flow_windows(paras: DataFrame, size: int = 10) -> DataFrame:
    """``doc_id, ord, first, last, prompt``: windows of paragraphs (doc_id, para, text) that overlap by one, long ones cut in the middle."""
    rows = sequences.overlapping_windows(paras, size, size - 1, "doc_id", "para")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("P"), F.col("i").cast("string"), F.lit(": "), middle_cut(F.col("text"))).alias("t")))), lambda x: x["t"])
    found = rows.groupBy("doc_id", F.col("window").alias("ord")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.array_join(listed, "\n\n").alias("prompt"))
    return found.where("last > first")


def openers(units: DataFrame, most: int = 600, least: int = 40) -> DataFrame:
    """``doc_id, ord, trail, opener``: the first two sentences of each unit (doc_id, ord, level, title, body) with the titles it stands below.

    Front and back matter is left out, and units of next to no text of their own.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    above = [F.last(F.when(F.col("level") <= k, F.struct("ord", "level", "title")), ignorenulls=True).over(w) for k in range(relations.LEVELS)]
    rows = units.withColumn("_above", F.array(*above))
    at = F.transform(F.filter(F.sequence(F.lit(0), F.lit(relations.LEVELS - 1)), lambda k: k <= F.col("level")), lambda k: F.get(F.col("_above"), k))
    trail = F.array_distinct(F.filter(at, lambda x: x.isNotNull()))
    rows = rows.withColumn("trail", F.array_join(F.transform(trail, lambda x: x["title"]), " > ")).drop("_above")
    kept = rows.where(~F.col("title").rlike(SKIPPED_TITLES) & (F.length(F.trim("body")) >= least))
    return kept.select("doc_id", "ord", "trail", F.left(F.array_join(F.slice(sentences(F.col("body")), 1, 2), " "), F.lit(most)).alias("opener"))


def introductions(units: DataFrame, most: int = 2600) -> DataFrame:
    """``doc_id, ord, title, intro, children``: what stands between a unit's heading and its first child's, for units with children.

    ``units``: doc_id, ord, level, title, at (the place of the heading in its document's text), text (the whole text).
    """
    nxt = F.lead("at").over(Window.partitionBy("doc_id").orderBy("ord"))
    rows = units.withColumn("stop", F.coalesce(nxt, F.length("text") + 1))
    body = F.expr("substring(text, at + length(title), stop - at - length(title))")
    rows = rows.withColumn("intro", F.left(F.trim(F.regexp_replace(body, r"\s+", " ")), F.lit(most)))
    own = relations.parents(rows.select("doc_id", "ord", "level", "title")).where("parent is not null").groupBy("doc_id", F.col("parent.ord").alias("ord")).agg(F.count("*").alias("children"))
    kept = rows.join(own, ["doc_id", "ord"]).where(~F.col("title").rlike(SKIPPED_TITLES))
    return kept.select("doc_id", "ord", "title", "intro", "children")


def located(units: DataFrame, texts: DataFrame) -> DataFrame:
    """``units`` (doc_id, ord, level, title) with ``at`` and ``text``: where the title first stands in its document's text, whatever its case and white space; those that don't are left out."""
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = units.join(texts.select("doc_id", squeezed.alias("text")), "doc_id")
    title = F.trim(F.regexp_replace("title", r"\s+", " "))
    return rows.withColumn("title", title).withColumn("at", F.position(F.lower("title"), F.lower("text"))).where("at > 0")


def selected(rows: DataFrame, order: str, *, only: list[str] | None = None, key: str = "id", match: str | None = None, column: str = "title", limit: int | None = None) -> DataFrame:
    """A stated subset of rows: of some keys, whose text has a part, the first so many in order."""
    if only:
        rows = rows.where(F.col(key).isin(only))
    if match:
        rows = rows.where(F.contains(F.lower(column), F.lit(match.lower())))
    return rows.orderBy(order).limit(limit) if limit is not None else rows


def judge_with_snapshot(paras: DataFrame, results: DataFrame) -> DataFrame:
    """``doc_id, ix, introduced, forward_refs``: the outcome for every paragraph (doc_id, ix, is_caption, is_reference), reconciled.

    ``results`` (doc_id, ix, introduced, forward_refs) come from batches that all knew the same snapshot of terms. Captions and references
    are skipped but keep an empty row; a paragraph without a result has one, too. A forward reference goes if an earlier paragraph introduces it.
    """
    none = F.array().cast("array<string>")
    rows = paras.join(results, ["doc_id", "ix"], "left").withColumn("skip", F.col("is_caption") | F.col("is_reference"))
    rows = rows.select("doc_id", "ix", *[F.when(~F.col("skip"), F.coalesce(c, none)).otherwise(none).alias(c) for c in ("introduced", "forward_refs")])
    kept = sequences.introduced_before(rows.select("doc_id", "ix", "introduced", F.col("forward_refs").alias("used")))
    listed = kept.groupBy("doc_id", "ix").agg(F.array_sort(F.collect_set("term")).alias("forward_refs"))
    return rows.drop("forward_refs").join(listed, ["doc_id", "ix"], "left").withColumn("forward_refs", F.coalesce("forward_refs", none))
