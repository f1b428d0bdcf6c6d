"""Registered queries of the judges' families, over literal answers; what they must give is worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import render, sequences
from marginalia.plans import families, judge
from marginalia.plans.fixtures import frame
from marginalia.plans.registered import query, table, values

_NO = "no answer from model"


@query(values("doc_id, item, verdict, evidence, suggestion", *[(i, x, *(("PASS", "p. 3", "") if (i, x) == (1, "baselines") else ("UNCLEAR", _NO, ""))) for i in (1, 2) for x in families.THESIS_ITEMS]))
def x1_thesis_checklist(spark, d):
    answers = frame(spark, "answers_checklist")
    return families.checklist(answers, families.checklist_items(answers))


_PAPER = {(1, "baselines"): ("PASS", "p. 3", ""), (1, "limitations"): ("PASS", "p. 9", "")}


@query(values("doc_id, item, verdict, evidence, suggestion", *[(i, x, *_PAPER.get((i, x), ("UNCLEAR", _NO, ""))) for i in (1, 2) for x in families.PAPER_ITEMS if x != "ethics-impact"]))
def x2_paper_checklist(spark, d):
    answers = frame(spark, "answers_checklist")
    return families.checklist(answers, families.checklist_items(answers, "paper", "TMLR"))


@query("SELECT doc_id, 9::BIGINT AS n, 1::BIGINT AS ethics FROM (SELECT DISTINCT doc_id FROM answers_checklist)", ("answers_checklist",))
def x2_ethics_by_venue(spark, d):
    items = families.checklist_items(frame(spark, "answers_checklist"), "paper", "NeurIPS")
    return items.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("item") == "ethics-impact").alias("ethics"))


_SPLIT = {("Net", "train-set"): ("PASS", "p. 2"), ("Net", "test-set"): ("FAIL", "leak")}


@query(values("doc_id, method, item, verdict, evidence", *[(1, m, c, *_SPLIT.get((m, c), ("UNCLEAR", _NO))) for m in ("Net", "(unnamed method)") for c in families.SPLIT_CHECKS]))
def x3_data_split(spark, d):
    return families.data_split(frame(spark, "answers_split"))


@query(values("doc_id, code, severity, subject", (1, "ANSWERED", "INFO", "RQ1"), (1, "ANSWERED", "INFO", "RQ2"), (1, "PARTIALLY-ANSWERED", "WARN", "RQ?"), (1, "NOT-REVISITED", "WARN", "RQ2"), (2, "NO-RQS", "WARN", "-"), (3, "UNANSWERED", "WARN", "RQ1")))
def x4_research_questions(spark, d):
    return families.research_questions(frame(spark, "answers_questions"))


@query(
    values(
        "doc_id, code, severity, subject", (1, "STRONG-RQ", "INFO", "RQ1"), (1, "WEAK-RQ", "WARN", "RQ2: scope, clarity"), (1, "GAP-IDENTIFIED", "INFO", "satisfied"), (1, "DELIMITATIONS", "WARN", "missing"), (1, "RQ-ALIGNMENT", "INFO", "satisfied"), (1, "AIM-COVERAGE", "WARN", "missing"),
        (2, "NO-RQS", "WARN", "-"), (2, "GAP-IDENTIFIED", "WARN", "missing"), (2, "DELIMITATIONS", "WARN", "missing"), (2, "RQ-ALIGNMENT", "WARN", "missing"), (2, "AIM-COVERAGE", "WARN", "missing"),
    )
)
def x5_question_quality(spark, d):
    return families.question_quality(frame(spark, "answers_quality"))


@query(values("doc_id, title, code, severity, has_abstract", (1, "Waves", "FAITHFUL", "INFO", True), (1, "Trees", "NOVELTY-OVERSTATED", "WARN", False), (2, "Maps", "UNVERIFIABLE", "INFO", False)))
def x6_related_work(spark, d):
    return families.related_work(frame(spark, "works"), frame(spark, "answers_related"), frame(spark, "abstracts"))


@query(values("doc_id, title, code", (1, "Maps of the North", "RELATED-WORK-OMITTED"), (2, "Waves", "RELATED-WORK-OMITTED")))
def x6_omitted_work(spark, d):
    return families.omitted_work(frame(spark, "found"), frame(spark, "cited"), frame(spark, "answers_related"))


_CELLS = {("Figure 1", "R1"): ("ok", ""), ("Figure 1", "R3"): ("weak", "90 dpi"), ("Figure 1", "R8"): ("bad", "junk"), ("Figure 2", "R2"): ("na", ""), ("Figure 2", "R4"): ("bad", "none")}


@query(values("figure, rule, verdict, note", *[(f, r, *_CELLS.get((f, r), ("?", ""))) for f in ("Figure 1", "Figure 2", "Figure 3") for r in families.FIGURE_RULES]))
def x7_figure_rules(spark, d):
    return families.figure_cells(frame(spark, "figures"), frame(spark, "answers_figures"))


@query(values("figure, " + ", ".join(families.FIGURE_RULES), *[(f, *[families.GLYPHS[_CELLS.get((f, r), ("?",))[0]] for r in families.FIGURE_RULES]) for f in ("Figure 1", "Figure 2", "Figure 3")]))
def k9_matrix(spark, d):
    return families.figure_matrix(families.figure_cells(frame(spark, "figures"), frame(spark, "answers_figures")))


@query("SELECT figure, avg(CASE WHEN r > 245 AND g > 245 AND b > 245 THEN 1.0 ELSE 0.0 END) AS white FROM samples GROUP BY 1", ("samples",))
def a13_white_share(spark, d):
    return families.white_share(frame(spark, "samples"))


@query("SELECT figure, min(width / (points / 72.0)) AS dpi FROM rasters WHERE points > 8 GROUP BY 1", ("rasters",))
def a13_least_dpi(spark, d):
    return frame(spark, "rasters").where("points > 8").groupBy("figure").agg(F.min(F.col("width") / (F.col("points") / 72.0)).alias("dpi"))


@query(values("doc_id, unit, code, severity", (1, "1 Intro", "GOOD-INTRO", "INFO"), (1, "2 Methods", "MISSING-INTRO", "WARN"), (1, "3 Results", "WEAK-INTRO", "WARN")))
def x8_section_intros(spark, d):
    return families.section_intros(frame(spark, "intro_units"), frame(spark, "answers_units"))


@query(values("doc_id, ord, subject", (1, 1, "who?"), (2, 1, "")))
def x9_opaque_openers(spark, d):
    return families.opaque_openers(frame(spark, "answers_openers"))


@query(values("doc_id, after, quote", (1, 3, "Then"), (1, 9, "On")))
def x9_flow_breaks(spark, d):
    return families.flow_breaks(frame(spark, "answers_flow"), frame(spark, "flow_ranges"))


@query(values("doc_id, ord, first, last, prompt", (1, 0, 0, 2, "P0: text 0\n\nP1: text 1\n\nP2: text 2"), (1, 1, 2, 4, "P2: text 2\n\nP3: text 3\n\nP4: text 4")))
def x9_flow_windows(spark, d):
    return families.flow_windows(frame(spark, "flow_paras"), 3)


@query(values("doc_id, ord, trail, opener", (1, 2, "1 Start", "This is a first sentence of some length. Another one follows."), (1, 4, "1 Start > 1.1 Detail > 1.1.1 Deep", "It goes on for more than forty characters here."), (1, 5, "2 End", "The end is long enough to be judged as an opener.")))
def x9_openers_with_trails(spark, d):
    return families.openers(frame(spark, "outline"))


@query(values("doc_id, ord, i, code, subject", (1, 1, 0, "JARGON", "deep"), (1, 1, 2, "TENSE-DRIFT", "was")))
def x10_prose_findings(spark, d):
    return families.prose_findings(frame(spark, "answers_prose"))


@query(values("doc_id, ord, i, code, subject", (1, 1, 0, "JARGON", "deep")))
def p19_only_known_checks(spark, d):
    try:
        families.prose_findings(frame(spark, "answers_prose"), "jargon, poetry")
    except ValueError:
        return families.prose_findings(frame(spark, "answers_prose"), " jargon ,uncited-claim")
    raise AssertionError("an unknown check must be refused")


@query(
    """WITH RECURSIVE r AS (SELECT conv_id AS doc_id, turn AS ord, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE length(text) > 60),
    s AS (SELECT doc_id, ord, text, i, 0::BIGINT AS chunk, length(text) AS held FROM r WHERE i = 1
      UNION ALL SELECT r.doc_id, r.ord, r.text, r.i, CASE WHEN s.held >= 9000 THEN s.chunk + 1 ELSE s.chunk END, CASE WHEN s.held >= 9000 THEN length(r.text) ELSE s.held + length(r.text) END FROM s JOIN r ON r.doc_id = s.doc_id AND r.i = s.i + 1)
    SELECT doc_id, chunk, min(ord) AS ord, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS prompt FROM s GROUP BY 1, 2"""
)
def x10_chunk_requests(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")
    return families.chunk_requests(rows).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("ord").cast("long").alias("ord"), "prompt")


@query(values("doc_id, chunk, ord, prompt", (1, 0, 1, "a" * 61 + "\n\n" + "b" * 70), (1, 1, 4, "c" * 80)))
def x10_chunks_of_a_size(spark, d):
    return families.chunk_requests(frame(spark, "prose_paras"), 100)


@query(values("doc_id, ord, label, violated", (1, 2, "Figure 2", "self-contained"), (1, 3, "Figure 3", "(unspecified)"), (1, 16, "Figure 16", "sentence-form, states-what-shown")))
def x11_weak_captions(spark, d):
    return families.weak_captions(frame(spark, "weak_caps"), frame(spark, "answers_captions"))


@query(values("doc_id, ix, introduced, forward_refs", (1, 0, "kernel", "widget"), (1, 1, "", ""), (1, 2, "gizmo", "gizmo,widget"), (1, 3, "", ""), (1, 4, "", "")))
def t2_t5_snapshot_and_reconcile(spark, d):
    """Skipped rows keep an empty result, so what a caption introduced doesn't count; plurals do."""
    out = families.judge_with_snapshot(frame(spark, "snapshot_paras"), frame(spark, "snapshot_results"))
    return out.select("doc_id", "ix", F.array_join("introduced", ",").alias("introduced"), F.array_join("forward_refs", ",").alias("forward_refs"))


@query(values("doc_id, i, code, severity, subject", (1, 0, "RANGE", "WARN", "p > 1"), (1, 1, "BRIDGE-LOOSE", "INFO", "a ~ b"), (1, 2, "UNCLEAR", "INFO", "")))
def x13_type_findings(spark, d):
    return families.type_findings(frame(spark, "answers_types"))


@query(values("doc_id, place, id, code, severity, claim", (1, 1, "C2", "ASSERTED", "WARN", "new"), (1, 2, "C3", "PARTIAL", "WARN", "small"), (1, 3, "C9", "SUPPORTED", "INFO", "fast")))
def x14_o5_claims_weakest_first(spark, d):
    return families.supported_claims(frame(spark, "answers_claims"))


@query("SELECT doc_id, sum(coalesce(json_extract(usage, '$.total_tokens')::BIGINT, 0))::BIGINT AS tokens FROM usages GROUP BY 1", ("usages",))
def a14_token_sums(spark, d):
    return families.token_sums(frame(spark, "usages"))


@query(values("doc_id, ord, title, intro, children", (1, 1, "1 Start", "here is the intro.", 2)))
def w21_text_between_headings(spark, d):
    """A unit's introduction: what stands between its heading and its first child's."""
    units = families.located(frame(spark, "unit_titles"), frame(spark, "unit_texts"))
    return families.introductions(units)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND contains(lower(event_type), 'vi') ORDER BY event_id LIMIT 25")
def p12_selected(spark, d):
    return families.selected(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", only=["view", "click"], key="event_type", match="VI", column="event_type", limit=25)


@query("SELECT doc_id, ord, title FROM outline WHERE NOT regexp_matches(title, '(?i)^(contents|abstract|references|bibliography|symbols|abbreviations|preface|acknowledg)')", ("outline",))
def p16_without_front_matter(spark, d):
    return frame(spark, "outline").where(~F.col("title").rlike(families.SKIPPED_TITLES)).select("doc_id", "ord", "title")


@query("SELECT conv_id, turn FROM conversations WHERE length(text) > 60")
def p15_long_paragraphs(spark, d):
    return table(spark, d, "conversations").where(F.length("text") > 60).select("conv_id", "turn")


@query("SELECT conv_id AS doc_id, b AS batch, 'Judge:' || chr(10) || string_agg(turn || '. ' || text, chr(10) ORDER BY turn) AS prompt FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 15 AS b FROM conversations) GROUP BY 1, 2")
def x0_requests(spark, d):
    return judge.requests(table(spark, d, "conversations"), 15, "Judge:", "conv_id", "turn")


@query(
    values(
        "doc_id, i, line", (1, 1, "| a | PASS | p. 3 |"), (1, 2, "| b | FAIL | none **Fix:** add |"), (1, 3, "| c | ODD | ? |"), (1, 4, "1 FAIL, 1 UNCLEAR, 1 PASS"),
    )
)
def k13_verdict_report(spark, d):
    rows = [(1, 2, "b", "FAIL", "none", "add"), (1, 1, "a", "PASS", "p. 3", ""), (1, 3, "c", "ODD", "?", "")]
    return render.verdict_report(spark.createDataFrame(rows, "doc_id int, place int, item string, verdict string, evidence string, suggestion string"))


@query(values("verdict, n", ("PASS", 2), ("UNCLEAR", 14)))
def k13_tally(spark, d):
    answers = frame(spark, "answers_checklist")
    return judge.tally(families.checklist(answers, families.checklist_items(answers, "paper")))


@query("SELECT conv_id AS doc_id, turn AS ix, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def t4_remaining_requests(spark, d):
    """Of all turns those that no answer is kept for: the first of each conversation, here."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ix"), "text")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("ix")) == 1
    done = rows.withColumn("answer", F.when(~first, F.lit("{}"))).drop("text")
    return judge.remaining(rows, done, "doc_id", "ix")


@query(values("doc_id, seq, ord", (1, 1, 1), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6), (1, 6, 7), (1, 7, 9), (1, 8, 10), (1, 9, 12), (1, 10, 13), (1, 11, 14), (1, 12, 15), (2, 1, 1), (2, 2, 2)))
def w2_sequence_of_kept_lines(spark, d):
    """Lines of the body that are neither captions nor table of contents, numbered."""
    from marginalia.plans import rules

    return rules.kept_lines(frame(spark, "lines")).select("doc_id", "seq", "ord")


def windows(rows: DataFrame) -> DataFrame:
    """Windows of ten paragraphs that overlap by one."""
    return sequences.overlapping_windows(rows, 10, 9, "conv_id", "turn")


@query(
    """WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    w AS (SELECT conv_id, turn, i, n, unnest(generate_series(greatest(0, ceil((i - 9) / 9.0))::BIGINT, i // 9)) AS "window" FROM n)
    SELECT conv_id, turn, i, "window" FROM w WHERE "window" * 9 < n - 1 OR (n = 1 AND "window" = 0)"""
)
def w8_windows_of_ten(spark, d):
    return windows(table(spark, d, "conversations").select("conv_id", "turn"))
