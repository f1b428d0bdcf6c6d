import pytest
from pyspark.sql import functions as F

from marginalia.operators import render
from marginalia.plans import rules, tex_blocks
from marginalia.plans.fixtures import frame
from marginalia.plans.suite import run_suite, suite_status

CASES = {
    "acronyms": ("lines", {("EXPANDED-ONCE-UNUSED", 1, 13, "SVM"), ("NEVER-EXPANDED", 1, 13, "LSTM"), ("NEVER-EXPANDED", 2, 2, "RNN"), ("RE-EXPANDED", 1, 14, "DBN")}),
    "terminology": ("terms", {("NON-DICTIONARY", 1, 1, "sample"), ("NON-DICTIONARY", 2, 1, "neural net"), ("NON-DICTIONARY", 2, 2, "cost function"), ("TERM-MIX", 1, 1, "dataset, data set")}),
    "unreferenced_tex": ("tex", {("UNLABELED-EQ", 1, 13, "eqnarray"), ("UNLABELED-EQ", 1, 14, "equation"), ("UNLABELED-EQ", 3, 6, "align"), ("UNLABELED-FLOAT", 1, 10, "figure"), ("UNREFERENCED", 1, 15, "tab:t"), ("UNREFERENCED", 3, 3, "fig:out")}),
    "eqref": ("tex", {("EQNARRAY", 1, 13, "eqnarray"), ("REF-NOT-EQREF", 1, 2, "eq:a"), ("REF-NOT-EQREF", 3, 5, "eq:in")}),
    "short_captions": ("lines", {("SHORT-CAPTION", 1, 11, "Table 2")}),
    "citation_style": ("lines", {("ENTRY-STYLE", 1, 19, "authors+title"), ("REFS-NOT-NUMBERED", 2, 3, "-")}),
    "ai_disclosure": (
        "ai",
        {("IN-METHODS", 2, 2, "-"), ("NO-AI-STATEMENT", 3, 0, "-"), ("NO-TOOL-NAMED", 5, 1, "-"), ("NO-VERSION", 2, 2, "-"), ("NO-VERSION", 6, 1, "-")}
        | {("STATEMENT-FOUND", i, o, s) for i, o, s in ((1, 1, "heading"), (2, 2, "sentence"), (4, 1, "heading"), (5, 1, "heading"), (6, 1, "heading"))},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_findings(spark, name):
    fixture, want = CASES[name]
    rows = frame(spark, fixture)
    for parts in (1, 5):  # the order of rows in the input doesn't matter
        got = getattr(rules, name)(rows.repartition(parts)).collect()
        assert {(r.code, r.doc_id, r.ord, r.subject) for r in got} == want
        assert len(got) == len(want)


def test_blocks_of_tex(spark):
    df = frame(spark, "formulas").repartition(3)
    got = {(r.code, r.ord) for r in tex_blocks.formulas(df).collect()}
    assert got == {("EQ-NO-PUNCT", 5), ("EQ-PUNCT-CHECK", 1), ("EQ-PUNCT-CHECK", 10), ("LONG-INLINE", 13)}
    got = {(r.code, r.ord, r.subject) for r in tex_blocks.tex_captions(df, listed=True).collect()}
    assert got == {("SHORT-CAPTION", 14, "4"), ("NO-CAPTION", 16, "table"), ("CAPTION", 17, "8")}
    assert {(r.doc_id, r.subject) for r in tex_blocks.author_year_citations(df).collect()} == {(2, "4")}


def lines(spark, *texts, page=1):
    return spark.createDataFrame([(1, i + 1, page, t) for i, t in enumerate(texts)], "doc_id int, ord int, page int, text string")


def test_used_before_expansion(spark):
    got = rules.acronyms(lines(spark, "The CNN is used.", "A convolutional neural network (CNN) is here.", "The CNN again.", "Some odd words (XYZ) here.")).collect()
    assert {(r.code, r.ord, r.subject) for r in got} == {("USED-BEFORE-EXPANSION", 1, "CNN")}


def test_numbers_are_found_in_lists_and_over_line_ends(spark):
    captions = ["Figure 1: One", "Figure 2: Two", "Figure 3. Three", "Table 4: Four", "Table 2.2: Five", "Figure 9: Nine"]
    text = ["see Figures 1-3 and Ta-", "ble 4, or Table", "2.2 as well", "Figure 9.4 shows more", "Figure 12 .......... 3"]
    rows = [(1, i, i, t) for i, t in enumerate(captions)] + [(1, 50 + i, 50, t) for i, t in enumerate(text)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, page int, text string")
    assert {r.subject for r in rules.unreferenced_numbers(df).collect()} == {"figure 9"}


def test_bibliography(spark):
    got = {(r.id, r.code) for r in rules.bibliography(frame(spark, "bib"), frame(spark, "candidates")).collect()}
    assert {c for i, c in got if i == "h"} == {"NOT-FOUND"} and {c for i, c in got if i == "j"} == {"OK"}  # without lookups that failed


def test_the_suite_and_its_reports(spark):
    with run_suite(frame(spark, "lines")) as found:
        kinds = {r.linter for r in found.select("linter").distinct().collect()}
        assert {"acronyms", "captions", "citations", "prose", "ai"} <= kinds and "labels" not in kinds
        status = {r.script: r.status for r in suite_status(spark, found).collect()}
        assert status["acronyms"] == 1 and status["codes"] == 0
    with run_suite(frame(spark, "lines"), profile="paper") as found:
        assert "ai" not in {r.linter for r in found.select("linter").distinct().collect()}
    with pytest.raises(ValueError), run_suite(frame(spark, "lines"), profile="essay"):
        pass
    with run_suite(frame(spark, "tex"), "tex") as found:
        assert "labels" in {r.linter for r in found.collect()}
    with run_suite(frame(spark, "lines")) as found:
        check_reports(spark, found)


def check_reports(spark, found):
    assert {r.doc_id: r.code for r in render.exit_codes(found).collect()} == {1: 1, 2: 1}
    report = [r.line for r in render.report_lines(found).where("doc_id = 2").orderBy("i").collect()]
    assert report[0].startswith("[ERROR] REFS-NOT-NUMBERED") and report[-1].startswith("1 error(s)")
    assert '"code"' in render.findings_json(found).first().json
    cards = render.dashboard_cards(suite_status(spark, found)).collect()
    assert any("clean" in r.html for r in cards)
    with pytest.raises(ValueError), run_suite(frame(spark, "lines"), "docx"):
        pass


def test_catalog_renderers(spark):
    rows = frame(spark, "catalog")
    md = {(r.university, r.part, r.i): r.line for r in render.catalog_lines(rows).collect()}
    assert md["North", 0, 1] == "| 1 | Ada Birch | Sparse models, revisited |  | Acme |"
    tex = {(r.university, r.part, r.i): r.line for r in render.catalog_lines(rows, "tex").collect()}
    assert r"Graphs \& 50\% of trees" in tex["North", 1, 2] and r"Waves\_and\_noise" in tex["South", 1, 1]
    assert [r.line[:3] for r in render.catalog_lines(rows, "text").where("part = 1 and university = 'North'").orderBy("i").collect()] == ["  1", "  2", "  3"]
    topics = {r.ord: r.line for r in render.topic_lines(frame(spark, "topics")).collect()}
    assert topics[1] == "### Open data — open · easy [mailto:?subject=Open%20data]"
    text = render.one_text(render.catalog_lines(rows).where(F.col("university") == "South"), "part", "i").first().text
    assert text.count("\n") == 1
