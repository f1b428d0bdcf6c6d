"""Registered queries of sources over files they write themselves, of services' answers, outlines, figures, and of whole reports."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.similarity import similarity
from marginalia.operators import layout, render
from marginalia.plans import rules
from marginalia.plans.fixtures import frame
from marginalia.plans.registered import query, table, values
from marginalia.sources import bibtex, files, lookups, outlines
from marginalia.streaming.introduced import running_terms


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for files of a query: below the one that the cluster shares, or of this machine if Spark runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='files-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, name: str, text: str) -> str:
    """The path of a file of this name and content, in a folder of its own."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder(spark, 'file')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(text.encode()))
    out.close()
    return path.toString()


# ---- sources -------------------------------------------------------------------------------------------------

_THESES = 'number,author,title,university,status,date,industry,url,recording\n1,Ada Birch,"Sparse, and ""quoted""",North,ongoing,,Acme,,\n2,Ben Cole,"Two\nlines",South,completed,Aug. 2024,,https://example.org,\n'


@query(values("ord, number, author, title, date, url", (0, 1, "Ada Birch", 'Sparse, and "quoted"', "", ""), (1, 2, "Ben Cole", "Two\nlines", "Aug. 2024", "https://example.org")))
def s1_theses_csv(spark, d):
    return files.read_theses(spark, written(spark, "theses.csv", _THESES)).select("ord", "number", "author", "title", "date", "url")


@query(values("ord, id, title, area, refs", (0, 7, "Wide nets", "", "a|b"), (1, 8, "Deep", "Learning", "")))
def s2_topics_csv(spark, d):
    text = "id,title,area,data_source,difficulty,status,description,url,references\n7,Wide nets,,web,easy,open,,,a|b\n8,Deep,Learning,,,open,,,\n"
    return files.read_topics(spark, written(spark, "topics.csv", text)).select("ord", "id", "title", "area", F.col("references").alias("refs"))


def _tex_folder(spark: SparkSession) -> str:
    path = written(spark, "main.tex", "\\section{One} % x\nHalf is 50\\% here")
    spark.createDataFrame([(r"\ref{a} \\% tail",)], "value string").coalesce(1).write.text(path.rsplit("/", 1)[0] + "/parts")
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(top.toString() + "/parts/part-*")):
        fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(top.toString() + "/parts/b.tex"))
    return top.toString()


@query(values("name, line_no, text, clean", ("main.tex", 1, r"\section{One} % x", r"\section{One} "), ("main.tex", 2, r"Half is 50\% here", r"Half is 50\% here"), ("b.tex", 1, r"\ref{a} \\% tail", r"\ref{a} \\")))
def s4_s5_s7_tex_lines(spark, d):
    lines = files.read_tex(spark, _tex_folder(spark)).where("text <> ''")
    return lines.select(F.element_at(F.split("file", "/"), -1).alias("name"), "line_no", "text", tx.strip_tex_comment(F.col("text")).alias("clean"))


@query(values("mode, n", ("tex", 3), ("pdf", 2), ("mixed", 0), ("empty", 0)))
def s6_modes_of_inputs(spark, d):
    """A folder of TeX is read as TeX, extracted texts page by page, with so many lines that aren't blank; a mix of both and inputs without text are refused."""
    tex, pages = _tex_folder(spark), written(spark, "thesis.txt", "one\ftwo")
    out = []
    for paths in ([tex], [pages]):
        lines, mode = files.read_lines(spark, paths)
        out.append((mode, lines.where(F.trim("text") != "").count()))
    for name, paths in (("mixed", [tex, pages]), ("empty", [written(spark, "none.txt", "")])):
        try:
            files.read_lines(spark, paths)
        except ValueError:
            out.append((name, 0))
    return spark.createDataFrame(out, "mode string, n int")


_BIBTEX = '@comment{x}\n@article{a1, author = {Birch, Ada and Cole, Ben}, title = {Deep {Nets} of\n Things}, journal = {J. Nets}, year = 2020}\n@misc{b2, title = "Waves", note = {arXiv:1801.00001}, howpublished = "Web", url = {https://x.org}}\n@string{y = 1}'


@query(values("id, kind, title, authors, venue, year, arxiv, url", ("a1", "article", "Deep Nets of Things", "Birch, Ada;Cole, Ben", "J. Nets", "2020", "", ""), ("b2", "misc", "Waves", "", "Web", "", "1801.00001", "https://x.org")))
def s8_bibtex(spark, d):
    texts = spark.createDataFrame([(1, _BIBTEX)], "doc_id long, text string")
    return bibtex.parse_bibtex(texts).select("id", "kind", "title", F.array_join("authors", ";").alias("authors"), "venue", "year", "arxiv", "url")


@query(
    values(
        "num, authors, title, year, arxiv", ("1", "A. Birch;B. Cole", "A title of note", "2020", ""), ("2", "C. Dunn", "Waves", "2019", "1801.00001"), ("3", "", "", "2021", ""),
    )
)
def s10_f10_reference_entries(spark, d):
    rows = [('[1] A. Birch, and B. Cole, "A title of note," J. Nets, 2020.',), ('[2] C. Dunn et al., “Waves,” arXiv:1801.00001, 2018, https://x.org/2030, 2019.',), ("[3] Someone, no quotes, 2021.",)]
    e = bibtex.listed_reference(F.col("entry")).alias("e")
    return spark.createDataFrame(rows, "entry string").select(e).select("e.num", F.array_join("e.authors", ";").alias("authors"), "e.title", "e.year", "e.arxiv")


@query(values("doc_id, entry, text", (1, 1, "[1] A. Birch, A title."), (1, 2, "[2] C. Dunn, Waves, a long enough entry with many more words in it so that what follows is far away.")))
def s9_references_before_an_appendix(spark, d):
    texts = ["References", "[1] A. Birch, A title.", "[2] C. Dunn, Waves, a long enough entry with many more", "words in it so that what follows is far away.", "Appendix", "[3] not an entry"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, ord int, text string")
    from marginalia.operators.sequences import reference_entries

    return reference_entries(lines, appendix=True).select("doc_id", "entry", "text")


@query(values("doc_id, ix, page, text, is_caption, is_reference", (1, 0, 1, "Figure 2: A", True, False), (1, 1, 1, "Some text", False, False), (1, 2, 2, "[ 3 ] A. Birch", False, True)))
def s11b_p9_blocks_without_boilerplate(spark, d):
    rows = [(1, 1, 1, "  Figure 2: A"), (1, 2, 1, "   "), (1, 3, 1, "Some text"), (1, 4, 2, "[ 3 ] A. Birch")]
    return outlines.text_blocks(spark.createDataFrame(rows, "doc_id int, ord int, page int, text string"))


@query(values("doc_id, ord, kind, num, bold, height", (1, 1, "figure", "2", False, 800.0), (1, 2, "equation", "3", False, 800.0), (1, 3, "section", "5.1", True, 800.0), (1, 4, "", "", True, 800.0), (1, 5, "", "", False, 800.0)))
def s12_lines_of_spans(spark, d):
    """Lines are joined spans: bold if any is, an equation's if a span far to the right is its number; with the median page height."""
    spans = [(1, 1, 1, 0, "Figure 2", 50.0, 90.0, False), (1, 1, 1, 1, ": Cap", 90.0, 120.0, False), (1, 2, 1, 0, "a = b", 50.0, 90.0, False), (1, 2, 1, 1, " (3) ", 500.0, 520.0, False), (1, 3, 2, 0, "5.1 ", 50.0, 60.0, True), (1, 3, 2, 1, "Foo", 60.0, 80.0, False), (1, 4, 2, 0, "Bold text", 50.0, 80.0, True), (1, 5, 2, 0, "(4)", 50.0, 60.0, False)]
    pages = [(1, 1, 600.0, 800.0), (1, 2, 600.0, 790.0), (1, 3, 600.0, 810.0)]
    lines = layout.lines_of_spans(spark.createDataFrame(spans, "doc_id int, ord int, page int, i int, text string, x0 double, x1 double, bold boolean"), spark.createDataFrame(pages, "doc_id int, page int, width double, height double"))
    return lines.select("doc_id", "ord", "kind", "num", "bold", "height")


@query(values("doc_id, ord, level, number, title, page", (1, 1, 1, "1", "Introduction", 3), (1, 2, 2, "1.2", "Aims", 4), (1, 3, 1, "A", "Data", 9), (1, 4, 1, None, "References", 12)))
def s13_bookmarks(spark, d):
    rows = [(1, 1, 1, "1 Introduction", 3), (1, 2, 2, "1.2. Aims", 4), (1, 3, 1, " A Data", 9), (1, 4, 1, "References", 12)]
    return outlines.bookmark_units(spark.createDataFrame(rows, "doc_id int, ord int, level int, title string, page int"))


@query(values("doc_id, ord, level, title, page", (1, 1, 1, "One", 1), (2, 2, 1, "2 Methods", 3), (2, 4, 2, "2.1 Data used", 3)))
def s13_outline_of_bookmarks_or_headings(spark, d):
    marks = spark.createDataFrame([(1, 1, 1, " One ", 1), (1, 2, 1, "Lost", 0)], "doc_id int, ord int, level int, title string, page int")
    lines = [(1, 1, 1, "1 Ignored"), (2, 1, 1, "2 Methods ..... 3"), (2, 2, 3, " 2 Methods "), (2, 3, 3, "text"), (2, 4, 3, "2.1 Data used")]
    return outlines.outline(marks, spark.createDataFrame(lines, "doc_id int, ord int, page int, text string"))


@query(values("doc_id, page, figure, x0, y0, x1, y1, dpi", (1, 1, "1", 100.0, 150.0, 300.0, 380.0, 150.0), (1, 2, "2.1", 36.0, 120.0, 564.0, 298.0, None)))
def s18_figure_regions(spark, d):
    long = "A paragraph that is long enough to stop a figure from going further up the page."
    blocks = [(1, 1, long, 50.0, 50.0, 550.0, 140.0), (1, 1, "Figure 1: One", 50.0, 400.0, 550.0, 420.0), (1, 2, long, 50.0, 50.0, 550.0, 120.0), (1, 2, "Fig. 2.1. Two", 50.0, 300.0, 550.0, 320.0), (1, 3, "Figure 3 shows that", 50.0, 300.0, 550.0, 320.0)]
    images = [(1, 1, 100.0, 150.0, 244.0, 300.0, 300), (1, 1, 100.0, 500.0, 200.0, 600.0, 50)]
    drawings = [(1, 1, 120.0, 200.0, 300.0, 380.0), (1, 1, 0.0, 200.0, 10.0, 380.0), (1, 2, 40.0, 200.0, 70.0, 225.0)]
    pages = [(1, p, 600.0, 800.0) for p in (1, 2, 3)]
    box = "doc_id int, page int, {}x0 double, y0 double, x1 double, y1 double{}"
    return outlines.figure_regions(*[spark.createDataFrame(r, s) for r, s in ((blocks, box.format("text string, ", "")), (images, box.format("", ", px int")), (drawings, box.format("", "")), (pages, "doc_id int, page int, width double, height double"))])


@query(values("doc_id, size", (1, 10.5), (2, 11.0)))
def s18_body_size(spark, d):
    """The upper median of four long spans; a document without any takes the usual size."""
    long = "text of more than twenty letters"
    rows = [(1, 1, long, 9.96), (1, 1, long, 10.0), (1, 2, long, 10.5), (1, 2, long, 12.0), (1, 2, "short", 30.0), (1, 31, long, 40.0), (2, 1, "short", 8.0)]
    return outlines.body_size(spark.createDataFrame(rows, "doc_id int, page int, text string, size double"))


_CROSSREF = json.dumps({"message": {"items": [{"title": ["Waves"], "author": [{"family": "Eck"}, {}], "container-title": ["Waves Letters"], "issued": {"date-parts": [[2021, 3]]}, "type": "journal-article", "DOI": "10.1/x"}, {"title": [], "publisher": "Press"}, *[{"title": [f"T{i}"]} for i in range(6)]]}})
_DBLP = json.dumps({"result": {"hits": {"hit": [{"info": {"title": "Waves", "authors": {"author": [{"text": "Di Eck 0002"}, {"text": "Flo Gale"}]}, "venue": "WL", "year": "2021", "type": "Journal Articles"}}, {"info": {"title": "Alone", "authors": {"author": {"text": "Ed Frost"}}}}]}}})
_S2 = json.dumps({"title": "Waves at Last", "venue": "NeurIPS", "year": 2022, "authors": [{"name": "Di Eck"}, {"name": ""}], "externalIds": {"DOI": "10.2/y"}})
_ATOM = "<feed><entry><title>Quiet\n  Fields</title><published>2021-01-05T00:00</published><author><name>Hal Iris</name></author><author><name>Jo Kay</name></author></entry></feed>"
_ANSWERS = {"crossref": _CROSSREF, "dblp": _DBLP, "semantic_scholar": _S2, "arxiv": _ATOM}


@query(
    values(
        "bib_id, ord, source, title, authors, venue, year, type, doi",
        ("b", 1, "crossref", "Waves", "Eck;", "Waves Letters", "2021", "journal-article", "10.1/x"), ("b", 2, "crossref", "", "", "Press", "", "", ""), ("b", 3, "crossref", "T0", "", "", "", "", ""), ("b", 4, "crossref", "T1", "", "", "", "", ""), ("b", 5, "crossref", "T2", "", "", "", "", ""),
        ("b", 1, "dblp", "Waves", "Eck;Gale", "WL", "2021", "Journal Articles", ""), ("b", 2, "dblp", "Alone", "Frost", "", "", "", ""), ("b", 1, "s2", "Waves at Last", "Eck", "NeurIPS", "2022", "record", "10.2/y"), ("b", 1, "arxiv", "Quiet Fields", "Iris;Kay", "arXiv", "2021", "preprint", ""),
    )
)
def s20_o8_candidates_of_services(spark, d):
    parts = [getattr(lookups, name)(spark.createDataFrame([("b", body), ("c", "{}")], "bib_id string, body string")) for name, body in _ANSWERS.items()]
    out = rules.together(*parts)
    return out.withColumn("authors", F.array_join("authors", ";"))


@query(values("bib_id, ord, title, abstract, year", ("b", 1, "Waves", "the waves and the sea", 2021), ("b", 2, "", "", None)))
def s21_works_with_abstracts(spark, d):
    body = json.dumps({"results": [{"title": " Waves ", "publication_year": 2021, "abstract_inverted_index": {"the": [0, 3], "waves": [1], "and": [2], "sea": [9]}}, {}]})
    return lookups.openalex(spark.createDataFrame([("b", body)], "bib_id string, body string"))


@query(values("item, answer", ("a", "one"), ("b", "two")))
def s22_cached_answers(spark, d):
    path = written(spark, "cache.jsonl", '{"item": "a", "answer": "one"}\nbroken {\n{"item": "b", "answer": "two"}\n')
    return files.read_answers(spark, path, "item string, answer string").where("item is not null")


@query("SELECT doc_id, ix FROM cached", ("cached",))
def k11_k12_checkpoint_of_results(spark, d):
    """Results are appended as lines of JSON, written anew as a whole, and read back."""
    rows, path = frame(spark, "cached"), folder(spark, "cache")
    files.append_answers(rows.where("doc_id = 1"), path)
    files.append_answers(rows.where("doc_id > 1"), path)
    again = files.read_answers(spark, path, "doc_id int, ix int")
    return files.rewrite_answers(again, folder(spark, "final"), "doc_id int, ix int")


@query(values("i, script, body", (0, "one", "[WARN] x"), (1, "two", "clean")))
def s23_transcript(spark, d):
    texts = spark.createDataFrame([(1, "start\n>>> one.py\n[WARN] x\n\n>>> two.py a\nclean\n")], "doc_id int, text string")
    return files.transcript_sections(texts).select("i", "script", "body")


@query(values("doc_id, location, kind, name, label, size", (1, 6, "section", "One", "a", 37), (1, 43, "subsection", "Two", "b", 31), (1, 74, "section", "Three", "c", 25)))
def s24_sections_of_a_text(spark, d):
    whole = "intro " + r"\section{One} \label{a} see \ref{b}." + "\n" + r"\subsection{Two}\label{b} more" + "\n" + r"\section{Three}" + "\n" + r"\label{c}"
    texts = spark.createDataFrame([(1, whole), (2, "none")], "doc_id int, text string")
    return outlines.labelled_sections(texts).select("doc_id", "location", "kind", "name", "label", F.length("text").alias("size"))


@query(values("file, sha", ("a.txt", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")))
def s25_f24_digests(spark, d):
    """The digest of a file that says abc, as a list of digests has it."""
    path = written(spark, "a.txt", "abc")
    sums = files.read_manifest(spark, written(spark, "SUMS", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad  a.txt\n"))
    return files.digest_files(spark, path.rsplit("/", 1)[0], "*.txt").join(sums, ["file", "sha"], "left_semi")


@query(values("doc_id, ord, level, title", (1, 1000, 1, "Start"), (1, 3000, 2, "In"), (1, 3001, 1, "Next")))
def s14_tex_units(spark, d):
    rows = [(1, 1, r"\section[s]{Start}"), (1, 2, r"\section*{None}"), (1, 3, r"\subsection{In} \section{Next}")]
    return files.tex_units(spark.createDataFrame(rows, "doc_id int, ord int, text string"))


@query(values("doc_id, ord, number, level, title", (1, 1, "1", 1, "Start"), (1, 3, "1.1", 2, "In"), (1, 5, "2", 1, "End")))
def s15_scanned_headings(spark, d):
    rows = [(1, 1, "1 Start"), (1, 2, "3.1 Orphan"), (1, 3, "1.1 In"), (1, 4, "1 Start again"), (1, 5, "2. End"), (1, 6, "99 Balloons")]
    return files.scanned_units(spark.createDataFrame(rows, "doc_id int, ord int, text string"))


@query("SELECT doc_id, ord, page, line_no, text FROM (VALUES (1, 1, 1, 1, 'one'), (1, 2, 1, 2, 'two'), (1, 3, 1, 3, ''), (1, 4, 2, 1, 'three'), (1, 5, 2, 2, '')) t(doc_id, ord, page, line_no, text)")
def s17_pages_of_a_text(spark, d):
    return files.page_lines(frame(spark, "paged").where("doc_id = 1")).select("doc_id", "ord", "page", "line_no", "text")


# ---- text ----------------------------------------------------------------------------------------------------


@query(values("bib_id, ord, sim", ("a", 1, 1.0), ("a", 2, 0.7222), ("b", 1, 0.8), ("c", 1, 1.0), ("d", 1, 0.3704), ("f", 1, 1.0), ("g", 1, 1.0), ("g", 2, 0.7273), ("j", 1, 1.0), ("k", 1, 1.0), ("l", 1, 1.0)))
def f8_title_similarity(spark, d):
    """The ratio of matching blocks of the titles of entries and candidates; the values are those of Python's difflib."""
    bib = frame(spark, "bib").select(F.col("id").alias("bib_id"), F.col("title").alias("cited"))
    found = frame(spark, "candidates").join(bib, "bib_id")
    return found.select("bib_id", "ord", F.round(similarity(tx.plain_title(F.col("cited")), tx.plain_title(F.col("title"))), 4).alias("sim"))


@query(values("a, b, ratio", ("tide", "diet", 0.25), ("diet", "tide", 0.5), ("", "", 1.0), ("abc", "", 0.0), ("hasselbacher", "r hasselbaecher", 0.8889)))
def f8_ratio_is_not_symmetric(spark, d):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", ""), ("hasselbacher", "r hasselbaecher")], "a string, b string")
    return rows.select("a", "b", F.round(similarity(F.col("a"), F.col("b")), 4).alias("ratio"))


@query(values("text, kept", (r"the \cite{ABC} of \textbf{CNN} and $DBN_1$", "the   of  {CNN} and  "), (r"see \cref{X} NN", "see   NN")))
def f4_plain_tex_lines(spark, d):
    rows = spark.createDataFrame([(r"the \cite{ABC} of \textbf{CNN} and $DBN_1$",), (r"see \cref{X} NN",)], "text string")
    return rows.select("text", rules.plain_line(F.col("text"), "tex").alias("kept"))


@query(values("text, terms", ("Kernel methods, the SVM, and a few  things", "kernel methods;svm"), ("of; the", ""), ("(Widgets) or gadgets.", "widgets;gadgets")))
def f14_p10_split_terms(spark, d):
    rows = spark.createDataFrame([("Kernel methods, the SVM, and a few  things",), ("of; the",), ("(Widgets) or gadgets.",)], "text string")
    return rows.select("text", F.array_join(tx.split_terms(F.col("text")), ";").alias("terms"))


@query(values("text, terms", ("We define the gain ratio as a quotient.", "gain ratio"), ("A support vector machine (SVM) separates.", "support vector machine;svm"), ("Let x denote inputs.", ""), ("Loss denotes cost", "loss")))
def w11_introduced_terms(spark, d):
    rows = spark.createDataFrame([("We define the gain ratio as a quotient.",), ("A support vector machine (SVM) separates.",), ("Let x denote inputs.",), ("Loss denotes cost",)], "text string")
    return rows.select("text", F.array_join(F.array_sort(tx.introduced_terms(F.col("text"))), ";").alias("terms"))


@query("SELECT conv_id, max(turn) AS at, array_to_string(list_sort(list(DISTINCT lower(trim(role)))), ',') AS terms FROM conversations GROUP BY 1")
def t1_running_terms(spark, d):
    """The terms (roles, here) that a document has introduced, as the stream keeps them, and the last place that brought one."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ix"), F.array("role").alias("introduced"))
    return running_terms(rows).select(F.col("doc_id").alias("conv_id"), "at", F.array_join("terms", ",").alias("terms"))


# ---- rules of whole documents ----------------------------------------------------------------------------------


@query(values("doc_id, code, severity, ord, subject", (1, "STATEMENT-FOUND", "INFO", 3, "heading"), (2, "STATEMENT-FOUND", "INFO", 2, "sentence"), (2, "NO-TOOL-NAMED", "WARN", 2, "-"), (2, "IN-METHODS", "WARN", 2, "-"), (3, "STATEMENT-FOUND", "INFO", 4, "sentence"), (3, "NO-VERSION", "WARN", 4, "-")))
def rule_ai_disclosure_tex(spark, d):
    return rules.ai_disclosure(frame(spark, "ai_tex"), mode="tex")


@query(values("doc_id, code, severity, ord, subject", (2, "FORWARD-FLOAT", "WARN", 3, "figure 9")))
def rule_forward_floats(spark, d):
    return rules.forward_floats(frame(spark, "numbered"))


@query(values("doc_id, code, severity, ord, subject", (1, "FORWARD-CONCEPT", "WARN", 1, "gain ratio")))
def rule_forward_concepts(spark, d):
    texts = ["Gain ratios matter.", "", "We define the gain ratio as a quotient.", "", "The gain ratio again.", "References", "[1] Gain ratio"]
    return rules.forward_concepts(spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id int, ord int, text string"))


@query("SELECT doc_id, 'VENUE-SKIP' AS code, 'INFO' AS severity, 0 AS ord, '-' AS subject FROM (SELECT DISTINCT doc_id FROM lines)", ("lines",))
def rule_venue_skip(spark, d):
    return rules.citation_style(frame(spark, "lines"), ieee=False)


# ---- sinks ---------------------------------------------------------------------------------------------------

_PARTS = """c AS (SELECT *, CASE WHEN lower(status) = 'ongoing' THEN 0 ELSE 1 END AS part FROM catalog),
    p AS (SELECT *, min(ord) OVER (PARTITION BY university) AS place, count(*) OVER (PARTITION BY university) AS total, count(*) OVER (PARTITION BY university, part) AS n, row_number() OVER (PARTITION BY university, part ORDER BY ord) AS i FROM c)"""


@query(
    f""", {_PARTS}, r AS (SELECT *, CASE WHEN recording <> '' THEN '[video](' || recording || ')' ELSE '' END AS v, CASE WHEN url <> '' THEN '[' || title || '](' || url || ')' ELSE title END AS t FROM p),
    l AS (SELECT DISTINCT place, -1 AS part, -1 AS i, '## ' || university || ' (' || total || ' total)' || chr(10) AS line FROM r
      UNION ALL SELECT DISTINCT place, part, -1, CASE part WHEN 0 THEN '### Ongoing (' || n || ')' || chr(10) || chr(10) || '| # | Author | Title | Industry | Recording |' || chr(10) || '|---|--------|-------|----------|-----------|' ELSE '### Completed (' || n || ')' || chr(10) || chr(10) || '| # | Author | Title | Date | Industry | Recording |' || chr(10) || '|---|--------|-------|------|----------|-----------|' END FROM r
      UNION ALL SELECT place, part, i, CASE part WHEN 0 THEN '| ' || i || ' | ' || author || ' | ' || title || ' | ' || industry || ' | ' || v || ' |' ELSE '| ' || i || ' | ' || author || ' | ' || t || ' | ' || date || ' | ' || industry || ' | ' || v || ' |' END || CASE WHEN i = n THEN chr(10) ELSE '' END FROM r)
    SELECT '# Theses' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY place, part, i) AS text FROM l""",
    ("catalog",),
)
def k1_markdown_catalog(spark, d):
    return render.catalog_document(frame(spark, "catalog"), "Theses")


_TEX = "regexp_replace({}, '([&%$#_{{}}])', '\\\\\\1', 'g')"


@query(
    f""", {_PARTS}, r AS (SELECT *, {_TEX.format("author")} AS ta, {_TEX.format("title")} AS tt, {_TEX.format("date")} AS td, {_TEX.format("industry")} AS ti, CASE WHEN recording <> '' THEN '\\href{{' || recording || '}}{{video}}' ELSE '' END AS v FROM p),
    l AS (SELECT DISTINCT place, -1 AS part, -1 AS i, '\\section*{{' || {_TEX.format("university")} || ' (' || total || ' total)}}' || chr(10) AS line FROM r
      UNION ALL SELECT DISTINCT place, part, -1, '\\subsection*{{' || CASE part WHEN 0 THEN 'Ongoing' ELSE 'Completed' END || ' (' || n || ')}}' || chr(10) || chr(10) || CASE part WHEN 0 THEN '\\begin{{longtable}}{{@{{}}r p{{3cm}} p{{6.5cm}} p{{2.8cm}} p{{2cm}}@{{}}}}' ELSE '\\begin{{longtable}}{{@{{}}r p{{2.8cm}} p{{6.3cm}} p{{1.6cm}} p{{2cm}} p{{1.8cm}}@{{}}}}' END || chr(10) || '\\toprule' || chr(10) || CASE part WHEN 0 THEN '\\# & Author & Title & Industry & Recording \\\\' ELSE '\\# & Author & Title & Date & Industry & Recording \\\\' END || chr(10) || '\\midrule' || chr(10) || '\\endhead' || chr(10) || '\\bottomrule' || chr(10) || '\\endfoot' FROM r
      UNION ALL SELECT place, part, i, CASE part WHEN 0 THEN i || ' & ' || ta || ' & ' || tt || ' & ' || ti || ' & ' || v ELSE i || ' & ' || ta || ' & ' || CASE WHEN url <> '' THEN '\\href{{' || url || '}}{{' || tt || '}}' ELSE tt END || ' & ' || td || ' & ' || ti || ' & ' || v END || ' \\\\' || CASE WHEN i = n THEN chr(10) || '\\end{{longtable}}' || chr(10) ELSE '' END FROM r)
    SELECT concat_ws(chr(10), '\\documentclass[11pt,a4paper]{{article}}', '\\usepackage[T1]{{fontenc}}', '\\usepackage[margin=2cm]{{geometry}}', '\\usepackage{{longtable,array,booktabs}}', '\\usepackage[hidelinks]{{hyperref}}', '\\title{{Theses}}', '\\begin{{document}}', '\\maketitle', '', string_agg(line, chr(10) ORDER BY place, part, i), '\\end{{document}}', '') AS text FROM l""",
    ("catalog",),
)
def k2_tex_catalog(spark, d):
    return render.catalog_document(frame(spark, "catalog"), "Theses", "tex")


@query(
    """, g AS (SELECT *, coalesce(nullif(area, ''), 'Other') AS grp, min(ord) OVER (PARTITION BY coalesce(nullif(area, ''), 'Other')) AS place, list_filter(list_transform(string_split(refs, '|'), lambda x: trim(x)), lambda x: x <> '') AS r FROM topics),
    m AS (SELECT *, concat_ws(' · ', CASE WHEN difficulty <> '' THEN '**Difficulty:** ' || difficulty END, CASE WHEN data_source <> '' THEN '**Data source:** ' || data_source END, CASE WHEN lower(status) <> 'open' THEN '**Status:** ' || status END) AS meta FROM g),
    l AS (SELECT DISTINCT place, -1 AS ord, '## ' || grp || chr(10) AS line FROM m
      UNION ALL SELECT place, ord, concat_ws(chr(10), '### ' || title || chr(10), CASE WHEN meta <> '' THEN meta || chr(10) END, CASE WHEN description <> '' THEN description || chr(10) END, CASE WHEN url <> '' THEN '[Read the full proposal](' || url || ')' || chr(10) END,
        CASE WHEN len(r) > 0 THEN '**References**' || chr(10) || chr(10) || array_to_string(list_transform(r, lambda x, i: i || '. ' || x), chr(10)) || chr(10) END, '[Ask about this topic](mailto:me@example.org?subject=Thesis%20topic:%20' || replace(title, ' ', '%20') || ')' || chr(10)) FROM m)
    SELECT '# Topics' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY place, ord) AS text FROM l""",
    ("topics",),
)
def k3_topics_document(spark, d):
    return render.topics_document(frame(spark, "topics"), "Topics", "me@example.org")


@query(
    f""", {_PARTS}, l AS (SELECT DISTINCT place, -1 AS i, chr(10) || repeat('=', 70) || chr(10) || '  ' || university || '  (' || total || ' theses)' || chr(10) || repeat('=', 70) AS line FROM p
      UNION ALL SELECT place, ord, '  ' || lpad(number::VARCHAR, 3, ' ') || '. ' || author || ', ' || title || CASE WHEN part = 0 THEN ' [ongoing]' ELSE '' END || CASE WHEN industry <> '' THEN '  (industry: ' || industry || ')' ELSE '' END || CASE WHEN url <> '' THEN chr(10) || '       ' || url ELSE '' END FROM p)
    SELECT string_agg(line, chr(10) ORDER BY place, i) AS text FROM l""",
    ("catalog",),
)
def k4_p18_console_summary(spark, d):
    return render.console_summary(frame(spark, "catalog"))


@query(
    """, y AS (SELECT list_filter(string_split(replace(date, ',', ' '), ' '), lambda w: regexp_full_match(w, '[0-9]{4}'))[1] AS year, count(*) AS n FROM catalog WHERE lower(status) <> 'ongoing' GROUP BY 1)
    SELECT 0 AS place, 0 AS i, 'Total theses: ' || count(*) AS line FROM catalog
    UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, f)::INT, '  ' || university || ': ' || n FROM (SELECT university, count(*) AS n, min(ord) AS f FROM catalog GROUP BY 1)
    UNION ALL SELECT 2, 0, 'Ongoing: ' || count(*) FILTER (WHERE lower(status) = 'ongoing') FROM catalog UNION ALL SELECT 3, 0, 'Completed: ' || count(*) FILTER (WHERE lower(status) <> 'ongoing') FROM catalog
    UNION ALL SELECT 4, row_number() OVER (ORDER BY year)::INT, '  ' || year || ': ' || n FROM y WHERE year IS NOT NULL
    UNION ALL SELECT 5, 0, 'Industry-partnered theses: ' || count(*) FILTER (WHERE industry <> '') FROM catalog
    UNION ALL SELECT 6, row_number() OVER (ORDER BY n DESC, f)::INT, '  ' || industry || ': ' || n FROM (SELECT industry, count(*) AS n, min(ord) AS f FROM catalog WHERE industry <> '' GROUP BY 1 ORDER BY n DESC, f LIMIT 10)""",
    ("catalog",),
)
def k5_o6_p5_statistics(spark, d):
    return render.statistics_report(frame(spark, "catalog"))


@query(values("doc_id, i, line", (1, 1, "[ERROR] REFS (9): -"), (1, 2, "[WARN] VAGUE (2): very"), (1, 3, "[WARN] VAGUE (10): huge"), (1, 4, "[INFO] NOTE (1): x"), (1, 5, "1 error(s), 2 warning(s), 1 note(s)")))
def k6_report(spark, d):
    rows = [(1, "NOTE", "INFO", 1, "x"), (1, "VAGUE", "WARN", 10, "huge"), (1, "REFS", "ERROR", 9, "-"), (1, "VAGUE", "WARN", 2, "very")]
    return render.report_lines(spark.createDataFrame(rows, "doc_id int, code string, severity string, ord int, subject string"))


@query(
    values(
        "doc_id, place, i, line", (1, 0, 0, "Floats defined: 6"), (1, 0, 1, "Forward references flagged: 2"), (1, 0, 2, "Unresolved references: 1"), (1, 1, 1, "  * figure: 1"), (1, 1, 2, "  * table: 1"),
        (1, 2, 1, "== Figure 2: page 2, defined on page 5 (3 ahead)"), (1, 2, 2, "== Table 5: page 4, defined on page 7 (3 ahead)"), (1, 3, 1, "  * table 7 (first seen on page 4)"),
    )
)
def k7_forward_report(spark, d):
    from marginalia.operators import relations

    defs, refs = frame(spark, "defs").withColumn("num", tx.normal_number(F.col("num"))), frame(spark, "crefs")
    found = relations.forward_references(defs, refs, 800.0, 1.0).withColumn("y", F.lit(0.0))
    return render.forward_report(found, defs, relations.unreferenced(refs, defs, ["doc_id", "kind", "num"]))


@query(values("doc_id, json", (1, '{"kind":"figure","distance":2.925}'), (2, '{"kind":"table","distance":1.0}')))
def k8_findings_json(spark, d):
    return render.findings_json(spark.createDataFrame([(1, "figure", 2.92512), (2, "table", 1.0)], "doc_id int, kind string, distance double"))


@query(
    values(
        "html",
        (
            "<!doctype html><html><head><meta charset='utf-8'><title>Report</title></head><body><h1>Report</h1><div class='tile'><b>3</b> checks run</div><div class='tile'><b>1</b> clean</div><div class='tile'><b>1</b> with findings</div><div class='tile'><b>1</b> errors</div>"
            "<div class='bar'><span class='s-clean' style='width:33.3333%'></span><span class='s-findings' style='width:33.3333%'></span><span class='s-error' style='width:33.3333%'></span></div>\n<section><h2>Prose</h2><details class='s-findings'><summary>b words findings</summary><pre>[WARN] &lt;x&gt;</pre></details></section>\n"
            "<section><h2>Math</h2><details class='s-clean'><summary>a sums clean</summary><pre>No output.</pre></details></section>\n<section><h2>Other</h2><details class='s-error'><summary>c odd error</summary><pre>y</pre></details></section>\n</body></html>",
        ),
    )
)
def k10_dashboard(spark, d):
    rows = [(1, "a", "Math", "sums", "", "clean"), (2, "b", "Prose", "words", "[WARN] <x>", "findings"), (3, "c", "Odd", "odd", "y", "error")]
    return render.dashboard(spark.createDataFrame(rows, "ord int, script string, grp string, about string, body string, status string"), ("Prose", "Math", "Other"), "Report")


@query(values("figure, html", ("Figure 1", "<tr><td>Figure 1</td><td class='ok'>✓</td><td class='unk'>?</td></tr>")))
def k10_matrix_rows(spark, d):
    return render.matrix_html(spark.createDataFrame([("Figure 1", "✓", "?")], "figure string, R1 string, R2 string"), ("R1", "R2"))


@query(values("doc_id, text", (1, "\\begin{tikzpicture}\n  \\path[->] (a) edge node {2} (b);\n  \\path[->] (a) edge node {1} (c);\n  \\path[->] (b) edge node {1} (a);\n  \\path[->] (c) edge node {1} (c);\n\\end{tikzpicture}"), (2, "\\begin{tikzpicture}\n  \\path[->] (e) edge node {1} (e);\n\\end{tikzpicture}")))
def k14_graph_as_tex(spark, d):
    from marginalia.operators import relations

    return render.graph_tex(relations.label_graph(frame(spark, "sections")))


@query("SELECT script, CASE WHEN rc = 0 THEN 'clean' WHEN rc IN (1, 2) THEN 'findings' ELSE 'error' END AS status FROM runs", ("runs",))
def f21_status_of_runs(spark, d):
    return frame(spark, "runs").select("script", F.when(F.col("rc") == 0, "clean").when(F.col("rc").isin(1, 2), "findings").otherwise("error").alias("status"))


@query(values("body, status", ("2 error(s), 1 warning(s)", "error"), ("0 error(s), no findings", "clean"), ("[WARN] x", "findings"), ("done", "clean")))
def f21_status_of_texts(spark, d):
    rows = spark.createDataFrame([("2 error(s), 1 warning(s)",), ("0 error(s), no findings",), ("[WARN] x",), ("done",)], "body string")
    return rows.select("body", tx.report_status(F.col("body")).alias("status"))


@query("SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, ord) AS place FROM layout", ("layout",))
def o3_by_page_and_height(spark, d):
    return frame(spark, "layout").select("doc_id", "ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "ord")).alias("place"))


@query("SELECT ord, title FROM catalog WHERE industry <> ''", ("catalog",))
def p5_not_empty(spark, d):
    return frame(spark, "catalog").where(F.col("industry") != "").select("ord", "title")


@query("SELECT doc_id, ord, regexp_matches(text, '\\.{4,}\\s*[0-9]+\\s*$') AS strict, regexp_matches(text, '\\.{4,}') AS loose, regexp_matches(text, '(\\.\\s){4,}|\\.{4,}') AS spaced FROM lines", ("lines",))
def p6_contents_lines(spark, d):
    text = F.col("text")
    return frame(spark, "lines").select("doc_id", "ord", tx.is_toc_line(text).alias("strict"), tx.is_toc_line(text, tx.TOC_LOOSE).alias("loose"), tx.is_toc_line(text, tx.TOC_SPACED).alias("spaced"))


def suite_rows(spark: SparkSession) -> DataFrame:
    from marginalia.plans.suite import run_suite

    with run_suite(frame(spark, "numbered"), bib=frame(spark, "bib"), candidates=frame(spark, "candidates")) as found:
        rows = found.groupBy("linter").agg(F.count("*").alias("n")).collect()  # a row for each linter
    return spark.createDataFrame([(r["linter"], r["n"]) for r in rows], "linter string, n long")


@query(values("linter, n", ("ai", 2), ("bibliography", 15), ("captions", 6), ("citations", 2), ("crossref", 1), ("numbers", 3)))
def p14_suite_of_a_document(spark, d):
    """The findings of each linter over a fixture, those over references included; a linter without findings has no row."""
    return suite_rows(spark)


