import hashlib

import pytest
from pyspark.sql import functions as F

from marginalia.operators import relations
from marginalia.plans import judge
from marginalia.plans.fixtures import frame
from marginalia.plans.all_queries import QUERIES
from marginalia.sources import bibtex, files
from marginalia.streaming.introduced import forward_terms


def test_catalogs(spark, tmp_path):
    (tmp_path / "t.csv").write_text('number,author,title,university,status,date,industry,url,recording\n2,Ada,"A ""quoted"", one",North,ongoing,,,,\n1,Ben,"Two\nlines",South,completed,2012,Acme,,\n')
    rows = files.read_theses(spark, str(tmp_path / "t.csv")).orderBy("ord").collect()
    assert [(r.number, r.title, r.date, r.industry) for r in rows] == [(2, 'A "quoted", one', "", ""), (1, "Two\nlines", "2012", "Acme")]
    (tmp_path / "bad.csv").write_text("id,title,area,data_source,difficulty,status,description,url,references\nx,a,b,c,d,e,f,g,h\n")
    with pytest.raises(Exception):
        files.read_topics(spark, str(tmp_path / "bad.csv")).collect()


def test_tex_files_and_units(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.tex").write_text("\\section{One}\nx\n\\subsection{Two} \\subsection*{no}\n\\section[s]{Three}")
    (tmp_path / "sub/b.tex").write_text("y\r\nz")
    (tmp_path / "c.txt").write_text("no")
    rows = files.read_tex(spark, str(tmp_path)).collect()
    assert {(r.file.rsplit("/", 1)[1], r.line_no, r.text) for r in rows if r.file.endswith("b.tex")} == {("b.tex", 1, "y"), ("b.tex", 2, "z")}
    units = files.tex_units(files.read_tex(spark, str(tmp_path / "a.tex"))).orderBy("ord").collect()
    assert [(u.level, u.title) for u in units] == [(1, "One"), (2, "Two"), (1, "Three")]


def test_pages_headings_and_transcripts(spark):
    pages = spark.createDataFrame([(1, "a\nb\fc"), (2, "")], "doc_id int, text string")
    got = files.page_lines(pages).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.page, r.text) for r in got] == [(1, 1, "a"), (1, 1, "b"), (1, 1, ""), (1, 2, "c"), (1, 2, ""), (2, 1, ""), (2, 1, "")]
    text = ["2.1 Before its parent", "1 Intro", "1.1 Goal", "2 Main", "2.1 After", "1 Intro", "2.1.1 Deep", "3.1 Orphan", "41 Too Many", "4. Dotted"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id int, ord int, text string")
    assert {(u.number, u.ord, u.level) for u in files.scanned_units(lines).collect()} == {("1", 1, 1), ("1.1", 2, 2), ("2", 3, 1), ("2.1", 4, 2), ("2.1.1", 6, 3), ("4", 9, 1)}
    runs = spark.createDataFrame([(1, "head\n>>> one.py\nfine\n>>> two.py\nWARN x\n")], "doc_id int, text string")
    assert [(r.script, r.body) for r in files.transcript_sections(runs).orderBy("i").collect()] == [("one", "fine"), ("two", "WARN x")]


def test_manifests_and_answers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.py", "b.py"):
        (tmp_path / "d" / name).write_text(name)
    (tmp_path / "sums").write_text(f"{hashlib.sha256(b'a.py').hexdigest()}  a.py\n{'0' * 64}  b.py\n{'1' * 64}  c.py\n")
    diff = relations.manifest_difference(files.read_manifest(spark, str(tmp_path / "sums")), files.digest_files(spark, str(tmp_path / "d"), "*.py"))
    assert {(r.file, r.change) for r in diff.collect()} == {("b.py", "changed"), ("c.py", "missing")}
    (tmp_path / "j").write_text('{"i": 1}\nbroken\n{"i": 2}\n')
    assert {r.i for r in files.read_answers(spark, str(tmp_path / "j"), "i int").collect() if r.i} == {1, 2}


def test_bibtex(spark):
    text = """@comment{x} @article{k1, title = {A {Nested {Deep}} One}, author = "Ada Birch and Ben  Cole", journal = {J. Nets}, year = 2020, note = {arXiv:1801.00001}}
    @string{s = "x"} @book{k2, title={T}, publisher={Press}, url={http://x}} @misc{k3}"""
    got = {r.id: r for r in bibtex.parse_bibtex(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert set(got) == {"k1", "k2", "k3"}
    k = got["k1"]
    assert (k.title, k.authors, k.venue, k.year, k.arxiv) == ("A Nested Deep One", ["Ada Birch", "Ben Cole"], "J. Nets", "2020", "1801.00001")
    assert (got["k2"].venue, got["k2"].url, got["k3"].title, got["k3"].authors) == ("Press", "http://x", "", [])


def test_listed_references(spark):
    rows = spark.createDataFrame([('[7] A. Birch, B. Cole, and C. Dunn, "A title," Nets, arXiv:1999.01234, 2018, rev. 2021.',)], "t string")
    r = rows.select(bibtex.listed_reference(F.col("t")).alias("r")).first().r
    assert (r.num, r.authors, r.title, r.year, r.arxiv) == ("7", ["A. Birch", "B. Cole", "C. Dunn"], "A title", "2021", "1999.01234")


def test_the_judge_shell(spark):
    rows = spark.createDataFrame([(1, i, f"text {i}") for i in range(5)], "doc_id int, ord int, text string")
    asked = judge.requests(rows, 2, "Judge:")
    assert {r.prompt for r in asked.collect()} == {"Judge:\n0. text 0\n1. text 1", "Judge:\n2. text 2\n3. text 3", "Judge:\n4. text 4"}

    def stub(prompts):
        if any("text 4" in p for p in prompts):
            raise OSError("down")
        return ['{"verdict": "PASS", "note": "n"}' for _ in prompts]

    answers = judge.ask(asked.repartition(3, "batch"), stub, tries=2, wait=0.0)
    got = {r.batch: r.answer for r in answers.collect()}
    assert got[2] is None and set(got) == {0, 1, 2}
    assert {r.batch for r in judge.remaining(asked, answers, "batch").collect()} >= {2}
    found = judge.verdicts(frame(spark, "judged").withColumnRenamed("raw", "answer"), frame(spark, "checklist"), "item")
    assert {r.item: r.verdict for r in found.collect()} == {"1": "PASS", "2": "PASS", "3": "PASS", "4": "UNCLEAR", "5": "UNCLEAR"}
    assert {r.verdict: r.n for r in judge.tally(found).collect()} == {"PASS": 3, "UNCLEAR": 2}
    done = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 1)], "doc_id int, ix int")
    assert {(r.doc_id, r.ix) for r in judge.contiguous_prefix(done).collect()} == {(1, 0), (1, 1)}


def test_the_prefix_of_whole_conversations_ends_at_a_gap(spark, tmp_path):
    rows = [(1, t) for t in range(7)] + [(2, t) for t in (0, 1, 2, 3, 4, 6, 7)] + [(3, 1), (3, 2)]
    spark.createDataFrame(rows, "conv_id int, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in QUERIES["t3_contiguous_prefix_of_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, t) for t in range(7)} | {(2, t) for t in range(5)}


def test_the_stream_gives_what_the_batch_gives(spark, tmp_path):
    from marginalia.operators.sequences import introduced_before

    paras = frame(spark, "paragraphs").select("doc_id", "ix", "introduced", "used")
    for i in range(4):
        paras.where(f"ix = {i}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(paras.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = forward_terms(stream).writeStream.format("memory").queryName("terms").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("terms").collect()}
    want = {tuple(r) for r in introduced_before(paras).collect()}
    same = {(1, 1, "kernel")}  # a term that its own paragraph introduces counts as introduced only from the next on
    assert got == want and same <= want
