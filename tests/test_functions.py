import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.similarity import similarity
from marginalia.operators import sequences


def strings(n, alphabet, longest, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]


def column(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}")


def kept(line):
    out, i = "", 0
    while i < len(line) and line[i] != "%":
        step = 2 if line[i] == "\\" else 1
        out, i = out + line[i : i + step], i + step
    return out


def test_comments(spark):
    some = [*strings(2000, "a%\\ ", 9), "a b " * 100_000 + "% c", "x \\% " * 300]
    got = column(spark, some).select("i", tx.strip_tex_comment(F.col("t")).alias("x")).collect()
    assert all(r.x == kept(some[r.i]) for r in got)


def test_sentences(spark):
    text = "One here. Two, e.g. This, et al. And Fig. 3. (Three!) four? Five.\nSix"
    got = column(spark, [text, "", "no end"]).select("i", tx.sentences(F.col("t")).alias("x")).orderBy("i").collect()
    assert got[0].x == ["One here.", "Two, e.g. This, et al. And Fig. 3.", "(Three!) four?", "Five.", "Six"]
    assert got[1].x == [] and got[2].x == ["no end"]


def test_number_lists(spark):
    cases = {"11-14": {"11", "12", "13", "14"}, "5 and 6": {"5", "6"}, "13/16/19": {"13", "16", "19"}, "2-90": {"2", "90"}, "A1, 2.4 to 2.6": {"A1", "2.4", "2.6"}, "7 to 9": {"7", "8", "9"}}
    got = column(spark, list(cases)).select("t", tx.number_list(F.col("t")).alias("x")).collect()
    assert {r.t: set(r.x) for r in got} == cases


def test_small_functions(spark):
    def one(value, f, kind="string"):
        return column(spark, [value], kind).select(f(F.col("t")).alias("x")).first().x

    assert one("02.010.0", tx.normal_number) == "2.10.0"
    assert one("a{b}&c\\d", tx.tex_escape) == r"a\{b\}\&c\textbackslash{}d"
    assert one("<a & b>", tx.html_escape) == "&lt;a &amp; b&gt;"
    assert one(" a | | b", tx.packed_list) == ["a", "b"]
    assert one("Deep--Nets: A  Study!", tx.squeezed_title) == "deep nets a study"
    assert one(["Ada Birch", "Cole, Ben"], tx.last_names, "array<string>") == ["birch", "cole"]
    assert one("kernels", tx.stem_plural) == "kernel" and one("class", tx.stem_plural) == "class" and one("gas", tx.stem_plural) == "gas"
    assert one("x" * 700, tx.middle_cut) == "x" * 350 + " … " + "x" * 250
    assert one("abcdefghij", lambda t: tx.snippet(t, F.lit(5), F.lit(2), 2)) == "…cdefgh…"
    assert one("Traceback (most recent)", tx.run_status) == "error" and one("1 WARN", tx.run_status) == "warn" and one("ok", tx.run_status) == "clean"
    assert one('say {"verdict": "PASS"} so', lambda t: tx.tolerant_json(t, "verdict string")).verdict == "PASS"
    assert one("nothing", lambda t: tx.tolerant_json(t, "verdict string")) is None


def test_similarity_isnt_symmetric(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), (None, "a")] + list(zip(strings(50, "abc ", 12), strings(50, "abc ", 12, 2), strict=True))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", "a", "b", similarity("a", "b").alias("s")).collect():
        assert r.s == (None if r.a is None else SequenceMatcher(None, r.a, r.b).ratio())


def test_chunks_windows_paragraphs_and_depths(spark):
    r = random.Random(3)
    rows = [(d, i, "x" * r.randint(0, 9) if r.random() < 0.8 else " ") for d in range(8) for i in range(r.randint(1, 40))]
    df = spark.createDataFrame(rows, "doc_id int, ord int, text string").repartition(5)
    chunk, window, para, depth = {}, set(), {}, {}
    for d in range(8):
        own = [(i, t) for x, i, t in rows if x == d]
        size = number = level = 0
        texts, at = [], None
        for i, t in own:
            chunk[d, i] = number
            size += len(t)
            if size >= 20:
                size, number = 0, number + 1
            level = max(0, level + (1 if len(t) > 4 else -1))
            depth[d, i] = level
        for w in range(0, max(1, len(own) - 1), 3):
            window |= {(d, w // 3, i) for i, _ in own[w : w + 4]}
        for i, t in [*own, (None, "")]:
            if t.strip():
                at = i if not texts else at
                texts.append(t.strip())
            elif texts:
                para[d, at] = " ".join(texts)
                texts = []
    assert {(x.doc_id, x.ord): x.chunk for x in sequences.greedy_chunks(df, 20).collect()} == chunk
    assert {(x.doc_id, x.window, x.ord) for x in sequences.overlapping_windows(df, 4, 3).collect()} == window
    assert {(x.doc_id, x.first_ord): x.text for x in sequences.paragraphs(df).collect()} == para
    delta = F.when(F.length("text") > 4, 1).otherwise(-1)
    assert {(x.doc_id, x.ord): x.depth for x in sequences.with_depth(df, delta).collect()} == depth


def test_captions_go_on_for_five_lines(spark):
    text = ["Figure 1: a", *"bcdefgh", "", "Table 2. x", "Table 3: y", "", "z"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id int, ord int, text string")
    assert {x.num: x.caption for x in sequences.captions(df).collect()} == {"1": "a b c d e f", "2": "x", "3": "y"}
    assert re.match(sequences.CAPTION, "Fig. 2.1: x")
