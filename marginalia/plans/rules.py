"""The rule catalogue: each function gives findings ``doc_id, code, severity, ord, subject`` of one linter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import introduced_terms, is_toc_line, number_list, sentences, strip_tex_comment_simply, word_count
from marginalia.operators import relations
from marginalia.operators.sequences import CAPTION, REFERENCES, body_lines, captions, last_state, paragraphs, reference_entries, so_far, with_depth

# Acronyms that are never reported.
KNOWN_ACRONYMS = ("II", "III", "IV", "VI", "VII", "IX", "XI", "XII", "USA", "UK", "EU", "US", "PhD", "MSc", "BSc", "DSc", "IEEE", "ACM", "ISBN", "ISSN", "DOI", "URL", "HTTP", "HTTPS", "WWW", "CPU", "GPU", "RAM", "TPU", "GHz", "MHz", "GB", "MB", "KB", "TB", "3D", "2D", "1D", "OK", "ID", "AND", "OR", "NOT", "THE", "IF", "LaTeX", "TeX", "PDF", "CSV", "JSON", "XML", "SQL", "API", "Eq", "Fig", "Tab", "Sec", "Ch", "App", "Alg", "TODO", "NOTE")
# An acronym, and a long form with its acronym in brackets.
ACRONYM = r"\b([A-Z][A-Za-z]?[A-Z0-9][A-Z0-9a-z]{0,4})\b"
EXPANSION = r"([A-Za-z][A-Za-z\-']*(?:[ \-][A-Za-z][A-Za-z\-']*){1,7})\s*\(\s*([A-Z][A-Za-z]?[A-Z0-9][A-Za-z0-9\-]{0,8}s?)\s*\)"
# Vague words that are reported by default.
VAGUE = ("significantly", "very", "a lot", "lots of", "hugely", "extremely", "drastically", "dramatically", "vastly", "enormous", "massive", "much better", "much worse", "much faster", "much slower")
# The words that are reported in strict mode.
VAGUE_STRICT = (
    "significantly", "significant", "very", "a lot", "lots of", "huge", "hugely", "extremely", "considerably", "considerable", "substantially", "substantial", "drastically", "dramatically", "vastly", "greatly",
    "enormous", "massive", "immense", "much better", "much worse", "much faster", "much slower", "quite", "fairly", "really", "clearly", "obviously", "many", "few",
)
# What excuses them, and the patterns of the other prose rules.
NUMBER, CITED, SIGNIFICANT = r"[0-9]|%|\\%", r"\[[0-9]+(?:,\s*[0-9]+)*\]|\\cite[pt]?\*?\{", r"(?i)statistically\s+significant|p\s*[<=>]"
JARGON = r"(?i)\b(smooth(?:est|er)?\s+convergence|converge[sd]?\s+(?:very\s+)?smoothly|(?:model|training|network|method)\s+struggl\w+|degrades?\s+gracefully|graceful\s+degradation|(?:works?|performs?)\s+(?:very\s+|quite\s+|really\s+)?well|(?:good|great|strong|excellent|impressive|decent)\s+(?:performance|results|accuracy)|(?:training|convergence)\s+is\s+(?:very\s+)?(?:stable|smooth)|(?:fast(?:est)?|smooth(?:est)?|(?:most\s+)?stable)\s+(?:and\s+(?:fast(?:est)?|smooth(?:est)?|(?:most\s+)?stable)\s+)?convergence)\b"
FORWARD = r"(?i)\b(as\s+(?:we\s+(?:will|shall)\s+see|will\s+be\s+(?:seen|shown|discussed|explained|described))|we\s+(?:will|shall)\s+(?:see|show|discuss|explain|describe|return\s+to|come\s+back\s+to)|(?:will|shall)\s+be\s+(?:discussed|described|explained|introduced|presented|defined)\s+(?:in|later)|more\s+on\s+this\s+(?:later|in)|later\s+(?:in\s+this\s+(?:thesis|chapter|section)|chapters?|sections?))\b"
DANGLING = r"^(This|These|It|Those)\s+(is|are|was|were|shows?|showed|means?|meant|implies|implied|follows?|followed|suggests?|suggested|demonstrates?|demonstrated|indicates?|indicated|leads?|led|results?|resulted|allows?|allowed|makes?|made|can|could|will|would|may|might|does|did|has|have|had)\b"
COMPANION = r"(?i)\b(companion\s+(?:stud(?:y|ies)|paper|papers|work|report)|(?:series|set|number)\s+of\s+(?:related|companion)\s+(?:stud(?:y|ies)|works?|papers?)|in\s+(?:a\s+)?(?:separate|companion|parallel|forthcoming)\s+(?:stud(?:y|ies)|paper|work|report|manuscript)|(?:reported|evaluated|assessed|addressed|presented|described|analy[sz]ed|examined|treated|studied|shown|demonstrated)\s+(?:\w+\s+){0,3}elsewhere|(?:remaining|other)\s+(?:\w+\s+){0,3}(?:are|were|is|will\s+be)\s+(?:evaluated|addressed|reported|treated|examined|studied|presented|described)\s+in\b|our\s+(?:companion|separate|forthcoming|other|prior)\s+(?:work|stud(?:y|ies)|paper|papers)|reported\s+elsewhere|forthcoming|in\s+preparation|under\s+review|to\s+appear)\b"
# Label codes, those that are notation, their definitions and the words near a scheme.
CODE = r"\b([A-Z]{1,3}[0-9]{1,2})\b"
NOTATION = ("R2", "F1", "F2", "L0", "L1", "L2", "P1", "P2", "P3", "K1", "K2", "K3", "K5", "K10", "S3", "EC2", "CO2", "O2", "H2", "N2", "NO2", "SO2", "H2O", "P2P", "V2", "G5", "G4", "G3")
DEFINING = (r"([A-Z]{1,3}[0-9]{1,2})\s*[\(:]\s*[A-Z]", r"([A-Z]{1,3}[0-9]{1,2})\s*[—–-]\s*[A-Za-z]", r"(?:criteri(?:on|a)|requirement|question|hypothesis|objective|dimension)\s+([A-Z]{1,3}[0-9]{1,2})\b", r"([A-Z]{1,3}[0-9]{1,2})\s+(?:denotes?|refers?\s+to|stands?\s+for|means?|is\s+defined|=)")
SCHEME = r"(?i)\b(criteri(?:on|a)|requirements?|research\s+questions?|hypothes[ei]s|objectives?|dimensions?)\b"
# Terms and their variants; the first is preferred.
TERMS = (
    ("data point", ("data point", "sample", "instance", "observation")), ("dataset", ("dataset", "data set")), ("feature", ("feature", "attribute", "covariate", "input variable", "explanatory variable", "independent variable")),
    ("label", ("label", "target", "response", "output variable", "dependent variable", "ground truth")), ("loss function", ("loss function", "cost function", "error function")), ("hypothesis", ("hypothesis", "predictor function", "prediction rule")),
    ("model parameter", ("model parameter", "model weight")), ("training set", ("training set", "training data", "train set", "training dataset")), ("validation set", ("validation set", "validation data", "dev set", "development set", "holdout set", "hold-out set")),
    ("test set", ("test set", "test data", "testing set")), ("learning rate", ("learning rate", "step size", "step-size")), ("hyperparameter", ("hyperparameter", "hyper-parameter", "tuning parameter")), ("empirical risk", ("empirical risk", "training loss", "empirical error")),
    ("artificial neural network", ("neural network", "neural net")), ("k-means", ("k-means", "kmeans", "k means")), ("i.i.d.", ("i.i.d.", "iid", "independent and identically distributed")), ("machine learning", ("machine learning", "statistical learning")),
)
# Forms of authors, signs of web sources and of books, and quoted titles in reference lists.
IEEE_AUTHORS = (r"^[A-Z]\.(?:\s?-?[A-Z]\.)*\s+(?:van|von|de|del|da|Le)?\s*[A-Z][a-zA-Z'’\-]+", r"^[A-Z][a-zA-Z\-]+\s+[A-Z]\.")
WEB = (r"^(https?://|www\.)", r"(?i)\b(dataset|documentation|available|online|accessed)\b")
BOOK, QUOTED = r"\b(Press|Springer|Wiley|Elsevier|McGraw|Prentice|University|Ph\.?D\.?|M\.?Sc\.?|dissertation|thesis|ed\.|Std\.)\b", "[\"“][^\"”]{6,}[,.]?[\"”]"
# Environments of numbered formulas and of floats, and what refers to a label.
MATH, FLOATS = ("equation", "align", "gather", "multline", "eqnarray", "alignat", "flalign"), ("figure", "table", "figure*", "table*", "algorithm", "listing")
REFERRING = r"\\(?:ref|eqref|autoref|cref|Cref|vref|pageref)\*?\{([^}]+)\}"
# Kinds of labels by their prefix.
LABEL_PREFIXES = {"eq": "equation", "fig": "figure", "tab": "table", "table": "table", "alg": "algorithm", "sec": "section", "ch": "chapter", "chap": "chapter", "app": "appendix", "lst": "listing", "thm": "theorem", "lem": "lemma"}
# Kinds of floats by the words that name them, and their numbers.
FLOAT_KINDS = {"figure": "figure", "figures": "figure", "fig.": "figure", "figs.": "figure", "table": "table", "tables": "table", "algorithm": "algorithm", "algorithms": "algorithm", "listing": "listing", "listings": "listing"}
NUM = r"[A-Z]?[0-9]+(?:\.[0-9]+)?"


def finding(rows: DataFrame, code: str, severity: str, subject: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("ord").cast("int").alias("ord"), subject.cast("string").alias("subject"))


def together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# TeX macros whose arguments aren't text, and formulas within a line.
TEX_MACROS = r"\\(?:cite[pt]?|ref|eqref|autoref|cref|Cref|label|includegraphics|input|include|bibliography\w*|url|href)\*?(?:\[[^\]]*\])?\{[^}]*\}"
TEX_FORMULA = r"\$[^$]*\$|\\\[[^\]]*\\\]|\\\(.*?\\\)"


def plain_line(text: Column, mode: str = "pdf") -> Column:
    """A line without what only looks like acronyms: citations by number, or macros and formulas of TeX."""
    if mode == "pdf":
        return F.regexp_replace(text, r"\[[0-9]+(?:,\s*[0-9]+)*\]", " ")
    for p in (TEX_MACROS, TEX_FORMULA, r"\\[A-Za-z]+"):
        text = F.regexp_replace(text, p, " ")
    return text


def kept_lines(lines: DataFrame, mode: str = "pdf") -> DataFrame:
    """Body lines that are neither captions nor table of contents, cleaned; ``seq`` numbers them from 1."""
    kept = body_lines(lines).where(~F.trim("text").rlike(CAPTION)).withColumn("text", plain_line(F.col("text"), mode))
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))


def acronyms(lines: DataFrame, min_uses: int = 2, mode: str = "pdf") -> DataFrame:
    """Uses before an expansion, expansions again, for nothing, or never."""
    kept = kept_lines(lines, mode)
    key = lambda c: F.regexp_replace(c, "s+$", "")
    uses = kept.select("doc_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(ACRONYM), 1)).alias("x")).select("doc_id", "ord", key(F.col("x")).alias("acro"))
    uses = uses.where(~F.col("acro").isin(*KNOWN_ACRONYMS) & (F.length(F.regexp_replace("acro", "[^A-Z]", "")) >= 2))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(EXPANSION), 1).alias("long"), F.regexp_extract_all("text", F.lit(EXPANSION), 2).alias("acro"))
    exp = kept.select("doc_id", "ord", F.posexplode(pairs).alias("i", "p")).select("doc_id", "ord", "i", F.col("p.long").alias("long"), key(F.col("p.acro")).alias("acro"))
    letters = F.filter(F.split(F.lower(F.regexp_replace("acro", "[^A-Za-z]", "")), ""), lambda c: c != "")
    initials = F.transform(F.split("long", r"[ \-]"), lambda w: F.lower(F.left(w, F.lit(1))))
    hits = F.size(F.filter(letters, lambda c: F.array_contains(initials, c)))
    exp = exp.where((F.size(letters) >= 2) & (hits >= F.greatest(F.lit(2), F.size(letters) - 1)))
    exp = exp.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "acro").orderBy("ord", "i")))
    first = exp.where("k = 1").select("doc_id", "acro", F.col("ord").alias("at"))
    both = uses.join(first, ["doc_id", "acro"])
    early = both.where("ord < at").groupBy("doc_id", "acro").agg(F.min("ord").alias("ord"))
    unused = first.join(both.where("ord > at"), ["doc_id", "acro"], "left_anti").withColumn("ord", F.col("at"))
    never = uses.join(first, ["doc_id", "acro"], "left_anti").groupBy("doc_id", "acro").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where(F.col("n") >= min_uses)
    acro = F.col("acro")
    return together(finding(early, "USED-BEFORE-EXPANSION", "WARN", acro), finding(exp.where("k > 1"), "RE-EXPANDED", "WARN", acro), finding(unused, "EXPANDED-ONCE-UNUSED", "INFO", acro), finding(never, "NEVER-EXPANDED", "WARN", acro))


def prose(rows: DataFrame, max_cues: int = 3, strict: bool = False) -> DataFrame:
    """Vague words (more of them if ``strict``), jargon, forward cues and dangling openings of sentences (doc_id, ord, text)."""
    text = F.col("text")
    words = "|".join(w.replace(" ", r"\s+") for w in (VAGUE_STRICT if strict else VAGUE))
    vague = F.lower(F.regexp_extract(text, rf"(?i)\b({words})\b", 1))
    excused = text.rlike(NUMBER) | text.rlike(CITED) | text.rlike(SIGNIFICANT)
    cue = F.regexp_extract(text, FORWARD, 1)
    cues = rows.where(cue != "")
    habit = cues.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where(F.col("n") > max_cues)
    return together(
        finding(rows.where((vague != "") & ~excused), "VAGUE-QUANTIFIER", "WARN", vague), finding(rows.where(text.rlike(JARGON)), "JARGON", "WARN", F.lower(F.regexp_extract(text, JARGON, 1))),
        finding(cues, "FORWARD-CUE", "WARN", F.lower(cue)), finding(habit, "FORWARD-CUE-HABIT", "WARN", F.col("n")), finding(rows.where(text.rlike(DANGLING)), "DANGLING-REFERENCE", "INFO", F.regexp_extract(text, DANGLING, 1)),
    )


def companions(rows: DataFrame) -> DataFrame:
    """Sentences that appeal to other studies without a citation."""
    text = F.col("text")
    return finding(rows.where(text.rlike(COMPANION) & ~text.rlike(CITED)), "COMPANION-REF", "WARN", F.lower(F.regexp_extract(text, COMPANION, 1)))


def codes(paras: DataFrame, min_members: int = 3) -> DataFrame:
    """Schemes of label codes with members that no paragraph defines."""
    text = F.col("text")
    uses = paras.select("doc_id", "ord", text.rlike(SCHEME).alias("near"), F.explode(F.regexp_extract_all(text, F.lit(CODE), 1)).alias("label"))
    uses = uses.withColumn("prefix", F.regexp_extract("label", "^([A-Z]+)", 1)).where(~F.col("label").isin(*NOTATION) & (F.regexp_extract("label", "([0-9]+)$", 1).cast("int") <= 20))
    defined = paras.select("doc_id", F.explode(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in DEFINING])).alias("label")).distinct().withColumn("defined", F.lit(True))
    members = uses.groupBy("doc_id", "prefix", "label").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.max("near").alias("near")).join(defined, ["doc_id", "label"], "left")
    families = members.groupBy("doc_id", "prefix").agg(
        F.count("*").alias("members"), F.max("near").alias("near"), F.sum(F.when(F.col("defined").isNull(), F.col("n"))).alias("total"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("defined").isNull(), F.col("label")))), ", ").alias("undefined"),
        F.min_by(F.col("ord"), F.when(F.col("defined").isNull(), F.col("label"))).alias("ord"),
    )
    families = families.where((F.col("members") >= 2) & (F.col("near") | (F.col("members") >= min_members)) & (F.col("undefined") != ""))
    out = finding(families, "UNDEFINED-CODE", "WARN", F.col("undefined")).drop("severity")
    total = families.select("doc_id", F.col("undefined").alias("subject"), F.when(F.col("total") >= 3, "WARN").otherwise("INFO").alias("severity"))
    return out.join(total, ["doc_id", "subject"]).select("doc_id", "code", "severity", "ord", "subject")


def count_variant(text: Column, variant: str) -> Column:
    """Occurrences of a variant as whole words, plurals included; any white space or ~ stands for a space."""
    pattern = re.escape(variant).replace(r"\ ", r"[\s~]+")
    return F.regexp_count(text, F.lit(rf"(?i)(?<![\w-]){pattern}(?:e?s)?(?![\w-])"))


def terminology(lines: DataFrame, min_count: int = 2) -> DataFrame:
    """Terms of which a document mixes variants, or uses one that isn't preferred."""
    counts = [F.struct(F.lit(t).alias("term"), F.lit(v).alias("variant"), F.lit(i).alias("i"), count_variant(F.col("text"), v).alias("n")) for t, vs in TERMS for i, v in enumerate(vs)]
    long = lines.select("doc_id", "ord", F.explode(F.filter(F.array(*counts), lambda c: c["n"] > 0)).alias("c"))
    found = long.groupBy("doc_id", "c.term", "c.variant", "c.i").agg(F.sum("c.n").alias("n"), F.min("ord").alias("ord")).where(F.col("n") >= min_count)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "i", "variant")))
    by = found.groupBy("doc_id", "term").agg(F.count("*").alias("kinds"), F.min("ord").alias("ord"), F.min("i").alias("least"), F.array_join(F.transform(listed, lambda x: x["variant"]), ", ").alias("variants"))
    return together(finding(by.where("kinds > 1"), "TERM-MIX", "WARN", F.col("variants")), finding(by.where("kinds = 1 and least > 0"), "NON-DICTIONARY", "INFO", F.col("variants")))


def labelled_entities(tex: DataFrame) -> DataFrame:
    """Labels, captions, begins and ends of numbered environments, each with ``open``: the innermost environment there.

    Comments go. A running depth, which no end takes below zero, tells on which level a token stands; the innermost open
    environment is the last one that began on its level, so environments may be nested.
    """
    known = "|".join(x.replace("*", r"\*") for x in (*MATH, *[m + "*" for m in MATH], *FLOATS))
    clean = tex.withColumn("text", strip_tex_comment_simply(F.col("text")))
    pattern = rf"(\\begin\{{(?:{known})\}}|\\end\{{(?:{known})\}}|\\label\{{[^}}]+\}}|\\caption\b)"
    toks = clean.select("doc_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("i", "tok"))
    toks = toks.withColumn("seq", F.col("ord") * 10000 + F.col("i"))
    begins, ends = F.col("tok").startswith(r"\begin"), F.col("tok").startswith(r"\end")
    toks = with_depth(toks, F.when(begins, 1).when(ends, -1).otherwise(0), order="seq").withColumn("level", F.col("depth") + F.when(ends, 1).otherwise(0))
    state = F.when(begins, F.struct(F.regexp_extract("tok", r"\{([^}]+)\}", 1).alias("env"), F.col("seq").alias("at"), F.col("ord").alias("start")))
    w = Window.partitionBy("doc_id", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return toks.withColumn("open", F.when(F.col("level") > 0, F.last(state, ignorenulls=True).over(w))).drop("depth", "level")


def unreferenced_tex(tex: DataFrame, all_labels: bool = False) -> DataFrame:
    """Labels that nothing in their document refers to, numbered formulas and captioned floats without a label."""
    toks = labelled_entities(tex)
    env = F.coalesce("open.env", F.lit(""))
    labels = toks.where(F.col("tok").startswith(r"\label")).select("doc_id", "ord", F.trim(F.regexp_extract("tok", r"\{([^}]+)\}", 1)).alias("label"), env.alias("env"))
    prefix = F.when(F.col("label").contains(":"), F.lower(F.split("label", ":")[0])).otherwise("")
    base = F.regexp_replace("env", r"\*$", "")
    named = F.create_map(*[F.lit(x) for kv in LABEL_PREFIXES.items() for x in kv])
    kind = F.when(base.isin(*MATH), "equation").when(base.isin("figure", "table", "algorithm", "listing"), base).otherwise(F.coalesce(F.try_element_at(named, prefix), F.lit("other")))
    labels = labels.withColumn("kind", kind)
    clean = strip_tex_comment_simply(F.col("text"))
    lists = F.concat(F.flatten(F.transform(F.regexp_extract_all(clean, F.lit(REFERRING), 1), lambda x: F.split(x, ","))), F.regexp_extract_all(clean, F.lit(r"\\hyperref\[([^\]]+)\]"), 1))
    refs = tex.select("doc_id", F.explode(F.transform(lists, lambda x: F.trim(x))).alias("label")).distinct()
    if not all_labels:
        labels = labels.where(F.col("kind").isin("equation", "figure", "table", "algorithm", "listing"))
    blocks = toks.where("open.env <> ''").groupBy("doc_id", F.col("open.at").alias("at"), F.col("open.env").alias("env"), F.col("open.start").alias("ord")).agg(F.max(F.col("tok").startswith(r"\label")).alias("has_label"), F.max(F.col("tok").startswith(r"\caption")).alias("has_caption"))
    bare = blocks.where("not has_label")
    return together(
        finding(relations.unreferenced(labels, refs, ["doc_id", "label"]), "UNREFERENCED", "WARN", F.col("label")),
        finding(bare.where(F.col("env").isin(*MATH)), "UNLABELED-EQ", "WARN", F.col("env")),
        finding(bare.where(F.col("env").isin(*FLOATS) & F.col("has_caption")), "UNLABELED-FLOAT", "WARN", F.col("env")),
    )


def eqref(tex: DataFrame) -> DataFrame:
    """Plain references to labels of formulas, and the obsolete eqnarray."""
    labels = labelled_entities(tex).where(F.col("tok").startswith(r"\label")).where(F.regexp_replace(F.coalesce("open.env", F.lit("")), r"\*$", "").isin(*MATH)).select("doc_id", F.trim(F.regexp_extract("tok", r"\{([^}]+)\}", 1)).alias("label"))
    clean = strip_tex_comment_simply(F.col("text"))
    refs = tex.select("doc_id", "ord", F.explode(F.flatten(F.transform(F.regexp_extract_all(clean, F.lit(r"\\ref\*?\{([^}]+)\}"), 1), lambda x: F.split(x, ",")))).alias("label")).withColumn("label", F.trim("label"))
    return together(finding(refs.join(labels, ["doc_id", "label"], "left_semi"), "REF-NOT-EQREF", "WARN", F.col("label")), finding(tex.where(clean.rlike(r"\\begin\{eqnarray\*?\}")), "EQNARRAY", "INFO", F.lit("eqnarray")))


def short_captions(lines: DataFrame, min_words: int = 6) -> DataFrame:
    found = captions(lines).withColumn("words", word_count(F.col("caption")))
    return finding(found.where(F.col("words") < min_words), "SHORT-CAPTION", "WARN", F.concat_ws(" ", "kind", "num"))


def lone_children(units: DataFrame, profile: str = "thesis") -> DataFrame:
    """Units with a single child: a warning in a thesis, a note in a paper."""
    return finding(relations.lone_children(units), "LONE-CHILD", "INFO" if profile == "paper" else "WARN", F.col("child"))


def citation_style(lines: DataFrame, ieee: bool = True) -> DataFrame:
    """A note that this isn't checked, for a venue of another style. Else entries that don't look like A. B. Surname, "Title," of a numbered list; lists that aren't there or not numbered."""
    if not ieee:
        return finding(lines.groupBy("doc_id").agg(F.lit(0).alias("ord")), "VENUE-SKIP", "INFO", F.lit("-"))
    body = F.regexp_replace("text", r"^\[[0-9]+\]\s+", "")
    entries = reference_entries(lines)
    some = lambda ps: F.coalesce(*[F.when(body.rlike(p), True) for p in ps], F.lit(False))
    authors, web, book, quoted = some(IEEE_AUTHORS), some(WEB), some((BOOK,)), some((QUOTED,))
    bad = F.concat_ws("+", F.when(~authors & ~web, "authors"), F.when(~quoted & ~web & ~book, "title"))
    heads = lines.groupBy("doc_id").agg(F.max(F.when(F.trim("text").rlike(REFERENCES), F.col("ord"))).alias("ord"))
    numbered = entries.select("doc_id").distinct()
    return together(
        finding(entries.where(bad != ""), "ENTRY-STYLE", "WARN", bad),
        finding(heads.where("ord is null").withColumn("ord", F.lit(0)), "NO-REFS-SECTION", "WARN", F.lit("-")),
        finding(heads.where("ord is not null").join(numbered, "doc_id", "left_anti"), "REFS-NOT-NUMBERED", "ERROR", F.lit("-")),
    )


def citation_style_tex(tex: DataFrame) -> DataFrame:
    """Bibliography styles other than IEEE, textual citations, or no style at all; comments count."""
    styles = tex.select("doc_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(r"\\bibliographystyle\{([^}]+)\}"), 1)).alias("s")).withColumn("good", F.col("s").rlike("(?i)ieee"))
    options = tex.select("doc_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(r"\\usepackage\[([^\]]*)\]\{biblatex\}"), 1)).alias("s")).withColumn("good", F.col("s").rlike(r"style\s*=\s*ieee"))
    both = styles.unionByName(options)
    textual = tex.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"\\cite[tp]\b"))).alias("n"), F.min("ord").alias("ord"))
    return together(
        finding(both.where("not good"), "NO-IEEE-STYLE", "ERROR", F.col("s")), finding(textual.where("n > 0"), "NATBIB-TEXTUAL", "WARN", F.col("n")),
        finding(textual.join(both, "doc_id", "left_anti"), "NO-BIB-STYLE", "WARN", F.lit("-")),
    )


# A caption of a float, an equation's number at the end of a line, and what mentions floats and equations.
NUMBERED_CAPTION = rf"^\s*(Figure|Fig\.|Table|Algorithm|Listing)\s+({NUM})\s*(?::|\.(?=\s|$))"
EQUATION_NUMBER = rf"(?:\s{{2,}}|^\s*)\(({NUM})\)\s*$"
FLOAT_WORD, FLOAT_NUMBERS = r"\b(Figures?|Figs?\.|Tables?|Algorithms?|Listings?)\s+", rf"{NUM}(?:\s*(?:,|and|&|/|to|--?|–|—)\s*{NUM})*"
EQUATION_MENTION = rf"\b(?:Equations?|Eqs?\.)\s*\(?({NUM}(?:\)?\s*(?:,|and|&|--?|–)\s*\(?{NUM})*)\)?"


def number_definitions(lines: DataFrame) -> DataFrame:
    """``doc_id, kind, num, ord, page``: captions of floats and numbers of equations, the first of each."""
    text = F.col("text")
    kinds = F.create_map(*[F.lit(x) for kv in FLOAT_KINDS.items() for x in kv])
    floats = lines.where(text.rlike(NUMBERED_CAPTION)).select("doc_id", "ord", "page", kinds[F.lower(F.regexp_extract(text, NUMBERED_CAPTION, 1))].alias("kind"), F.regexp_extract(text, NUMBERED_CAPTION, 2).alias("num"))
    equations = lines.where(text.rlike(EQUATION_NUMBER)).select("doc_id", "ord", "page", F.lit("equation").alias("kind"), F.regexp_extract(text, EQUATION_NUMBER, 1).alias("num"))
    return relations.first_of(floats.unionByName(equations), ["doc_id", "kind", "num"], [F.col("ord")])


def number_mentions(lines: DataFrame, bare: bool = True) -> DataFrame:
    """``doc_id, ord, page, kind, num``: floats and equations that a line names, by word or, if ``bare``, by a number in brackets.

    A line is also read together with the end of the line before it on its page, so that a caption below another
    line counts as mentioned.
    """
    text = F.col("text")
    kinds = F.create_map(*[F.lit(x) for kv in FLOAT_KINDS.items() for x in kv])
    following = F.lead(F.ltrim("text"), 1, "").over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    cur = F.rtrim(text)
    seam = F.when(cur.endswith("-"), F.concat(F.regexp_extract(cur, r"(\S*)-$", 1), "next")).otherwise(F.concat_ws(" ", F.regexp_extract(cur, r"(\S*)$", 1), "next"))
    sources = lines.withColumn("next", following).select("doc_id", "ord", "page", F.explode(F.array(F.regexp_replace(text, NUMBERED_CAPTION, " "), seam)).alias("t"))
    pairs = F.arrays_zip(F.regexp_extract_all("t", F.lit(FLOAT_WORD + "(?:" + FLOAT_NUMBERS + ")"), 1).alias("word"), F.regexp_extract_all("t", F.lit(FLOAT_WORD.replace("(Fig", "(?:Fig") + "(" + FLOAT_NUMBERS + ")"), 1).alias("nums"))
    floats = sources.select("doc_id", "ord", "page", F.explode(pairs).alias("p")).select("doc_id", "ord", "page", kinds[F.lower("p.word")].alias("kind"), F.explode(number_list(F.col("p.nums"))).alias("num"))
    equations = sources.select("doc_id", "ord", "page", F.lit("equation").alias("kind"), F.explode(F.regexp_extract_all("t", F.lit(EQUATION_MENTION), 1)).alias("nums")).withColumn("num", F.explode(number_list(F.col("nums")))).drop("nums")
    out = floats.unionByName(equations)
    if bare:  # the number of an equation doesn't mention itself
        alone = lines.select("doc_id", "ord", "page", F.lit("equation").alias("kind"), F.explode(F.regexp_extract_all(F.regexp_replace(text, EQUATION_NUMBER, " "), F.lit(r"\(([0-9]{1,3})\)"), 1)).alias("num"))
        out = out.unionByName(alone)
    return out.distinct()


def unreferenced_numbers(lines: DataFrame, bare: bool = True) -> DataFrame:
    """Captioned floats and numbered equations whose number no line mentions; see ``number_mentions``."""
    kept = lines.where(~is_toc_line(F.col("text"), r"(?:\.\s){4,}|\.{4,}"))
    named = number_mentions(kept, bare).select("doc_id", "kind", "num").distinct()
    return finding(relations.unreferenced(number_definitions(kept), named, ["doc_id", "kind", "num"]), "UNREFERENCED", "WARN", F.concat_ws(" ", "kind", "num"))


def forward_floats(lines: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Mentions of floats that stand more than ``threshold`` pages before the float; a line's place is its number on the page.

    The height of a page is the median of the pages' line counts.
    """
    kept = lines.where(~is_toc_line(F.col("text"), r"(?:\.\s){4,}|\.{4,}"))
    placed = kept.withColumn("y", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")).cast("double"))
    high = placed.groupBy("doc_id", "page").agg(F.max("y").alias("n")).groupBy("doc_id").agg(F.greatest(F.lit(1.0), F.median("n")).alias("height"))
    placed = placed.join(high, "doc_id").withColumn("y", F.col("y") / F.col("height"))
    at = placed.select("doc_id", "ord", "y")
    defs = number_definitions(kept).where("kind <> 'equation'").join(at, ["doc_id", "ord"]).drop("ord")
    text = kept.where(~F.col("text").rlike(NUMBERED_CAPTION))
    refs = number_mentions(text, bare=False).where("kind <> 'equation'").join(at, ["doc_id", "ord"])
    found = relations.forward_references(defs, refs, 1.0, threshold)
    return finding(found, "FORWARD-FLOAT", "WARN", F.concat_ws(" ", "kind", "num"))


def forward_concepts(lines: DataFrame) -> DataFrame:
    """Concepts that a paragraph uses before the one that introduces them by a cue of definition."""
    paras = paragraphs(body_lines(lines))
    rows = paras.select("doc_id", F.col("first_ord").alias("ix"), "text", F.trim("text").rlike(CAPTION).alias("is_caption"), introduced_terms(F.col("text")).alias("introduced"))
    return finding(relations.concept_uses(rows).withColumnRenamed("ix", "ord"), "FORWARD-CONCEPT", "WARN", F.col("term"))


# Hosts of web sources, signs of preprints, kinds of records that aren't published, and words of venues that tell nothing.
WEB_HOST = r"(?i)kaggle|roboflow|zenodo|hugging\s*face|huggingface|github|gitlab|medium\.com|towardsdatascience|wikipedia|blog|\bdataset\b"
PREPRINT = r"(?i)arxiv|preprint|corr\b|ssrn|techrxiv|biorxiv"
UNPUBLISHED = ("preprint", "posted-content", "Informal and Other Publications")
VENUE_STOPWORDS = ("proceedings", "of", "the", "on", "in", "conference", "international")


def bibliography(bib: DataFrame, candidates: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """``id, code, severity``: how entries compare with records found for them.

    ``bib``: id, title, authors, venue, year, arxiv, url. ``candidates``: bib_id, ord, source, title, authors, venue, year, type; a record of an
    entry's own arXiv number overrides the most similar title. ``lookups``: bib_id, source, failed; an entry without records is UNVERIFIED if
    a lookup failed, and a preprint without a published record is PREPRINT-UNCHECKED if that of source 's2' did. Similarities are ratios
    of matching blocks; one row for each pair of an entry and a record, and of their authors.
    """
    from marginalia.functions.similarity import similarity
    from marginalia.functions.text import plain_title, surnames

    failed = bib.sparkSession.createDataFrame([], "bib_id string, source string, failed boolean") if lookups is None else lookups
    failed = failed.where("failed").groupBy("bib_id").agg(F.max(F.col("source") != "s2").alias("some_failed"), F.max(F.col("source") == "s2").alias("s2_failed"))
    c = candidates.select("bib_id", "ord", "source", plain_title(F.col("title")).alias("c_title"), F.transform("authors", plain_title).alias("theirs"), F.col("venue").alias("c_venue"), F.col("year").alias("c_year"), "type")
    own = bib.select(F.col("id").alias("bib_id"), plain_title(F.col("title")).alias("b_title"), F.col("arxiv").alias("b_arxiv"))
    c = c.join(own, "bib_id").withColumn("sim", similarity(F.col("b_title"), F.col("c_title")))
    exact = (F.col("b_arxiv") != "") & (F.col("source") == "arxiv")
    best = relations.first_of(c, ["bib_id"], [F.desc(exact), F.desc("sim"), F.col("ord")])
    published = (F.col("c_venue") != "") & ~F.col("c_venue").rlike(PREPRINT) & ~F.coalesce("type", F.lit("")).isin(*UNPUBLISHED)
    twins = c.where(published & ((F.col("sim") > 0.85) | (F.col("source") == "s2"))).select("bib_id").distinct().withColumn("twin", F.lit(True))
    rows = bib.withColumnRenamed("id", "bib_id").join(best.drop("b_title", "b_arxiv", "ord"), "bib_id", "left").join(twins, "bib_id", "left").join(failed, "bib_id", "left")
    rows = rows.withColumn("own", surnames(F.col("authors"))).withColumn("cited_preprint", F.col("venue").rlike(PREPRINT) | ((F.col("venue") == "") & (F.col("arxiv") != "")))
    pairs = rows.select("bib_id", F.posexplode("own").alias("i", "a"), "theirs").select("bib_id", "i", "a", F.explode("theirs").alias("f"))
    same = (F.col("a") == F.col("f")) | F.contains(F.col("f"), F.col("a")) | F.contains(F.col("a"), F.col("f")) | (similarity(F.col("a"), F.col("f")) > 0.85)
    hits = pairs.withColumn("same", same).groupBy("bib_id", "i").agg(F.max("same").alias("same")).groupBy("bib_id").agg(F.count_if("same").alias("overlap"), F.max(F.col("same") & (F.col("i") == 0)).alias("lead"))
    rows = rows.join(hits, "bib_id", "left")
    venue, found_venue = plain_title(F.col("venue")), plain_title(F.coalesce("c_venue", F.lit("")))
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    short = F.array_join(F.transform(words(found_venue), lambda w: F.left(w, F.lit(1))), "")
    run = F.replace(venue, F.lit(" "), F.lit(""))
    other_venue = (similarity(venue, found_venue) < 0.5) & ~F.arrays_overlap(F.array_except(words(venue), F.array(*map(F.lit, VENUE_STOPWORDS))), words(found_venue)) & ~F.contains(short, run) & ~F.contains(run, short)
    rows = rows.withColumn("other_venue", F.coalesce(other_venue, F.lit(False)))
    untitled, none = F.col("title") == "", F.col("sim").isNull()
    web = ~untitled & (F.col("venue").rlike(WEB_HOST) | ((F.col("venue") == "") & (F.col("url") != "") & (F.col("arxiv") == "")))
    checked = ~untitled & ~web
    some_failed, twin, s2_failed = (F.coalesce(x, F.lit(False)) for x in ("some_failed", "twin", "s2_failed"))
    matched, preprint = checked & (F.col("sim") >= 0.55), F.col("cited_preprint")
    checks = [
        ("WEB-SOURCE", "INFO", web | (untitled & (F.col("url") != ""))),
        ("INCOMPLETE", "INFO", untitled & (F.col("url") == "")),
        ("UNVERIFIED", "INFO", checked & none & some_failed),
        ("NOT-FOUND", "WARN", checked & ((none & ~some_failed) | (F.col("sim") < 0.55))),
        ("TITLE-DRIFT", "WARN", matched & (F.col("sim") < 0.85)),
        ("AUTHOR-MISMATCH", "ERROR", matched & (F.size("own") > 0) & (F.size("theirs") > 0) & ((F.col("overlap") < F.greatest(F.lit(1), F.floor(F.size("own") / 2))) | ~F.col("lead"))),
        ("YEAR-MISMATCH", "WARN", matched & (F.abs(F.col("year").try_cast("int") - F.col("c_year").try_cast("int")) > 1)),
        ("INCOMPLETE", "WARN", matched & (F.col("venue") == "") & (F.col("arxiv") == "") & (F.col("url") == "")),
        ("PREPRINT-UNCHECKED", "INFO", matched & preprint & (F.col("arxiv") != "") & ~twin & s2_failed),
        ("PREPRINT", "WARN", matched & preprint & twin),
        ("VENUE-MISMATCH", "WARN", matched & ~(preprint & twin) & (F.col("venue") != "") & ~preprint & (F.col("c_venue") != "") & F.col("other_venue")),
    ]
    codes_ = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("code"), F.lit(s).alias("severity"))) for n, s, c in checks]), lambda x: x.isNotNull())
    listed = F.when(F.size(codes_) == 0, F.array(F.struct(F.lit("OK").alias("code"), F.lit("INFO").alias("severity")))).otherwise(codes_)
    return rows.select(F.col("bib_id").alias("id"), F.explode(listed).alias("c")).select("id", "c.code", "c.severity")


# Headings of AI statements, of methods and of any section, tools, versions and mentions.
AI_HEADING = r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\s+)?(use\s+of\s+(?:ai|artificial\s+intelligence|generative\s+ai)|(?:ai|artificial\s+intelligence)[ -]use|(?:ai|generative\s+ai)\s+(?:disclosure|statement|declaration)|disclosure\s+of\s+ai|declaration\s+of\s+(?:ai|the\s+use)|statement\s+on\s+(?:the\s+)?use\s+of\s+ai)\b.{0,40}$"
METHODS_HEADING, ANY_HEADING = r"(?i)^\s*(?:chapter\s+)?\d?\.?\s*(methods?|methodology)\s*$", r"(?i)^\s*(?:chapter\s+)?\d+(?:\.\d+)*\s+\S|^\s*(abstract|acknowledg|contents|references|bibliography|appendix)"
AI_TOOL = r"(?i)\b(ChatGPT|GPT-?[3-9](?:\.\d)?[a-z]*|Claude(?:\s+(?:Code|Opus|Sonnet|Haiku))?|Gemini|Copilot|Grammarly|DeepL|LLaMA|Mistral|Qwen|DeepSeek|Cursor|Perplexity|Overleaf\s+AI|Writefull|QuillBot|large\s+language\s+model)\b"
AI_VERSION = r"(?i)\b(v?\d+(?:\.\d+)+|GPT-?[3-9](?:\.\d)?[a-z]*|4o|o[13](?:-mini)?|(?:Opus|Sonnet|Haiku)\s*[\d.]*|20\d{2}-\d{2}|version\s+\S+)\b"
AI_SENTENCE = r"(?i)\b(AI|artificial intelligence|language model)s?\b.{0,80}\b(used|employed|assisted|utili[sz]ed)\b|\b(used|employed|utili[sz]ed)\b.{0,60}\b(ChatGPT|Claude|Copilot|AI tools?|LLMs?)\b"
NO_AI = r"(?i)\bno\b.{0,40}\bAI\b|\bwithout\b.{0,30}\bAI\b"


AI_MENTION = r"\b(AI\s+tools?|artificial\s+intelligence|generative\s+AI|large\s+language\s+models?|LLMs?)\b"
SECTIONING = r"\\(?:chapter|section|subsection)\*?\{([^}]*)\}"


def ai_disclosure(lines: DataFrame, body: int = 60, mode: str = "pdf") -> DataFrame:
    """Whether a document has a statement on the use of AI, which names tool and version, outside of its methods.

    In TeX mode the title of a chapter or section is a line of its own before the line that has it, and it ends what came before.
    """
    rows = lines.where(~is_toc_line(F.col("text"))).withColumn("macro", F.lit(False)).withColumn("part", F.lit(1))
    if mode == "tex":
        titles = rows.where(F.col("text").rlike(SECTIONING)).withColumn("text", F.regexp_extract("text", SECTIONING, 1)).withColumn("part", F.lit(0))
        rows = rows.withColumn("macro", F.trim("text").rlike("^" + SECTIONING)).unionByName(titles)
    text = F.trim("text")
    title = F.trim(F.regexp_extract(text, SECTIONING, 1))
    state = F.when(F.col("macro"), title.rlike(METHODS_HEADING)).when(text.rlike(METHODS_HEADING), True).when(text.rlike(ANY_HEADING), False)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "part"))).withColumn("state", state)
    rows = rows.withColumn("methods", F.coalesce(last_state(F.col("state"), order="place"), F.lit(False)) & F.col("state").isNull())
    starts = rows.groupBy("doc_id").agg(
        F.min(F.when(text.rlike(AI_HEADING), F.col("place"))).alias("head"), F.min(F.when(F.col("text").rlike(AI_SENTENCE), F.col("place"))).alias("loose"),
        F.max(F.col("methods") & (text.rlike(AI_MENTION) | text.rlike(AI_TOOL))).alias("named"),
    )
    starts = starts.withColumn("at", F.coalesce("head", "loose"))
    own = rows.join(starts.where("at is not null"), "doc_id").where(F.col("place").between(F.col("at"), F.col("at") + body))
    stop = F.coalesce(F.max((F.col("place") > F.col("at")) & text.rlike(ANY_HEADING)).over(so_far(order="place")), F.lit(False))
    own = own.withColumn("stop", stop).where("not stop").groupBy("doc_id", "head", "named").agg(F.min("ord").alias("ord"), F.min_by("methods", "place").alias("methods"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("body"))
    tool, said = F.col("body").rlike(AI_TOOL), F.lit("-")
    return together(
        finding(starts.where("at is null").withColumn("ord", F.lit(0)), "NO-AI-STATEMENT", "WARN", said), finding(own, "STATEMENT-FOUND", "INFO", F.when(F.col("head").isNull(), "sentence").otherwise("heading")),
        finding(own.where(~tool & ~F.col("body").rlike(NO_AI)), "NO-TOOL-NAMED", "WARN", said), finding(own.where(tool & ~F.col("body").rlike(AI_VERSION)), "NO-VERSION", "WARN", said),
        finding(own.where("head is null and methods and named"), "IN-METHODS", "WARN", said),
    )


def sentence_rows(lines: DataFrame) -> DataFrame:
    """``doc_id, ord, i, text``: the sentences of the paragraphs of a document's body."""
    paras = paragraphs(body_lines(lines))
    return paras.select("doc_id", F.col("first_ord").alias("ord"), F.posexplode(sentences(F.col("text"))).alias("i", "text"))

