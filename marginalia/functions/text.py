"""Scalar text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("e.g", "i.e", "et al", "cf", "vs", "Fig", "Eq", "Sec", "Tab", "Alg", "approx", "resp", "w.r.t", "No")
# Patterns of lines of a table of contents, strict, loose and spaced.
TOC_STRICT, TOC_LOOSE, TOC_SPACED = r"\.{4,}\s*[0-9]+\s*$", r"\.{4,}", r"(\.\s){4,}|\.{4,}"
# The pattern that keeps a TeX line up to its first unescaped per cent sign.
TEX_KEEP = r"^((?:[^%\\]+|\\.)*\\?)"
# Replacements that make text safe in TeX and in HTML.
TEX_SPECIAL = (("{", r"\{"), ("}", r"\}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))
HTML_SPECIAL = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))

_MARK = "\u0002"


def is_toc_line(text: Column, pattern: str = TOC_STRICT) -> Column:
    return text.rlike(pattern)


def strip_tex_comment(line: Column) -> Column:
    """The line up to its first per cent sign that no backslash escapes; escaped backslashes don't escape."""
    return F.regexp_extract(line, TEX_KEEP, 1)


def strip_tex_comment_simply(line: Column) -> Column:
    """The same, but any backslash before the sign escapes it."""
    return F.regexp_replace(line, r"(^|[^\\])%.*", "$1")


def sentences(text: Column) -> Column:
    """The sentences of a text: split after . ! ? where white space and a capital or a bracket follow.

    One pattern does it, with a bounded look behind for abbreviations.
    """
    safe = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    parts = F.split(text, rf"(?<=[.!?])(?<!\b(?:{safe})\.)\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, lambda s: F.trim(s, F.lit(" \n\r\t"))), lambda s: s != "")


def word_count(text: Column) -> Column:
    """Words that begin with a letter; numbers and punctuation aside."""
    return F.regexp_count(text, F.lit(r"[A-Za-z][A-Za-z\-']*")).cast("long")


def normal_number(number: Column) -> Column:
    """A dotted number without leading zeros in its parts."""
    return F.array_join(F.transform(F.split(number, r"\."), lambda p: F.regexp_replace(p, r"^0+([0-9])", "$1")), ".")


def number_list(text: Column) -> Column:
    """All numbers that a list names: '11-13' has 11, 12, 13; '5 and 6', '13/16' as written."""
    number = r"[A-Z]?[0-9]+(?:\.[0-9]+)?"
    named = F.regexp_extract_all(text, F.lit(f"({number})"), 1)
    low = F.regexp_extract_all(text, F.lit(f"({number})\\s*(?:--?|–|—|to)\\s*{number}"), 1)
    high = F.regexp_extract_all(text, F.lit(f"{number}\\s*(?:--?|–|—|to)\\s*({number})"), 1)

    def between(pair: Column) -> Column:
        a, b = pair["low"].try_cast("int"), pair["high"].try_cast("int")
        return F.when((a < b) & (b <= a + 50), F.transform(F.sequence(a, F.greatest(a, b)), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))

    ranges = F.flatten(F.transform(F.arrays_zip(low.alias("low"), high.alias("high")), between))
    return F.array_distinct(F.concat(named, ranges))


def tex_escape(text: Column) -> Column:
    """Text as TeX shows it; a backslash is replaced in the same pass, so that its braces stay."""
    text = F.replace(text, F.lit("\\"), F.lit(_MARK))
    for a, b in TEX_SPECIAL:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.replace(text, F.lit(_MARK), F.lit(r"\textbackslash{}"))


def html_escape(text: Column) -> Column:
    for a, b in HTML_SPECIAL:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def packed_list(text: Column, separator: str = "|") -> Column:
    """The trimmed, non-empty parts of a list packed into a string."""
    parts = F.transform(F.split(text, rf"\{separator}"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def squeezed_title(title: Column) -> Column:
    """Small letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "), " +", " "))


def last_names(authors: Column) -> Column:
    """The last word of each author, or what stands before a comma; small letters."""
    return F.transform(authors, lambda a: F.lower(F.when(a.contains(","), F.trim(F.split(a, ",")[0])).otherwise(F.element_at(F.split(F.trim(a), r"\s+"), -1))))


def tolerant_json(text: Column, schema: str) -> Column:
    """A JSON object from a model's answer: code fences go, else the outermost braces are tried; null if none parses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-zA-Z]*", ""), r"```\s*$", ""))
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, schema)).when(F.try_parse_json(braces).isNotNull(), F.from_json(braces, schema))


def snippet(text: Column, start: Column, length: Column, around: int = 40) -> Column:
    """What stands around a match, with an ellipsis at either end that is cut."""
    first, last = F.greatest(F.lit(1), start - around), F.least(F.length(text), start + length - 1 + around)
    cut = F.substring(text, first, last - first + 1)
    return F.concat(F.when(first > 1, "…").otherwise(""), cut, F.when(last < F.length(text), "…").otherwise(""))


def middle_cut(text: Column, head: int = 350, tail: int = 250) -> Column:
    """A long text's head and tail."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(" … "), F.right(text, F.lit(tail))))


def stem_plural(term: Column) -> Column:
    """Without a plural s, for terms of more than four letters that don't end in ss."""
    return F.when((F.length(term) > 4) & term.endswith("s") & ~term.endswith("ss"), F.regexp_replace(term, "s$", "")).otherwise(term)


def run_status(text: Column) -> Column:
    """Whether a transcript reports errors, warnings, or neither."""
    return F.when(text.rlike(r"(?i)traceback|\berror\b"), "error").when(text.rlike(r"(?i)\bwarn"), "warn").otherwise("clean")


def plain_title(title: Column) -> Column:
    """Small letters, digits and spaces; all else goes without leaving a space."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", ""))


def surnames(authors: Column) -> Column:
    """The last word of each author as a plain title has it; single capitals and what is left of et al. don't count."""
    bare = F.transform(authors, lambda a: F.filter(F.split(F.trim(F.regexp_replace(a, r"[{}\\.]", "")), r"\s+"), lambda w: (F.length(w) > 1) | ~w.rlike("^[A-Z]?$")))
    return F.filter(F.transform(F.filter(bare, lambda w: F.size(w) > 0), lambda w: plain_title(F.element_at(w, -1))), lambda x: ~x.isin("", "al", "et"))


def report_status(text: Column) -> Column:
    """What a report says, where no summary does: errors, findings, or neither; counts of nothing are clean."""
    low = F.lower(text)
    some = F.regexp_extract(low, r"([0-9]+)\s+error\(s\)", 1).try_cast("int") > 0
    clean = low.rlike(r"\bno findings\b|0 finding|all .*clean|verified, 0 error") | low.contains("figure(s): 0 bad cell(s), 0 weak")
    return F.when(F.coalesce(some, F.lit(False)), "error").when(clean, "clean").when(low.rlike(r"\bfinding|\bwarn|\bbad cell|weak cell|\[warn\]"), "findings").otherwise("clean")


# Phrases that introduce a concept, words that are none, and ordinary words that never are one.
DEFINITION_CUES = (
    (r"\bwe\s+define\s+(.+?)\s+as\b", 1), (r"\b(.+?)\s+is\s+defined\s+as\b", 1), (r"\b(.+?)\s+is\s+defined\s+to\s+be\b", 1), (r"\bwe\s+call\s+(.+?)\s+(?:a|an|the)\s+(.+?)[\.\,;]", 2), (r"\bwe\s+refer\s+to\s+.+?\s+as\s+(.+?)[\.\,;]", 1),
    (r"\blet\s+(.+?)\s+denote\b", 1), (r"\b(.+?)\s+denotes\b", 1), (r"\b(.+?)\s+stands\s+for\b", 1), (r"\bby\s+(.+?)\s+we\s+mean\b", 1), (r"\bthe\s+term\s+(.+?)\s+refers\s+to\b", 1), (r"\b(.+?)\s+\(also\s+known\s+as\b", 1), (r"\b(.+?)\s+\(also\s+called\b", 1),
    (r"\b([A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{1,}){0,4})\s+\(([A-Z]{2,6})\)", 2),
)
TERM_STOPWORDS = (
    "the", "a", "an", "this", "that", "these", "those", "it", "its", "we", "our", "us", "i", "you", "they", "their", "them", "he", "she", "and", "or", "but", "if", "then", "else", "when", "while", "as", "of", "to", "in", "on", "for", "with", "without", "by", "from", "into",
    "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "do", "does", "did", "not", "no", "yes", "such", "so", "than", "very", "can", "could", "may", "might", "must", "shall", "should", "will", "would",
    "which", "who", "whom", "what", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "one", "two", "first", "second", "third", "new", "old", "same", "different",
    "above", "below", "over", "under", "again", "further", "here", "there", "figure", "table", "equation", "eq", "section", "chapter", "page", "note", "example", "see", "cf", "etc", "versus", "vs",
)
ORDINARY_WORDS = (
    "multiple", "single", "several", "various", "numerous", "number", "numbers", "amount", "amounts", "total", "totals", "majority", "minority", "count", "counts", "half", "quarter", "percentage", "percentages",
    "year", "years", "month", "months", "week", "weeks", "day", "days", "hour", "hours", "minute", "minutes", "second", "seconds", "time", "times", "decade", "decades", "period", "periods", "moment", "moments",
    "thing", "things", "way", "ways", "lot", "kind", "kinds", "sort", "sorts", "part", "parts", "piece", "pieces", "area", "areas", "aspect", "aspects", "item", "items", "order", "place", "places", "point", "points", "side", "sides",
    "end", "ends", "range", "ranges", "matter", "issue", "issues", "fact", "facts", "reason", "reasons", "detail", "details", "step", "steps",
)


def normal_term(term: Column) -> Column:
    """A term in small letters without surrounding punctuation, inner white space as one space."""
    return F.lower(F.regexp_replace(F.trim(F.trim(F.trim(term), F.lit(".,;:()\"'"))), r"\s+", " "))


def split_terms(group: Column) -> Column:
    """The terms that 'X, Y and Z' names, without stopwords; those that are nothing but stopwords are left out."""
    stop = F.array(*map(F.lit, TERM_STOPWORDS + ORDINARY_WORDS))
    parts = F.filter(F.transform(F.split(group, r",|;|\band\b|\bor\b"), normal_term), lambda t: F.length(t) >= 3)
    return F.filter(F.transform(parts, lambda t: F.array_join(F.filter(F.split(t, " "), lambda w: ~F.array_contains(stop, w)), " ")), lambda t: t != "")


def introduced_terms(text: Column) -> Column:
    """The distinct terms that a paragraph introduces by a cue of definition."""
    groups = [F.regexp_extract_all(text, F.lit("(?i)" + p), i) for p, n in DEFINITION_CUES for i in range(1, n + 1)]
    return F.array_distinct(F.flatten(F.transform(F.concat(*groups), split_terms)))
