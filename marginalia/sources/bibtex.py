"""BibTeX entries and plain reference lists as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIB = "doc_id long, id string, kind string, title string, authors array<string>, venue string, year string, arxiv string, url string"
# Fields that name a venue, in order, and entries that are none.
VENUES, NO_ENTRIES = ("journal", "booktitle", "publisher", "howpublished"), ("comment", "string", "preamble")


def _balanced(text: str, start: int) -> int:
    """The place after the brace that closes the one before ``start``."""
    depth, i = 1, start
    while i < len(text) and depth:
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        i += 1
    return i


def _fields(body: str) -> dict[str, str]:
    out, i = {}, 0
    while m := re.compile(r"(\w+)\s*=\s*").search(body, i):
        i = m.end()
        if body[i : i + 1] == "{":
            end = _balanced(body, i + 1)
            value = body[i + 1 : end - 1]
        elif body[i : i + 1] == '"':
            end = body.find('"', i + 1)
            end = len(body) if end < 0 else end + 1
            value = body[i + 1 : end - 1]
        else:
            end = len(re.match(r"[^,}]*", body[i:]).group()) + i
            value = body[i:end]
        out.setdefault(m.group(1).lower(), " ".join(value.replace("{", "").replace("}", "").split()))
        i = max(end, i + 1)
    return out


def entries(text: str) -> Iterator[dict]:
    i = 0
    while m := re.compile(r"@(\w+)\s*\{\s*([^,\s}]*)\s*,?").search(text, i):
        i = _balanced(text, m.end())
        if m.group(1).lower() in NO_ENTRIES:
            continue
        f = _fields(text[m.end() : i - 1])
        named = " ".join([f.get("eprint", ""), f.get("note", ""), f.get("journal", ""), f.get("url", "")])
        arxiv = re.search(r"\b(\d{4}\.\d{4,5})\b", named)
        authors = [" ".join(a.split()) for a in re.split(r"\s+and\s+", f.get("author", "")) if a.strip()]
        venue = next((f[v] for v in VENUES if f.get(v)), "")
        yield {"id": m.group(2), "kind": m.group(1).lower(), "title": f.get("title", ""), "authors": authors, "venue": venue, "year": f.get("year", ""), "arxiv": arxiv.group(1) if arxiv else "", "url": f.get("url", "")}


def parse_bibtex(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The entries of each file (key, whole text). Nested braces need a scan, so this is an Arrow function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"doc_id": doc, **e} for e in entries(whole or "")]
                kinds = [pa.int64(), *[pa.string()] * 3, pa.list_(pa.string()), *[pa.string()] * 4]
                names = ["doc_id", "id", "kind", "title", "authors", "venue", "year", "arxiv", "url"]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, BIB)


def listed_reference(entry: Column) -> Column:
    """``num, authors, title, year, arxiv`` of an entry '[n] A. Author, "Title," venue, 2020.'; the last year counts."""
    body = F.regexp_replace(entry, r"^\[[0-9]+\]\s*", "")
    quoted = "^(.*?)[\"“]([^\"”]+?)[,.]?[\"”]"
    arxiv = F.regexp_extract(body, r"(?i)arxiv[: ]*([0-9]{4}\.[0-9]{4,5})", 1)
    rest = F.regexp_replace(F.regexp_replace(body, r"(?i)arxiv[: ]*[0-9.v]+", " "), r"https?://\S+", " ")
    years = F.regexp_extract_all(rest, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)
    named = F.regexp_replace(F.regexp_replace(F.regexp_extract(body, quoted, 1), r",?\s*et al\.?", ""), r",\s*$", "")
    authors = F.filter(F.transform(F.split(named, r",\s*(?:and\s+)?|\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")
    return F.struct(F.regexp_extract(entry, r"^\[([0-9]+)\]", 1).alias("num"), authors.alias("authors"), F.regexp_extract(body, quoted, 2).alias("title"), F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit("")).alias("year"), arxiv.alias("arxiv"))
