"""Sinks: reports, tables, JSON and summaries as rows of text that any writer takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import html_escape, packed_list, tex_escape
from marginalia.operators.catalog import equals

SEVERITIES = ("ERROR", "WARN", "INFO")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(9))


def exit_codes(findings: DataFrame) -> DataFrame:
    """``doc_id, code``: 1 if a document has errors or warnings."""
    return findings.groupBy("doc_id").agg(F.max(F.when(F.col("severity").isin("ERROR", "WARN"), 1).otherwise(0)).alias("code"))


def report_lines(findings: DataFrame) -> DataFrame:
    """``doc_id, i, line``: findings by severity and place, then a line of counts."""
    rows = findings.select("doc_id", severity_rank(F.col("severity")).alias("rank"), "ord", F.format_string("[%s] %s (%d): %s", "severity", "code", "ord", "subject").alias("line"))
    count = lambda s: F.count_if(F.col("severity") == s)
    last = findings.groupBy("doc_id").agg(F.format_string("%d error(s), %d warning(s), %d note(s)", *map(count, SEVERITIES)).alias("line"))
    rows = rows.unionByName(last.select("doc_id", F.lit(99).cast("long").alias("rank"), F.lit(0).alias("ord"), "line"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "ord", "line")).alias("i"), "line")


def findings_json(findings: DataFrame, digits: int = 3) -> DataFrame:
    """``doc_id, json``: a finding as one object; a distance is rounded."""
    rounded = [F.round(c, digits).alias(c) if c == "distance" else F.col(c) for c in findings.columns if c != "doc_id"]
    return findings.select("doc_id", F.to_json(F.struct(*rounded)).alias("json"))


def catalog_lines(rows: DataFrame, form: str = "markdown") -> DataFrame:
    """``university, part, i, line``: ongoing entries first, renumbered within each part.

    ``form``: markdown table rows, TeX table rows, or plain text with the number three wide.
    """
    part = F.when(equals("status", "ongoing"), 0).otherwise(1)
    i = F.row_number().over(Window.partitionBy("university", part).orderBy("ord"))
    cells = [F.col(c) for c in ("author", "title", "date", "industry")]
    numbered = i.cast("string")
    line = {
        "markdown": F.concat(F.lit("| "), F.concat_ws(" | ", numbered, *cells), F.lit(" |")),
        "tex": F.concat(F.concat_ws(" & ", numbered, *[tex_escape(c) for c in cells]), F.lit(r" \\")),
        "text": F.concat_ws("  ", F.format_string("%3d", i), *cells),
    }[form]
    return rows.select("university", part.alias("part"), i.alias("i"), line.alias("line"))


def topic_lines(rows: DataFrame) -> DataFrame:
    """``area, ord, line``: a topic's heading and its metadata, joined by dots; spaces of a subject become %20."""
    meta = F.concat_ws(" · ", *[F.when(F.col(c) != "", F.col(c)) for c in ("status", "difficulty")])
    mail = F.concat(F.lit("mailto:?subject="), F.replace("title", F.lit(" "), F.lit("%20")))
    return rows.select(F.coalesce(F.nullif("area", F.lit("")), F.lit("Other")).alias("area"), "ord", F.concat(F.lit("### "), F.col("title"), F.lit(" — "), meta, F.lit(" ["), mail, F.lit("]")).alias("line"))


def _parts(rows: DataFrame) -> DataFrame:
    """Adds ``place`` of the university by its first row, ``part`` (0 ongoing, 1 completed), ``i`` within the part, and counts of both."""
    part = F.when(equals("status", "ongoing"), 0).otherwise(1)
    whole, own = Window.partitionBy("university"), Window.partitionBy("university", "part")
    return rows.withColumn("part", part).withColumn("place", F.min("ord").over(whole)).withColumn("total", F.count("*").over(whole)).withColumn("n", F.count("*").over(own)).withColumn("i", F.row_number().over(own.orderBy("ord")))


def _stacked(rows: DataFrame, *levels: tuple[tuple[str, ...], tuple[Column, ...]]) -> DataFrame:
    """``place, part, i, k, line``: lines that head groups of rows, or that stand for rows; a level is its key and lines (null ones are left out)."""
    out = None
    for depth, (keys, lines) in enumerate(levels):
        heads = rows.select(*keys, F.array(*lines).alias("lines")).distinct() if depth < len(levels) - 1 else rows.select(*keys, F.array(*lines).alias("lines"))
        order = {c: F.col(c) if c in keys else F.lit(-1) for c in ("place", "part", "i")}
        flat = heads.select(*[v.cast("long").alias(c) for c, v in order.items()], F.posexplode("lines").alias("k", "line")).where("line is not null")
        out = flat if out is None else out.unionByName(flat)
    return out


def catalog_document(rows: DataFrame, title: str, form: str = "markdown") -> DataFrame:
    """``text``: the whole catalog in Markdown or TeX: universities as first seen, ongoing entries, then completed ones, renumbered, with links.

    ``rows``: a catalog with ``url`` and ``recording``.
    """
    rows = _parts(rows)
    ongoing = F.col("part") == 0
    name = F.when(ongoing, "Ongoing").otherwise("Completed")
    count, own = F.col("total").cast("string"), F.col("n").cast("string")
    link = lambda text, to, shape: F.when(F.col(to) != "", F.format_string(shape, *((F.col(to), text) if form == "tex" else (text, F.col(to))))).otherwise(text)
    if form == "markdown":
        cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", F.col("i").cast("string"), *c), F.lit(" |"))
        video = F.when(F.col("recording") != "", F.concat(F.lit("[video]("), F.col("recording"), F.lit(")"))).otherwise("")
        line = F.when(ongoing, cells(F.col("author"), F.col("title"), F.col("industry"), video)).otherwise(cells(F.col("author"), link(F.col("title"), "url", "[%s](%s)"), F.col("date"), F.col("industry"), video))
        head = (F.concat(F.lit("## "), F.col("university"), F.lit(" ("), count, F.lit(" total)")), F.lit(""))
        table = (F.concat(F.lit("### "), name, F.lit(" ("), own, F.lit(")")), F.lit(""), F.when(ongoing, "| # | Author | Title | Industry | Recording |").otherwise("| # | Author | Title | Date | Industry | Recording |"), F.when(ongoing, "|---|--------|-------|----------|-----------|").otherwise("|---|--------|-------|------|----------|-----------|"))
        return one_text(_stacked(rows, (("place",), head), (("place", "part"), table), (("place", "part", "i"), (line, F.when(F.col("i") == F.col("n"), "")))), "place", "part", "i", "k").select(F.concat(F.lit(f"# {title}\n\n"), "text").alias("text"))
    cells = lambda *c: F.concat(F.concat_ws(" & ", F.col("i").cast("string"), *c), F.lit(r" \\"))
    video = F.when(F.col("recording") != "", F.concat(F.lit(r"\href{"), F.col("recording"), F.lit("}{video}"))).otherwise("")
    author, name_, date, industry = (tex_escape(F.col(c)) for c in ("author", "title", "date", "industry"))
    line = F.when(ongoing, cells(author, name_, industry, video)).otherwise(cells(author, link(name_, "url", r"\href{%s}{%s}"), date, industry, video))
    head = (F.concat(F.lit(r"\section*{"), tex_escape(F.col("university")), F.lit(" ("), count, F.lit(" total)}")), F.lit(""))
    names = F.when(ongoing, r"\# & Author & Title & Industry & Recording \\").otherwise(r"\# & Author & Title & Date & Industry & Recording \\")
    widths = F.when(ongoing, r"\begin{longtable}{@{}r p{3cm} p{6.5cm} p{2.8cm} p{2cm}@{}}").otherwise(r"\begin{longtable}{@{}r p{2.8cm} p{6.3cm} p{1.6cm} p{2cm} p{1.8cm}@{}}")
    table = (F.concat(F.lit(r"\subsection*{"), name, F.lit(" ("), own, F.lit(")}")), F.lit(""), widths, F.lit(r"\toprule"), names, F.lit(r"\midrule"), F.lit(r"\endhead"), F.lit(r"\bottomrule"), F.lit(r"\endfoot"))
    last = F.when(F.col("i") == F.col("n"), F.lit("\\end{longtable}\n"))
    whole = one_text(_stacked(rows, (("place",), head), (("place", "part"), table), (("place", "part", "i"), (line, last))), "place", "part", "i", "k")
    start = "\n".join([r"\documentclass[11pt,a4paper]{article}", r"\usepackage[T1]{fontenc}", r"\usepackage[margin=2cm]{geometry}", r"\usepackage{longtable,array,booktabs}", r"\usepackage[hidelinks]{hyperref}", rf"\title{{{title}}}", r"\begin{document}", r"\maketitle", "", ""])
    return whole.select(F.concat(F.lit(start), "text", F.lit("\n\\end{document}\n")).alias("text"))


def console_summary(rows: DataFrame) -> DataFrame:
    """``text``: universities with their entries, numbers three wide, ongoing ones and partners tagged, links below."""
    rows = _parts(rows).withColumn("part", F.lit(0))
    rule = F.lit("=" * 70)
    head = (F.lit(""), rule, F.format_string("  %s  (%d theses)", "university", "total"), rule)
    tags = F.concat(F.when(equals("status", "ongoing"), " [ongoing]").otherwise(""), F.when(F.col("industry") != "", F.concat(F.lit("  (industry: "), "industry", F.lit(")"))).otherwise(""))
    line = F.concat(F.format_string("  %3d. %s, %s", "number", "author", "title"), tags)
    lines = _stacked(rows.withColumn("i", F.col("ord")), (("place",), head), (("place", "part", "i"), (line, F.when(F.col("url") != "", F.concat(F.lit("       "), "url")))))
    return one_text(lines, "place", "part", "i", "k")


def statistics_report(rows: DataFrame, most: int = 10) -> DataFrame:
    """``place, i, line``: totals, universities by size, ongoing and completed ones, completed ones by year, and the commonest partners."""
    from marginalia.operators.catalog import most_common, year_of

    ongoing = equals("status", "ongoing")
    one = lambda place, text, c: rows.agg(F.format_string(text, F.coalesce(c, F.lit(0)).cast("long")).alias("line")).select(F.lit(place).alias("place"), F.lit(0).alias("i"), "line")
    ranked = lambda place, found, key: found.select(F.lit(place).alias("place"), F.col("place").cast("int").alias("i"), F.format_string("  %s: %d", key, "n").alias("line"))
    years = rows.where(~ongoing).select(year_of(F.col("date")).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("n"))
    years = years.withColumn("place", F.row_number().over(Window.orderBy("year")))  # one row per year
    partners = rows.where("industry <> ''")
    parts = [
        one(0, "Total theses: %d", F.count("*")), ranked(1, most_common(rows, "university", "ord"), "university"), one(2, "Ongoing: %d", F.count_if(ongoing)), one(3, "Completed: %d", F.count_if(~ongoing)),
        ranked(4, years, "year"), one(5, "Industry-partnered theses: %d", F.count_if(F.col("industry") != "")), ranked(6, most_common(partners, "industry", "ord", most), "industry"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topics_document(rows: DataFrame, title: str, mail: str) -> DataFrame:
    """``text``: topics by area as first seen, with metadata, description, link, numbered references and a link to write to; only spaces of a subject are encoded."""
    rows = rows.withColumn("group", F.coalesce(F.nullif("area", F.lit("")), F.lit("Other"))).withColumn("place", F.min("ord").over(Window.partitionBy("group"))).withColumn("part", F.lit(0)).withColumn("i", F.col("ord"))
    meta = F.concat_ws(" · ", F.when(F.col("difficulty") != "", F.concat(F.lit("**Difficulty:** "), "difficulty")), F.when(F.col("data_source") != "", F.concat(F.lit("**Data source:** "), "data_source")), F.when(F.lower("status") != "open", F.concat(F.lit("**Status:** "), "status")))
    refs = packed_list(F.col("refs"))
    listed = F.array_join(F.transform(refs, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x)), "\n")
    block = lambda c, has: F.when(has, F.concat(c, F.lit("\n")))
    lines = (
        F.concat(F.lit("### "), "title", F.lit("\n")), block(meta, meta != ""), block(F.col("description"), F.col("description") != ""), block(F.concat(F.lit("[Read the full proposal]("), "url", F.lit(")")), F.col("url") != ""),
        block(F.concat(F.lit("**References**\n\n"), listed), F.size(refs) > 0), F.concat(F.lit(f"[Ask about this topic](mailto:{mail}?subject=Thesis%20topic:%20"), F.replace("title", F.lit(" "), F.lit("%20")), F.lit(")\n")),
    )
    whole = one_text(_stacked(rows, (("place",), (F.concat(F.lit("## "), "group", F.lit("\n")),)), (("place", "part", "i"), lines)), "place", "part", "i", "k")
    return whole.select(F.concat(F.lit(f"# {title}\n\n"), "text").alias("text"))


def forward_report(findings: DataFrame, defs: DataFrame, unresolved: DataFrame, most: int = 200, mark: str = "==", bullet: str = "  * ") -> DataFrame:
    """``doc_id, place, i, line``: counts, findings by kind, each finding by page and height, and what couldn't be resolved, ``most`` at most.

    ``findings``: doc_id, kind, num, page, y, def_page; ``defs``, ``unresolved``: doc_id, kind, num (and page). A text for people: the list is cut, as it says.
    """
    docs = defs.select("doc_id").union(findings.select("doc_id")).union(unresolved.select("doc_id")).distinct()
    count = lambda rows, name: docs.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").select("doc_id", F.coalesce(name, F.lit(0)).alias(name))
    first = unresolved.groupBy("doc_id", "kind", "num").agg(F.min("page").alias("page"))
    head = count(defs.select("doc_id", "kind", "num").distinct(), "d").join(count(findings, "f"), "doc_id").join(count(first, "u"), "doc_id")
    out = head.select("doc_id", F.lit(0).alias("place"), F.posexplode(F.array(F.format_string("Floats defined: %d", "d"), F.format_string("Forward references flagged: %d", "f"), F.format_string("Unresolved references: %d", "u"))).alias("i", "line"))
    kinds = findings.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    numbered = lambda rows, place, line, *order: rows.select("doc_id", F.lit(place).alias("place"), F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).alias("i"), line.alias("line"))
    out = out.unionByName(numbered(kinds, 1, F.concat(F.lit(bullet), F.format_string("%s: %d", "kind", "n")), "kind"))
    line = F.concat(F.lit(mark + " "), F.initcap("kind"), F.format_string(" %s: page %d, defined on page %d (%d ahead)", "num", "page", "def_page", F.col("def_page") - F.col("page")))
    out = out.unionByName(numbered(findings, 2, line, "page", "y", "kind", "num"))
    left = numbered(first, 3, F.concat(F.lit(bullet), F.format_string("%s %s (first seen on page %d)", "kind", "num", "page")), "page", "kind", "num")
    return out.unionByName(left.where(F.col("i") <= most))


def verdict_report(rows: DataFrame, markdown: bool = True) -> DataFrame:
    """``doc_id, i, line``: a table row, or a line, for each item (doc_id, item, verdict, evidence, suggestion) in order of ``place``, and counts at the end."""
    fix = F.when(F.col("suggestion") != "", F.concat(F.lit(" **Fix:** " if markdown else " fix: "), "suggestion")).otherwise("")
    line = F.concat(F.lit("| "), "item", F.lit(" | "), "verdict", F.lit(" | "), "evidence", fix, F.lit(" |")) if markdown else F.concat(F.lit("["), "verdict", F.lit("] "), "item", F.lit(": "), "evidence", fix)
    out = rows.select("doc_id", F.col("place").cast("long").alias("place"), line.alias("line"))
    count = lambda v: F.count_if(F.col("verdict") == v)
    last = rows.groupBy("doc_id").agg(F.format_string("%d FAIL, %d UNCLEAR, %d PASS", count("FAIL"), F.count_if(~F.col("verdict").isin("FAIL", "PASS")), count("PASS")).alias("line"))
    out = out.unionByName(last.select("doc_id", F.lit(10**9).cast("long").alias("place"), "line"))
    return out.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).alias("i"), "line")


def dashboard(sections: DataFrame, groups: tuple[str, ...], title: str) -> DataFrame:
    """``html``: a page with tiles, a bar, and cards by group in the given order, the last for all others.

    ``sections``: script, grp, about, body, status (clean, findings or error).
    """
    count = lambda s: F.count_if(F.col("status") == s)
    tile = lambda n, label: F.format_string("<div class='tile'><b>%d</b> " + label + "</div>", n)
    width = lambda s: F.format_string("<span class='s-" + s + "' style='width:%.4f%%%%'></span>".replace("%%%%", "%%"), count(s) * 100.0 / F.count("*"))
    tiles = F.concat(tile(F.count("*"), "checks run"), tile(count("clean"), "clean"), tile(count("findings"), "with findings"), tile(count("error"), "errors"))
    bar = F.concat(F.lit("<div class='bar'>"), width("clean"), width("findings"), width("error"), F.lit("</div>"))
    card = F.concat(F.lit("<details class='s-"), "status", F.lit("'><summary>"), html_escape(F.col("script")), F.lit(" "), html_escape(F.col("about")), F.lit(" "), "status", F.lit("</summary><pre>"), F.coalesce(F.nullif(html_escape(F.col("body")), F.lit("")), F.lit("No output.")), F.lit("</pre></details>"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, groups)), F.col("grp")), F.lit(0)), F.lit(len(groups)))
    cards = sections.select(place.alias("place"), F.struct("ord", card.alias("card")).alias("c")).groupBy("place").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["card"]), "").alias("cards"))
    name = F.get(F.array(*map(F.lit, groups)), (F.col("place") - 1).cast("int"))
    listed = cards.select("place", F.concat(F.lit("<section><h2>"), html_escape(name), F.lit("</h2>"), "cards", F.lit("</section>")).alias("line"))
    head = sections.agg(F.concat(F.lit(f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>"), tiles, bar).alias("line")).select(F.lit(0).cast("long").alias("place"), "line")
    foot = sections.sparkSession.createDataFrame([(999, "</body></html>")], "place long, line string")
    return one_text(head.unionByName(listed.select(F.col("place").cast("long").alias("place"), "line")).unionByName(foot), "place").withColumnRenamed("text", "html")


def matrix_html(matrix: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """``figure, html``: a table row for each figure of a matrix of glyphs."""
    kinds = {"✓": "ok", "~": "weak", "✗": "bad", "·": "na"}
    named = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    cells = [F.concat(F.lit("<td class='"), F.coalesce(F.try_element_at(named, F.col(r)), F.lit("unk")), F.lit("'>"), F.col(r), F.lit("</td>")) for r in rules]
    return matrix.select("figure", F.concat(F.lit("<tr><td>"), html_escape(F.col("figure")), F.lit("</td>"), *cells, F.lit("</tr>")).alias("html"))


def graph_tex(edges: DataFrame) -> DataFrame:
    """``doc_id, text``: the weighted edges of a label graph as a TeX picture; where nodes stand is left to TeX."""
    line = F.format_string(r"  \path[->] (%s) edge node {%d} (%s);", "source", "weight", "target")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "target", line.alias("line")))), lambda x: x["line"]), "\n")
    return edges.groupBy("doc_id").agg(F.concat(F.lit("\\begin{tikzpicture}\n"), listed, F.lit("\n\\end{tikzpicture}")).alias("text"))


def one_text(lines: DataFrame, *order: str) -> DataFrame:
    """All lines as one text: for reports, which are small."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"])
    return lines.agg(F.array_join(parts, "\n").alias("text"))


def dashboard_cards(status: DataFrame) -> DataFrame:
    """``grp, html``: a card for each group of linters, with the share of clean ones."""
    cells = F.concat(F.lit("<li>"), html_escape(F.col("script")), F.lit(": "), F.when(F.col("status") == 0, "clean").otherwise("findings"), F.lit("</li>"))
    items = F.array_join(F.array_sort(F.collect_list(cells)), "")
    share = F.round(100.0 * F.count_if(F.col("status") == 0) / F.count("*"), 0).cast("int")
    return status.groupBy("grp").agg(F.concat(F.lit("<section><h2>"), html_escape(F.first("grp")), F.format_string("</h2><p>%d%% clean</p><ul>", share), items, F.lit("</ul></section>")).alias("html"))
