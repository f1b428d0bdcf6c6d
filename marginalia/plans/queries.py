"""The registered queries over driver tables and fixtures, each with the same in SQL where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import catalog, layout, relations, render, sequences
from marginalia.plans import judge, rules, tex_blocks
from marginalia.plans.fixtures import frame
from marginalia.plans.registered import query, table, values
from marginalia.sources import files

# ---- catalog -----------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE lower(o_orderstatus) = 'f' GROUP BY 1")
def p1_eq_ci(spark, d):
    return table(spark, d, "orders").where(catalog.equals("o_orderstatus", "f")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE contains(lower(p_type), 'eco') GROUP BY 1")
def p2_contains_ci(spark, d):
    return table(spark, d, "part").where(catalog.holds("p_type", "Eco")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT ord, title FROM catalog WHERE starts_with(date, '2024') OR ends_with(date, '2024')", ("catalog",))
def p3_year_affix(spark, d):
    return catalog.filter_catalog(frame(spark, "catalog"), year="2024").select("ord", "title")


@query("SELECT ord, title, author FROM catalog WHERE lower(university) = 'north' AND lower(status) = 'completed' AND contains(lower(industry), 'acme')", ("catalog",))
def p1_p2_all_filters(spark, d):
    return catalog.filter_catalog(frame(spark, "catalog"), university="NORTH", status="COMPLETED", industry="acme").select("ord", "title", "author")


@query("SELECT ord, title, coalesce(nullif(area, ''), 'Other') AS area FROM topics WHERE lower(status) = 'open'", ("topics",))
def p4_open_topics(spark, d):
    return catalog.open_topics(frame(spark, "topics")).select("ord", "title", F.coalesce(F.nullif("area", F.lit("")), F.lit("Other")).alias("area"))


@query("SELECT event_type AS key, count(*) AS n, min(event_id) AS first_ord, row_number() OVER (ORDER BY min(event_id)) AS place FROM events GROUP BY 1")
def a1_group_first_seen(spark, d):
    return catalog.groups_in_order(table(spark, d, "events"), F.col("event_type"), "event_id")


@query("SELECT user_id, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM (SELECT user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1)")
def a2_most_common(spark, d):
    return catalog.most_common(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus <> 'F') AS open FROM orders GROUP BY 1")
def a3_conditional_counts(spark, d):
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.count_if(~done).alias("open"))


@query("SELECT y AS year, count(*) AS n FROM (SELECT list_filter(string_split(replace(date, ',', ' '), ' '), lambda w: regexp_full_match(w, '[0-9]{4}'))[1] AS y FROM catalog WHERE lower(status) = 'completed') WHERE y IS NOT NULL GROUP BY 1", ("catalog",))
def a4_year_histogram(spark, d):
    return catalog.year_histogram(frame(spark, "catalog"))


@query("SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM (SELECT p_brand, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1 ORDER BY n DESC, f LIMIT 10)")
def a5_topk(spark, d):
    return catalog.most_common(table(spark, d, "part"), "p_brand", "p_partkey", 10)


@query("SELECT n_regionkey, median(n_nationkey) AS middle, list_sort(list(n_nationkey))[count(*) // 2 + 1] AS upper_middle FROM nation GROUP BY 1")
def a7_medians(spark, d):
    upper = F.get(F.array_sort(F.collect_list("n_nationkey")), F.expr("cast(count(*) div 2 as int)"))  # 25 rows
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.median("n_nationkey").alias("middle"), upper.alias("upper_middle"))


@query("SELECT user_id, min_by(event_type, event_id) AS first_type, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types FROM events GROUP BY 1")
def a8_a10_first_and_set(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("types"))


@query("SELECT script, rc, greatest(CASE WHEN rc <> 0 THEN 1 ELSE 0 END, CASE WHEN findings > 0 THEN 1 ELSE 0 END) AS status, round(100.0 * findings / sum(findings) OVER (), 4) AS share FROM runs", ("runs",))
def a12_a18_status_and_share(spark, d):
    whole = Window.partitionBy()
    status = F.greatest(F.when(F.col("rc") != 0, 1).otherwise(0), F.when(F.col("findings") > 0, 1).otherwise(0))
    return frame(spark, "runs").select("script", "rc", status.alias("status"), F.round(F.lit(100.0) * F.col("findings") / F.sum("findings").over(whole), 4).alias("share"))


@query("SELECT caption, rule, max_by(method, severity * 10 + CASE method WHEN 'pixels' THEN 1 ELSE 0 END) AS method, max(severity) AS severity FROM caption_judged GROUP BY 1, 2", ("caption_judged",))
def a13_most_severe(spark, d):
    order = F.struct("severity", F.col("method") == "pixels")
    return frame(spark, "caption_judged").groupBy("caption", "rule").agg(F.max_by("method", order).alias("method"), F.max("severity").alias("severity"))


@query("SELECT event_type, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM events GROUP BY 1")
def a15_distinct_first(spark, d):
    return relations.first_of(table(spark, d, "events"), ["event_type"], [F.col("event_id")]).select("event_type", "event_id", "user_id")


@query("SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS place FROM orders")
def w1_rownum_in_group(spark, d):
    return catalog.numbered(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), "o_custkey", "o_orderstatus", order="o_orderkey")


@query("SELECT DISTINCT n_regionkey AS key FROM nation UNION SELECT r_regionkey FROM region WHERE r_regionkey > 2")
def u1_union_distinct(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("key")).union(table(spark, d, "region").where("r_regionkey > 2").select("r_regionkey")).distinct()


@query("SELECT id, list_filter(list_transform(string_split(refs, '|'), lambda x: trim(x)), lambda x: x <> '')[1] AS first_ref, len(list_filter(list_transform(string_split(refs, '|'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM topics", ("topics",))
def f20_packed_list(spark, d):
    parts = tx.packed_list(F.col("refs"))
    return frame(spark, "topics").select("id", F.try_element_at(parts, F.lit(1)).alias("first_ref"), F.size(parts).cast("long").alias("n"))


# ---- text --------------------------------------------------------------------------------------------------

_SAFE = "text"
for _a in tx.ABBREVIATIONS:
    _SAFE = f"regexp_replace({_SAFE}, '(^|[^0-9A-Za-z_]){_a.replace('.', chr(92) + '.')}\\.', '\\1{_a.replace('.', '')}', 'g')"
_SENTENCES = f"list_filter(string_split(regexp_replace({_SAFE}, '([.!?])[ \\t\\n\\r]+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '')"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n FROM documents")
def f3_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-'']*')) AS words FROM documents")
def f6_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, ord, regexp_extract(text, '^((?:\\\\.|[^%\\\\])*\\\\?)', 1) AS kept, regexp_replace(text, '(^|[^\\\\])%.*', '\\1', 'g') AS simply FROM tex", ("tex",))
def f2_strip_comments(spark, d):
    return frame(spark, "tex").select("doc_id", "ord", tx.strip_tex_comment(F.col("text")).alias("kept"), tx.strip_tex_comment_simply(F.col("text")).alias("simply"))


@query("SELECT ord, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, regexp_replace(title, '([&%$#_{}])', '\\\\\\1', 'g') AS tex FROM catalog", ("catalog",))
def f12_f21_escape(spark, d):
    return frame(spark, "catalog").select("ord", tx.html_escape(F.col("title")).alias("html"), tx.tex_escape(F.col("title")).alias("tex"))


@query("SELECT doc_id, kind, num, list_aggregate(list_transform(string_split(num, '.'), lambda p: regexp_replace(p, '^0+([0-9])', '\\1')), 'string_agg', '.') AS normal FROM crefs UNION ALL SELECT doc_id, kind, num, list_aggregate(list_transform(string_split(num, '.'), lambda p: regexp_replace(p, '^0+([0-9])', '\\1')), 'string_agg', '.') FROM defs", ("crefs", "defs"))
def f13_normal_number(spark, d):
    both = frame(spark, "crefs").select("doc_id", "kind", "num").unionAll(frame(spark, "defs").select("doc_id", "kind", "num"))
    return both.withColumn("normal", tx.normal_number(F.col("num")))


@query(
    """SELECT doc_id, ord, n FROM (SELECT doc_id, ord, unnest(regexp_extract_all(text, '[A-Z]?[0-9]+(?:\\.[0-9]+)?')) AS n FROM mentions)
    UNION SELECT doc_id, ord, unnest(list_transform(generate_series(a::INT, b::INT), lambda x: x::VARCHAR)) FROM (SELECT doc_id, ord, regexp_extract(text, '([0-9]+)-([0-9]+)', 1) AS a, regexp_extract(text, '([0-9]+)-([0-9]+)', 2) AS b FROM mentions) WHERE a <> '' AND b::INT <= a::INT + 50""",
    ("mentions",),
)
def f11_number_ranges(spark, d):
    return frame(spark, "mentions").select("doc_id", "ord", F.explode(tx.number_list(F.col("text"))).alias("n")).distinct()


@query("SELECT id, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT id, word, unnest(positions) AS p FROM inverted) GROUP BY 1", ("inverted",))
def f22_inverted_index(spark, d):
    return relations.inverted_text(frame(spark, "inverted"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 350) || ' … ' || right(text, 250) END AS cut FROM documents")
def f18_middle_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.middle_cut(F.col("text")).alias("cut"))


@query("SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS norm, list_transform(authors, lambda a: lower(list_extract(string_split(a, ' '), -1)))[1] AS first_author FROM bib", ("bib",))
def f7_f9_titles_and_names(spark, d):
    return frame(spark, "bib").select("id", tx.squeezed_title(F.col("title")).alias("norm"), F.try_element_at(tx.last_names(F.col("authors")), F.lit(1)).alias("first_author"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events")
def x_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


# ---- sequences ---------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, coalesce(max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) = 1 AS seen FROM conversations")
def w3_sticky_flag(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sequences.sticky(F.col("role") == "assistant", "conv_id", "turn").alias("seen"))


@query(
    """, m AS (SELECT *, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM lines)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) - 1 AS para, min(ord) AS first_ord, string_agg(trim(text), ' ' ORDER BY ord) AS text FROM m WHERE trim(text) <> '' GROUP BY doc_id, p""".lstrip(),
    ("lines",),
)
def w4_paragraph_islands(spark, d):
    return sequences.paragraphs(frame(spark, "lines"))


@query(
    """, n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    w AS (SELECT conv_id, turn, i, n, unnest(generate_series(greatest(0, ceil((i - 2) / 2.0))::BIGINT, i // 2)) AS "window" FROM n)
    SELECT conv_id, turn, i, "window" FROM w WHERE "window" * 2 < n - 1 OR (n = 1 AND "window" = 0)""".replace(", n AS", "WITH n AS", 1).lstrip(),
)
def w8_overlap_windows(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    return sequences.overlapping_windows(rows, 3, 2, "conv_id", "turn")


@query(
    """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    s AS (SELECT conv_id, turn, i, 0::BIGINT AS chunk, l AS held FROM r WHERE i = 1
      UNION ALL SELECT r.conv_id, r.turn, r.i, CASE WHEN s.held >= 300 THEN s.chunk + 1 ELSE s.chunk END, CASE WHEN s.held >= 300 THEN r.l ELSE s.held + r.l END FROM s JOIN r ON r.conv_id = s.conv_id AND r.i = s.i + 1)
    SELECT conv_id, turn, chunk FROM s"""
)
def w9_greedy_chunks(spark, d):
    rows = table(spark, d, "conversations").withColumn("turn", F.col("turn").cast("int"))
    return sequences.greedy_chunks(rows, 300, "conv_id", "turn").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("chunk").cast("long").alias("chunk"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 15 AS batch FROM conversations")
def w10_batches(spark, d):
    return sequences.batches(table(spark, d, "conversations").select("conv_id", "turn"), 15, "conv_id", "turn")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS section_end FROM conversations")
def w14_w16_state_and_end(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = sequences.last_state(F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", asked.alias("asked"), F.lead("turn").over(w).alias("section_end"))


@query(
    """, t AS (SELECT doc_id, ord, trim(text) AS x FROM lines)
    SELECT a.doc_id, a.ord, (SELECT arg_min(b.x, b.ord) FROM t b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.ord <= a.ord + 3 AND b.x <> '') AS next FROM t a""",
    ("lines",),
)
def w6_next_text(spark, d):
    return frame(spark, "lines").select("doc_id", "ord", sequences.next_text().alias("next"))


@query(
    """, s AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN -1 WHEN 'view' THEN 1 ELSE 0 END AS v FROM events),
    r AS (SELECT *, sum(v) OVER w AS raw FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, user_id, raw - least(0, min(raw) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS depth FROM r""".replace(", s AS", "WITH s AS", 1)
)
def w13_clamped_depth(spark, d):
    delta = F.when(F.col("event_type") == "purchase", -1).when(F.col("event_type") == "view", 1).otherwise(0)
    return sequences.with_depth(table(spark, d, "events").select("event_id", "user_id", "event_type"), delta, "user_id", "event_id").select("event_id", "user_id", "depth")


_STEM = "CASE WHEN length(t) > 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) ELSE t END"


@query(
    f""", i AS (SELECT doc_id, ix, {_STEM} AS k FROM (SELECT doc_id, ix, unnest(introduced) AS t FROM paragraphs)),
    u AS (SELECT doc_id, ix, t AS term, {_STEM} AS k FROM (SELECT doc_id, ix, unnest(used) AS t FROM paragraphs))
    SELECT doc_id, ix, term FROM u WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = u.doc_id AND i.k = u.k AND i.ix < u.ix)""",
    ("paragraphs",),
)
def w12_reconcile(spark, d):
    return sequences.introduced_before(frame(spark, "paragraphs"))


@query(
    """, t AS (SELECT doc_id, ord, trim(text) AS x FROM lines), h AS (SELECT doc_id, max(ord) AS s FROM t WHERE regexp_matches(x, '(?i)^(References|Bibliography)\\s*$') GROUP BY 1),
    n AS (SELECT t.doc_id, t.ord, t.x, sum(CASE WHEN regexp_matches(x, '^\\[[0-9]+\\]\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.ord) AS entry FROM t JOIN h ON t.doc_id = h.doc_id AND t.ord > h.s AND t.x <> '')
    SELECT doc_id, entry, min(ord) AS ord, string_agg(x, ' ' ORDER BY ord) AS text FROM n WHERE entry > 0 GROUP BY 1, 2""",
    ("lines",),
)
def w18_reference_entries(spark, d):
    return sequences.reference_entries(frame(spark, "lines"))


# ---- relations ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j1_anti_customers(spark, d):
    return relations.unreferenced(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j2_semi_labels(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")).join(toxic, "doc_id", "left_semi")


_DEFS = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, num ORDER BY page, y) AS k FROM (SELECT doc_id, kind, regexp_replace(num, '^0+([0-9])', '\\1') AS num, page, y FROM defs)) WHERE k = 1)"


@query(
    f""", {_DEFS}, f AS (SELECT r.doc_id, r.kind, r.num, r.page, r.ord, d.page AS def_page, (d.page - r.page) + (d.y - r.y) / 800.0 AS distance, round(r.y) AS place FROM crefs r JOIN d ON r.doc_id = d.doc_id AND r.kind = d.kind AND r.num = d.num AND (d.page > r.page OR d.page = r.page AND d.y > r.y))
    SELECT doc_id, kind, num, page, ord, def_page, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, num, page, place ORDER BY ord) AS k FROM f WHERE distance > 1.0) WHERE k = 1""",
    ("defs", "crefs"),
)
def j4_forward_float_theta(spark, d):
    defs = frame(spark, "defs").withColumn("num", tx.normal_number(F.col("num")))
    return relations.forward_references(defs, frame(spark, "crefs"), 800.0, 1.0).withColumn("distance", F.round("distance", 4))


@query(f", {_DEFS} SELECT doc_id, kind, num, min(ord) AS ord FROM crefs r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = r.doc_id AND d.kind = r.kind AND d.num = r.num) GROUP BY 1, 2, 3", ("defs", "crefs"))
def j4b_unresolved_anti(spark, d):
    defs = frame(spark, "defs").withColumn("num", tx.normal_number(F.col("num")))
    left = relations.unreferenced(frame(spark, "crefs"), defs, ["doc_id", "kind", "num"])
    return left.groupBy("doc_id", "kind", "num").agg(F.min("ord").alias("ord"))


@query("SELECT v.user_id, v.event_id, min(p.event_id) AS purchase FROM events v JOIN events p ON v.user_id = p.user_id AND p.event_id > v.event_id WHERE v.event_type = 'view' AND p.event_type = 'purchase' GROUP BY 1, 2")
def j6_before_purchase(spark, d):
    """The next purchase after each view: a window, where a join on an inequality would pair all of a user's events."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type").where(F.col("event_type").isin("view", "purchase"))
    after = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(after)
    return events.withColumn("purchase", nxt).where("event_type = 'view' and purchase is not null").select("user_id", "event_id", "purchase")


@query(
    f""", i AS (SELECT doc_id, t AS term, min(ix) AS at, {_STEM} AS stem FROM (SELECT doc_id, ix, unnest(introduced) AS t FROM paragraphs) WHERE length(t) >= 4 GROUP BY 1, 2)
    SELECT DISTINCT i.doc_id, i.term, p.ix, i.at FROM i JOIN paragraphs p ON i.doc_id = p.doc_id AND NOT p.is_caption AND p.ix < i.at AND regexp_matches(lower(p.text), '(^|[^a-z0-9-])' || i.stem || 's?([^a-z0-9-]|$)')""",
    ("paragraphs",),
)
def j5_concept_before_definition(spark, d):
    return relations.concept_uses(frame(spark, "paragraphs"))


@query(
    """, e AS (SELECT u.doc_id, u.ord, u.level, u.title, (SELECT min(v.ord) FROM units v WHERE v.doc_id = u.doc_id AND v.ord > u.ord AND v.level <= u.level) AS stop FROM units u)
    SELECT e.doc_id, 'LONE-CHILD' AS code, 'WARN' AS severity, e.ord, min(c.title) AS subject FROM e JOIN units c ON c.doc_id = e.doc_id AND c.ord > e.ord AND (e.stop IS NULL OR c.ord < e.stop) AND c.level = e.level + 1 GROUP BY e.doc_id, e.ord HAVING count(*) = 1""",
    ("units",),
)
def j8_lone_child(spark, d):
    return rules.lone_children(frame(spark, "units"))


@query(
    """, e AS (SELECT u.doc_id, u.ord, u.level, u.title, (SELECT min(v.ord) FROM units v WHERE v.doc_id = u.doc_id AND v.ord > u.ord AND v.level <= u.level) AS stop FROM units u)
    SELECT e.doc_id, 'LONE-CHILD' AS code, 'INFO' AS severity, e.ord, min(c.title) AS subject FROM e JOIN units c ON c.doc_id = e.doc_id AND c.ord > e.ord AND (e.stop IS NULL OR c.ord < e.stop) AND c.level = e.level + 1 GROUP BY e.doc_id, e.ord HAVING count(*) = 1""",
    ("units",),
)
def j8_lone_child_of_a_paper(spark, d):
    return rules.lone_children(frame(spark, "units"), "paper")


@query("SELECT s.doc_id, s.label AS source, r.target, count(*) AS weight FROM sections s, (SELECT doc_id, label, unnest(regexp_extract_all(text, '\\\\ref\\{([^}]*)\\}', 1)) AS target FROM sections) r WHERE r.doc_id = s.doc_id AND r.label = s.label AND r.target IN (SELECT label FROM sections x WHERE x.doc_id = s.doc_id) GROUP BY 1, 2, 3", ("sections",))
def j10_label_graph(spark, d):
    return relations.label_graph(frame(spark, "sections"))


@query(
    """, p AS (SELECT item, ord, regexp_extract(raw, '"verdict": "([A-Z]+)"', 1) AS verdict, regexp_extract(raw, '"note": "([a-z]+)"', 1) AS note FROM judged), l AS (SELECT item, arg_max(verdict, ord) AS verdict, arg_max(note, ord) AS note FROM p GROUP BY 1)
    SELECT c.item, c.question, coalesce(nullif(verdict, ''), 'UNCLEAR') AS verdict, coalesce(nullif(note, ''), '-') AS note FROM checklist c LEFT JOIN l ON c.item = l.item""",
    ("judged", "checklist"),
)
def j11_judge_defaults(spark, d):
    parsed = tx.tolerant_json(F.col("raw"), "verdict string, note string")
    results = frame(spark, "judged").select("item", "ord", parsed.alias("r")).select("item", "ord", "r.verdict", "r.note")
    return relations.with_default(frame(spark, "checklist"), results, "item", "ord", verdict="UNCLEAR", note="-")


@query("SELECT bib_id, ord, title, sim FROM (SELECT *, row_number() OVER (PARTITION BY bib_id ORDER BY sim DESC, ord) AS k FROM candidates) WHERE k = 1", ("candidates",))
def j12_best_candidate(spark, d):
    return relations.best_candidates(frame(spark, "candidates")).select("bib_id", "ord", "title", "sim")


@query("SELECT r.script, coalesce(g.grp, 'Other') AS grp FROM runs r LEFT JOIN registry g ON r.script = g.script", ("runs", "registry"))
def j15_registry_group(spark, d):
    groups = frame(spark, "registry").select("script", "grp")
    return frame(spark, "runs").join(F.broadcast(groups), "script", "left").select("script", F.coalesce("grp", F.lit("Other")).alias("grp"))  # the registry is a literal


@query("SELECT script FROM registry WHERE list_contains(profiles, 'thesis') AND tex_ok", ("registry",))
def p14_applicable(spark, d):
    return frame(spark, "registry").where(F.array_contains("profiles", "thesis") & F.col("tex_ok")).select("script")


@query("SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'missing' ELSE 'changed' END AS change FROM manifest_a a FULL JOIN manifest_b b ON a.file = b.file WHERE a.sha IS DISTINCT FROM b.sha", ("manifest_a", "manifest_b"))
def j16_manifest_diff(spark, d):
    return relations.manifest_difference(frame(spark, "manifest_a"), frame(spark, "manifest_b"))


@query("SELECT f.doc_id, f.title FROM found f WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = f.doc_id AND contains(lower(c.title), lower(f.title)))", ("found", "cited"))
def j17_not_cited(spark, d):
    return relations.not_cited(frame(spark, "found"), frame(spark, "cited"))


@query("SELECT code, severity, n, row_number() OVER (ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, code) AS place FROM (VALUES ('A', 'INFO', 1), ('B', 'ERROR', 2), ('C', 'WARN', 3)) t(code, severity, n)")
def o1_severity_order(spark, d):
    rows = spark.createDataFrame([("A", "INFO", 1), ("B", "ERROR", 2), ("C", "WARN", 3)], "code string, severity string, n int")
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(rank, "code")))


# ---- rules -------------------------------------------------------------------------------------------------

_FINDING = "doc_id, '{0}' AS code, '{1}' AS severity, {3} AS ord, {2} AS subject"


def _sql_finding(code: str, severity: str, subject: str, rest: str, order: str = "ord") -> str:
    return "SELECT " + _FINDING.format(code, severity, subject, order) + " " + rest


def _pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_VAGUE = r"(?i)\b(" + "|".join(w.replace(" ", r"\s+") for w in rules.VAGUE) + r")\b"
_PROSE = " UNION ALL ".join(
    [
        _sql_finding("VAGUE-QUANTIFIER", "WARN", f"lower(regexp_extract(text, {_pattern(_VAGUE)}, 1))", f"FROM sentences WHERE regexp_matches(text, {_pattern(_VAGUE)}) AND NOT regexp_matches(text, {_pattern(rules.NUMBER)}) AND NOT regexp_matches(text, {_pattern(rules.CITED)}) AND NOT regexp_matches(text, {_pattern(rules.SIGNIFICANT)})"),
        _sql_finding("JARGON", "WARN", f"lower(regexp_extract(text, {_pattern(rules.JARGON)}, 1))", f"FROM sentences WHERE regexp_matches(text, {_pattern(rules.JARGON)})"),
        _sql_finding("FORWARD-CUE", "WARN", f"lower(regexp_extract(text, {_pattern(rules.FORWARD)}, 1))", f"FROM sentences WHERE regexp_matches(text, {_pattern(rules.FORWARD)})"),
        _sql_finding("FORWARD-CUE-HABIT", "WARN", "count(*)::VARCHAR", f"FROM sentences WHERE regexp_matches(text, {_pattern(rules.FORWARD)}) GROUP BY doc_id HAVING count(*) > 3", "min(ord)"),
        _sql_finding("DANGLING-REFERENCE", "INFO", f"regexp_extract(text, {_pattern(rules.DANGLING)}, 1)", f"FROM sentences WHERE regexp_matches(text, {_pattern(rules.DANGLING)})"),
    ]
)


@query(_PROSE, ("sentences",))
def rule_prose(spark, d):
    return rules.prose(frame(spark, "sentences"))


@query(_PROSE.replace(_pattern(_VAGUE), _pattern(r"(?i)\b(" + "|".join(w.replace(" ", r"\s+") for w in rules.VAGUE_STRICT) + r")\b")), ("sentences",))
def rule_prose_strict(spark, d):
    return rules.prose(frame(spark, "sentences"), strict=True)


@query(_sql_finding("COMPANION-REF", "WARN", f"lower(regexp_extract(text, {_pattern(rules.COMPANION)}, 1))", f"FROM sentences WHERE regexp_matches(text, {_pattern(rules.COMPANION)}) AND NOT regexp_matches(text, {_pattern(rules.CITED)})"), ("sentences",))
def rule_companion(spark, d):
    return rules.companions(frame(spark, "sentences"))


_DEFINED = " UNION ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, {_pattern(p)}, 1)) AS label FROM codes" for p in rules.DEFINING)


@query(
    f""", u AS (SELECT doc_id, ord, regexp_matches(text, {_pattern(rules.SCHEME)}) AS near, unnest(regexp_extract_all(text, {_pattern(rules.CODE)}, 1)) AS label FROM codes),
    m AS (SELECT doc_id, regexp_extract(label, '^([A-Z]+)', 1) AS prefix, label, count(*) AS n, min(ord) AS ord, bool_or(near) AS near FROM u WHERE label NOT IN ({", ".join(_pattern(x) for x in rules.NOTATION)}) AND regexp_extract(label, '([0-9]+)$', 1)::INT <= 20 GROUP BY 1, 2, 3),
    x AS ({_DEFINED}), f AS (SELECT m.*, x.label IS NOT NULL AS defined FROM m LEFT JOIN x ON m.doc_id = x.doc_id AND m.label = x.label)
    SELECT doc_id, 'UNDEFINED-CODE' AS code, CASE WHEN sum(n) FILTER (WHERE NOT defined) >= 3 THEN 'WARN' ELSE 'INFO' END AS severity, arg_min(ord, label) FILTER (WHERE NOT defined) AS ord, string_agg(label, ', ' ORDER BY label) FILTER (WHERE NOT defined) AS subject
    FROM f GROUP BY doc_id, prefix HAVING count(*) >= 2 AND (bool_or(near) OR count(*) >= 3) AND count(*) FILTER (WHERE NOT defined) > 0""",
    ("codes",),
)
def a9_code_schemes(spark, d):
    return rules.codes(frame(spark, "codes"))


def _term_pattern(variant: str) -> str:
    """The variant between characters that no word has; separators of the text are doubled first."""
    return r"(?i)(?:^|[^\w-])" + re.escape(variant).replace(r"\ ", r"[\s~]+") + r"(?:e?s)?(?:[^\w-]|$)"


_VARIANTS = " UNION ALL ".join(f"SELECT doc_id, ord, {_pattern(t)} AS term, {_pattern(v)} AS variant, {i} AS i, len(regexp_extract_all(regexp_replace(text, '([^\\w-])', '\\1\\1', 'g'), {_pattern(_term_pattern(v))})) AS n FROM terms" for t, vs in rules.TERMS for i, v in enumerate(vs))


@query(
    f""", c AS ({_VARIANTS}), f AS (SELECT doc_id, term, variant, i, sum(n) AS n, min(ord) AS ord FROM c WHERE n > 0 GROUP BY 1, 2, 3, 4 HAVING sum(n) >= 2),
    g AS (SELECT doc_id, term, count(*) AS kinds, min(i) AS least, min(ord) AS ord, string_agg(variant, ', ' ORDER BY n DESC, i) AS variants FROM f GROUP BY 1, 2)
    SELECT doc_id, CASE WHEN kinds > 1 THEN 'TERM-MIX' ELSE 'NON-DICTIONARY' END AS code, CASE WHEN kinds > 1 THEN 'WARN' ELSE 'INFO' END AS severity, ord, variants AS subject FROM g WHERE kinds > 1 OR least > 0""",
    ("terms",),
)
def a17_term_mix(spark, d):
    return rules.terminology(frame(spark, "terms"))


_KEPT = f"""k AS (SELECT doc_id, ord, regexp_replace(text, '\\[[0-9]+(?:,\\s*[0-9]+)*\\]', ' ', 'g') AS text FROM (SELECT *, coalesce(max(CASE WHEN regexp_matches(trim(text), {_pattern(sequences.REFERENCES)}) THEN 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), 0) AS refs FROM lines WHERE NOT regexp_matches(text, {_pattern(tx.TOC_STRICT)})) WHERE refs = 0 AND NOT regexp_matches(trim(text), {_pattern(sequences.CAPTION)}))"""


@query(
    f""", {_KEPT}, u AS (SELECT doc_id, ord, regexp_replace(unnest(regexp_extract_all(text, {_pattern(rules.ACRONYM)}, 1)), 's+$', '') AS acro FROM k),
    v AS (SELECT * FROM u WHERE acro NOT IN ({", ".join(_pattern(x) for x in rules.KNOWN_ACRONYMS)}) AND length(regexp_replace(acro, '[^A-Z]', '', 'g')) >= 2),
    p AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, {_pattern(rules.EXPANSION)}, 1)) AS long, regexp_replace(unnest(regexp_extract_all(text, {_pattern(rules.EXPANSION)}, 2)), 's+$', '') AS acro FROM k),
    q AS (SELECT *, string_split(lower(regexp_replace(acro, '[^A-Za-z]', '', 'g')), '') AS letters, list_transform(regexp_split_to_array(long, '[ -]'), lambda w: lower(left(w, 1))) AS initials FROM p),
    e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, acro ORDER BY ord) AS i FROM q WHERE len(letters) >= 2 AND len(list_filter(letters, lambda c: list_contains(initials, c))) >= greatest(2, len(letters) - 1)),
    f AS (SELECT doc_id, acro, ord AS start_at FROM e WHERE i = 1)
    SELECT v.doc_id, 'USED-BEFORE-EXPANSION' AS code, 'WARN' AS severity, min(v.ord) AS ord, v.acro AS subject FROM v JOIN f ON v.doc_id = f.doc_id AND v.acro = f.acro AND v.ord < f.start_at GROUP BY v.doc_id, v.acro
    UNION ALL SELECT doc_id, 'RE-EXPANDED', 'WARN', ord, acro FROM e WHERE i > 1
    UNION ALL SELECT doc_id, 'EXPANDED-ONCE-UNUSED', 'INFO', start_at, acro FROM f WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = f.doc_id AND v.acro = f.acro AND v.ord > f.start_at)
    UNION ALL SELECT doc_id, 'NEVER-EXPANDED', 'WARN', min(ord), acro FROM v WHERE NOT EXISTS (SELECT 1 FROM f WHERE v.doc_id = f.doc_id AND v.acro = f.acro) GROUP BY doc_id, acro HAVING count(*) >= 2""",
    ("lines",),
)
def rule_acronyms(spark, d):
    return rules.acronyms(frame(spark, "lines"))


@query(
    """, c AS (SELECT doc_id, ord, regexp_replace(text, '(^|[^\\\\])%.*', '\\1', 'g') AS t FROM tex),
    r AS (SELECT DISTINCT doc_id, trim(unnest(string_split(x, ','))) AS label FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\\\(?:ref|eqref|autoref|cref|Cref|vref|pageref)\\*?\\{([^}]+)\\}', 1)) AS x FROM c) UNION SELECT doc_id, unnest(regexp_extract_all(t, '\\\\hyperref\\[([^\\]]+)\\]', 1)) FROM c),
    l AS (SELECT doc_id, ord, unnest(regexp_extract_all(t, '\\\\label\\{([^}]+)\\}', 1)) AS label FROM c)
    SELECT doc_id, ord, label FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.label = l.label)""",
    ("tex",),
)
def j1_unreferenced_labels(spark, d):
    return rules.unreferenced_tex(frame(spark, "tex"), all_labels=True).where("code = 'UNREFERENCED'").select("doc_id", "ord", F.col("subject").alias("label"))


_ENVS = "|".join(x.replace("*", r"\*") for x in (*rules.MATH, *[m + "*" for m in rules.MATH], *rules.FLOATS))
_TOKENS = f"""c AS (SELECT doc_id, ord, regexp_replace(text, '(^|[^\\\\])%.*', '\\1', 'g') AS t FROM tex),
    k AS (SELECT doc_id, ord, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, ord, regexp_extract_all(t, {_pattern(rf"(\\begin\{{(?:{_ENVS})\}}|\\end\{{(?:{_ENVS})\}}|\\label\{{[^}}]+\}}|\\caption\b)")}, 1) AS l FROM c)),
    v AS (SELECT *, sum(CASE WHEN starts_with(tok, '\\begin') THEN 1 WHEN starts_with(tok, '\\end') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord, i ROWS UNBOUNDED PRECEDING) AS raw FROM k),
    z AS (SELECT *, raw - least(0, min(raw) OVER (PARTITION BY doc_id ORDER BY ord, i ROWS UNBOUNDED PRECEDING)) + CASE WHEN starts_with(tok, '\\end') THEN 1 ELSE 0 END AS lv FROM v),
    y AS (SELECT *, last_value(CASE WHEN starts_with(tok, '\\begin') THEN regexp_extract(tok, '\\{{([^}}]+)\\}}', 1) END IGNORE NULLS) OVER w AS e, max(CASE WHEN starts_with(tok, '\\begin') THEN ord * 10000 + i END) OVER w AS block, max(CASE WHEN starts_with(tok, '\\begin') THEN ord END) OVER w AS begun
      FROM z WINDOW w AS (PARTITION BY doc_id, lv ORDER BY ord, i ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT * EXCLUDE (e), CASE WHEN lv > 0 THEN coalesce(e, '') ELSE '' END AS env FROM y),
    l AS (SELECT doc_id, ord, coalesce(env, '') AS env, trim(regexp_extract(tok, '\\{{([^}}]+)\\}}', 1)) AS label FROM o WHERE starts_with(tok, '\\label'))"""
_MATHS, _FLOATS = (", ".join(map(_pattern, x)) for x in (rules.MATH, rules.FLOATS))


@query(
    f""", {_TOKENS}, r AS (SELECT DISTINCT doc_id, trim(unnest(string_split(x, ','))) AS label FROM (SELECT doc_id, unnest(regexp_extract_all(t, {_pattern(rules.REFERRING)}, 1)) AS x FROM c) UNION SELECT doc_id, trim(unnest(regexp_extract_all(t, '\\\\hyperref\\[([^\\]]+)\\]', 1))) FROM c),
    n AS (SELECT *, CASE WHEN contains(label, ':') THEN lower(split_part(label, ':', 1)) ELSE '' END AS prefix, regexp_replace(env, '\\*$', '') AS base FROM l),
    b AS (SELECT doc_id, block, any_value(env) AS env, min(begun) AS ord, bool_or(starts_with(tok, '\\label')) AS labelled, bool_or(starts_with(tok, '\\caption')) AS captioned FROM o WHERE env <> '' GROUP BY 1, 2)
    SELECT doc_id, 'UNREFERENCED' AS code, 'WARN' AS severity, ord, label AS subject FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = n.doc_id AND r.label = n.label) AND (base IN ({_MATHS}) OR base IN ('figure', 'table', 'algorithm', 'listing') OR prefix IN ('eq', 'fig', 'tab', 'table', 'alg', 'lst'))
    UNION ALL SELECT doc_id, 'UNLABELED-EQ', 'WARN', ord, env FROM b WHERE NOT labelled AND env IN ({_MATHS})
    UNION ALL SELECT doc_id, 'UNLABELED-FLOAT', 'WARN', ord, env FROM b WHERE NOT labelled AND captioned AND env IN ({_FLOATS})""",
    ("tex",),
)
def rule_unreferenced_tex(spark, d):
    return rules.unreferenced_tex(frame(spark, "tex"))


@query(
    f""", {_TOKENS}, m AS (SELECT DISTINCT doc_id, label FROM l WHERE regexp_replace(env, '\\*$', '') IN ({_MATHS})),
    r AS (SELECT doc_id, ord, trim(unnest(string_split(x, ','))) AS label FROM (SELECT doc_id, ord, unnest(regexp_extract_all(t, '\\\\ref\\*?\\{{([^}}]+)\\}}', 1)) AS x FROM c))
    SELECT r.doc_id, 'REF-NOT-EQREF' AS code, 'WARN' AS severity, r.ord, r.label AS subject FROM r JOIN m ON r.doc_id = m.doc_id AND r.label = m.label
    UNION ALL SELECT doc_id, 'EQNARRAY', 'INFO', ord, 'eqnarray' FROM c WHERE regexp_matches(t, '\\\\begin\\{{eqnarray\\*?\\}}')""",
    ("tex",),
)
def rule_eqref(spark, d):
    return rules.eqref(frame(spark, "tex"))


_CAP = _pattern(sequences.CAPTION)


@query(
    f""", t AS (SELECT doc_id, ord, trim(text) AS x, regexp_matches(trim(text), {_CAP}) AND NOT regexp_matches(trim(text), {_pattern(tx.TOC_STRICT)}) AS s FROM lines),
    a AS (SELECT *, max(CASE WHEN s THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS start_at FROM t),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start_at ORDER BY ord) - 1 AS i, max(CASE WHEN x = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, start_at ORDER BY ord ROWS UNBOUNDED PRECEDING) AS gap FROM a WHERE start_at IS NOT NULL),
    c AS (SELECT doc_id, start_at, string_agg(CASE WHEN s THEN regexp_extract(x, {_CAP}, 3) ELSE x END, ' ' ORDER BY i) AS cap, arg_min(regexp_extract(x, {_CAP}, 1) || ' ' || regexp_extract(x, {_CAP}, 2), i) AS name FROM b WHERE gap = 0 AND i <= 5 GROUP BY 1, 2)
    SELECT doc_id, 'SHORT-CAPTION' AS code, 'WARN' AS severity, start_at AS ord, name AS subject FROM c WHERE len(regexp_extract_all(cap, '[A-Za-z][A-Za-z\\-'']*')) < 6""",
    ("lines",),
)
def rule_captions(spark, d):
    return rules.short_captions(frame(spark, "lines"))


_BODY = "regexp_replace(text, '^\\[[0-9]+\\]\\s+', '')"
_AUTHORS = " OR ".join(f"regexp_matches({_BODY}, {_pattern(p)})" for p in rules.IEEE_AUTHORS)
_WEB = " OR ".join(f"regexp_matches({_BODY}, {_pattern(p)})" for p in rules.WEB)


@query(
    f""", t AS (SELECT doc_id, ord, trim(text) AS x FROM lines), h AS (SELECT doc_id, max(CASE WHEN regexp_matches(x, {_pattern(sequences.REFERENCES)}) THEN ord END) AS s FROM t GROUP BY 1),
    n AS (SELECT t.doc_id, t.ord, t.x, sum(CASE WHEN regexp_matches(x, '^\\[[0-9]+\\]\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.ord) AS entry FROM t JOIN h ON t.doc_id = h.doc_id AND t.ord > h.s AND t.x <> ''),
    e AS (SELECT doc_id, entry, min(ord) AS ord, string_agg(x, ' ' ORDER BY ord) AS text FROM n WHERE entry > 0 GROUP BY 1, 2),
    b AS (SELECT doc_id, ord, NOT ({_AUTHORS}) AND NOT ({_WEB}) AS a, NOT regexp_matches({_BODY}, {_pattern(rules.QUOTED)}) AND NOT ({_WEB}) AND NOT regexp_matches({_BODY}, {_pattern(rules.BOOK)}) AS q FROM e)
    SELECT doc_id, 'ENTRY-STYLE' AS code, 'WARN' AS severity, ord, CASE WHEN a AND q THEN 'authors+title' WHEN a THEN 'authors' ELSE 'title' END AS subject FROM b WHERE a OR q
    UNION ALL SELECT doc_id, 'NO-REFS-SECTION', 'WARN', 0, '-' FROM h WHERE s IS NULL
    UNION ALL SELECT doc_id, 'REFS-NOT-NUMBERED', 'ERROR', s, '-' FROM h WHERE s IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM e)""",
    ("lines",),
)
def rule_citation_style(spark, d):
    return rules.citation_style(frame(spark, "lines"))


@query(
    """, s AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, '\\\\bibliographystyle\\{([^}]+)\\}', 1)) AS s, '(?i)ieee' AS good FROM tex UNION ALL SELECT doc_id, ord, unnest(regexp_extract_all(text, '\\\\usepackage\\[([^\\]]*)\\]\\{biblatex\\}', 1)), 'style\\s*=\\s*ieee' FROM tex),
    n AS (SELECT doc_id, sum(len(regexp_extract_all(text, '\\\\cite[tp]\\b'))) AS n, min(ord) AS ord FROM tex GROUP BY 1)
    SELECT doc_id, 'NO-IEEE-STYLE' AS code, 'ERROR' AS severity, ord, s AS subject FROM s WHERE NOT regexp_matches(s, good)
    UNION ALL SELECT doc_id, 'NATBIB-TEXTUAL', 'WARN', ord, n::VARCHAR FROM n WHERE n > 0 UNION ALL SELECT doc_id, 'NO-BIB-STYLE', 'WARN', ord, '-' FROM n WHERE doc_id NOT IN (SELECT doc_id FROM s)""",
    ("tex",),
)
def rule_citation_style_tex(spark, d):
    return rules.citation_style_tex(frame(spark, "tex"))


@query(values("doc_id, code, severity, ord, subject", (1, "UNREFERENCED", "WARN", 5, "figure 9"), (1, "UNREFERENCED", "WARN", 10, "equation 3"), (2, "UNREFERENCED", "WARN", 1, "table 1")))
def rule_unreferenced_numbers(spark, d):
    return rules.unreferenced_numbers(frame(spark, "numbered"))


#: Worked out by hand, with ratios from Python's difflib.
_BIBLIOGRAPHY = (
    ("a", "OK", "INFO"), ("b", "TITLE-DRIFT", "WARN"), ("b", "INCOMPLETE", "WARN"), ("c", "YEAR-MISMATCH", "WARN"), ("c", "PREPRINT", "WARN"), ("d", "NOT-FOUND", "WARN"), ("e", "WEB-SOURCE", "INFO"), ("f", "AUTHOR-MISMATCH", "ERROR"), ("f", "YEAR-MISMATCH", "WARN"),
    ("f", "VENUE-MISMATCH", "WARN"), ("g", "TITLE-DRIFT", "WARN"), ("g", "PREPRINT", "WARN"), ("h", "UNVERIFIED", "INFO"), ("i", "NOT-FOUND", "WARN"), ("j", "PREPRINT-UNCHECKED", "INFO"), ("k", "OK", "INFO"), ("l", "OK", "INFO"), ("m", "INCOMPLETE", "INFO"), ("n", "WEB-SOURCE", "INFO"),
)


@query(values("id, code, severity", *_BIBLIOGRAPHY))
def rule_bibliography(spark, d):
    return rules.bibliography(frame(spark, "bib"), frame(spark, "candidates"), frame(spark, "lookups"))


def _matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_pattern(pattern)})"


@query(
    f""", t AS (SELECT doc_id, ord, text, trim(text) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM ai),
    m AS (SELECT *, CASE WHEN {_matches("x", rules.METHODS_HEADING)} THEN 2 WHEN {_matches("x", rules.ANY_HEADING)} THEN 1 END AS h FROM t),
    r AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 1) = 2 AND coalesce(h, 0) <> 2 AS methods FROM m),
    s AS (SELECT doc_id, min(CASE WHEN {_matches("x", rules.AI_HEADING)} THEN i END) AS head, min(CASE WHEN {_matches("text", rules.AI_SENTENCE)} THEN i END) AS loose FROM t GROUP BY 1),
    a AS (SELECT *, coalesce(head, loose) AS start_at FROM s),
    o AS (SELECT r.*, a.head, a.start_at, coalesce(max(CASE WHEN r.i > a.start_at AND {_matches("x", rules.ANY_HEADING)} THEN 1 END) OVER (PARTITION BY r.doc_id ORDER BY r.i ROWS UNBOUNDED PRECEDING), 0) AS stop FROM r JOIN a ON r.doc_id = a.doc_id AND r.i BETWEEN a.start_at AND a.start_at + 60),
    b AS (SELECT doc_id, any_value(head) AS head, min(ord) AS ord, arg_min(methods, ord) AS methods, string_agg(text, ' ' ORDER BY ord) AS body FROM o WHERE stop = 0 GROUP BY 1)
    SELECT doc_id, 'NO-AI-STATEMENT' AS code, 'WARN' AS severity, 0 AS ord, '-' AS subject FROM a WHERE start_at IS NULL
    UNION ALL SELECT doc_id, 'STATEMENT-FOUND', 'INFO', ord, CASE WHEN head IS NULL THEN 'sentence' ELSE 'heading' END FROM b
    UNION ALL SELECT doc_id, 'NO-TOOL-NAMED', 'WARN', ord, '-' FROM b WHERE NOT {_matches("body", rules.AI_TOOL)} AND NOT {_matches("body", rules.NO_AI)}
    UNION ALL SELECT doc_id, 'NO-VERSION', 'WARN', ord, '-' FROM b WHERE {_matches("body", rules.AI_TOOL)} AND NOT {_matches("body", rules.AI_VERSION)}
    UNION ALL SELECT doc_id, 'IN-METHODS', 'WARN', ord, '-' FROM b WHERE head IS NULL AND methods""",
    ("ai",),
)
def rule_ai_disclosure(spark, d):
    return rules.ai_disclosure(frame(spark, "ai"))


@query(values("doc_id, code, severity, ord, subject", (1, "EQ-PUNCT-CHECK", "INFO", 1, "Then it follows."), (1, "EQ-NO-PUNCT", "WARN", 5, "Here starts a sentence."), (1, "EQ-PUNCT-CHECK", "INFO", 10, "where $x$ and $" + "y + " * 6 + "y"), (1, "LONG-INLINE", "WARN", 13, "101")))
def rule_formulas(spark, d):
    return tex_blocks.formulas(frame(spark, "formulas"))


@query(values("doc_id, code, severity, ord, subject", (1, "SHORT-CAPTION", "WARN", 14, "4"), (1, "NO-CAPTION", "WARN", 16, "table"), (1, "CAPTION", "INFO", 17, "8")))
def rule_tex_captions(spark, d):
    return tex_blocks.tex_captions(frame(spark, "formulas"), listed=True)


@query(
    """, r AS (SELECT doc_id, min(ord) AS stop FROM formulas WHERE regexp_matches(trim(text), '(?i)^(References|Bibliography)\\s*$') GROUP BY 1),
    n AS (SELECT f.doc_id, sum(len(regexp_extract_all(text, '\\([A-Z][a-zA-Z]+(?:\\s+(?:and|&)\\s+[A-Z][a-zA-Z]+|\\s+et\\s+al\\.?)?,?\\s+(?:19|20)[0-9]{2}[a-z]?\\)'))) AS n, min(ord) AS ord FROM formulas f LEFT JOIN r ON f.doc_id = r.doc_id WHERE r.stop IS NULL OR f.ord < r.stop GROUP BY 1)
    SELECT doc_id, 'CITE-STYLE' AS code, 'INFO' AS severity, ord, n::VARCHAR AS subject FROM n WHERE n > 3""",
    ("formulas",),
)
def rule_author_year(spark, d):
    return tex_blocks.author_year_citations(frame(spark, "formulas"))


# ---- layout ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, ord, text FROM layout WHERE page BETWEEN 2 AND 3", ("layout",))
def p7_page_range(spark, d):
    return layout.page_range(frame(spark, "layout"), 3, 2).select("doc_id", "ord", "text")


@query(
    """, s AS (SELECT *, CASE WHEN y - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY y, ord) > 14 THEN 1 ELSE 0 END AS s FROM layout), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y, ord ROWS UNBOUNDED PRECEDING) AS para FROM s)
    SELECT doc_id, page, para, string_agg(text, ' ' ORDER BY y, ord) AS text FROM r GROUP BY 1, 2, 3""",
    ("layout",),
)
def s11_gap_paragraphs(spark, d):
    return layout.gap_paragraphs(frame(spark, "layout"))


@query(
    f"SELECT doc_id, ord, CASE WHEN regexp_matches(trim(text), {_pattern(layout.CAPTION_HEAD)}) THEN 'caption' WHEN regexp_matches(trim(text), {_pattern(layout.EQUATION_TAG)}) AND x0 > 0.55 * 600 THEN 'equation' WHEN regexp_matches(trim(text), {_pattern(layout.HEADING)}) AND bold THEN 'heading' ELSE 'text' END AS kind FROM layout",
    ("layout",),
)
def s12_line_kinds(spark, d):
    return frame(spark, "layout").select("doc_id", "ord", layout.line_kind(F.lit(600.0)).alias("kind"))


@query("SELECT doc_id, left(string_agg(line, chr(10) ORDER BY ord), 60) AS text FROM (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY doc_id ORDER BY ord) IS NOT DISTINCT FROM page THEN text ELSE '[p. ' || page || '] ' || text END AS line FROM layout) GROUP BY 1", ("layout",))
def w19_page_markers(spark, d):
    return layout.page_marked_text(frame(spark, "layout"), 60)


@query("SELECT doc_id, ord, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(term)) ORDER BY ord) AS k FROM terms_used) WHERE k = 1", ("terms_used",))
def a16_first_spellings(spark, d):
    return layout.first_spellings(frame(spark, "terms_used"), "term", "doc_id")


@query("SELECT doc_id, ord, term, row_number() OVER (PARTITION BY doc_id, lower(trim(term)) ORDER BY ord) AS k FROM terms_used QUALIFY k > 1", ("terms_used",))
def w17_after_the_first(spark, d):
    w = Window.partitionBy("doc_id", F.lower(F.trim("term"))).orderBy("ord")
    return frame(spark, "terms_used").withColumn("k", F.row_number().over(w)).where("k > 1")


@query(
    "SELECT num, row_number() OVER (ORDER BY regexp_extract(num, '^([A-Z]*)', 1), coalesce(try_cast(regexp_extract(num, '^([A-Z]*)\\.?([0-9]+)(?:\\.([0-9]+))?', 2) AS INT), 0), coalesce(try_cast(regexp_extract(num, '^([A-Z]*)\\.?([0-9]+)(?:\\.([0-9]+))?', 3) AS INT), 0)) AS place FROM (VALUES ('A.10'), ('A.2'), ('10'), ('2.4'), ('2.10'), ('1')) t(num)"
)
def o2_natural_order(spark, d):
    rows = spark.createDataFrame([("A.10",), ("A.2",), ("10",), ("2.4",), ("2.10",), ("1",)], "num string")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(layout.natural_order(F.col("num")))))


@query(
    """, e AS (SELECT u.doc_id, u.ord, u.level, u.title, (SELECT min(v.ord) FROM units v WHERE v.doc_id = u.doc_id AND v.ord > u.ord AND v.level <= u.level) AS stop FROM units u)
    SELECT e.doc_id, e.ord, e.title, string_agg(c.title, ', ' ORDER BY c.ord) AS children FROM e JOIN units c ON c.doc_id = e.doc_id AND c.ord > e.ord AND (e.stop IS NULL OR c.ord < e.stop) AND c.level = e.level + 1 GROUP BY 1, 2, 3""",
    ("units",),
)
def j9_children_lists(spark, d):
    return layout.children(frame(spark, "units")).withColumn("children", F.array_join("children", ", "))


@query(
    """, b AS (SELECT DISTINCT doc_id, ord, unnest(regexp_extract_all(text, '\\(([0-9]{1,3})\\)', 1)) AS num FROM layout), n AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, '\\b(?:Equations?|Eqs?\\.)\\s*\\(?([0-9]+)\\)?', 1)) AS num FROM layout)
    SELECT doc_id, ord, num FROM b WHERE EXISTS (SELECT 1 FROM defs d WHERE d.kind = 'equation' AND d.doc_id = b.doc_id AND d.num = b.num) AND NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = b.doc_id AND n.ord = b.ord AND n.num = b.num)""",
    ("layout", "defs"),
)
def j19_bare_equations(spark, d):
    return layout.bare_equations(frame(spark, "layout"), frame(spark, "defs"))


@query("SELECT k.kind, k.place, count(d.num) AS n FROM (VALUES ('figure', 1), ('table', 2), ('algorithm', 3), ('equation', 4)) k(kind, place) LEFT JOIN defs d ON d.kind = k.kind GROUP BY 1, 2", ("defs",))
def a6_counts_in_fixed_order(spark, d):
    kinds = spark.createDataFrame([("figure", 1), ("table", 2), ("algorithm", 3), ("equation", 4)], "kind string, place int")
    counted = frame(spark, "defs").groupBy("kind").agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(counted, "kind", "left").select("kind", "place", F.coalesce("n", F.lit(0)).alias("n"))  # four kinds


@query("SELECT id, len(list_intersect(a, b)) > 0 AS overlap, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS rest FROM (SELECT bib.id, string_split(lower(bib.venue), ' ') AS a, string_split(lower(c.venue), ' ') AS b FROM bib JOIN candidates c ON c.bib_id = bib.id AND c.ord = 1)", ("bib", "candidates"))
def u3_u4_difference_and_overlap(spark, d):
    first = frame(spark, "candidates").where("ord = 1").select(F.col("bib_id").alias("id"), F.split(F.lower("venue"), " ").alias("b"))
    both = frame(spark, "bib").select("id", F.split(F.lower("venue"), " ").alias("a")).join(first, "id")
    return both.select("id", F.arrays_overlap("a", "b").alias("overlap"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("rest"))


@query("SELECT doc_id, ord, CASE WHEN p > 11 THEN '…' ELSE '' END || substring(text, greatest(1, p - 10), least(length(text), p + 2 + 10) - greatest(1, p - 10) + 1) || CASE WHEN p + 12 < length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT *, strpos(text, 'the') AS p FROM paragraphs2) WHERE p > 0".replace("paragraphs2", "(SELECT doc_id, ix AS ord, text FROM paragraphs)"), ("paragraphs",))
def f15_snippets(spark, d):
    at = F.locate("the", F.col("text"))
    rows = frame(spark, "paragraphs").withColumnRenamed("ix", "ord").where(at > 0)
    return rows.select("doc_id", "ord", tx.snippet(F.col("text"), at, F.lit(3), 10).alias("snippet"))


# ---- sources, sinks and the judge shell -----------------------------------------------------------------------


@query(
    """WITH p AS (SELECT doc_id, unnest(l) AS t, unnest(generate_series(1, len(l))) AS page FROM (SELECT doc_id, string_split(text, chr(12)) AS l FROM documents))
    SELECT doc_id, page, i - 1 AS at, m[i] AS text FROM (SELECT doc_id, page, list_append(string_split(t, chr(10)), '') AS m, unnest(generate_series(1, len(string_split(t, chr(10))) + 1)) AS i FROM p)"""
)
def s3_page_lines(spark, d):
    return files.page_lines(table(spark, d, "documents")).select("doc_id", "page", (F.col("line_no") - 1).alias("at"), "text")


@query(
    """, p AS (SELECT doc_id, unnest(l) AS t, unnest(generate_series(1, len(l))) AS page FROM (SELECT doc_id, string_split(text, chr(12)) AS l FROM paged)),
    m AS (SELECT doc_id, page, unnest(list_append(string_split(t, chr(10)), '')) AS text, unnest(generate_series(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM p)
    SELECT doc_id, page, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS ord, text FROM m""",
    ("paged",),
)
def s3_pages_by_form_feed(spark, d):
    return files.page_lines(frame(spark, "paged")).select("doc_id", "page", "line_no", "ord", "text")


@query(
    """SELECT university, part, i, '| ' || i || ' | ' || author || ' | ' || title || ' | ' || date || ' | ' || industry || ' |' AS line FROM
    (SELECT *, CASE WHEN lower(status) = 'ongoing' THEN 0 ELSE 1 END AS part, row_number() OVER (PARTITION BY university, CASE WHEN lower(status) = 'ongoing' THEN 0 ELSE 1 END ORDER BY ord) AS i FROM catalog)""",
    ("catalog",),
)
def k1_markdown_rows(spark, d):
    return render.catalog_lines(frame(spark, "catalog"))


@query(f"SELECT doc_id, max(CASE WHEN severity IN ('ERROR', 'WARN') THEN 1 ELSE 0 END) AS code FROM ({_PROSE}) GROUP BY 1", ("sentences",))
def k6_exit_codes(spark, d):
    return render.exit_codes(rules.prose(frame(spark, "sentences")))


@query("SELECT c.item, c.question, CASE WHEN length(c.question) % 2 = 0 THEN 'PASS' ELSE 'UNCLEAR' END AS verdict, CASE WHEN length(c.question) % 2 = 0 THEN 'even' ELSE '' END AS note FROM checklist c", ("checklist",))
def x1_checklist_with_a_stub(spark, d):
    """The whole shell with a deterministic judge: requests, answers, tolerant parsing, defaults."""
    items = frame(spark, "checklist")

    def stub(prompts: list[str]) -> list[str]:
        return ['```json\n{"verdict": "PASS", "note": "even"}\n```' if len(p) % 2 == 0 else "no idea" for p in prompts]

    answers = judge.ask(items.select("item", F.lit(1).alias("ord"), F.col("question").alias("prompt")), stub)
    return judge.verdicts(answers, items, "item")


@query("SELECT doc_id, ix FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS p FROM cached) WHERE p = ix", ("cached",))
def t3_contiguous_prefix(spark, d):
    return judge.contiguous_prefix(frame(spark, "cached")).select("doc_id", "ix")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) WHERE p = turn")
def t3_contiguous_prefix_of_all(spark, d):
    return judge.contiguous_prefix(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders numbered within each status, and how common each status is."""
    orders = table(spark, d, "orders").where(catalog.equals("o_orderpriority", "1-urgent"))
    return catalog.most_common(orders, "o_orderstatus", "o_orderkey")
