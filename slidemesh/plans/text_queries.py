"""Queries over usage logs, words, OCR lines, colours and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidemesh.functions import color as C
from slidemesh.functions import routing as R
from slidemesh.functions import text as T
from slidemesh.operators import colors, ocr, usage
from slidemesh.plans import views as V
from slidemesh.plans.registry import query, sql

_LOG = """s AS (SELECT *, max(CASE WHEN marker = 'slide_start' THEN line_no END) OVER (ORDER BY line_no) AS sl FROM usage_log),
g AS (SELECT s.*, st.image AS simg FROM s LEFT JOIN usage_log st ON st.line_no = s.sl),
e AS (SELECT sl, min(line_no) AS closed FROM g WHERE marker = 'slide_end' AND image = simg GROUP BY 1),
att AS (SELECT g.*, CASE WHEN e.closed IS NULL OR g.line_no < e.closed THEN simg END AS open_image FROM g LEFT JOIN e ON e.sl = g.sl)"""


@query("usage_attribution", sql("SELECT line_no, open_image FROM att", "usage_log", extra=_LOG))
def usage_attribution(spark, sf):
    return usage.attribute_to_slides(V.usage_log(spark, sf)).select("line_no", "open_image")


@query("usage_per_agent", sql("""SELECT coalesce(agent, 'unknown') AS agent, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM usage_log WHERE marker IS NULL AND backend IS NOT NULL GROUP BY 1""", "usage_log"))
def usage_per_agent(spark, sf):
    return usage.per_agent(V.usage_log(spark, sf))


_SLIDE = """st AS (SELECT image, min(line_no) AS f FROM usage_log WHERE marker = 'slide_start' GROUP BY 1),
en AS (SELECT l.image, max(l.line_no) AS end_line FROM usage_log l JOIN st ON st.image = l.image AND l.line_no > st.f WHERE marker = 'slide_end' GROUP BY 1),
ca AS (SELECT open_image AS image, count(*) AS calls, sum(input_tokens) AS it, sum(output_tokens) AS ot, sum(latency_ms) AS lm FROM att WHERE marker IS NULL AND backend IS NOT NULL AND open_image IS NOT NULL GROUP BY 1),
per AS (SELECT st.image, end_line, coalesce(calls, 0) AS calls, CAST(coalesce(it, 0) AS BIGINT) AS input_tokens, CAST(coalesce(ot, 0) AS BIGINT) AS output_tokens, CAST(coalesce(lm, 0) AS BIGINT) AS latency_ms
 FROM st LEFT JOIN en ON en.image = st.image LEFT JOIN ca ON ca.image = st.image)"""


@query("usage_per_slide", sql("SELECT * FROM per", "usage_log", extra=_LOG + ",\n" + _SLIDE))
def usage_per_slide(spark, sf):
    return usage.per_slide(usage.attribute_to_slides(V.usage_log(spark, sf))).drop("wall_clock_sec", "agents")


@query("usage_totals", sql("""SELECT count(end_line) AS slides_completed, count(*) AS slides_started, round_even(avg(calls) FILTER (end_line IS NOT NULL), 2) AS mean_calls_per_slide,
round_even(avg(input_tokens) FILTER (end_line IS NOT NULL), 1) AS mean_input_tokens_per_slide, round_even(avg(end_line) FILTER (end_line IS NOT NULL), 1) AS mean_wall_clock_sec_per_slide FROM per""", "usage_log", extra=_LOG + ",\n" + _SLIDE))
def usage_totals(spark, sf):
    log = V.usage_log(spark, sf).withColumn("wall_clock_sec", F.col("line_no").cast("double"))
    t = usage.totals(usage.per_slide(usage.attribute_to_slides(log), with_agents=False))
    return t.select("slides_completed", "slides_started", "mean_calls_per_slide", "mean_input_tokens_per_slide", "mean_wall_clock_sec_per_slide")


@query("audit_agreement", sql("""SELECT audit, count(*) AS n, avg(CASE WHEN agree THEN 1.0 ELSE 0.0 END) AS agreement FROM (
 SELECT concat('agent_', event_type) AS audit, event_id % 5 <> 0 AS agree, CAST(concat('0x', substr(md5(concat('crop', cast(event_id AS VARCHAR))), 1, 8)) AS BIGINT) % 10000 AS b FROM events) t WHERE b < 2500 GROUP BY 1"""))
def audit_agreement(spark, sf):
    e = V.table(spark, sf, "events").select(F.concat(F.lit("agent_"), "event_type").alias("audit"), (F.col("event_id") % 5 != 0).alias("agree"),
                                            F.concat(F.lit("crop"), F.col("event_id")).alias("path"))
    return usage.audit_rate(e, "path", 0.25)


@query("screen_then_escalate", sql("""SELECT cascade, count(*) AS n, CAST(sum(cls) AS BIGINT) AS cls_sum FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'screen_accepted' WHEN event_id % 7 <> 0 THEN 'escalated' ELSE 'error' END AS cascade,
 CASE WHEN event_id % 3 = 0 THEN event_id % 6 WHEN event_id % 7 <> 0 THEN event_id % 5 END AS cls FROM events) t GROUP BY 1"""))
def screen_then_escalate(spark, sf):
    e = V.table(spark, sf, "events")
    cheap = e.select("event_id", (F.col("event_id") % 6).alias("cls"), F.when(F.col("event_id") % 3 == 0, "high").otherwise("low").alias("confidence"))
    full = e.where("event_id % 7 <> 0").select("event_id", (F.col("event_id") % 5).alias("cls"), F.lit("high").alias("confidence"))
    return usage.screened(cheap, full, ["event_id"], "confidence = 'high'").groupBy("cascade").agg(F.count(F.lit(1)).alias("n"), F.sum("answer.cls").alias("cls_sum"))


@query("metric_stats", sql("SELECT event_type, avg(value) AS value_mean, stddev_pop(value) AS value_std, count(value) AS value_n FROM (SELECT event_type, CASE WHEN event_id % 9 <> 0 THEN event_id % 1000 END AS value FROM events) t GROUP BY 1"))
def metric_stats(spark, sf):
    e = V.table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 1000).alias("value"))
    return usage.metric_stats(e, ["value"], ["event_type"])


# words --------------------------------------------------------------------------------------------------------------
_SIDES = """w AS (SELECT page, word, count(*) FILTER (side = 'orig') AS o, count(*) FILTER (side = 'render') AS r, median(h) FILTER (side = 'orig') AS ho, median(h) FILTER (side = 'render') AS hr
 FROM (SELECT *, length(word) + CASE WHEN side = 'orig' THEN 10 ELSE 8 END AS h FROM page_words) q GROUP BY 1, 2)"""


@query("ocr_coverage", sql("""SELECT page, count(*) FILTER (o > 0) AS orig_words, count(*) FILTER (r > 0) AS render_words, count(*) FILTER (o > 0 AND r = 0) AS missing,
round_even(median(hr / CAST(ho AS DOUBLE)) FILTER (o > 0 AND r > 0), 3) AS median_height_ratio, 1.0 - count(*) FILTER (o > 0 AND r = 0) / CAST(greatest(count(*) FILTER (o > 0), 1) AS DOUBLE) AS coverage FROM w GROUP BY 1""", "page_words", extra=_SIDES))
def ocr_coverage(spark, sf):
    h = F.length("word") + F.when(F.col("side") == "orig", 10).otherwise(8)
    return ocr.coverage(V.page_words(spark, sf), h)


@query("pages_to_repair", sql("SELECT page, coverage FROM (SELECT page, 1.0 - count(*) FILTER (o > 0 AND r = 0) / CAST(greatest(count(*) FILTER (o > 0), 1) AS DOUBLE) AS coverage FROM w GROUP BY 1) t WHERE coverage < CAST(0.9 AS DOUBLE)", "page_words", extra=_SIDES))
def pages_to_repair(spark, sf):
    return ocr.pages_to_repair(ocr.coverage(V.page_words(spark, sf))).select("page", "coverage")


@query("missing_words", sql("SELECT page, word FROM w WHERE o > 0 AND r = 0", "page_words", extra=_SIDES))
def missing_words(spark, sf):
    return ocr.missing_words(V.page_words(spark, sf))


@query("shared_words", sql("SELECT page, word FROM w WHERE o > 0 AND r > 0", "page_words", extra=_SIDES))
def shared_words(spark, sf):
    return ocr.shared_words(V.page_words(spark, sf))


@query("dup_words", sql("SELECT page, CAST(sum(greatest(0, r + CASE WHEN length(word) % 5 = 0 THEN o ELSE 0 END - o)) AS BIGINT) AS excess FROM w WHERE o > 0 GROUP BY 1", "page_words", extra=_SIDES))
def dup_words(spark, sf):
    """Words of length divisible by five are rendered twice."""
    w = V.page_words(spark, sf)
    again = w.where("side = 'orig' AND length(word) % 5 = 0").withColumn("side", F.lit("render"))
    return ocr.duplicate_excess(w.unionByName(again))


@query("word_height_ratio", sql("""SELECT round_even(median(ratio), 3) AS median_ratio, count(ratio) AS n FROM (SELECT round_even(median(h) FILTER (side = 'render') / CAST(median(h) FILTER (side = 'orig') AS DOUBLE), 3) AS ratio FROM
 (SELECT page, side, length(word) + CASE WHEN side = 'orig' THEN 10 ELSE 8 END AS h FROM page_words) q GROUP BY page) t""", "page_words"))
def word_height_ratio(spark, sf):
    w = V.page_words(spark, sf).select(F.col("page").alias("stem"), "side", (F.length("word") + F.when(F.col("side") == "orig", 10).otherwise(8)).alias("h"))
    return ocr.component_height_ratio(w)


def _lines(spark, sf):
    """Document lines as OCR lines of the page."""
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.where(F.trim("text") != "")


_LINES = """ln AS (SELECT doc_id AS page, i - 1 AS pos, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) d WHERE trim(parts[i], ' ') <> ''),
nl AS (SELECT page, pos, text, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS n FROM ln)"""


@query("important_texts", sql("SELECT page, n, CAST(min(pos) AS INTEGER) AS pos FROM nl WHERE length(n) >= 3 AND NOT regexp_full_match(n, '[0-9]+') GROUP BY 1, 2", extra=_LINES))
def important_texts(spark, sf):
    return ocr.important(_lines(spark, sf), ["page"]).select("page", "n", "pos")


def _hay(spark, sf):
    """Joined normal text of the render, which lost every third line (documents hold the whole text in one row)."""
    kept = F.filter(F.split("text", "\n"), lambda x, i: i % 3 != 2)
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("page"), T.norm(F.array_join(kept, " ")).alias("hay"))


@query("missing_texts", sql("""SELECT f.page, f.pos FROM (SELECT page, n, CAST(min(pos) AS INTEGER) AS pos FROM nl WHERE length(n) >= 3 AND NOT regexp_full_match(n, '[0-9]+') GROUP BY 1, 2) f JOIN
 (SELECT doc_id AS page, regexp_replace(lower(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: (i - 1) % 3 <> 2), ' ')), '[^a-z0-9]+', '', 'g') AS hay FROM documents) h ON h.page = f.page WHERE NOT contains(hay, n)""", extra=_LINES))
def missing_texts(spark, sf):
    return ocr.missing_texts(_lines(spark, sf), _hay(spark, sf), ["page"]).select("page", "pos")


@query("missing_lines")
def missing_lines(spark, sf):
    """Odd turns of a conversation are the lines, even ones the rendered texts: lines neither contained nor similar (difflib)."""
    c = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), "text")
    got = c.where("pos % 2 = 0")
    hay = got.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: T.norm(s["text"])), "").alias("hay"))
    return ocr.missing_lines(c, got, hay, ["page"]).select("page", "pos")


@query("fuzzy_folded_words")
def fuzzy_folded_words(spark, sf):
    """Words of conversations; the render doubles the last letter of words of length six, folded back by similarity."""
    w = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("page"), F.explode(T.words(F.col("text"))).alias("word"))
    misread = F.when(F.length("word") == 6, F.concat("word", F.substring("word", 6, 1))).otherwise(F.col("word"))
    both = w.withColumn("side", F.lit("orig")).unionByName(w.select("page", misread.alias("word"), F.lit("render").alias("side")))
    return ocr.duplicate_excess(both, fuzzy=True)


def _ocr_boxes(spark, sf):
    """Even components are text boxes, odd ones OCR lines of the same slide."""
    c = V.components(spark, sf)
    return c.where("pos % 2 = 0"), c.where("pos % 2 = 1").withColumn("line_id", F.col("pos"))


@query("free_ocr_lines", sql("""SELECT l.slide_id, l.pos AS line_id FROM components l WHERE l.pos % 2 = 1 AND NOT EXISTS (SELECT 1 FROM components b WHERE b.slide_id = l.slide_id AND b.pos % 2 = 0
 AND b.x0 <= (l.x0 + l.x1) / 2.0 AND (l.x0 + l.x1) / 2.0 <= b.x1 AND b.y0 <= (l.y0 + l.y1) / 2.0 AND (l.y0 + l.y1) / 2.0 <= b.y1)""", "components"))
def free_ocr_lines(spark, sf):
    boxes, lines = _ocr_boxes(spark, sf)
    return ocr.free_lines(lines, boxes, ["slide_id"]).select("slide_id", "line_id")


@query("assigned_ocr_lines", sql("""SELECT a.slide_id, a.pos AS line_id, b.pos, a.y1 - a.y0 AS h FROM components a JOIN components b ON a.slide_id = b.slide_id AND a.pos % 2 = 1 AND b.pos % 2 = 0
 WHERE a.x0 >= b.x0 - greatest(12.0, 0.25 * (a.y1 - a.y0)) AND a.y0 >= b.y0 - greatest(12.0, 0.25 * (a.y1 - a.y0)) AND a.x1 <= b.x1 + greatest(12.0, 0.25 * (a.y1 - a.y0)) AND a.y1 <= b.y1 + greatest(12.0, 0.25 * (a.y1 - a.y0))""", "components"))
def assigned_ocr_lines(spark, sf):
    boxes, lines = _ocr_boxes(spark, sf)
    return ocr.assign_lines(lines, boxes, ["slide_id"])


@query("shape_line_heights", sql("""SELECT page, shape_id, CAST(list_sort(list(h))[len(list(h)) // 2 + 1] AS BIGINT) AS h FROM (SELECT s.page, s.pos AS shape_id, l.h FROM
 (SELECT conv_id AS page, turn AS pos, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS n FROM conversations WHERE turn % 2 = 0) s JOIN
 (SELECT page, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') AS n, h FROM (SELECT conv_id AS page, unnest(string_split(text, chr(10))) AS line, turn + 9 + generate_subscripts(string_split(text, chr(10)), 1) AS h FROM conversations) x) l ON l.page = s.page AND s.n <> '' AND l.n <> '' AND (contains(s.n, l.n) OR contains(l.n, s.n))) t GROUP BY 1, 2"""))
def shape_line_heights(spark, sf):
    c = V.table(spark, sf, "conversations")
    shapes = c.where("turn % 2 = 0").select(F.col("conv_id").alias("page"), F.col("turn").alias("shape_id"), "text")
    rows = c.select(F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", "\n")).alias("no", "text"))
    lines = rows.select("page", (F.col("turn") * 1_000_000 + F.col("no")).alias("line_id"), "text", (F.col("turn") + 10 + F.col("no")).alias("h_px"))
    return ocr.line_height_of_shape(shapes, lines, ["page"])


# text functions -----------------------------------------------------------------------------------------------------
@query("text_measures", sql("""SELECT doc_id, length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS norm_chars, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2)) AS n_words,
len(regexp_extract_all(text, '(?m)^\\s*(?:[•\\-]|\\d+[.)])\\s+')) AS bullets FROM documents"""))
def text_measures(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", F.length(T.norm(t)).cast("long").alias("norm_chars"), F.size(T.words(t)).cast("long").alias("n_words"),
                                                  T.bullet_count(t).cast("long").alias("bullets"))


@query("fallback_fonts", sql("""SELECT doc_id, greatest(CAST(10.0 AS DOUBLE), least(CASE WHEN m > 150 THEN 14.0 WHEN m > 100 THEN 18.0 WHEN m > 70 THEN 28.0 ELSE 34.0 END, 300 / CAST(96 AS DOUBLE) * 72 / greatest(1, k) * CAST(0.7 AS DOUBLE))) AS pt FROM (
 SELECT doc_id, len(ls) AS k, coalesce(list_max(list_transform(ls, lambda s: length(s))), 0) AS m FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> '') AS ls FROM documents) a) b"""))
def fallback_fonts(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.fallback_font_pt(F.col("text"), F.lit(300.0)).alias("pt"))


@query("latex_clean")
def latex_clean(spark, sf):
    """OCR clean-up of text wrapped in LaTeX marks; compared with a plain-Python twin in the tests."""
    raw = F.concat(F.lit("\\textbf{"), F.substring_index("text", "\n", 1), F.lit("} \\frac{a}{b} $x^{2}_{i}$ \\\\ \\item "), "text")
    return V.table(spark, sf, "documents").select("doc_id", T.latex_to_text(raw).alias("plain"))


@query("under_extracted", sql("""SELECT doc_id, flag FROM (SELECT doc_id, trim(text, ' ') <> '' AND ol >= 120 AND gl < CAST(0.72 AS DOUBLE) * ol AS flag FROM (
 SELECT doc_id, text, length(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+', '', 'g')) AS ol, length(regexp_replace(lower(regexp_replace(text, '[aeiou]', '', 'g')), '[^\\p{L}\\p{N}\\p{M}_]+', '', 'g')) AS gl FROM documents) a) b"""))
def under_extracted(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", T.looks_under_extracted(F.regexp_replace(t, "[aeiou]", ""), t).alias("flag"))


@query("loose_answers", sql("""SELECT event_id, CAST(event_id % 8 AS INTEGER) AS cls, CASE event_id % 7 WHEN 3 THEN event_type || ' }{' WHEN 4 THEN event_type || '"' ELSE event_type END AS role FROM events WHERE event_id % 7 <> 6"""))
def loose_answers(spark, sf):
    """Answers in fences, in prose, bare, with braces or quotes in strings and more objects behind; every seventh has none and is dropped."""
    kind = F.col("event_id") % 7
    role = F.when(kind == 3, F.concat("event_type", F.lit(" }{"))).when(kind == 4, F.concat("event_type", F.lit('\\"'))).otherwise(F.col("event_type"))
    obj = F.concat(F.lit('{"class": '), F.col("event_id") % 8, F.lit(', "semantic_role": "'), role, F.lit('"}'))
    raw = (F.when(kind == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Sure: "), obj, F.lit(" Done.")))
           .when(kind.isin(2, 3), F.concat(obj, F.lit(' or {"class": 99} {'))).when(kind == 4, F.concat(F.lit("first "), obj, F.lit(" then }"))).when(kind == 5, obj).otherwise(F.lit("no {answer")))
    p = V.table(spark, sf, "events").select("event_id", T.loose_json(raw, "class int, semantic_role string").alias("p"))
    return p.where("p IS NOT NULL").select("event_id", F.col("p.class").alias("cls"), F.col("p.semantic_role").alias("role"))


def _components_named(spark, sf):
    """Component files named after part types, as a detector would write them."""
    p = V.table(spark, sf, "part")
    word = F.expr("element_at(array('logo icon', 'line chart', 'data table', 'flowchart', 'slide title', 'photo', 'callout box', 'shape'), cast(p_partkey % 8 + 1 AS int))")
    return p.select("p_partkey", "p_size", F.concat(F.lit("a/b/iter0"), F.col("p_partkey") % 3, F.lit("_component_"), F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.lit("_"),
                                                   F.replace(word, F.lit(" "), F.lit("_")), F.lit(".png")).alias("path"), word.alias("word"))


_WORD = "(['logo icon', 'line chart', 'data table', 'flowchart', 'slide title', 'photo', 'callout box', 'shape'])[p_partkey % 8 + 1]"


@query("filename_hints", sql(f"SELECT p_partkey, {_WORD} AS hint, {_WORD} AS cls_name FROM part"))
def filename_hints(spark, sf):
    c = _components_named(spark, sf)
    return c.select("p_partkey", T.filename_hint(F.col("path")).alias("hint"), T.class_from_filename(F.col("path")).alias("cls_name"))


@query("routed_classes", sql(f"""SELECT p_partkey, role, CASE WHEN p_size % 6 = 0 AND (role <> 'other' OR prot OR p_size % 4 = 0 OR role = 'other') THEN
  CASE WHEN role = 'text' THEN 1 WHEN role = 'table' THEN 3 WHEN role IN ('logo', 'photo') OR p_size % 5 = 0 THEN 5 WHEN role IN ('chart', 'technical_diagram', 'callout') OR p_size % 3 = 0 THEN 4 ELSE 5 END
  ELSE CAST(p_size % 6 AS INTEGER) END AS cls,
 p_size % 6 IN (0, 5) OR (p_size % 6 = 4 AND role = 'chart') OR p_size % 7 = 0 OR p_partkey % 8 IN (0, 1, 3, 5, 6) AS critic FROM (
 SELECT p_partkey, p_size, (['logo', 'chart', 'table', 'chart', 'text', 'photo', 'callout', 'other'])[p_partkey % 8 + 1] AS role, p_partkey % 8 <> 7 AS prot
 FROM (SELECT p_partkey, p_size FROM part) a) b"""))
def routed_classes(spark, sf):
    c = _components_named(spark, sf).withColumn("hint", T.filename_hint(F.col("path"))).withColumn("role", R.role_from_hint(F.col("hint")))
    size = F.col("p_size")
    raw = size % 6
    g = R.guarded_class(raw, F.col("hint"), F.col("role"), size % 4 != 0, size % 3 == 0, size % 5 == 0, F.lit(False))
    critic = R.needs_critic(R.valid_class(raw), F.col("role"), F.col("hint"), F.when(size % 7 == 0, "low").otherwise("high"))
    return c.select("p_partkey", "role", g["cls"].alias("cls"), critic.alias("critic"))


@query("table_cells", sql("""SELECT p_partkey, count(*) AS cells, count(*) FILTER (r = 0 AND p_partkey % 2 = 0) AS header_cells FROM (SELECT p_partkey, unnest(range(0, p_size)) AS r FROM part WHERE p_size BETWEEN 1 AND 32) t, range(0, 4) c(c) GROUP BY 1"""))
def table_cells(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", R.table_cells(F.col("p_size"), F.lit(4), F.col("p_partkey") % 2 == 0, F.lit(True)).alias("cells"))
    return p.where("cells IS NOT NULL").select("p_partkey", F.size("cells").cast("long").alias("cells"), F.size(F.filter("cells", lambda c: c["anchor"] == "header")).cast("long").alias("header_cells"))


@query("fractions_and_orders", sql("""SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) / (p_size + 3) ELSE CAST(0.5 AS DOUBLE) END, 9) AS first_frac, p_partkey % 3 = 1 AS reorder FROM part"""))
def fractions_and_orders(spark, sf):
    p = V.table(spark, sf, "part")
    fr = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_size").cast("double"), F.lit(3.0))).otherwise(F.array(F.lit(1.0)))
    order = F.expr("element_at(array(array(1, 2, 3), array(3, 1, 2), array(1, 1, 2)), cast(p_partkey % 3 + 1 AS int))")
    return p.select("p_partkey", F.round(T.scaled_fractions(fr, F.lit(2))[0], 9).alias("first_frac"), T.valid_permutation(order, F.lit(3)).alias("reorder"))


# colours ------------------------------------------------------------------------------------------------------------
def _lum(p):
    def ch(c):
        return f"CASE WHEN {p}{c} / 255.0::DOUBLE <= 0.03928::DOUBLE THEN {p}{c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({p}{c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    return f"(0.2126::DOUBLE * {ch('r')} + 0.7152::DOUBLE * {ch('g')} + 0.0722::DOUBLE * {ch('b')})"


_CON = f"con AS (SELECT *, (greatest(lf, lb) + 0.05::DOUBLE) / (least(lf, lb) + 0.05::DOUBLE) AS ratio, (1.05::DOUBLE) / (lb + 0.05::DOUBLE) AS white, (lb + 0.05::DOUBLE) / 0.05::DOUBLE AS black FROM (SELECT *, {_lum('fg_')} AS lf, {_lum('bg_')} AS lb FROM text_runs) t)"


@query("contrast_ratios", sql("SELECT run_id, round(ratio, 6) AS ratio, ratio >= 4.5::DOUBLE AS kept, CASE WHEN ratio >= 4.5::DOUBLE THEN printf('%02X%02X%02X', fg_r, fg_g, fg_b) ELSE '1A2B3C' END AS hex FROM con", "text_runs", extra=_CON))
def contrast_ratios(spark, sf):
    r = colors.recolour_runs(V.text_runs(spark, sf), "1A2B3C")
    return r.select("run_id", F.round(C.contrast(C.rgb("fg_"), C.rgb("bg_")), 6).alias("ratio"), "kept", "hex")


@query("contrast_audit", sql("SELECT run_id, CASE WHEN black >= white THEN '000000' ELSE 'FFFFFF' END AS new_hex, round(ratio, 6) AS old FROM con WHERE ratio < 3.0::DOUBLE", "text_runs", extra=_CON))
def contrast_audit(spark, sf):
    a = colors.audit_runs(V.text_runs(spark, sf), ["000000", "FFFFFF"])
    return a.select("run_id", "new_hex", F.round(C.contrast(C.rgb("fg_"), C.rgb("bg_")), 6).alias("old"))


@query("contrast_audit_totals", sql("SELECT page, count(*) AS n FROM con WHERE ratio < 3.0::DOUBLE GROUP BY 1", "text_runs", extra=_CON))
def contrast_audit_totals(spark, sf):
    return colors.audit_runs(V.text_runs(spark, sf), ["000000", "FFFFFF"]).groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query("local_background", sql("""SELECT slide_id, pos AS idx, coalesce(fill, (SELECT arg_max(b.fill, b.pos) FROM f b WHERE b.slide_id = a.slide_id AND b.pos < a.pos AND b.fill IS NOT NULL AND b.x0 <= (a.x0 + a.x1) / 2.0 AND (a.x0 + a.x1) / 2.0 <= b.x1
 AND b.y0 <= (a.y0 + a.y1) / 2.0 AND (a.y0 + a.y1) / 2.0 <= b.y1), 'FFFFFF') AS local_bg FROM f a""", "components", extra="f AS (SELECT *, CASE WHEN score % 2 = 0 THEN printf('%06X', score * 1601) END AS fill FROM components)"))
def local_background(spark, sf):
    c = V.components(spark, sf).select("slide_id", F.col("pos").alias("idx"), F.when(F.col("score") % 2 == 0, F.format_string("%06X", F.col("score") * 1601)).alias("fill"), "x0", "y0", "x1", "y1")
    return colors.local_background(c, c.select("slide_id", "idx", F.lit("FFFFFF").alias("mean_hex"))).select("slide_id", "idx", "local_bg")


_CELLS = "cells AS (SELECT page, 'fill' AS role, printf('%02X%02X00', fg_r - fg_r % 64, bg_r - bg_r % 64) AS hex FROM text_runs UNION ALL SELECT page, 'border', printf('%02X%02XFF', fg_g - fg_g % 64, bg_g - bg_g % 64) FROM text_runs)"


def _cells(spark, sf):
    r = V.text_runs(spark, sf)
    q = lambda c: F.col(c) - F.col(c) % 64
    return (r.select("page", F.lit("fill").alias("role"), F.concat(F.lit(" #"), F.lower(F.format_string("%02X%02X00", q("fg_r"), q("bg_r")))).alias("hex"))
            .unionAll(r.select("page", F.lit("border").alias("role"), F.format_string("%02X%02XFF", q("fg_g"), q("bg_g")).alias("hex"))))


@query("colour_histogram", sql("SELECT page, role, hex, count(*) AS n FROM cells GROUP BY ALL", "text_runs", extra=_CELLS))
def colour_histogram(spark, sf):
    return colors.histogram(_cells(spark, sf), ["page"])


@query("colour_listing", sql("SELECT page, role, string_agg(concat('#', hex, ' (x', n, ')'), ', ' ORDER BY n DESC, hex) AS listing FROM (SELECT page, role, hex, count(*) AS n FROM cells GROUP BY ALL) t GROUP BY 1, 2", "text_runs", extra=_CELLS))
def colour_listing(spark, sf):
    return colors.histogram_text(colors.histogram(_cells(spark, sf), ["page"]), ["page"])


@query("colour_map", sql("SELECT page, role, CASE WHEN role = 'fill' AND hex LIKE '00%' THEN 'ABCDEF' ELSE hex END AS new_hex, count(*) AS n FROM cells GROUP BY ALL", "text_runs", extra=_CELLS))
def colour_map(spark, sf):
    cells = _cells(spark, sf)
    raw = F.map_from_arrays(F.array(*[F.lit(h) for h in ("#000000", "004000", "008000", "00c000", "123456", "zz")]), F.array(*[F.lit(h) for h in ("#abcdef", "abcdef", "ABCDEF", "abcdef", "abcdef", "abcdef")]))
    seen = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda g: F.format_string("00%02X00", g))
    m = cells.sparkSession.range(1).select(F.explode(C.valid_colour_map(raw, seen, F.array(F.lit("ABCDEF")))).alias("source", "target")).withColumn("role", F.lit("fill"))
    return colors.map_colours(cells, m, ["page"]).groupBy("page", "role", "new_hex").agg(F.count(F.lit(1)).alias("n"))


@query("palette_choice", sql("SELECT page, arg_max(hex, k) AS hex FROM (SELECT page, printf('%02X%02X%02X', fg_r, fg_g, fg_b) AS hex, (CAST(fg_r AS BIGINT) * 1000000000000 - run_id) AS k FROM text_runs) t GROUP BY 1", "text_runs"))
def palette_choice(spark, sf):
    p = V.text_runs(spark, sf).select("page", F.col("run_id").alias("pos"), C.rgb_hex(*C.rgb("fg_")).alias("hex"), F.col("fg_r").alias("contrast_ratio"))
    return colors.best_font(p, ["page"])
