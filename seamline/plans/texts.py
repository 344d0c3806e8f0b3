"""Queries: scalar functions (F), response parsing (R), sources (S), sinks (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.labels import SPACES
from ..functions import parsers
from ..functions import responses as R
from ..operators import ranges
from ..operators import windows as W
from ..sources import readers, sinks, workbooks
from .base import PRED, RESP, SENT, SEQ, predictions, responses, sentences, sequence, table, workspace
from .registry import query

# labels in many spellings
_SPELL = "CASE k % 9 WHEN 0 THEN ' border ' WHEN 1 THEN 'Yes' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'no' WHEN 4 THEN 'NO_BORDER' WHEN 5 THEN 'False' WHEN 6 THEN '1' WHEN 7 THEN NULL ELSE 'maybe' END"
_L = f"{SEQ}, l AS (SELECT event_id, {_SPELL} AS v FROM seq)"
_YES, _NO = "('BORDER', 'TRUE', 'YES')", "('NOBORDER', 'NO_BORDER', 'FALSE', 'NO')"


def _spelled(spark, d):
    return sequence(spark, d).select("event_id", "k", F.expr(_SPELL).alias("v"))


@query(f"WITH {_L} SELECT event_id, CASE WHEN upper(trim(v)) IN {_YES} THEN 'BORDER' WHEN upper(trim(v)) IN {_NO} THEN 'NOBORDER' END AS label FROM l")
def f1_nullable_label(spark, d):
    return _spelled(spark, d).select("event_id", L.nullable_label("v").alias("label"))


@query(f"WITH {_L} SELECT event_id, CASE WHEN upper(trim(v)) IN {_YES} OR trim(v) = '1' THEN 'BORDER' ELSE 'NOBORDER' END AS label FROM l")
def f2_total_label(spark, d):
    return _spelled(spark, d).select("event_id", L.total_label("v").alias("label"))


@query(f"WITH {_L} SELECT event_id, CASE WHEN upper(trim(v)) = 'BORDER' THEN 'BORDER' ELSE 'NOBORDER' END AS label FROM l")
def f3_gold_label(spark, d):
    return _spelled(spark, d).select("event_id", L.gold_label("v").alias("label"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS lowered FROM documents")
def f4_collapse_space(spark, d):
    return table(spark, d, "documents").select("doc_id", L.collapse_space("text").alias("collapsed"), L.collapse_space("text", lower=True).alias("lowered"))


@query(f"WITH {SEQ} SELECT event_id, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'x' ELSE '' END AS cleaned FROM seq")
def f5_clean_text(spark, d):
    x = sequence(spark, d).withColumn("v", F.expr("CASE k % 3 WHEN 0 THEN ' NaN ' WHEN 1 THEN ' x ' END"))
    return x.select("event_id", L.clean_text("v").alias("cleaned"))


@query(f"WITH {SEQ} SELECT event_id, CASE WHEN k % 3 = 0 THEN k WHEN k % 3 = 1 THEN k ELSE idx END AS number FROM seq")
def f6_int_or_position(spark, d):
    x = sequence(spark, d).withColumn("s", F.expr("CASE k % 3 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN concat(CAST(k AS STRING), '.7') ELSE 'n/a' END"))
    return x.select("event_id", L.int_or("s", "idx").alias("number"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS slug FROM documents")
def f7_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", L.slug("text").alias("slug"))


@query("SELECT p_partkey, replace(replace(p_brand || '/' || p_type || ':x', '/', '_'), ':', '_') AS model_path, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS ascii_slug, p_type || ':x' AS short_model, CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS BIGINT) AS number FROM part")
def f8_path_helpers(spark, d):
    x = table(spark, d, "part").withColumn("m", F.concat("p_brand", F.lit("/"), "p_type", F.lit(":x")))
    return x.select("p_partkey", L.model_path("m").alias("model_path"), L.ascii_slug("p_name").alias("ascii_slug"), L.short_model("m").alias("short_model"), L.stem_number("p_brand").alias("number"))


_JC = "TRY_CAST(CASE WHEN starts_with(trim(raw), '{') AND json_valid(raw) THEN json_extract_string(raw, '$.confidence') END AS DOUBLE)"


@query(f"WITH {RESP} SELECT event_id, {_JC} AS confidence FROM resp")
def f9_confidence(spark, d):
    return responses(spark, d).select("event_id", R.confidence("raw").alias("confidence"))


@query(f"WITH {RESP} SELECT event_id, coalesce(CASE WHEN starts_with(raw, '{{') AND json_valid(raw) THEN json_extract_string(raw, '$.reason') END, '') AS reason FROM resp")
def f10_reason(spark, d):
    return responses(spark, d).select("event_id", R.reason("raw").alias("reason"))


@query("SELECT doc_id, left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 240) AS line FROM documents")
def f11_first_line(spark, d):
    return table(spark, d, "documents").select("doc_id", L.first_line("text").alias("line"))


_HTML = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|h[1-6]|li|tr|section|article)\s*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, trim({_HTML}, ' ' || chr(10)) AS text FROM pages")
def f12_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", L.html_text("html").alias("text"))


@query(f"WITH {SEQ} SELECT event_id, CASE WHEN pred AND gold THEN 'TP' WHEN pred THEN 'FP' WHEN gold THEN 'FN' ELSE 'TN' END AS status FROM seq")
def f13_eval_status(spark, d):
    return sequence(spark, d).select("event_id", L.eval_status("pred", "gold").alias("status"))


@query("SELECT doc_id, left(replace(text, chr(10), ' '), 160) AS preview FROM documents")
def f14_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", L.preview("text", 160).alias("preview"))


@query("SELECT doc_id, text || 'b' AS cleaned FROM documents")
def f15_strip_controls(spark, d):
    """Controls stand after each blank and at the end of every text."""
    x = table(spark, d, "documents").select("doc_id", F.concat(F.replace("text", F.lit(" "), F.concat(F.lit(" "), F.char(F.lit(1)))), F.char(F.lit(11)), F.lit("b")).alias("t"))
    return x.select("doc_id", L.strip_controls("t").alias("cleaned"))


_SCHEMA = """concat('{"$schema":"x","type":"object","title":"', p_brand, '","additionalProperties":false,"properties":{"label":{"type":"string","title":"l"},"size":{"anyOf":[{"$id":"s","maximum":', CAST(p_size AS STRING), '},{"title":1}]}}}')"""


@query("""SELECT p_partkey, '{"type":"object","properties":{"label":{"type":"string"},"size":{"anyOf":[{"maximum":' || CAST(p_size AS VARCHAR) || '},{}]}}}' AS schema FROM part""")
def f16_schema_sanitiser(spark, d):
    return table(spark, d, "part").select("p_partkey", sinks.sanitized_schema(F.expr(_SCHEMA)).alias("schema"))


_COST = "(prompt_tokens * 0.3 + (output_tokens + coalesce(thought_tokens, 0)) * 2.5) / 1000000"


@query(f"WITH {PRED} SELECT key, CAST({_COST} AS DOUBLE) AS cost FROM pr")
def f17_cost(spark, d):
    return predictions(spark, d).select("key", L.cost("prompt_tokens", "output_tokens", "thought_tokens", 0.3, 2.5).alias("cost"))


@query(f"WITH {SEQ} SELECT doc, count(*) FILTER (WHERE pred) AS calls, CAST(count(*) FILTER (WHERE pred) * (11 * 30 * 0.3 + 60 * 2.5) / 1000000 AS DOUBLE) AS cost FROM seq GROUP BY doc")
def f18_verifier_cost(spark, d):
    x = sequence(spark, d).groupBy("doc").agg(F.count_if("pred").alias("calls"))
    return x.select("doc", "calls", (F.col("calls") * (11 * 30 * 0.3 + 60 * 2.5) / 1_000_000).alias("cost"))


@query(f"""WITH {PRED}, b AS (SELECT slug, count(*) FILTER (WHERE parse_ok) / count(*) AS p, count(*) FILTER (WHERE label = 'BORDER') / count(*) AS r FROM pr GROUP BY slug)
SELECT slug, concat_ws(';', CASE WHEN p < 0.95 THEN 'parse_rate' END, CASE WHEN r < 0.1 OR r > 0.4 THEN 'border_rate' END) AS alerts FROM b""")
def f19_gate_alerts(spark, d):
    x = predictions(spark, d).groupBy("slug").agg((F.count_if("parse_ok") / F.count(F.lit(1))).alias("p"), (F.count_if(F.col("label") == "BORDER") / F.count(F.lit(1))).alias("r"))
    return x.select("slug", F.array_join(L.alerts((F.col("p") < 0.95, "parse_rate"), ((F.col("r") < 0.1) | (F.col("r") > 0.4), "border_rate")), ";").alias("alerts"))


@query(f"""WITH {RESP}, b AS (SELECT doc, count(*) FILTER (WHERE gold) AS g, count(*) FILTER (WHERE pred AND k < 2) AS p, count(*) FILTER (WHERE raw = '') / count(*) AS f FROM resp GROUP BY doc)
SELECT doc, concat_ws(';', CASE WHEN g > 0 AND p = 0 THEN 'no_predicted_borders' END, CASE WHEN f > 0.1 THEN 'parse_failures' END) AS warnings FROM b""")
def f20_eval_warnings(spark, d):
    x = responses(spark, d).groupBy("doc").agg(F.count_if("gold").alias("g"), F.count_if(F.col("pred") & (F.col("k") < 2)).alias("p"), (F.count_if(F.col("raw") == "") / F.count(F.lit(1))).alias("f"))
    return x.select("doc", F.array_join(L.alerts(((F.col("g") > 0) & (F.col("p") == 0), "no_predicted_borders"), (F.col("f") > 0.1, "parse_failures")), ";").alias("warnings"))


_ERR = """CASE k % 7 WHEN 0 THEN '401 Unauthorized' WHEN 1 THEN 'HTTP 402: insufficient credit' WHEN 2 THEN 'model not found (404)' WHEN 3 THEN 'Rate limit reached, "retry_after_seconds": 12.5'
WHEN 4 THEN 'error 429 Retry-After: 0' WHEN 5 THEN 'Insufficient Credit left' ELSE 'connection reset' END"""
_LOW = "lower(e)"


def _errors(spark, d):
    return sequence(spark, d).select("event_id", "idx", F.expr(_ERR).alias("e"))


@query(f"""WITH {SEQ}, er AS (SELECT event_id, {_ERR} AS e FROM seq) SELECT event_id, CASE WHEN contains(e, '401') OR contains(e, '403') OR contains({_LOW}, 'invalid api key') OR contains({_LOW}, 'unauthorized') THEN 'auth_error'
WHEN contains(e, '402') OR (contains({_LOW}, 'insufficient') AND contains({_LOW}, 'credit')) OR contains({_LOW}, 'payment required') THEN 'billing_error'
WHEN (contains(e, '404') OR contains({_LOW}, 'not found')) AND contains({_LOW}, 'model') THEN 'model_not_found'
WHEN contains(e, '429') OR contains({_LOW}, 'rate limit') OR contains({_LOW}, 'rate-limit') THEN 'rate_limit' ELSE 'api_error' END AS kind FROM er""")
def f21_error_kind(spark, d):
    return _errors(spark, d).select("event_id", L.error_kind("e").alias("kind"))


@query(f"""WITH {SEQ}, er AS (SELECT event_id, idx, {_ERR} AS e FROM seq) SELECT event_id, CASE WHEN contains(e, 'retry_after_seconds') THEN 12.5 WHEN contains(e, 'Retry-After') THEN 1.0 ELSE CAST(least(60, 5 * pow(2, least(idx % 9, 6))) AS DOUBLE) END AS seconds FROM er""")
def f22_retry_after(spark, d):
    return _errors(spark, d).withColumn("attempt", F.col("idx") % 9).select("event_id", L.retry_after("e", "attempt").alias("seconds"))


@query(f"""WITH {SEQ}, z AS (SELECT event_id, conf, pred, gold, least(idx - last_value(CASE WHEN gold THEN idx END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING),
first_value(CASE WHEN gold THEN idx END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - idx) AS dist FROM seq)
SELECT event_id, CASE WHEN dist <= 1 THEN 'off_by_one' WHEN dist <= 3 THEN 'near_miss' WHEN conf >= 0.85 THEN 'confident_fp' ELSE 'isolated_fp' END AS tag FROM z WHERE pred AND NOT gold""")
def f23_fp_tag(spark, d):
    x = sequence(spark, d).withColumn("dist", W.distance_to("gold")).where("pred and not gold")
    return x.select("event_id", L.fp_tag("dist", "conf").alias("tag"))


def _cue_sql(c: str) -> str:
    out = []
    for name, words in L.CUES.items():
        single, many = [w for w in words if " " not in w], [w for w in words if " " in w]
        tests = [rf"regexp_matches(' ' || {c} || ' ', '[^\p{{L}}\p{{N}}_](?:{'|'.join(single)})[^\p{{L}}\p{{N}}_]')"] + [f"contains({c}, '{w}')" for w in many]
        out.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    return f"concat_ws(',', {', '.join(out)})"


@query(f"WITH {RESP}, t AS (SELECT event_id, lower(raw || CASE k % 4 WHEN 0 THEN ' Später geht zu Fuß' WHEN 1 THEN ' inside a place' WHEN 2 THEN ' ortlos, Figur' ELSE '' END) AS x FROM resp) SELECT event_id, {_cue_sql('x')} AS cues FROM t")
def f24_shift_cues(spark, d):
    x = responses(spark, d).withColumn("t", F.expr("raw || CASE k % 4 WHEN 0 THEN ' Später geht zu Fuß' WHEN 1 THEN ' inside a place' WHEN 2 THEN ' ortlos, Figur' ELSE '' END"))
    return x.select("event_id", F.array_join(L.shift_cues("t"), ",").alias("cues"))


_FORMAT = "CASE p_size % 4 WHEN 0 THEN 'cot_list' WHEN 1 THEN 'json' WHEN 2 THEN 'no_cot' ELSE 'other' END"


@query(f"SELECT p_partkey, CAST(least(4096, p_size * 100 + 768) AS INTEGER) AS seq_len, CASE {_FORMAT} WHEN 'cot_list' THEN 256 WHEN 'no_cot' THEN 128 ELSE 96 END AS new_tokens FROM part")
def f25_sequence_length(spark, d):
    return table(spark, d, "part").select("p_partkey", L.sequence_length(F.col("p_size") * 100).cast("int").alias("seq_len"), L.new_tokens(F.expr(_FORMAT)).alias("new_tokens"))


@query("""SELECT p_partkey, left(sha256('{"p_brand":"' || p_brand || '","p_size":' || CAST(p_size AS VARCHAR) || '}'), 16) AS hash FROM part""")
def f26_config_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", L.config_hash("p_size", "p_brand").alias("hash"))


_AREA = "CASE WHEN p_size % 3 = 0 THEN 'reproduction' ELSE 'prompting' END"
_COMMAND = """'run ''--brand=' || p_brand || ''' ''' || p_type || ' x'' ''it''"''"''s'''"""


@query(f"SELECT p_partkey, replace(p_brand, '/', '_') || '__' || p_type || '__x' AS key, {_COMMAND} AS command, '/r/outputs/' || (CASE WHEN p_size % 3 = 0 THEN '' ELSE 'runs/' END) || {_AREA} || '/2024-01-31/' || CAST(p_partkey AS VARCHAR) AS folder FROM part")
def f27_output_key(spark, d):
    key = sinks.output_key("{0}", "{1}", "x")
    words = F.array(F.lit("run"), F.concat(F.lit("--brand="), "p_brand"), F.concat("p_type", F.lit(" x")), F.lit("it's"))
    return table(spark, d, "part").withColumn("area", F.expr(_AREA)).select(
        "p_partkey",
        F.replace(F.replace(F.lit(key), F.lit("{0}"), F.col("p_brand")), F.lit("{1}"), F.col("p_type")).alias("key"),
        L.command_line(words).alias("command"),
        L.run_folder(F.lit("/r"), "area", F.lit("2024-01-31"), F.col("p_partkey").cast("string")).alias("folder"),
    )


@query(f"WITH {PRED} SELECT slug, coalesce(array_to_string(list(idx ORDER BY idx) FILTER (WHERE parse_ok AND label = 'BORDER'), ','), '') AS borders FROM pr GROUP BY slug")
def f28_border_list(spark, d):
    x = predictions(spark, d)
    found = F.array_sort(F.collect_list(F.when(F.col("parse_ok") & (F.col("label") == "BORDER"), F.col("idx"))))
    return x.groupBy("slug").agg(F.array_join(found.cast("array<string>"), ",").alias("borders"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'nicht') OR contains(lower(text), 'nonscene') THEN 'Nonscene' ELSE 'Scene' END AS kind FROM documents")
def f29_segment_type(spark, d):
    return table(spark, d, "documents").select("doc_id", L.segment_type("text").alias("kind"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'label_reason.json' WHEN 1 THEN 'score_array.json' END AS schema_file FROM part")
def f30_schema_lookup(spark, d):
    family = F.get(F.array(*map(F.lit, "BIA")), F.col("p_size") % 3)
    return table(spark, d, "part").select("p_partkey", L.schema_file(family, {"B": "label_reason.json", "I": "score_array.json", "A": None}).alias("schema_file"))


# -- responses ---------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'before ' || chr(10) || ' <sentence> ' || text || ' </sentence> after ' ELSE text END AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'before' ELSE s END AS left_context, CASE WHEN turn % 2 = 0 THEN trim(regexp_extract(s, '(?s)<sentence>(.*?)</sentence>', 1), ' ' || chr(10)) ELSE '' END AS target, CASE WHEN turn % 2 = 0 THEN 'after' ELSE '' END AS right_context FROM c""")
def r1_split_context(spark, d):
    s = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("before \n <sentence> "), F.col("text"), F.lit(" </sentence> after "))).otherwise(F.col("text"))
    x = table(spark, d, "conversations").withColumn("c", R.split_context(s))
    return x.select("conv_id", "turn", F.col("c.left").alias("left_context"), F.col("c.target").alias("target"), F.col("c.right").alias("right_context"))


@query("SELECT item_id, replace(replace('L: {left_context} T: {target_sentence}', '{left_context}', text || ' {target_sentence}'), '{target_sentence}', text) AS prompt FROM benchmark")
def r2_render(spark, d):
    values = [("left_context", F.concat("text", F.lit(" {target_sentence}"))), ("target_sentence", F.col("text"))]
    return table(spark, d, "benchmark").select("item_id", R.render(F.lit("L: {left_context} T: {target_sentence}"), values).alias("prompt"))


def _closing(s: str, p: str, pair: str) -> str:
    """Where the bracket at place ``p`` of ``s`` closes, else null: as many of each kind stand from there on."""
    o, c = pair
    part = f"substr({s}, {p}, i - {p} + 1)"
    return f"list_filter(range({p}, length({s}) + 1), lambda i: substr({s}, i, 1) = '{c}' AND length(replace({part}, '{o}', '')) = length(replace({part}, '{c}', '')))[1]"


def _candidate_ctes(rows: str, raw: str) -> str:
    """CTEs on (event_id, ``raw``) of ``rows``: ``cand`` with the JSON candidate of each text."""
    return f"""cs AS (SELECT event_id, {raw} AS t, trim({raw}, '{SPACES}') AS s FROM {rows}), cp AS (SELECT *, least(nullif(strpos(s, '{{'), 0), nullif(strpos(s, '['), 0)) AS p FROM cs),
cand AS (SELECT event_id, t, CASE WHEN p = 1 THEN s WHEN substr(s, p, 1) = '{{' THEN substr(s, p, {_closing('s', 'p', '{}')} - p + 1) WHEN p IS NOT NULL THEN substr(s, p, {_closing('s', 'p', '[]')} - p + 1) END AS candidate FROM cp)"""


@query(f"WITH {RESP}, {_candidate_ctes('resp', 'raw')} SELECT event_id, candidate FROM cand")
def r3_json_candidate(spark, d):
    return responses(spark, d).select("event_id", parsers.candidate_col("raw").alias("candidate"))


_LABEL_WORDS = f"CASE WHEN upper(trim({{0}})) IN {_YES} THEN 'BORDER' WHEN upper(trim({{0}})) IN {_NO} THEN 'NOBORDER' END"
_TOKEN = """CASE WHEN upper(trim(raw)) IN ('BORDER', 'TRUE', 'YES') THEN 'BORDER' WHEN regexp_matches(upper(raw), '\\bNOBORDER\\b') THEN 'NOBORDER' WHEN regexp_matches(upper(raw), '\\bBORDER\\b') THEN 'BORDER'
WHEN regexp_matches(lower(raw), '\\b(?:does\\s+not|doesn''t)\\s+(?:start|mark|introduce)\\b') THEN 'NOBORDER' WHEN regexp_matches(lower(raw), '\\b(?:not\\s+a|no)\\s+new\\s+segment\\b') THEN 'NOBORDER'
WHEN regexp_matches(lower(raw), '\\b(?:starts?|marks?|introduces?)\\s+(?:a\\s+)?new\\s+(?:event|scene|segment)\\b') THEN 'BORDER' END"""
_WORD_TOKEN = "CASE WHEN regexp_matches({0}, '(?i)\\bNONE\\b') THEN 'NONE' ELSE nullif(regexp_extract({0}, '\\b(\\d+)\\b', 1), '') END"
#: the responses, with an object that has no label
_RAW4 = "CASE WHEN event_id % 14 = 13 THEN '{\"note\": 1}' ELSE raw END"
_NUMBER_JSON = """CASE WHEN event_id % 14 = 0 THEN '{"label": "BORDER", "confidence": ' || CAST(CAST(json_extract_string(candidate, '$.confidence') AS DOUBLE) AS VARCHAR) || '}' ELSE candidate END"""
_R4 = f"""{RESP}, {_candidate_ctes('resp', _RAW4)},
pay AS (SELECT event_id, t, replace(t, 'x', 'x') AS raw, CASE WHEN json_valid(candidate) THEN {_NUMBER_JSON} END AS shown, CASE WHEN json_valid(candidate) THEN json_type(candidate) END AS kind, CASE WHEN json_valid(candidate) THEN json_extract_string(candidate, '$.label') END AS said FROM cand),
lab AS (SELECT *, {_LABEL_WORDS.format('said')} AS label, {_TOKEN} AS token, {_WORD_TOKEN.format('raw')} AS word FROM pay)"""


@query(f"""WITH {_R4} SELECT event_id, 'A' AS family, coalesce(token, label) AS label, coalesce(token, label) IS NOT NULL AS is_valid, CASE WHEN coalesce(token, label) IS NULL THEN 'invalid_label' ELSE '' END AS error, CASE WHEN token IS NULL AND label IS NOT NULL THEN shown ELSE t END AS payload FROM lab
UNION ALL SELECT event_id, 'L', label, label IS NOT NULL, CASE WHEN label IS NOT NULL THEN '' WHEN shown IS NULL THEN 'json_parse_error' WHEN kind = 'OBJECT' THEN 'missing_or_invalid_label' ELSE 'json_not_object' END, shown FROM lab
UNION ALL SELECT event_id, 'H', CASE WHEN word = 'NONE' THEN 'NOBORDER' END, word IS NOT NULL, CASE WHEN word IS NULL THEN 'invalid_sentence_id_or_none' ELSE '' END, coalesce(word, t) FROM lab
UNION ALL SELECT event_id, 'I', NULL, coalesce(kind = 'ARRAY', FALSE), CASE WHEN shown IS NULL THEN 'json_parse_error' WHEN kind = 'ARRAY' THEN '' ELSE 'json_not_array' END, shown FROM lab
UNION ALL SELECT event_id, 'Z', NULL, FALSE, 'unsupported_family:Z', NULL FROM lab""")
def r4_family_output(spark, d):
    x = responses(spark, d).select("event_id", F.expr(_RAW4).alias("raw"))
    return parsers.by_family(x, "raw", "ALHIZ")


@query(f"WITH {RESP} SELECT event_id, {_TOKEN} AS label FROM resp")
def r5_label_token(spark, d):
    return responses(spark, d).select("event_id", R.label_token("raw").alias("label"))


@query(f"WITH {RESP} SELECT event_id, {_WORD_TOKEN.format('raw')} AS token FROM resp")
def r6_sentence_token(spark, d):
    return responses(spark, d).select("event_id", R.sentence_token("raw").alias("token"))


# the first balanced braces that hold JSON: a fold over the places of opening braces, which ends where one never closes
_OPENING = "list_filter(range(1, length(raw) + 1), lambda i: substr(raw, i, 1) = '{')"
_FOLD = """list_reduce(pairs, lambda st, x: CASE WHEN st.dead OR st.found IS NOT NULL OR x.p < st.at THEN st WHEN x.e IS NULL THEN {'at': st.at, 'found': st.found, 'dead': TRUE}
WHEN json_valid(substr(raw, x.p, x.e - x.p + 1)) THEN {'at': st.at, 'found': substr(raw, x.p, x.e - x.p + 1), 'dead': FALSE} ELSE {'at': x.e + 1, 'found': st.found, 'dead': FALSE} END, {'at': CAST(0 AS BIGINT), 'found': CAST(NULL AS VARCHAR), 'dead': FALSE}).found"""
_PARSED = f"""{RESP}, op AS (SELECT event_id, raw, unnest({_OPENING}) AS p FROM resp), en AS (SELECT event_id, p, {_closing('raw', 'p', '{}')} AS e FROM op),
pr2 AS (SELECT event_id, list({{'p': p, 'e': e}} ORDER BY p) AS pairs FROM en GROUP BY event_id), ob AS (SELECT r.event_id, r.raw, CASE WHEN pairs IS NOT NULL THEN {_FOLD} END AS found FROM resp r LEFT JOIN pr2 ON r.event_id = pr2.event_id),
tp AS (SELECT event_id, raw, {_LABEL_WORDS.format("json_extract_string(found, '$.label')")} AS own, TRY_CAST(json_extract_string(found, '$.confidence') AS DOUBLE) AS conf,
CASE WHEN regexp_matches(upper(raw), '\\bNOBORDER\\b') THEN 'NOBORDER' WHEN regexp_matches(upper(raw), '\\bBORDER\\b') THEN 'BORDER' END AS word FROM ob)"""


@query(f"""WITH {_PARSED} SELECT event_id, coalesce(own, word, 'NOBORDER') AS label, CASE WHEN own IS NOT NULL THEN conf END AS confidence, coalesce(own, word) IS NOT NULL AS parse_ok, CASE WHEN coalesce(own, word) IS NULL THEN 'no_json_or_label_token' ELSE '' END AS parse_error,
CASE WHEN own IS NOT NULL THEN 'json' WHEN word IS NOT NULL THEN 'regex_fallback' ELSE 'default_noborder' END AS parse_method FROM tp""")
def r7_tolerant_parse(spark, d):
    return responses(spark, d).select("event_id", parsers.tolerant_col("raw").alias("r")).select("event_id", "r.*")


@query(f"""WITH {_R4.replace(_RAW4, 'raw')} SELECT event_id, coalesce(label, 'NOBORDER') AS label, CASE WHEN label IS NOT NULL THEN TRY_CAST(json_extract_string(shown, '$.confidence') AS DOUBLE) END AS confidence, label IS NOT NULL AS parse_ok,
CASE WHEN label IS NOT NULL THEN '' WHEN shown IS NULL THEN 'json_parse_error' WHEN kind = 'OBJECT' THEN 'missing_or_invalid_label' ELSE 'json_not_object' END AS parse_error, CASE WHEN label IS NOT NULL THEN 'strict' ELSE 'default_noborder' END AS parse_method FROM lab""")
def r8_strict_parse(spark, d):
    return responses(spark, d).select("event_id", parsers.strict_col("raw").alias("r")).select("event_id", "r.*")


@query(f"WITH {RESP} SELECT event_id, contains(raw, '{{') AS has_json, contains(raw, '{{') AND event_id % 14 <> 3 AS json_closed, CASE WHEN contains(raw, '{{') THEN event_id % 14 = 3 ELSE trim(raw) <> '' END AS truncation_suspect FROM resp")
def r9_generation_diagnostics(spark, d):
    return responses(spark, d).select("event_id", R.has_json("raw").alias("has_json"), R.json_closed("raw").alias("json_closed"), R.truncation_suspect("raw").alias("truncation_suspect"))


def _ordered_sql(x: str, rules) -> str:
    out = " ".join("WHEN regexp_matches({}, '{}') THEN {}".format(x, pattern.replace("'", "''"), str(value).upper()) for pattern, value in rules)
    return f"CASE {out} END"


# the patterns of free text and, for its last line, of single words too
_SURE = ((r"(?i)\b(?:Answer|Final\s*Answer)\s*:\s*BORDER\b", True), (r"(?i)\b(?:Answer|Final\s*Answer)\s*:\s*NOBORDER\b", False))
_YES_NO = ((r"(?i)\bAnswer\s*:\s*No\b", False), (r"(?i)\bAnswer\s*:\s*Yes\b", True))
_STARTS = ((r"(?i)\b(?:does\s+(?:\*{0,2})not(?:\*{0,2})|doesn't)\s+(?:start|introduce|mark\b)", False), (r"(?i)\b(?:starts?|introduces?|marks?)\s+(?:a\s+new\s+scene|the\s+beginning)", True))
_WORD = ((r"(?i)^(?:BORDER|Yes|True)$", True), (r"(?i)^(?:NOBORDER|No|False)$", False))
_SAID = "CASE WHEN event_id % 14 = 9 AND k % 2 = 0 THEN 'No.' ELSE raw END"
_FREE = f"""CASE WHEN plain IN ('border', 'yes', 'true') THEN TRUE WHEN plain IN ('noborder', 'no', 'false') THEN FALSE
    ELSE coalesce({_ordered_sql('t', (*_SURE, *_YES_NO, *_STARTS))}, CASE WHEN contains(line, 'True') THEN TRUE WHEN contains(line, 'False') THEN FALSE WHEN starts_with(trim(line), 'Yes') THEN TRUE WHEN starts_with(trim(line), 'No') THEN FALSE END) END"""
_LOOSE = f"coalesce({_ordered_sql('last', (*_SURE, *_WORD, *_STARTS))}, {_ordered_sql('trim(t)', (*_SURE, *_WORD, *_STARTS))})"


@query(f"""WITH {RESP}, t AS (SELECT event_id, {_SAID} AS t FROM resp), l AS (SELECT event_id, t, coalesce(string_split(trim(t), chr(10))[1], '') AS line, coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1], '') AS last FROM t),
p AS (SELECT *, lower(regexp_replace(line, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS plain FROM l) SELECT event_id, {_FREE} AS strict_flag, {_LOOSE} AS loose_flag FROM p""")
def r10_free_text(spark, d):
    x = responses(spark, d).withColumn("t", F.expr(_SAID))
    return x.select("event_id", R.free_text_flag("t").alias("strict_flag"), R.loose_flag("t").alias("loose_flag"))


@query(f"WITH {RESP} SELECT event_id, CASE WHEN event_id % 14 = 8 THEN k >= 50 END AS first_flag, CASE WHEN event_id % 14 = 8 THEN k >= 50 END AS last_flag, CAST(NULL AS BOOLEAN) AS absent_flag FROM resp")
def r11_chunk_scores(spark, d):
    x = responses(spark, d).withColumn("s", R.chunk_scores("raw"))
    flag = lambda i, last=False: R.chunk_score_flag("s", i, last=last)
    return x.select("event_id", flag(F.lit(1)).alias("first_flag"), flag(F.lit(1), True).alias("last_flag"), flag(F.lit(7)).alias("absent_flag"))


@query(f"WITH {SEQ} SELECT event_id, CASE k % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN NULL ELSE TRUE END AS keep FROM seq")
def r12_verifier_answer(spark, d):
    said = """CASE k % 5 WHEN 0 THEN 'ok {"keep": true}' WHEN 1 THEN '{"keep": "nein"} so' WHEN 2 THEN 'I say no here' WHEN 3 THEN 'yes or no' ELSE 'Ja, sicher' END"""
    return sequence(spark, d).select("event_id", R.verifier_keep(F.expr(said)).alias("keep"))


@query(f"WITH {SEQ} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'answer' ELSE 'thought' END AS text FROM seq")
def r13_visible_text(spark, d):
    part = lambda text, thought: F.struct(F.lit(text).alias("text"), F.lit(thought).alias("thought"))
    parts = F.when(F.col("k") % 2 == 0, F.array(part("thought", True), part("ans", False), part("wer", False))).otherwise(F.array(part("thought", True)))
    return sequence(spark, d).withColumn("parts", parts).select("event_id", R.visible_text("parts").alias("text"))


@query(f"WITH {SEQ} SELECT event_id, CASE WHEN k % 3 < 2 THEN k ELSE 0 END AS prompt_tokens FROM seq")
def r14_usage(spark, d):
    body = F.expr("""CASE k % 3 WHEN 0 THEN concat('{"usageMetadata": {"promptTokenCount": ', CAST(k AS STRING), '}}') WHEN 1 THEN concat('{"usage_metadata": {"prompt_token_count": ', CAST(k AS STRING), '}}') ELSE '{}' END""")
    return sequence(spark, d).withColumn("b", body).select("event_id", R.usage_count("b", "promptTokenCount", "prompt_token_count").alias("prompt_tokens"))


_TAIL = "CASE WHEN contains(raw, 'NOBORDER') AND NOT contains(replace(raw, 'NOBORDER', ''), 'BORDER') THEN 'NOBORDER' WHEN contains(right(raw, 120), 'BORDER') THEN 'BORDER' END"


@query(f"WITH {RESP} SELECT event_id, {_TAIL} AS label FROM resp")
def r15_prose_tail(spark, d):
    return responses(spark, d).select("event_id", R.prose_tail_label("raw").alias("label"))


@query(f"WITH {SEQ} SELECT event_id, CASE k % 3 WHEN 0 THEN 'time,action' WHEN 1 THEN 'location' ELSE '' END AS tags FROM seq")
def r16_feature_tags(spark, d):
    body = F.expr("""CASE k % 3 WHEN 0 THEN '{"reason": "3, Time ,action,other"}' WHEN 1 THEN '{"reason": "location"}' ELSE '{}' END""")
    return sequence(spark, d).select("event_id", F.array_join(R.feature_tags(body, ["time", "location", "character", "action"]), ",").alias("tags"))


@query(f"""WITH {RESP}, w AS (SELECT event_id, k % 5 + 1 AS local, event_id % 17 = 0 AS failed, {_WORD_TOKEN.format('raw')} AS word FROM resp),
l AS (SELECT *, CASE WHEN failed OR word IS NULL THEN NULL WHEN word <> 'NONE' AND TRY_CAST(word AS INTEGER) = local THEN 'BORDER' ELSE 'NOBORDER' END AS label FROM w)
SELECT event_id, label, CASE WHEN failed THEN 'request_failed' WHEN label IS NULL THEN 'invalid_sentence_id_or_none' END AS error, label IS NOT NULL AS parse_ok FROM l""")
def r17_chunk_rows(spark, d):
    """A row per sentence from chunk answers: a failed request fails, NONE is a valid no, no match is an error."""
    x = responses(spark, d).withColumn("local", F.col("k") % 5 + 1)
    h = x.withColumn("r", parsers.family_col("raw", "H")).withColumn("failed", F.col("event_id") % 17 == 0)
    label = F.when(F.col("r.payload") == "NONE", "NOBORDER").when(F.col("r.payload").try_cast("int") == F.col("local"), "BORDER").when(F.col("r.is_valid"), "NOBORDER")
    label = F.when(~F.col("failed"), label)
    error = F.when(F.col("failed"), "request_failed").when(label.isNull(), F.coalesce(F.nullif(F.col("r.error"), F.lit("")), F.lit("chunk_map_failed")))
    return h.select("event_id", label.alias("label"), error.alias("error"), label.isNotNull().alias("parse_ok"))


@query(f"""WITH {_PARSED} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'BORDER' WHEN event_id % 2 = 0 THEN 'NOBORDER' ELSE coalesce(own, word, 'NOBORDER') END AS label, event_id % 2 = 0 OR coalesce(own, word) IS NOT NULL AS parse_ok FROM tp""")
def r18_enrich_cached(spark, d):
    """Parses generations only where that wasn't done; labels that are there stay."""
    x = responses(spark, d).select("event_id", "raw", F.when(F.col("event_id") % 2 == 0, F.lit(True)).alias("parse_ok"), F.when(F.col("event_id") % 4 == 0, F.lit("BORDER")).alias("label"))
    done, todo = x.where("parse_ok is not null"), x.where("parse_ok is null")
    parsed = todo.withColumn("r", parsers.tolerant_col("raw")).select("event_id", F.coalesce("label", "r.label").alias("label"), F.col("r.parse_ok").alias("parse_ok"))
    return done.select("event_id", F.coalesce("label", F.lit("NOBORDER")).alias("label"), "parse_ok").unionByName(parsed)


@query(f"WITH {_PARSED} SELECT event_id, coalesce(own, word, 'NOBORDER') AS label, conf AS confidence FROM tp")
def r19_label_confidence(spark, d):
    return responses(spark, d).select("event_id", parsers.label_confidence_col("raw").alias("r")).select("event_id", "r.*")


@query(f"WITH {SEQ} SELECT event_id, k AS output_tokens, 'x' AS text FROM seq")
def r20_object_twins(spark, d):
    """The same readers over responses kept as structs: made JSON first."""
    body = F.to_json(F.struct(F.struct(F.col("k").alias("candidatesTokenCount")).alias("usageMetadata"), F.array(F.struct(F.lit("x").alias("text"))).alias("parts")))
    x = sequence(spark, d).withColumn("b", body)
    parts = F.from_json(F.get_json_object("b", "$.parts"), "array<struct<text: string, thought: boolean>>")
    return x.withColumn("parts", parts).select("event_id", R.usage_count("b", "candidatesTokenCount", "candidates_token_count").alias("output_tokens"), R.visible_text("parts").alias("text"))


# -- sources -----------------------------------------------------------------------------------------------


def _jsonl(spark, d):
    """Sentences of the conversations as JSON lines, with blank lines between."""
    path = workspace(spark, "jsonl")
    x = table(spark, d, "conversations").select(F.col("turn").cast("int").alias("sentence_index"), F.col("text").alias("sentence_text_full"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".csv")).alias("source_file"))
    x.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.text(path)
    return path


@query("SELECT CAST(turn AS INTEGER) AS sentence_index, text AS sentence_text_full, 'c' || CAST(conv_id AS VARCHAR) || '.csv' AS source_file FROM conversations")
def s1_read_jsonl(spark, d):
    return readers.read_jsonl(spark, _jsonl(spark, d), readers.SENTENCE)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def s2_read_csv(spark, d):
    path = workspace(spark, "csv")
    sinks.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(spark, path)


@query("SELECT source AS scene, CAST(doc_id AS VARCHAR) AS sentence_id, text FROM documents")
def s3_infer_roles(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("Scene nr"), F.col("doc_id").cast("string").alias("Sentence ID"), F.col("text").alias("Satz"))
    return readers.with_roles(x)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment, CAST(NULL AS VARCHAR) AS absent FROM customer")
def s4_read_sheet(spark, d):
    """Workbooks with stripped headers and empty cells, many files of one folder."""
    path = workspace(spark, "sheets")
    x = table(spark, d, "customer").select(F.col("c_custkey").alias(" c_custkey"), F.col("c_name").alias("c_name "), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment"))
    workbooks.write_files(workbooks.as_workbooks(x, rows=100), path)
    return workbooks.read_workbooks(spark, path, ["c_custkey", "c_name", "segment", "absent"]).drop("path", "row")


def _caches(spark, d):
    entry = F.struct(F.when(F.col("k") % 10 != 0, F.when(F.col("pred"), "border").otherwise("noborder")).alias("pred"), F.to_json(F.struct(F.col("conf").alias("confidence"))).alias("reason"), F.when(F.col("gold"), "BORDER").otherwise("NOBORDER").alias("gold"))
    x = sequence(spark, d).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("string").alias("key"), entry.alias("value")))).alias("m"))
    bad = F.create_map(F.lit("meta"), F.struct(F.lit("x").alias("pred"), F.lit("{}").alias("reason"), F.lit("y").alias("gold")))
    return x.select("doc", F.to_json(F.map_concat("m", bad)).alias("value"))


@query(f"WITH {SEQ} SELECT doc, idx, CASE WHEN k % 10 <> 0 AND pred THEN 'BORDER' ELSE 'NOBORDER' END AS pred, CASE WHEN gold THEN 'BORDER' ELSE 'NOBORDER' END AS gold, CAST(conf AS DOUBLE) AS conf FROM seq")
def s5_read_cache(spark, d):
    return readers.explode_cache(_caches(spark, d)).drop("sentence")


@query(f"WITH {SEQ} SELECT doc, idx AS original_indices, pred AS labels FROM seq")
def s6_read_results(spark, d):
    pairs = F.array_sort(F.collect_list(F.struct("idx", "pred")))
    x = sequence(spark, d).groupBy("doc").agg(pairs.alias("p")).select("doc", F.col("p.idx").alias("original_indices"), F.col("p.pred").alias("labels"))
    path = workspace(spark, "results")
    x.write.json(path)
    return readers.explode_results(spark.read.schema("doc long, original_indices array<int>, labels array<boolean>").json(path))


@query("SELECT 'conversations' AS slug, CAST(turn AS INTEGER) AS idx, text FROM conversations")
def s7_manifest_sentences(spark, d):
    root = workspace(spark, "manifest")
    x = table(spark, d, "conversations").select(F.col("turn").cast("int").alias("sentence_index"), F.col("text").alias("sentence_text_full"), F.lit("c").alias("source_file"))
    x.coalesce(1).write.json(f"{root}/part")
    name = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/part").select("path").head()[0].rsplit("/", 1)[-1]
    manifest = spark.createDataFrame([("t", 0, [(None, "conversations", f"part/{name}", None, None, None, None)])], readers.MANIFEST)
    return readers.manifest_sentences(spark, manifest, root).select("slug", "idx", "text")


@query("SELECT text FROM (SELECT unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS text FROM documents) a")
def s8_read_lines(spark, d):
    path = workspace(spark, "lines")
    table(spark, d, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    return readers.read_lines(spark, f"{path}/*/*.txt").select("text")


@query(f"WITH {SENT} SELECT doc_id, idx, text FROM sent")
def s9_split_sentences(spark, d):
    return sentences(spark, d).select("doc_id", "idx", "text")


def _books(spark, d):
    """A book of each conversation, a page a turn, under file names in the opposite order."""
    from html import escape

    from ..sources.archives import write_epub

    def run(batches):
        for pdf in batches:
            books = [write_epub([(f"z{10_000 - r['turn']}.html", f"<style>x</style><h1>{escape(r['role'])}</h1><p>{escape(r['text'])}</p>") for r in turns]) for turns in pdf["turns"]]
            yield pdf[["path"]].assign(content=books)

    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    x = table(spark, d, "conversations").groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".epub")).alias("path")).agg(turns)
    return x.mapInPandas(run, "path string, content binary")


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(role || chr(10) || coalesce(text, ''), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT 'c' || CAST(conv_id AS VARCHAR) || '.epub' AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS page, trim({_PLAIN}, ' ' || chr(10)) AS text FROM conversations")
def s10_read_epub(spark, d):
    from ..sources.archives import epub_texts

    return epub_texts(_books(spark, d))


def _archives(spark, d):
    """A zipped annotation file of each document: its lines are sentences, its halves scenes of two types."""
    from ..sources.archives import write_xmi

    def one(text: str) -> bytes:
        sentences, at = [], 0
        for line in text.split("\n"):
            sentences.append((at, at + len(line)))
            at += len(line) + 1
        middle = len(text) // 2
        return write_xmi(text, sentences, [(0, middle, "Scene"), (middle, len(text), "Nonscene")])

    def run(batches):
        for pdf in batches:
            yield pdf[["path"]].assign(content=[one(t) for t in pdf["text"]])

    x = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".xmi.zip")).alias("path"), "text")
    return x.mapInPandas(run, "path string, content binary")


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INTEGER) - length(line) - 1 AS b FROM l)
SELECT 'd' || CAST(doc_id AS VARCHAR) || '.xmi.zip' AS path, 'sentence' AS kind, CAST(b AS INTEGER) AS begin, CAST(b + length(line) AS INTEGER) AS "end", trim(regexp_replace(line, '[{SPACES}]+', ' ', 'g')) AS text FROM o WHERE trim(line, '{SPACES}') <> ''
UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR) || '.xmi.zip', 'scene', 0, CAST(length(text) // 2 AS INTEGER), NULL FROM documents WHERE text IS NOT NULL""")
def s11_read_xmi(spark, d):
    from ..sources.archives import xmi_rows

    return xmi_rows(_archives(spark, d)).select("path", "kind", "begin", "end", "text")


@query("SELECT conv_id, conv_id AS start, turn AS scene FROM conversations")
def s12_standoff(spark, d):
    path = workspace(spark, "standoff")
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("conv_id").alias("begin"), F.col("turn").alias("scene"))).alias("scenes"))
    x.write.json(path)
    y = readers.read_documents_json(spark, path, "conv_id long, scenes array<struct<start: long, begin: long, scene: long>>").select("conv_id", F.explode("scenes").alias("s"))
    return y.select("conv_id", F.coalesce("s.start", "s.begin").alias("start"), F.col("s.scene").alias("scene"))


@query("SELECT 'doc' || CAST(p_partkey % 50 AS VARCHAR) AS stem, min('/a/' || CAST(p_partkey AS VARCHAR) || '/doc' || CAST(p_partkey % 50 AS VARCHAR) || '.xmi.zip') AS path FROM part GROUP BY 1")
def s13_first_path_per_stem(spark, d):
    n = F.col("p_partkey").cast("string")
    files = table(spark, d, "part").select(F.concat(F.lit("/a/"), n, F.lit("/doc"), (F.col("p_partkey") % 50).cast("string"), F.lit(".xmi.zip")).alias("path"))
    return readers.first_path_per_stem(files)


@query(f"WITH {SEQ} SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN k % 3 < 2 THEN '{{\"a\":1}}' END AS response, CASE WHEN k % 3 = 2 THEN 'timeout' END AS error FROM seq")
def s14_batch_results(spark, d):
    body = F.expr("""concat('{"key": "', CAST(event_id AS STRING), '"', CASE WHEN k % 3 < 2 THEN ', "response": {"a":1}' ELSE '' END, CASE WHEN k % 3 > 0 THEN ', "error": "timeout"' ELSE '' END, '}')""")
    return readers.batch_results(sequence(spark, d).select(body.alias("value")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'BORDER' AS label, CASE WHEN c_custkey % 2 = 0 THEN 'Manual override.' ELSE c_name END AS reason FROM customer")
def s15_overrides(spark, d):
    path = workspace(spark, "overrides")
    x = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit(" border").alias("label"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("reason"))
    sinks.write_csv(x, path)
    return readers.read_overrides(spark, path)


@query(f"WITH {PRED} SELECT slug, idx, key FROM pr WHERE NOT parse_ok")
def s16_key_list(spark, d):
    x = predictions(spark, d).where("not parse_ok").groupBy("slug").agg(F.collect_list("key").alias("keys")).select("keys")
    return readers.explode_keys(x)


@query(f"WITH {SEQ} SELECT 'm' AS model, CAST(doc AS VARCHAR) AS doc, avg(value) AS f1_3, max(value) AS over_prediction FROM seq GROUP BY doc")
def s17_summaries(spark, d):
    path = workspace(spark, "summary")
    x = sequence(spark, d).groupBy("doc").agg(F.avg("value").alias("f1_3"), F.max("value").alias("over_prediction"))
    x.select(F.lit("m").alias("model"), F.create_map(F.col("doc").cast("string"), F.struct("f1_3", "over_prediction")).alias("documents")).write.json(path)
    return readers.flatten_summaries(readers.read_documents_json(spark, path, "model string, documents map<string, struct<f1_3: double, over_prediction: double>>"))


@query(f"WITH {SEQ}, u AS (SELECT * FROM seq WHERE k % 5 <> 0) SELECT doc, idx, CASE WHEN coalesce(lag(event_type) OVER (PARTITION BY doc ORDER BY idx) <> event_type, TRUE) THEN 'BORDER' ELSE 'NOBORDER' END AS ground_truth_label, event_type AS scene_id_raw FROM u")
def s18_gold_rows(spark, d):
    x = sequence(spark, d).where("k % 5 <> 0")
    return x.select("doc", "idx", L.as_label(W.changed("event_type")).alias("ground_truth_label"), F.col("event_type").alias("scene_id_raw"))


@query(f"WITH {SEQ} SELECT DISTINCT CAST(doc AS VARCHAR) AS doc, event_type AS job FROM seq WHERE k % 4 <> 0")
def s19_completed_keys(spark, d):
    line = F.when(F.col("k") % 4 == 0, F.lit('{"doc": "1", "jo')).otherwise(F.to_json(F.struct(F.col("doc").cast("string").alias("doc"), F.col("event_type").alias("job"))))
    return readers.completed_keys(sequence(spark, d).select(line.alias("value")), ["doc", "job"])


@query(f"WITH {PRED} SELECT slug, idx - 1 AS pos, max_by(label, event_id) AS label FROM pr GROUP BY slug, idx - 1")
def s20_prediction_positions(spark, d):
    x = predictions(spark, d).select("key", F.lit("other").alias("source_file"), F.col("idx").alias("sentence_index"), "label", F.col("event_id").alias("seq"))
    return readers.prediction_positions(x).withColumn("pos", F.col("pos").cast("int"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position FROM conversations WHERE role = 'user' OR turn % 3 = 0")
def s21_kept_position(spark, d):
    x = table(spark, d, "conversations").withColumn("t", F.when((F.col("role") == "user") | (F.col("turn") % 3 == 0), F.col("text")).otherwise(" "))
    return readers.kept_position(x, "conv_id", "turn", "t").select("conv_id", "turn", "position")


@query("SELECT c_mktsegment AS split, 'c' || CAST(c_custkey AS VARCHAR) AS member, CASE WHEN c_custkey % 3 = 0 THEN '/f/c' || CAST(c_custkey AS VARCHAR) || '.csv' END AS path, c_custkey % 3 <> 0 AS missing FROM customer")
def s22_split_members(spark, d):
    c = table(spark, d, "customer")
    # a split is told over several manifests, none of them longer than a thousand members
    manifest = c.withColumn("m", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 1000)).agg(F.collect_list("m").alias("ms"))
    manifest = manifest.select(F.create_map("c_mktsegment", "ms").alias("splits"))
    files = readers.first_path_per_stem(c.where("c_custkey % 3 = 0").select(F.concat(F.lit("/f/c"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path")))
    return readers.members_with_files(readers.explode_splits(manifest), files)


_SCENES = "unnest([{'t': 'Scene', 'b': 0, 'e': length(text) // 2}, {'t': 'Nonscene', 'b': length(text) // 2, 'e': length(text)}])"


@query(f"""SELECT 'd' || CAST(doc_id AS VARCHAR) || '.xmi.zip' AS path, x.t AS scene_type, CAST(x.b AS INTEGER) AS begin, CAST(x.e AS INTEGER) AS "end" FROM (SELECT doc_id, {_SCENES} AS x FROM documents WHERE text IS NOT NULL) y""")
def s23_all_segments(spark, d):
    from ..sources.archives import xmi_rows

    return xmi_rows(_archives(spark, d), ()).where("kind = 'scene'").select("path", "scene_type", "begin", "end")


@query(f"WITH {PRED} SELECT slug, array_to_string(list(event_id ORDER BY coalesce(CASE WHEN idx % 7 <> 0 THEN idx END, 0), event_id), ',') AS ids FROM pr GROUP BY slug")
def s24_grouped_rows(spark, d):
    x = predictions(spark, d).withColumn("i", F.coalesce(F.when(F.col("idx") % 7 != 0, F.col("idx")), F.lit(0)))
    return x.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_id"))), lambda s: s["event_id"].cast("string")), ",").alias("ids"))


_S25 = """CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'x' || CAST(p_partkey AS VARCHAR) || '.txt' END WHEN p_size % 3 = 1 THEN 'm' || CAST(p_partkey AS VARCHAR) || '.txt'
WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'a' || CAST(p_partkey AS VARCHAR) || '.txt' ELSE 'b' || CAST(p_partkey AS VARCHAR) || '.txt' END"""


@query(f"SELECT p_partkey, {_S25} AS source, CASE WHEN ({_S25}) IS NULL THEN CASE WHEN p_size % 3 = 0 THEN 'missing file' ELSE 'no source' END END AS error FROM part")
def s25_resolve_source(spark, d):
    """Named files, manifests' first files and candidates, of which some aren't there."""
    x, size = table(spark, d, "part"), F.col("p_size")
    file = lambda c: F.concat(F.lit(c), F.col("p_partkey").cast("string"), F.lit(".txt"))
    x = x.select("p_partkey", "p_size", F.when(size % 3 == 0, file("x")).alias("explicit"), F.when(size % 3 == 1, file("m")).alias("manifest_first"), F.array(file("a"), file("b")).alias("candidates"))
    have = F.array_compact(F.array(F.when(size % 2 == 0, file("x")), file("m"), F.when((size % 5 > 0) & (size % 2 == 0), file("a")), F.when(size % 5 > 0, file("b"))))
    files = x.select(F.explode(have).alias("path"))
    return readers.resolve_source(x, files, ["p_partkey"]).select("p_partkey", "source", "error")


# -- sinks -------------------------------------------------------------------------------------------------

_DOCS = "SELECT doc_id, text, lang FROM documents"


@query(_DOCS)
def k1_atomic_json(spark, d):
    path = workspace(spark, "k1")
    sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id long, text string, lang string").json(path)


@query("SELECT doc_id, text, CAST(NULL AS VARCHAR) AS note FROM documents")
def k2_write_jsonl(spark, d):
    path = workspace(spark, "k2")
    sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("note")), path)
    return spark.read.schema("doc_id long, text string, note string").json(path)


@query(f"WITH {SEQ} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN pred THEN 'TRUE' ELSE 'FALSE' END AS pred FROM seq")
def k3_write_csv(spark, d):
    path = workspace(spark, "k3")
    sinks.write_csv(sequence(spark, d), path, ["event_id", "pred"])
    return readers.read_csv(spark, path)


@query(f"WITH {SEQ} SELECT CAST(doc AS VARCHAR) AS doc, count(*) AS n, 0 AS row_order FROM seq GROUP BY doc UNION ALL SELECT 'ALL', count(*), 1 FROM seq")
def k4_stats_with_total(spark, d):
    detail = sequence(spark, d).groupBy(F.col("doc").cast("string").alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.with_total(detail, detail.agg(F.sum("n").alias("n")), "doc")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, CASE WHEN lang = 'en' THEN 'TRUE' WHEN lang IS NOT NULL THEN 'FALSE' END AS english FROM documents")
def k5_sheet_text(spark, d):
    """Workbooks of all texts, with control characters that no workbook may hold, read again."""
    x = table(spark, d, "documents").select("doc_id", F.concat(F.char(F.lit(2)), "text").alias("text"), (F.col("lang") == "en").alias("english"))
    return workbooks.sheet_rows(workbooks.as_workbooks(x, rows=300), ["doc_id", "text", "english"]).drop("path", "row")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def k6_per_document(spark, d):
    path = workspace(spark, "k6")
    sinks.write_per_document(table(spark, d, "documents").select("doc_id", "lang"), path, "lang")
    return spark.read.option("header", True).csv(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SEQ}, e AS (SELECT doc, idx, CASE WHEN pred AND gold THEN 'TP' WHEN pred THEN 'FP' WHEN gold THEN 'FN' ELSE 'TN' END AS status, conf FROM seq)
SELECT CAST(doc AS VARCHAR) AS doc, CAST(idx AS VARCHAR) AS idx, status, CASE status WHEN 'TP' THEN 'C6EFCE' WHEN 'FP' THEN 'FFC7CE' WHEN 'FN' THEN 'FFEB9C' ELSE 'E7E6E6' END AS colour, CAST(conf AS DOUBLE) AS conf FROM e""")
def k7_reviewer_table(spark, d):
    """Reviewers' workbooks: rows with their status, coloured by it."""
    x = sequence(spark, d).select("doc", "idx", L.eval_status("pred", "gold").alias("status"), "conf")
    rows = workbooks.sheet_rows(workbooks.as_workbooks(x, fill_by="status", rows=2000), ["doc", "idx", "status", "conf"], fills=True)
    return rows.select("doc", "idx", "status", F.col("fills")[2].alias("colour"), F.col("conf").cast("double").alias("conf"))


@query("SELECT doc_id FROM documents")
def k8_append_log(spark, d):
    path, x = workspace(spark, "k8"), table(spark, d, "documents").select("doc_id")
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        sinks.append_log(x.where(part), path)
    return spark.read.schema("doc_id long").json(path)


@query(f"""WITH {SEQ}, r AS (SELECT doc, count(*) AS n, count(*) FILTER (WHERE pred) AS p, count(*) FILTER (WHERE gold) AS g FROM seq GROUP BY doc)
SELECT 0 AS part, unnest(['| doc | n | pred_borders | gold_borders | note |', '| --- | --- | --- | --- | --- |']) AS line UNION ALL SELECT 1, concat('| ', doc, ' | ', n, ' | ', p, ' | ', g, ' | a\\|b |') FROM r""")
def k9_report_table(spark, d):
    x = sequence(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if("pred").alias("pred_borders"), F.count_if("gold").alias("gold_borders"))
    path = workspace(spark, "k9")
    sinks.markdown_report(x.withColumn("note", F.lit("a|b")), ["doc"]).write.parquet(path)
    return spark.read.parquet(path)


def _files(spark, d):
    """A text file of each document, in folders by source."""
    return table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("/r/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")


_MANIFEST = "SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, octet_length(encode(text)) AS size_bytes, md5(text) AS md5, doc_id FROM documents WHERE text IS NOT NULL"


@query(f"SELECT name, path, size_bytes, md5 FROM ({_MANIFEST}) m")
def k10_build_manifest(spark, d):
    return sinks.build_manifest(_files(spark, d), "/r/")


@query(f"""SELECT CASE WHEN doc_id % 13 > 0 THEN name END AS name, CASE WHEN doc_id % 13 = 0 THEN 'missing name' WHEN doc_id % 11 = 0 THEN 'missing file' WHEN doc_id % 5 = 0 THEN 'size mismatch' ELSE 'md5 mismatch' END AS error
FROM ({_MANIFEST}) m WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0""")
def k11_verify_manifest(spark, d):
    """A manifest some of whose entries have no name, no file, another size or another sum."""
    have, n = _files(spark, d), F.col("doc_id")
    told = sinks.build_manifest(have).withColumn("doc_id", F.split_part("name", F.lit("."), F.lit(1)).cast("long"))
    told = told.select(
        F.when(n % 13 > 0, F.col("name")).alias("name"), (F.col("size_bytes") + F.when(n % 5 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(n % 7 == 0, "x").when(n % 3 > 0, F.col("md5")).alias("md5")
    )
    return sinks.verify_manifest(told, sinks.build_manifest(have.where("doc_id % 11 > 0")))


_COMMAND_FILE = """'run --size=' || CAST(p_size AS VARCHAR) || ' ''' || p_type || ' x''' || chr(10)"""
_CONFIG_FILE = """concat('{', chr(10), '  "brand": "', p_brand, '",', chr(10), '  "none": null,', chr(10), '  "size": ', p_size, chr(10), '}', chr(10))"""


@query(f"SELECT p_partkey, {_COMMAND_FILE} AS command, {_CONFIG_FILE} AS config FROM part")
def k12_repro_files(spark, d):
    words = F.array(F.lit("run"), F.concat(F.lit("--size="), F.col("p_size").cast("string")), F.concat("p_type", F.lit(" x")))
    command, config = sinks.repro_files(words, size="p_size", brand="p_brand", none=F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", command.alias("command"), config.alias("config"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def k13_unchanged(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.md5("text").alias("md5"))
    known = files.where("doc_id % 3 <> 0").select("name", "md5").unionByName(files.where("doc_id % 3 = 0").select("name", F.lit("old").alias("md5")))
    return sinks.unchanged(files, known).select("doc_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer WHERE c_acctbal > 9500")
def k14_outlier_csv(spark, d):
    path = workspace(spark, "k14")
    sinks.write_csv(table(spark, d, "customer").where("c_acctbal > 9500").select("c_custkey", "c_acctbal"), path)
    return readers.read_csv(spark, path)


@query(f"WITH {PRED} SELECT key, 'NOBORDER' AS label, 'auto' AS reason FROM pr WHERE NOT parse_ok")
def k15_patch_export(spark, d):
    path = workspace(spark, "k15")
    x = predictions(spark, d).where("not parse_ok").select("key", F.lit("NOBORDER").alias("label"), F.lit("auto").alias("reason"))
    sinks.write_csv(x.na.fill(""), path)
    return readers.read_overrides(spark, path)


@query("SELECT p_brand AS family, avg(p_retailprice) AS f1, CAST(row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_brand) AS INTEGER) AS rank FROM part GROUP BY p_brand")
def k16_family_comparison(spark, d):
    path = workspace(spark, "k16")
    x = table(spark, d, "part").groupBy(F.col("p_brand").alias("family")).agg(F.avg("p_retailprice").alias("f1"))
    ranges.rank(x, [-F.col("f1"), "family"]).write.parquet(path)
    return spark.read.parquet(path)
