"""Queries on model outputs: parsing, action scores, text scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions import parsing as G, text as X
from gridloom.operators import bleu as L, curation as C, evaluate as E, passes as P
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import Fixtures

# --------------------------------------------------------------------------- actions


@query("action_confusion", "SELECT gold_action, pred_action, count(*) AS n FROM fx_actions GROUP BY 1, 2", "fx_actions")
def action_confusion(fx):
    return E.action_confusion(fx.actions())


@query("action_accuracy", """
SELECT count(*) AS n, count(*) FILTER (gold_action = pred_action) AS n_correct, count(*) FILTER (pred_action = '<unparseable>') AS n_unparseable,
  count(*) FILTER (pred_action = 'abort') AS n_invalid, round(avg((gold_action = pred_action)::int), 6) AS accuracy FROM fx_actions""", "fx_actions")
def action_accuracy(fx):
    return E.action_accuracy(fx.actions()).withColumn("accuracy", F.round("accuracy", 6))


@query("per_class_scores", """
SELECT g.a AS action, round(coalesce(t.n, 0) / cast(p.n AS double), 6) AS precision, round(coalesce(t.n, 0) / cast(g.n AS double), 6) AS recall, g.n AS support
FROM (SELECT gold_action AS a, count(*) AS n FROM fx_actions GROUP BY 1) g
LEFT JOIN (SELECT pred_action AS a, count(*) AS n FROM fx_actions GROUP BY 1) p USING (a)
LEFT JOIN (SELECT gold_action AS a, count(*) AS n FROM fx_actions WHERE gold_action = pred_action GROUP BY 1) t USING (a)""", "fx_actions")
def per_class_scores(fx):
    return E.per_class(fx.actions()).select("action", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


@query("action_reward", "SELECT gold_action, round(avg((gold_action = pred_action)::int), 6) AS reward FROM fx_actions GROUP BY 1", "fx_actions")
def action_reward(fx):
    r = E.action_reward(F.col("pred_action"), F.col("gold_action"))
    return fx.actions().groupBy("gold_action").agg(F.round(F.avg(r), 6).alias("reward"))


@query("class_distribution", "SELECT gold_action, count(*) AS n FROM fx_actions GROUP BY 1", "fx_actions")
def class_distribution(fx):
    return E.class_distribution(fx.actions(), ["gold_action"], "count")


@query("join_predictions", """
SELECT tile_id, gold_action, CASE WHEN tile_id % 5 = 0 THEN '<unparseable>' ELSE pred_action END AS pred_action FROM fx_actions""", "fx_actions")
def join_predictions(fx):
    a = fx.actions()
    answered = a.filter(F.col("tile_id") % 5 != 0).select("tile_id", "pred_action")
    return E.join_predictions(a.select("tile_id", "gold_action"), answered)


@query("running_accuracy", """
SELECT tile_id, round(avg((gold_action = pred_action)::int) OVER (ORDER BY tile_id), 6) AS accuracy FROM fx_actions""", "fx_actions")
def running_accuracy(fx):
    hit = F.when(F.col("gold_action") == F.col("pred_action"), 1).otherwise(0)
    out = E.running_ratio(fx.actions(), ["tile_id"], F.floor(F.col("tile_id") / 1024), hit, F.lit(1), "accuracy")
    return out.select("tile_id", F.round("accuracy", 6).alias("accuracy"))


@query("tool_mapping", """
SELECT gold_action AS tool, CASE gold_action WHEN 'downlink_now' THEN 'downlink' WHEN 'flag_for_review' THEN 'flag'
  WHEN 'request_neighbor_tile' THEN 'request_neighbor' WHEN 'request_higher_resolution' THEN 'request_hires' ELSE 'discard' END AS action,
  gold_action AS back, count(*) AS n FROM fx_actions GROUP BY 1, 2, 3""", "fx_actions")
def tool_mapping(fx):
    action = X.tool_to_action(F.col("gold_action"))
    return fx.actions().select(F.col("gold_action").alias("tool"), action.alias("action"), X.action_to_tool(action).alias("back")).groupBy(
        "tool", "action", "back"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("restricted_tools", """
SELECT gold_action, count(*) AS n FROM fx_actions WHERE gold_action IN ('discard', 'flag_for_review', 'downlink_now') GROUP BY 1""", "fx_actions")
def restricted_tools(fx):
    return P.restrict_actions(fx.actions(), column="gold_action").groupBy("gold_action").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- parsers

_TOOLS = """
SELECT event_id, CASE WHEN long THEN 'discard' ELSE action END AS action, CASE WHEN long THEN 'discard' ELSE tool END AS tool,
  CASE WHEN long THEN repeat('x', 1000000) ELSE reason END AS reason, CASE WHEN NOT long THEN direction END AS direction,
  CASE WHEN long THEN 'ok' ELSE outcome END AS outcome
FROM fx_calls"""


@query("parse_tool_calls", _TOOLS, "fx_calls")
def parse_tool_calls(fx):
    return G.parse_tool_calls(fx.call_outputs(), "raw").select("event_id", "action", "tool", "reason", "direction", "outcome")


@query("parse_outcomes", f"SELECT outcome, count(*) AS n FROM ({_TOOLS}) GROUP BY 1", "fx_calls")
def parse_outcomes(fx):
    return G.parse_outcomes(G.parse_tool_calls(fx.call_outputs(), "raw"))


# Bare calls end at the first closing bracket, so what nests or has one in its text is cut there.
@query("lenient_tools", r"""
SELECT event_id, CASE WHEN long OR event_id % 3 <> 0 THEN CASE WHEN long THEN 'discard' WHEN outcome = 'unparseable' THEN '<unparseable>' WHEN outcome = 'no_tool_call' THEN
    CASE WHEN regexp_matches(raw, '\w\(') THEN 'discard' ELSE '<no_call>' END ELSE tool END
  WHEN NOT regexp_matches(body, '\w+\s*\([^)]*\)') THEN '<no_call>'
  WHEN contains(body, '"broken') OR contains(body, 'reason=''a'', ') OR contains(body, 'len(x)') OR contains(body, '(3,)') OR contains(body, '(and)') OR contains(body, '[[[[') AND NOT contains(body, ']]]]')
    THEN '<unparseable>'
  ELSE regexp_extract(body, '(\w+)\s*\([^)]*\)', 1) END AS tool
FROM (SELECT *, split_part(replace(replace(raw, '<|tool_call_start|>', ''), '<|tool_call_end|>', '<|im_end|>'), '<|im_end|>', 1) AS body FROM fx_calls)""", "fx_calls")
def lenient_tools(fx):
    bare = F.replace(F.replace("raw", F.lit("<|tool_call_start|>"), F.lit("")), F.lit("<|tool_call_end|>"), F.lit("<|im_end|>"))
    raw = fx.call_outputs().withColumn("raw", F.when(F.col("event_id") % 3 == 0, bare).otherwise(F.col("raw")))
    return raw.select("event_id", G.lenient_tool(F.col("raw")).alias("tool"))


@query("parse_json_actions", """
SELECT event_id, CASE event_id % 8 WHEN 5 THEN 'flag' ELSE 'discard' END AS action,
  CASE event_id % 8 WHEN 5 THEN 'flag' WHEN 6 THEN '(invalid_action:explode)' ELSE '(no_json)' END AS tool,
  CASE event_id % 8 WHEN 5 THEN 'small' WHEN 6 THEN 'agent emitted unknown action ''explode''; default discard' ELSE 'agent emitted no JSON object; default discard' END AS reason,
  CASE event_id % 8 WHEN 5 THEN 'ok' WHEN 6 THEN 'invalid_action' ELSE 'no_json' END AS outcome
FROM fx_raw_outputs""", "fx_raw_outputs")
def parse_json_actions(fx):
    return G.parse_json_actions(fx.raw_outputs(), "raw").select("event_id", "action", "tool", "reason", "outcome")


@query("parse_json_eval", r"""
SELECT event_id, CASE WHEN span = '' OR NOT json_valid(span) THEN '<unparseable>' ELSE coalesce(json_extract_string(CASE WHEN json_valid(span) THEN span END, '$.action'), '<no_action_field>') END AS action
FROM (SELECT event_id, regexp_extract(props || raw, '(?s)\{.*\}', 0) AS span FROM (
  SELECT e.event_id, CASE WHEN e.event_id % 5 = 0 THEN e.props ELSE '' END AS props, CASE WHEN e.event_id % 5 IN (0, 1) AND e.event_id % 8 <> 6 THEN '' ELSE r.raw END AS raw
  FROM events e JOIN fx_raw_outputs r USING (event_id)))""", "fx_raw_outputs")
def parse_json_eval(fx):
    k = F.col("event_id")
    texts = fx.table("events").select("event_id", "props").join(fx.raw_outputs(), "event_id").select(
        "event_id",
        F.concat(
            F.when(k % 5 == 0, F.col("props")).otherwise(""),
            F.when((k % 5).isin(0, 1) & (k % 8 != 6), "").otherwise(F.col("raw")),
        ).alias("t"),
    )
    return G.parse_json_actions(texts, "t", "eval").select("event_id", "action")


_ANSWERS = """
WITH raw AS (SELECT l_orderkey AS tile_id, l_partkey AS k, cast(l_partkey % 96 AS double) AS x, cast(l_suppkey % 96 AS double) AS y,
  CASE WHEN l_linenumber = 7 THEN cast(l_partkey % 96 AS double) ELSE cast(l_partkey % 96 AS double) + l_quantity END AS xx,
  l_orderkey % 9 IN (2, 5, 6, 7, 8) AS readable FROM lineitem),
rows AS (SELECT *, row_number() OVER () AS row_no, CASE WHEN k % 7 = 0 THEN 'number' WHEN k % 11 = 0 THEN 'note' WHEN k % 13 = 0 THEN 'short' WHEN k % 17 = 0 THEN 'word' ELSE 'box' END AS kind FROM raw),
items AS (SELECT row_no, tile_id, readable, 'box' AS kind, x / 128e0 AS x1, y / 128e0 AS y1, xx / 128e0 AS x2, (y + 1e0 + cast(k % 40 AS double)) / 128e0 AS y2 FROM rows
  UNION ALL SELECT row_no, tile_id, readable, kind, (x + 8e0) / 128e0, y / 128e0, (xx + 8e0) / 128e0, (y + 1e0 + cast(k % 40 AS double)) / 128e0 FROM rows),
clamped AS (SELECT row_no, tile_id, readable, kind, greatest(0e0, least(1e0, x1)) AS x1, greatest(0e0, least(1e0, y1)) AS y1, greatest(0e0, least(1e0, x2)) AS x2, greatest(0e0, least(1e0, y2)) AS y2 FROM items),
good AS (SELECT * FROM clamped WHERE kind = 'box' AND readable AND x2 > x1 AND y2 > y1),
"""


@query("parse_boxes_strict", _ANSWERS + """
per AS (SELECT tile_id, count(*) AS n, sum((x2 - x1) * (y2 - y1)) AS area FROM good GROUP BY 1)
SELECT t.tile_id, coalesce(n, 0) AS n_boxes, round(coalesce(area, 0), 6) AS area FROM (SELECT DISTINCT tile_id FROM raw) t LEFT JOIN per USING (tile_id)""")
def parse_boxes_strict(fx):
    out = G.parse_boxes(fx.answers(), "answer", "strict")
    area = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
    return out.groupBy("tile_id").agg(F.sum("n_boxes").alias("n_boxes"), F.round(F.sum(area), 6).alias("area"))


@query("parse_boxes_perception", _ANSWERS + """
per AS (SELECT row_no, tile_id, bool_or(kind = 'word') AS broken, count(*) FILTER (kind = 'box') AS n, sum(x1) FILTER (kind = 'box') AS sx FROM items WHERE readable GROUP BY 1, 2),
tot AS (SELECT tile_id, sum(CASE WHEN broken THEN 0 ELSE n END) AS n, sum(CASE WHEN broken THEN 0e0 ELSE sx END) AS sx FROM per GROUP BY 1)
SELECT t.tile_id, cast(coalesce(n, 0) AS bigint) AS n_boxes, round(coalesce(sx, 0e0), 6) AS sum_x1 FROM (SELECT DISTINCT tile_id FROM raw) t LEFT JOIN tot USING (tile_id)""")
def parse_boxes_perception(fx):
    out = G.parse_boxes(fx.answers(), "answer", "perception")
    sum_x1 = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["x1"])
    return out.groupBy("tile_id").agg(F.sum("n_boxes").alias("n_boxes"), F.round(F.sum(sum_x1), 6).alias("sum_x1"))


@query("parse_boxes_lenient", _ANSWERS + """
zz AS (SELECT 1)
SELECT tile_id, cast(sum(CASE WHEN tile_id % 9 IN (0, 1) THEN 0 WHEN tile_id % 9 IN (3, 4) THEN (kind = 'box')::int ELSE (kind IN ('box', 'short', 'word'))::int END) AS bigint) AS n_boxes FROM items GROUP BY 1""")
def parse_boxes_lenient(fx):
    return G.parse_boxes(fx.answers(), "answer", "lenient").groupBy("tile_id").agg(F.sum("n_boxes").alias("n_boxes"))


@query("output_hygiene", _ANSWERS + """
per AS (SELECT row_no, count(*) AS n FROM good GROUP BY 1)
SELECT count(*) FILTER (tile_id % 9 = 1) AS n_unparseable, count(*) FILTER (coalesce(n, 0) = 0 AND tile_id % 3 <> 0) AS empty_on_negative,
  count(*) FILTER (coalesce(n, 0) = 0 AND tile_id % 3 = 0) AS empty_on_positive, count(*) AS n, count(*) FILTER (tile_id % 9 <> 1) AS n_parseable
FROM rows LEFT JOIN per USING (row_no)""")
def output_hygiene(fx):
    out = G.parse_boxes(fx.answers(), "answer", "strict")
    bad, truth = G.is_unparseable(F.col("answer"), F.col("n_boxes")), F.col("tile_id") % 3 == 0
    listed = G.is_parseable_list(F.col("answer"), F.col("n_boxes"))
    return E.hygiene(out.withColumn("_all", F.lit(1)), bad, F.col("n_boxes"), truth, ["_all"], listed).drop("_all")


# --------------------------------------------------------------------------- text scores

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _tok13a(c: str) -> str:
    t = f"replace(replace(replace(replace(replace(replace(replace({c}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    t = f"' ' || {t} || ' '"
    for pattern, put in L.RULES:
        pattern = pattern.replace("'", "''")
        put = put.replace("$1", r"\1").replace("$2", r"\2")
        t = f"regexp_replace({t}, '{pattern}', '{put}', 'g')"
    return t


def _bleu_sql(key: str, group: str, tok) -> str:
    """BLEU of fx_pairs by whitespace-split tokens of ``tok``."""
    grams = " UNION ALL ".join(
        f"SELECT k, grp, side, {n} AS n, array_to_string(w[i:i+{n - 1}], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM toks WHERE len(w) >= {n})"
        for n in range(1, 5)
    )
    return f"""
, toks AS (SELECT {key} AS k, {group} AS grp, side, list_filter(regexp_split_to_array(t, '{_WS}'), lambda z: z <> '') AS w FROM (
  SELECT *, 'p' AS side, {tok('pred')} AS t FROM fx_pairs UNION ALL SELECT *, 'g' AS side, {tok('gold')} AS t FROM fx_pairs)),
grams AS ({grams}),
counts AS (SELECT k, grp, n, gram, count(*) FILTER (side = 'p') AS cp, count(*) FILTER (side = 'g') AS cg FROM grams GROUP BY 1, 2, 3, 4),
sums AS (SELECT grp, n, sum(least(cp, cg)) AS correct, sum(cp) AS total, sum(cg) AS gold FROM counts GROUP BY 1, 2),
prec AS (SELECT *, CASE WHEN total = 0 THEN 0e0 WHEN correct = 0 THEN 100e0 / (pow(2, sum((correct = 0)::int) OVER (PARTITION BY grp ORDER BY n)) * total)
  ELSE 100e0 * correct / total END AS p FROM sums),
score AS (SELECT grp, max(p) FILTER (n = 1) AS p1, max(p) FILTER (n = 2) AS p2, max(p) FILTER (n = 3) AS p3, max(p) FILTER (n = 4) AS p4,
  max(total) FILTER (n = 1) AS pl, max(gold) FILTER (n = 1) AS gl FROM prec GROUP BY 1)
SELECT grp, round(CASE WHEN least(p1, p2, p3, p4) > 0 THEN (CASE WHEN pl >= gl THEN 1e0 ELSE exp(1e0 - gl / cast(pl AS double)) END) * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0e0 END, 4) AS bleu,
  round(p1, 4) AS p1, round(p4, 4) AS p4 FROM score"""


def _rounded(df: DataFrame, group: str) -> DataFrame:
    return df.select(F.col(group).alias("grp"), *[F.round(c, 4).alias(c) for c in ("bleu", "p1", "p4")])


@query("corpus_bleu", ", fx_pairs AS (SELECT * FROM fx_text_pairs)" + _bleu_sql("doc_id", "lang", _tok13a), "fx_text_pairs")
def corpus_bleu(fx):
    return _rounded(L.corpus_bleu(fx.text_pairs(), "doc_id", "pred", "gold", ["lang"]), "lang")


@query("corpus_bleu_whitespace", ", fx_pairs AS (SELECT *, 'all' AS every FROM fx_text_pairs)" + _bleu_sql("doc_id", "every", lambda c: c), "fx_text_pairs")
def corpus_bleu_whitespace(fx):
    out = L.corpus_bleu(fx.text_pairs(), "doc_id", "pred", "gold", tokenize="none")
    return _rounded(out.withColumn("every", F.lit("all")), "every")


@query("turn_bleu_first_rows", """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM conversations),
fx_pairs AS (SELECT conv_id * 1000 + turn AS k, role, text AS gold, lower(text) AS pred FROM ranked WHERE rn <= 300)""" + _bleu_sql("k", "role", _tok13a), "fx_actions")
def turn_bleu_first_rows(fx):
    """BLEU over the first 300 turns of each role: the report's own row limit."""
    first = C.first_rows(fx.table("conversations"), ["role"], ["conv_id", "turn"], 300)
    pairs = first.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "role", F.col("text").alias("gold"), F.lower("text").alias("pred"))
    return _rounded(L.corpus_bleu(pairs, "k", "pred", "gold", ["role"]), "role")


@query("empty_outputs", """
SELECT lang, count(*) FILTER (trim(replace(pred, chr(10), ' ')) = '') AS n_empty, count(*) AS n_pairs FROM (
  SELECT lang, CASE WHEN doc_id % 10 = 0 THEN ' ' || chr(10) ELSE pred END AS pred FROM fx_text_pairs) GROUP BY 1""", "fx_text_pairs")
def empty_outputs(fx):
    blanked = fx.text_pairs().withColumn("pred", F.when(F.col("doc_id") % 10 == 0, " \n").otherwise(F.col("pred")))
    return L.empty_counts(blanked, "pred", ["lang"])


@query("prompt_tasks", f"""
SELECT conv_id, turn, CASE WHEN contains(t, 'Provide result as a valid JSON') OR (contains(lower(t), 'detect') AND contains(lower(t), 'bbox')) THEN 'grounding'
  WHEN contains(lower(t), 'describe') THEN 'description' END AS task,
  CASE WHEN starts_with(t, '{{"action"') THEN 'action' WHEN starts_with(t, '[') OR contains(t, 'bbox') THEN 'grounding' ELSE 'description' END AS target_task
FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '{K.GROUNDING_PROMPT}' WHEN turn % 4 = 1 THEN '{K.DESCRIPTION_PROMPT}' WHEN turn % 4 = 2 THEN '{{"action": "' || role || '"}}'
  ELSE text END AS t FROM conversations)""")
def prompt_tasks(fx):
    turn = F.col("turn") % 4
    t = F.when(turn == 0, K.GROUNDING_PROMPT).when(turn == 1, K.DESCRIPTION_PROMPT).when(
        turn == 2, F.concat(F.lit('{"action": "'), F.col("role"), F.lit('"}'))
    ).otherwise(F.col("text"))
    staged = fx.table("conversations").select("conv_id", "turn", t.alias("t"))
    return staged.select("conv_id", "turn", X.task_of_prompt(F.col("t")).alias("task"), X.task_of_target(F.col("t")).alias("target_task"))
