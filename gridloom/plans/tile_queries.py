"""Queries on boxes, passes, decisions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions import boxes as B, text as X
from gridloom.functions.numbers import clamp_cloud_cover
from gridloom.operators import budget as U, evaluate as E, matching as M, passes as P
from gridloom.operators.detect import detect
from gridloom.operators.ranking import seq_block
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import Fixtures
from gridloom.plans.oracle_views import iou
from gridloom.sources.files import policy_markdown, policy_rows, write_json, write_policy_csv
from gridloom.session import cut_lineage, scratch_path, settle
from gridloom.streaming import events as S


def valid(fx: Fixtures) -> DataFrame:
    """Clamped boxes with extent and enough area."""
    c = B.clamp_box(F.struct(*B.CORNERS))
    kept = ("tile_id", "year", "line", "ord")
    clamped = fx.boxes().select(*kept, c.alias("_b")).select(*kept, "_b.*")
    b = F.struct(*B.CORNERS)
    return clamped.filter(B.is_valid_box(b) & (B.box_area(b) >= K.MIN_BOX_AREA))


def detected(fx: Fixtures) -> DataFrame:
    """Tiles with box count, largest area and confidence after suppression.

    Accounts read their input twice, so the suppressed boxes are settled in the shared folder first.
    """
    kept = M.nms_table(valid(fx), "ord")
    found = kept.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_boxes"), F.max(B.box_area(F.struct(*B.CORNERS))).alias("max_area")
    )
    return (
        fx.tiles().join(cut_lineage(found), "tile_id", "left").fillna(0, ["n_boxes"]).fillna(0.0, ["max_area"])
        .withColumn("confidence", B.confidence(F.col("n_boxes"), F.col("max_area")))
    )


def decided(fx: Fixtures) -> DataFrame:
    return detected(fx).withColumn("action", P.threshold_action(F.col("confidence"))["action"]).withColumn(
        "description", F.concat(F.col("n_boxes").cast("string"), F.lit(" boxes on tile "), F.col("tile_id").cast("string"))
    )


def _box_no(df: DataFrame) -> DataFrame:
    return df.select("tile_id", "ord.l_linenumber", "ord.l_partkey", *[F.round(c, 6).alias(c) for c in B.CORNERS])


@query("valid_boxes", """
SELECT tile_id, year, count(*) AS n_boxes, round(sum((x2 - x1) * (y2 - y1)), 6) AS area, round(min(x1), 6) AS x1, round(max(y2), 6) AS y2
FROM fx_valid GROUP BY 1, 2""", "fx_valid")
def valid_boxes(fx):
    return valid(fx).groupBy("tile_id", "year").agg(
        F.count(F.lit(1)).alias("n_boxes"), F.round(F.sum(B.box_area(F.struct(*B.CORNERS))), 6).alias("area"),
        F.round(F.min("x1"), 6).alias("x1"), F.round(F.max("y2"), 6).alias("y2"),
    )


@query("nms_boxes", "SELECT tile_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM fx_kept", "fx_kept")
def nms_boxes(fx):
    return M.nms_table(valid(fx), "ord").select("tile_id", *[F.round(c, 6).alias(c) for c in B.CORNERS])


@query("nms_boxes_crowded", "SELECT tile_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM fx_kept", "fx_kept")
def nms_boxes_crowded(fx):
    """The sweep that crowded tiles take, forced for all tiles of more than five boxes."""
    return M.nms_table(valid(fx), "ord", max_array=5).select("tile_id", *[F.round(c, 6).alias(c) for c in B.CORNERS])


@query("box_geometry", """
SELECT tile_id, box_no, round((x2 - x1) * (y2 - y1), 6) AS area, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy,
  CASE WHEN h = 'center' AND v = 'middle' THEN 'center of the scene' WHEN h = 'center' THEN v || ' portion of the scene'
       WHEN v = 'middle' THEN h || ' side of the scene' ELSE v || '-' || h || ' quadrant' END AS region,
  CASE WHEN a < 0.01e0 THEN 'very small' WHEN a < 0.04e0 THEN 'small' WHEN a < 0.15e0 THEN 'moderate' WHEN a < 0.40e0 THEN 'large' ELSE 'very large' END AS size
FROM (SELECT *, greatest((x2 - x1) * (y2 - y1), 0e0) AS a,
  CASE WHEN (x1 + x2) / 2 < 0.33e0 THEN 'left' WHEN (x1 + x2) / 2 > 0.67e0 THEN 'right' ELSE 'center' END AS h,
  CASE WHEN (y1 + y2) / 2 < 0.33e0 THEN 'upper' WHEN (y1 + y2) / 2 > 0.67e0 THEN 'lower' ELSE 'middle' END AS v FROM fx_valid)""", "fx_valid")
def box_geometry(fx):
    b = F.struct(*B.CORNERS)
    c = B.box_centroid(b)
    ranked = P.block_rank(fx.boxes(), ["tile_id"], ["ord"], F.col("ord.l_linenumber"), "box_no")
    clamped = ranked.select("tile_id", "box_no", B.clamp_box(b).alias("_b")).select("tile_id", "box_no", "_b.*")
    return clamped.filter(B.is_valid_box(b) & (B.box_area(b) >= K.MIN_BOX_AREA)).select(
        "tile_id", "box_no", F.round(B.box_area(b), 6).alias("area"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"),
        X.box_region(b).alias("region"), X.size_category(b).alias("size"),
    )


@query("tile_confidence", """
SELECT tile_id, n_boxes, round(max_area, 6) AS max_area, round(confidence, 6) AS confidence,
  round(CASE WHEN n_boxes = 0 THEN 0e0 ELSE least(0.95e0, 0.4e0 + 0.15e0 * n_boxes) END, 6) AS eval_confidence FROM fx_conf""", "fx_conf")
def tile_confidence(fx):
    return detected(fx).select(
        "tile_id", "n_boxes", F.round("max_area", 6).alias("max_area"), F.round("confidence", 6).alias("confidence"),
        F.round(B.confidence_eval(F.col("n_boxes")), 6).alias("eval_confidence"),
    )


@query("array_confidence", """
SELECT tile_id, coalesce(n, 0) AS n_boxes, round(CASE WHEN n IS NULL THEN 0e0 ELSE least(1e0, 0.5e0 + 0.2e0 * n + a * 1.5e0) END, 6) AS confidence
FROM (SELECT o_orderkey AS tile_id FROM orders) LEFT JOIN (SELECT tile_id, count(*) AS n, max((x2 - x1) * (y2 - y1)) AS a FROM fx_nkept GROUP BY 1) USING (tile_id)""", "fx_nkept")
def array_confidence(fx):
    """Validation, suppression and confidence as array functions on nested detections."""
    kept = fx.detections().select("tile_id", B.nms(B.valid_boxes(F.col("raw"), True, K.MIN_BOX_AREA)).alias("boxes"))
    return kept.select("tile_id", F.size("boxes").cast("long").alias("n_boxes"), F.round(B.confidence_from_boxes(F.col("boxes")), 6).alias("confidence"))


@query("threshold_actions", """
SELECT tile_id, action, CASE action WHEN 'downlink' THEN 'high-confidence detection within budget'
  WHEN 'flag' THEN 'moderate-confidence detection; flagged for end-of-pass review' ELSE 'below threshold' END AS reason,
  CASE action WHEN 'downlink' THEN 'downlink_now' WHEN 'flag' THEN 'flag_for_review' ELSE 'discard' END AS tool FROM fx_decided""", "fx_decided")
def threshold_actions(fx):
    t = P.threshold_action(F.col("confidence"))
    return detected(fx).select("tile_id", t["action"].alias("action"), t["reason"].alias("reason")).withColumn(
        "tool", X.action_to_tool(F.col("action"))
    )


@query("pass_ledger", """
SELECT pass_id, seq, tile_id, action, used_kb, remaining_kb, cast(floor(used_before / 80) AS bigint) AS prior_downlinked FROM fx_ledger""", "fx_ledger")
def pass_ledger(fx):
    return P.ledger(decided(fx), F.col("action")).select("pass_id", "seq", "tile_id", "action", "used_kb", "remaining_kb", "prior_downlinked")


_FIT = """
SELECT pass_id, seq, tile_id, CASE WHEN action = 'downlink' AND run > 6 THEN 'discard' ELSE action END AS action,
  cast(80 * least(run, 6) AS bigint) AS used_kb, cast(512 - 80 * least(run, 6) AS bigint) AS remaining_kb
FROM (SELECT *, sum(CASE WHEN action = 'downlink' THEN 1 ELSE 0 END) OVER (PARTITION BY pass_id ORDER BY seq) AS run FROM fx_decided)"""


@query("fit_ledger", _FIT, "fx_decided")
def fit_ledger(fx):
    return P.ledger(decided(fx), F.col("action"), check_fit=True).select("pass_id", "seq", "tile_id", "action", "used_kb", "remaining_kb")


@query("fit_ledger_blocks", _FIT, "fx_decided")
def fit_ledger_blocks(fx):
    """The same account with blocks of four tiles, so every pass spans several blocks."""
    return P.ledger(decided(fx), F.col("action"), check_fit=True, block=4).select("pass_id", "seq", "tile_id", "action", "used_kb", "remaining_kb")


@query("cost_ledger", """
, tiles AS (SELECT *, CASE WHEN action = 'downlink' THEN 30 + 25 * (tile_id % 7) ELSE 0 END AS cost FROM fx_decided),
replay AS (
  SELECT pass_id, seq, tile_id, action, cost, 512 AS found FROM tiles WHERE seq = 1
  UNION ALL
  SELECT t.pass_id, t.seq, t.tile_id, t.action, t.cost, CASE WHEN r.cost <= r.found THEN r.found - r.cost ELSE r.found END
  FROM replay r JOIN tiles t ON t.pass_id = r.pass_id AND t.seq = r.seq + 1)
SELECT pass_id, seq, tile_id, CASE WHEN cost > found THEN 'discard' ELSE action END AS action, cost AS cost_kb,
  found - CASE WHEN cost <= found THEN cost ELSE 0 END AS remaining_kb, 512 - found + CASE WHEN cost <= found THEN cost ELSE 0 END AS used_kb FROM replay""", "fx_decided")
def cost_ledger(fx):
    """Downlinks of seven sizes, with blocks of four tiles, so every pass spans several."""
    out = U.cost_ledger(decided(fx), F.col("action"), F.lit(30) + 25 * (F.col("tile_id") % 7), block=4)
    return out.select("pass_id", "seq", "tile_id", "action", "cost_kb", "remaining_kb", "used_kb")


@query("pass_summary", """
SELECT pass_id, count(*) AS tiles_processed, count(*) FILTER (action = 'flag') AS tiles_flagged, count(*) FILTER (action = 'downlink') AS tiles_downlinked,
  count(*) FILTER (action NOT IN ('flag', 'downlink')) AS tiles_discarded, max(used_kb) AS bandwidth_used_kb, min(remaining_kb) AS bandwidth_remaining_kb,
  coalesce(array_to_string(list_slice(list(description ORDER BY seq) FILTER (action IN ('flag', 'downlink')), 1, 10), '; '), '') AS flagged
FROM fx_ledger GROUP BY pass_id""", "fx_ledger")
def pass_summary(fx):
    return P.pass_summary(P.ledger(decided(fx), F.col("action"))).withColumn("flagged", F.array_join("flagged_summary", "; ")).drop("flagged_summary")


_COMPARE = """
, wants AS (
  SELECT *, 'send_everything' AS policy, 'downlink' AS want FROM fx_conf
  UNION ALL SELECT *, 'threshold', CASE WHEN confidence >= 0.85e0 THEN 'downlink' WHEN confidence >= 0.65e0 THEN 'flag' ELSE 'discard' END FROM fx_conf
  UNION ALL SELECT *, 'random', ['downlink', 'flag', 'discard'][cast(('0x' || substr(md5('42|' || tile_id), 1, 8)) AS bigint) % 3 + 1] FROM fx_conf
  UNION ALL SELECT *, 'model', CASE WHEN image_available AND n_boxes >= 3 THEN 'downlink' WHEN n_boxes >= 1 AND image_available THEN 'flag' ELSE 'discard' END FROM fx_conf),
runs AS (SELECT *, sum(CASE WHEN want = 'downlink' THEN 1 ELSE 0 END) OVER (PARTITION BY policy, pass_id ORDER BY seq) AS run FROM wants),
res AS (SELECT policy, count(*) FILTER (want = 'downlink' AND run <= 6) AS tiles_downlinked,
  count(*) FILTER (want = 'downlink' AND run <= 6 AND tile_id % 3 = 0) AS pits_captured, count(*) FILTER (tile_id % 3 = 0) AS pits_total FROM runs GROUP BY policy)
"""


def _compared(fx: Fixtures) -> DataFrame:
    model = F.when(F.col("image_available") & (F.col("n_boxes") >= 3), "downlink").when(
        (F.col("n_boxes") >= 1) & F.col("image_available"), "flag"
    ).otherwise("discard")
    tiles = detected(fx).withColumn("has_pit", F.col("tile_id") % 3 == 0).withColumn("decided_action", model)
    return P.compare_policies(
        tiles,
        {
            "send_everything": P.send_everything, "random": P.random_policy(), "threshold": P.threshold_policy,
            "model": P.decided_policy(),
        },
    )


@query("policy_comparison", _COMPARE + """
SELECT policy, tiles_downlinked, pits_captured, pits_total, tiles_downlinked * 80 AS kb_used,
  round(CASE WHEN tiles_downlinked > 0 THEN pits_captured / (tiles_downlinked * 80e0) ELSE 0e0 END, 8) AS pits_per_kb FROM res""", "fx_conf")
def policy_comparison(fx):
    return _compared(fx).withColumn("pits_per_kb", F.round("pits_per_kb", 8))


@query("policy_report_files", _COMPARE + """
SELECT policy, cast(tiles_downlinked AS varchar) AS tiles_downlinked, cast(tiles_downlinked * 80 AS varchar) AS bytes_used_kb,
  printf('%.6f', CASE WHEN tiles_downlinked > 0 THEN pits_captured / (tiles_downlinked * 80e0) ELSE 0e0 END) AS pits_per_kb,
  '| ' || policy || ' | ' || tiles_downlinked || ' | ' || pits_captured || ' of ' || pits_total || ' | ' || tiles_downlinked * 80 || ' KB | '
  || printf('%.4f', CASE WHEN tiles_downlinked > 0 THEN pits_captured / (tiles_downlinked * 80e0) ELSE 0e0 END) || ' |' AS line FROM res""", "fx_conf")
def policy_report_files(fx):
    """Written as CSV, read back, joined to the Markdown lines."""
    results = _compared(fx)
    path = scratch_path(fx.spark, "policies")
    write_policy_csv(results, path)
    schema = ", ".join(f"{c} string" for c in policy_rows(results).columns)
    back = fx.spark.read.csv(path, header=True, schema=schema)
    return back.select("policy", "tiles_downlinked", "bytes_used_kb", "pits_per_kb").join(policy_markdown(results), "policy")


_REQUESTS = """
, req AS (SELECT c_custkey, -3e0 + (c_custkey % 7) * 0.5e0 AS lon_min, 4e0 + (c_custkey % 5) * 0.4e0 AS lat_min,
  -3e0 + (c_custkey % 7) * 0.5e0 + (c_custkey % 11) * 0.3e0 AS lon_max, 4e0 + (c_custkey % 5) * 0.4e0 + (c_custkey % 13) * 0.25e0 AS lat_max,
  cast(c_custkey % 41 AS int) - 2 AS tile_count FROM customer)"""


def requests(fx: Fixtures) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = F.lit(-3.0) + (k % 7) * 0.5, F.lit(4.0) + (k % 5) * 0.4
    return fx.table("customer").select(
        "c_custkey", lon.alias("lon_min"), lat.alias("lat_min"), (lon + (k % 11) * 0.3).alias("lon_max"),
        (lat + (k % 13) * 0.25).alias("lat_max"), ((k % 41).cast("int") - 2).alias("tile_count"),
    )


@query("plan_grid", "WITH RECURSIVE zz AS (SELECT 1)" + _REQUESTS + """,
sized AS (SELECT *, lat_max - lat_min <= 0 OR lon_max - lon_min <= 0 AS flat,
  greatest(1, cast(round_even(sqrt(tile_count / (((lon_max - lon_min) * 111e0 * cos(radians((lat_min + lat_max) / 2))) / ((lat_max - lat_min) * 111e0))), 0) AS int)) AS n_rows
  FROM req WHERE tile_count > 0 AND NOT (lat_max - lat_min <= 0 OR lon_max - lon_min <= 0)
  UNION ALL SELECT *, true, 1 FROM req WHERE tile_count > 0 AND (lat_max - lat_min <= 0 OR lon_max - lon_min <= 0)),
dims AS (SELECT *, greatest(1, cast(ceil(tile_count / cast(n_rows AS double)) AS int)) AS n_cols FROM sized),
cells AS (SELECT *, unnest(range(tile_count)) AS tile_no FROM dims)
SELECT c_custkey, 't' || lpad(cast(tile_no AS varchar), 3, '0') AS tile_id,
  round(CASE WHEN flat THEN (lon_min + lon_max) / 2 ELSE lon_min + (tile_no % n_cols + 0.5e0) * ((lon_max - lon_min) / n_cols) END, 6) AS lon,
  round(CASE WHEN flat THEN (lat_min + lat_max) / 2 ELSE lat_min + (tile_no // n_cols + 0.5e0) * ((lat_max - lat_min) / n_rows) END, 6) AS lat
FROM cells WHERE flat OR tile_no // n_cols < n_rows""")
def plan_grid(fx):
    return P.plan_grid(requests(fx)).select("c_custkey", "tile_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("validate_passes", "WITH RECURSIVE zz AS (SELECT 1)" + _REQUESTS + """
SELECT tile_count, tile_count BETWEEN 1 AND 200 AS is_valid, count(*) AS n FROM req GROUP BY 1, 2""")
def validate_passes(fx):
    return P.validate_passes(requests(fx)).groupBy("tile_count", "is_valid").agg(F.count(F.lit(1)).alias("n"))


@query("pass_ids", "SELECT c_custkey, substr(md5('pass|' || c_custkey || '|' || c_name), 1, 12) AS pass_id FROM customer")
def pass_ids(fx):
    return fx.table("customer").select("c_custkey", P.pass_id("c_custkey", "c_name").alias("pass_id"))


@query("sample_coordinates", """
WITH h AS (SELECT o_orderkey AS id, md5('42|' || o_orderkey) AS a, md5('43|' || o_orderkey) AS b FROM orders),
u AS (SELECT *, cast('0x' || substr(a, 1, 8) AS bigint) / 4294967296e0 AS u0, cast('0x' || substr(a, 9, 8) AS bigint) AS p,
  (cast('0x' || substr(b, 1, 8) AS bigint) + 0.5e0) / 4294967296e0 AS u1, cast('0x' || substr(b, 9, 8) AS bigint) / 4294967296e0 AS u2,
  (cast('0x' || substr(b, 17, 8) AS bigint) + 0.5e0) / 4294967296e0 AS u3, cast('0x' || substr(b, 25, 8) AS bigint) / 4294967296e0 AS u4 FROM h),
s AS (SELECT *, CASE WHEN u0 < 0.3e0 THEN 'mining' WHEN u0 < 0.55e0 THEN 'forest' WHEN u0 < 0.65e0 THEN 'water' WHEN u0 < 0.75e0 THEN 'urban'
  WHEN u0 < 0.9e0 THEN 'mixed' ELSE 'edge' END AS stratum FROM u),
areas(area, clon, clat, radius, stratum, prior, no) AS (VALUES
""" + ",\n".join(
    f"('{a}', {lon}e0, {lat}e0, {r}e0, '{s}', '{prior}', {[x[0] for x in K.SAMPLING_AREAS if x[4] == s].index(a)})" for a, lon, lat, r, s, prior in K.SAMPLING_AREAS
) + """)
SELECT id, s.stratum AS stratum, area, round(clon + radius / 2 * (sqrt(-2e0 * ln(u1)) * cos(2e0 * pi() * u2)), 6) AS lon,
  round(clat + radius / 2 * (sqrt(-2e0 * ln(u3)) * cos(2e0 * pi() * u4)), 6) AS lat, printf('u%04d', id) AS coord_id, prior AS mission_priors
FROM s JOIN areas ON areas.stratum = s.stratum AND areas.no = p % (SELECT count(*) FROM areas a2 WHERE a2.stratum = s.stratum)""")
def sample_coordinates(fx):
    out = P.sample_coordinates(fx.table("orders").select(F.col("o_orderkey").alias("id")), "id")
    return out.select("id", "stratum", "area", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "coord_id", "mission_priors")


def gridded(fx: Fixtures) -> DataFrame:
    """Decided tiles on a grid four cells wide."""
    hint = F.when(F.col("n_boxes") >= 3, "cluster").when(F.col("n_boxes") >= 1, "mixed").otherwise("forest")
    return decided(fx).select(
        "pass_id", "seq", "tile_id", "lon", "lat", "cloud_cover", "captured_at", "budget_kb", "n_boxes", "max_area", "confidence", "description",
        F.floor((F.col("seq") - 1) / 4).alias("row"), ((F.col("seq") - 1) % 4).alias("col"),
        X.action_to_tool(F.col("action")).alias("action"), F.col("n_boxes").alias("boxes"), hint.alias("scene_hint"), F.col("action").alias("decision"),
    )


_GRIDDED = """
, grid AS (SELECT *, (seq - 1) // 4 AS r, (seq - 1) % 4 AS c,
  CASE action WHEN 'downlink' THEN 'downlink_now' WHEN 'flag' THEN 'flag_for_review' ELSE 'discard' END AS tool,
  CASE WHEN n_boxes >= 3 THEN 'cluster' WHEN n_boxes >= 1 THEN 'mixed' ELSE 'forest' END AS hint FROM fx_decided),
met AS (SELECT g.*, n.tool AS n_tool, n.n_boxes AS n_n, n.hint AS n_hint, s.tool AS s_tool, s.n_boxes AS s_n, s.hint AS s_hint,
  e.tool AS e_tool, e.n_boxes AS e_n, e.hint AS e_hint, w.tool AS w_tool, w.n_boxes AS w_n, w.hint AS w_hint
  FROM grid g
  LEFT JOIN grid n ON n.pass_id = g.pass_id AND n.r = g.r + 1 AND n.c = g.c AND n.seq < g.seq
  LEFT JOIN grid s ON s.pass_id = g.pass_id AND s.r = g.r - 1 AND s.c = g.c AND s.seq < g.seq
  LEFT JOIN grid e ON e.pass_id = g.pass_id AND e.r = g.r AND e.c = g.c + 1 AND e.seq < g.seq
  LEFT JOIN grid w ON w.pass_id = g.pass_id AND w.r = g.r AND w.c = g.c - 1 AND w.seq < g.seq)
"""


@query("neighbor_summary", _GRIDDED + """
SELECT tile_id, (n_tool IS NOT NULL)::int + (s_tool IS NOT NULL)::int + (e_tool IS NOT NULL)::int + (w_tool IS NOT NULL)::int AS n_known,
  s_tool AS south_action, s_n AS south_boxes, s_hint AS south_hint, w_tool AS west_action, w_n AS west_boxes FROM met""", "fx_decided")
def neighbor_summary(fx):
    n = P.neighbor_summary(gridded(fx))
    s, w = F.try_element_at("neighbors", F.lit("south")), F.try_element_at("neighbors", F.lit("west"))
    return n.select(
        "tile_id", F.size("neighbors").alias("n_known"), s["action"].alias("south_action"), s["boxes"].alias("south_boxes"),
        s["scene_hint"].alias("south_hint"), w["action"].alias("west_action"), w["boxes"].alias("west_boxes"),
    )


def _sql_entry(d: str) -> str:
    p = d[0]
    return (
        f"""'  "{d}": ' || CASE WHEN {p}_tool IS NULL THEN 'null' ELSE '{{' || chr(10) || '    "action": "' || {p}_tool || '",' || chr(10) || """
        f"""'    "boxes": ' || {p}_n || ',' || chr(10) || '    "scene_hint": "' || {p}_hint || '"' || chr(10) || '  }}' END"""
    )


_NEIGHBOR_JSON = "'{' || chr(10) || " + " || ',' || chr(10) || ".join(_sql_entry(d) for d in X.DIRECTIONS) + " || chr(10) || '}'"
_MESSAGE = f"""
'Tile u' || tile_id || ' at lon=' || printf('%.4f', lon) || ', lat=' || printf('%.4f', lat) || '.' || chr(10) || 'Stratum (sampling category): ' || hint || chr(10)
|| 'Cloud cover (metadata, may be unreliable): ' || coalesce(cast(cloud_cover AS varchar), 'None') || chr(10)
|| 'Captured: ' || strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'Tile imagery issue: None' || chr(10)
|| 'Pass budget: ' || greatest(0, 512 - 80 * prior) || ' of 512 KB remaining' || chr(10) || 'Prior tiles downlinked this pass: ' || prior || chr(10)
|| 'Mission priors: known area' || chr(10) || 'Neighbor summary (structured):' || chr(10) || {_NEIGHBOR_JSON} || chr(10)"""
_MESSAGES = _GRIDDED + f""", told AS (SELECT *, {_MESSAGE} AS message FROM (
  SELECT *, coalesce(sum(CASE WHEN action = 'downlink' THEN 1 ELSE 0 END) OVER (PARTITION BY pass_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM met))"""


def labelled(fx: Fixtures) -> DataFrame:
    """Tiles with their labelling message, the budget taken from the downlinks before them."""
    n = P.neighbor_summary(gridded(fx))
    run = P.block_running_sum(
        n, ["pass_id"], ["seq"], seq_block(F.col("seq")), F.when(F.col("decision") == "downlink", 1).otherwise(0), "_run"
    )
    prior = F.col("_run") - F.when(F.col("decision") == "downlink", 1).otherwise(0)
    return run.withColumn("prior", prior).withColumn("remaining_kb", F.greatest(F.lit(0), F.lit(512) - F.col("prior") * 80)).withColumn(
        "message",
        X.label_message(
            F.concat(F.lit("u"), F.col("tile_id").cast("string")), F.col("lon"), F.col("lat"), F.col("scene_hint"), F.col("cloud_cover"),
            F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(None), F.col("remaining_kb"), F.lit(512),
            F.col("prior"), F.lit("known area"), F.col("neighbors"),
        ),
    )


@query("label_messages", _MESSAGES + "SELECT tile_id, md5(message) AS digest, length(message) AS n_chars FROM told", "fx_decided")
def label_messages(fx):
    return labelled(fx).select("tile_id", F.md5("message").alias("digest"), F.length("message").alias("n_chars"))


@query("prompt_fields", _MESSAGES + """
SELECT tile_id, 'u' || tile_id AS named, cast(printf('%.4f', lon) AS double) AS lon, cast(printf('%.4f', lat) AS double) AS lat, cloud_cover,
  strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') AS captured_at, cast(greatest(0, 512 - 80 * prior) AS int) AS budget_remaining_kb, 512 AS budget_total_kb,
  'known area' AS mission_priors, md5(""" + _NEIGHBOR_JSON + ") AS neighbors FROM told", "fx_decided")
def prompt_fields(fx):
    f = X.prompt_fields(F.col("message"))
    return labelled(fx).select(
        "tile_id", f["tile_id"].alias("named"), f["lon"].alias("lon"), f["lat"].alias("lat"), f["cloud_cover"].alias("cloud_cover"),
        f["captured_at"].alias("captured_at"), f["budget_remaining_kb"].alias("budget_remaining_kb"), f["budget_total_kb"].alias("budget_total_kb"),
        f["mission_priors"].alias("mission_priors"), F.md5(f["neighbors_json"]).alias("neighbors"),
    )


@query("tile_prompts", """
SELECT tile_id, 'Tile ' || tile_id || ' at lon=' || printf('%.4f', lon) || ', lat=' || printf('%.4f', lat) || '.' || chr(10) || 'Cloud cover: '
  || coalesce(printf('%.0f', cloud_cover * 100) || '%', 'n/a') || '. Captured: ' || strftime(captured_at, '%Y-%m-%d') || '.' || chr(10) || chr(10)
  || 'VLM detection:' || chr(10) || '- ' || n_boxes || ' mining-pit candidate bounding box(es)'
  || CASE WHEN n_boxes > 0 THEN ' (largest area = ' || printf('%.3f', max_area) || ')' ELSE '' END || chr(10)
  || '- Description: "' || description || '"' || chr(10) || '- Derived confidence: ' || printf('%.2f', confidence) || chr(10) || chr(10)
  || 'Pass budget: 512 KB of 512 KB remaining.' || chr(10) || chr(10) || 'Choose the appropriate tool.' AS prompt,
  'confidence=' || printf('%.2f', confidence) || '; boxes=' || n_boxes || '; cloud_cover=' || coalesce(cast(cloud_cover AS varchar), 'n/a')
  || '; budget_remaining_kb=512' AS scratchpad
FROM fx_decided""", "fx_decided")
def tile_prompts(fx):
    c = F.col
    return decided(fx).select(
        "tile_id",
        X.tile_prompt(
            c("tile_id"), c("lon"), c("lat"), c("cloud_cover"), F.date_format("captured_at", "yyyy-MM-dd"), c("n_boxes"), c("max_area"),
            F.concat(F.lit("  "), c("description"), F.lit("\n")), c("confidence"), F.lit(512), F.lit(512),
        ).alias("prompt"),
        X.scratchpad(c("confidence"), c("n_boxes"), c("cloud_cover"), F.lit(512)).alias("scratchpad"),
    )


@query("cloud_clamp", """
SELECT tile_id, CASE WHEN cloud_cover IS NULL THEN NULL ELSE greatest(0e0, least(1e0, cloud_cover)) END AS cloud_cover FROM fx_tiles""", "fx_tiles")
def cloud_clamp(fx):
    return fx.tiles().select("tile_id", clamp_cloud_cover(F.col("cloud_cover")).alias("cloud_cover"))


# --------------------------------------------------------------------------- matching over years and to gold

_CHANGE = f"""
, side AS (SELECT *, row_number() OVER (PARTITION BY tile_id, year ORDER BY box_no) AS no FROM fx_valid),
past AS (SELECT tile_id, list({{'no': no, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY no) AS boxes FROM side WHERE year = 2016 GROUP BY tile_id),
now AS (SELECT * FROM side WHERE year = 2022),
step AS (
  SELECT n.tile_id, n.no, p.boxes AS before, n.x1, n.y1, n.x2, n.y2 FROM now n LEFT JOIN past p USING (tile_id) WHERE n.no < 0),
walk AS (
  SELECT t.tile_id, cast(0 AS bigint) AS no, coalesce(p.boxes, []) AS remaining, cast(NULL AS varchar) AS status FROM (SELECT DISTINCT tile_id FROM now) t LEFT JOIN past p USING (tile_id)
  UNION ALL
  SELECT s.tile_id, s.no, CASE WHEN s.best IS NULL THEN s.remaining ELSE list_filter(s.remaining, lambda q: q.no <> s.best.no) END,
    CASE WHEN s.best IS NULL THEN 'new' ELSE 'persistent' END
  FROM (SELECT n.tile_id, n.no, w.remaining,
          list_sort(list_filter(list_transform(w.remaining, lambda q: {{'neg': -{iou('n.', 'q.')}, 'no': q.no}}), lambda z: -z.neg >= 0.3e0))[1] AS best
        FROM walk w JOIN now n ON n.tile_id = w.tile_id AND n.no = w.no + 1) s)
"""


def _years(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    v = valid(fx)
    return v.filter("year = 2016"), v.filter("year = 2022")


@query("match_change", _CHANGE + """
SELECT n.tile_id, round(n.x1, 6) AS x1, round(n.y1, 6) AS y1, round(n.x2, 6) AS x2, round(n.y2, 6) AS y2, w.status
FROM walk w JOIN now n ON n.tile_id = w.tile_id AND n.no = w.no""", "fx_valid")
def match_change(fx):
    past, present = _years(fx)
    return M.match_change_table(past, present, "ord").select("tile_id", *[F.round(c, 6).alias(c) for c in B.CORNERS], "status")


@query("match_change_crowded", _CHANGE + """
SELECT n.tile_id, round(n.x1, 6) AS x1, round(n.y1, 6) AS y1, round(n.x2, 6) AS x2, round(n.y2, 6) AS y2, w.status
FROM walk w JOIN now n ON n.tile_id = w.tile_id AND n.no = w.no""", "fx_valid")
def match_change_crowded(fx):
    """The sweep that crowded tiles take, forced for tiles of more than four boxes."""
    past, present = _years(fx)
    return M.match_change_table(past, present, "ord", max_array=4).select("tile_id", *[F.round(c, 6).alias(c) for c in B.CORNERS], "status")


@query("change_box_counts", _CHANGE + "SELECT status, count(*) AS n FROM walk WHERE status IS NOT NULL GROUP BY status", "fx_valid")
def change_box_counts(fx):
    past, present = _years(fx)
    return M.match_change_table(past, present, "ord").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_BEST = f"""
, g AS (SELECT * FROM fx_valid WHERE year = 2016), p AS (SELECT * FROM fx_valid WHERE year = 2022),
per_gold AS (SELECT g.tile_id, g.box_no, coalesce(max({iou('g.', 'p.')}), 0e0) AS best FROM g LEFT JOIN p ON p.tile_id = g.tile_id GROUP BY 1, 2),
scored AS (SELECT tile_id, count(*) AS n_gold, avg(best) AS mean_best, sum((best >= 0.5e0)::int) AS h0, sum((best >= 0.25e0)::int) AS h1 FROM per_gold GROUP BY 1),
best AS (SELECT t.tile_id, coalesce(s.n_gold, 0) AS n_gold, coalesce(c.n, 0) AS n_pred, coalesce(s.h0, 0) AS h0, coalesce(s.h1, 0) AS h1,
  CASE WHEN s.n_gold IS NULL THEN CASE WHEN c.n IS NULL THEN 1e0 ELSE 0e0 END ELSE s.mean_best END AS iou
  FROM fx_tiles t LEFT JOIN scored s USING (tile_id) LEFT JOIN (SELECT tile_id, count(*) AS n FROM p GROUP BY 1) c USING (tile_id))
"""


@query("best_iou", _BEST + "SELECT tile_id, n_gold, n_pred, round(iou, 6) AS iou FROM best", "fx_valid fx_tiles")
def best_iou(fx):
    gold, pred = _years(fx)
    return M.best_iou(pred, gold, fx.tiles()).withColumn("iou", F.round("iou", 6))


@query("best_iou_crowded", _BEST + "SELECT tile_id, n_gold, n_pred, round(iou, 6) AS iou, cast(h0 AS bigint) AS hit_0 FROM best", "fx_valid fx_tiles")
def best_iou_crowded(fx):
    """The cell join that crowded tiles take, forced for tiles of more than three boxes."""
    gold, pred = _years(fx)
    return M.best_iou(pred, gold, fx.tiles(), thresholds=(0.5,), max_array=3).withColumn("iou", F.round("iou", 6))


@query("grounding_summary", _BEST + """
SELECT round(avg(iou), 6) AS mean_iou, round(avg((n_gold = n_pred)::int), 6) AS count_match_rate, round(avg((iou >= 0.5e0)::int), 6) AS hit_rate_50,
  round(sum(h0) / sum(n_gold), 6) AS recall_50, round(avg((iou >= 0.25e0)::int), 6) AS hit_rate_25, round(sum(h1) / sum(n_gold), 6) AS recall_25 FROM best""", "fx_valid fx_tiles")
def grounding_summary(fx):
    gold, pred = _years(fx)
    out = E.grounding_summary(M.best_iou(pred, gold, fx.tiles(), thresholds=(0.5, 0.25)), (0.5, 0.25))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("explode_detections", """
SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY (x2 - x1) * (y2 - y1) DESC, box_no) - 1 AS pos, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM fx_nkept""", "fx_nkept")
def explode_detections(fx):
    """Nested detections to one row per surviving box."""
    kept = fx.detections().select("tile_id", B.nms(B.valid_boxes(F.col("raw"), True, K.MIN_BOX_AREA)).alias("boxes"))
    # Not posexplode, for which Spark first runs the suppression once more to leave out rows without boxes.
    rows = kept.select("tile_id", F.posexplode_outer("boxes").alias("pos", "b")).filter(F.col("pos").isNotNull())
    return rows.select("tile_id", "pos", F.round("b.x1", 6).alias("x1"), F.round("b.y2", 6).alias("y2"))


def _load_detector():
    """Stands in for a model: boxes from a tile's two numbers, six to a tile."""
    import numpy as np

    def boxes_of(batch):
        k, cust = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[:, None] for c in ("o_orderkey", "o_custkey"))
        i = np.arange(6)
        x, y = (cust + i * 5 + (k % 3) * i) % 96, (k + i * 7) % 96
        return np.stack([x / 128, y / 128, (x + (k + i * i) % 40) / 128, (y + 1 + (k + i) % 30) / 128], axis=2).tolist()

    return boxes_of


@query("detected_by_function", """
SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY (x2 - x1) * (y2 - y1) DESC, box_no) - 1 AS pos, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM fx_nkept""", "fx_nkept")
def detected_by_function(fx):
    """Boxes of a detector function, which enter as a table's do."""
    tiles = fx.table("orders").select(F.col("o_orderkey").alias("tile_id"), "o_orderkey", "o_custkey")
    found = detect(tiles, _load_detector, "six-boxes", keep=["tile_id"])
    kept = found.select("tile_id", B.nms(B.valid_boxes(F.col("raw"), True, K.MIN_BOX_AREA)).alias("boxes"))
    rows = kept.select("tile_id", F.posexplode_outer("boxes").alias("pos", "b")).filter(F.col("pos").isNotNull())
    return rows.select("tile_id", "pos", F.round("b.x1", 6).alias("x1"), F.round("b.y2", 6).alias("y2"))


@query("predictions_written", """
SELECT action, count(*) AS n, round(avg(confidence), 6) AS confidence FROM fx_decided GROUP BY 1""", "fx_decided")
def predictions_written(fx):
    """Predictions of every tile written as JSON lines, read back and summed up; the summary is written and read as well."""
    rows, sums = scratch_path(fx.spark, "predictions"), scratch_path(fx.spark, "metrics")
    write_json(decided(fx).select("tile_id", "pass_id", "action", "confidence", "n_boxes"), rows)
    back = fx.spark.read.schema("tile_id long, pass_id long, action string, confidence double, n_boxes long").json(rows)
    write_json(back.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")), sums)
    return fx.spark.read.schema("action string, n long, confidence double").json(sums)


# --------------------------------------------------------------------------- events

@query("number_events", "SELECT event_id, pass_id, seq FROM fx_events", "fx_events")
def number_events(fx):
    return P.number_events(fx.events()).select("event_id", "pass_id", "seq")


_STATE = """
, s AS (SELECT pass_id, tile_no, max(seq) FILTER (event = 'tile_arrived') AS a, arg_max(value, seq) FILTER (event = 'tile_arrived') AS arrived,
  max(seq) FILTER (event = 'vlm_done') AS d, arg_max(value, seq) FILTER (event = 'vlm_done') AS detection,
  max(seq) FILTER (event = 'agent_thinking') AS t, arg_max(value, seq) FILTER (event = 'agent_thinking') AS scratchpad,
  max(seq) FILTER (event = 'agent_decided') AS e, arg_max(value, seq) FILTER (event = 'agent_decided') AS decision, max(seq) AS last_seq
  FROM fx_events WHERE event <> 'budget_update' GROUP BY 1, 2),
state AS (SELECT pass_id, tile_no, a IS NOT NULL AS has_arrived, arrived, CASE WHEN a IS NULL OR d > a THEN detection END AS detection,
  CASE WHEN a IS NULL OR t > a THEN scratchpad END AS scratchpad, CASE WHEN a IS NULL OR e > a THEN decision END AS decision, last_seq FROM s)
"""


@query("tile_state", _STATE + "SELECT * FROM state", "fx_events")
def tile_state(fx):
    return P.tile_state(fx.numbered_events())


@query("activity_feed", """
SELECT pass_id, event_id, event, rank FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY seq DESC) AS rank FROM fx_events) WHERE rank <= 10""", "fx_events")
def activity_feed(fx):
    return P.activity_feed(fx.numbered_events()).select("pass_id", "event_id", "event", "rank")


@query("pass_counters", _STATE + """
, b AS (SELECT pass_id, arg_max(value, seq) AS used_kb, 512e0 AS total_kb FROM fx_events WHERE event = 'budget_update' GROUP BY 1)
SELECT pass_id, count(*) FILTER (has_arrived) AS processed, count(*) FILTER (decision >= 10 AND decision < 30) AS flagged, count(*) FILTER (decision >= 30) AS downlinked,
  count(*) FILTER (decision < 10) AS discarded, used_kb, total_kb, least(100e0, used_kb / total_kb * 100) AS budget_pct
FROM state LEFT JOIN b USING (pass_id) GROUP BY pass_id, used_kb, total_kb""", "fx_events")
def pass_counters(fx):
    ev = fx.numbered_events()
    d = F.col("decision")
    state = P.tile_state(ev).withColumn("action", F.when(d >= 30, "downlink").when(d >= 10, "flag").when(d < 10, "discard"))
    budget = ev.filter(F.col("event") == "budget_update").groupBy("pass_id").agg(F.max_by("value", "seq").alias("used_kb")).withColumn("total_kb", F.lit(512.0))
    return P.pass_counters(state, budget).withColumn("budget_pct", F.when(F.col("used_kb").isNotNull(), F.col("budget_pct")))


# --------------------------------------------------------------------------- streams


def _replayed(fx: Fixtures, df: DataFrame, files: int = 4) -> DataFrame:
    """A derived table written to the shared folder and read back as a stream, a file at a time."""
    path = scratch_path(fx.spark, "replay")
    df.repartition(files, *[c for c in ("pass_id",) if c in df.columns]).write.parquet(path)
    return fx.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def as_it_came(fx: Fixtures, df: DataFrame, arrival: Column, files: int = 3) -> DataFrame:
    """A derived table as a stream in the order of ``arrival``: each file, one micro-batch, holds a span of it."""
    path, staged = scratch_path(fx.spark, "arrivals"), settle(df.withColumn("_at", arrival.cast("double")), "arrivals-all")
    ends = staged.agg(F.min("_at").alias("low"), F.max("_at").alias("high")).first()
    for k in range(files if ends.low is not None else 0):
        part = F.least(F.lit(files - 1), F.floor((F.col("_at") - ends.low) * files / max(1.0, ends.high - ends.low)))
        staged.filter(part == k).drop("_at").coalesce(1).write.mode("append").parquet(path)
    return fx.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _decisions(fx: Fixtures) -> DataFrame:
    """Decisions of passes that start within a day, a tile every 20 seconds."""
    minutes = (F.col("pass_id") % 97) * 10
    at = (F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long") + minutes * 60 + F.col("seq") * 20).cast("timestamp")
    return decided(fx).select("pass_id", "seq", at.alias("ts"), "tile_id", "action", "description", "budget_kb", "tile_count")


def _late(minutes: int = 50) -> Column:
    """Seconds of arrival: event time and a delay below the watermark's."""
    return F.col("ts").cast("long") + F.pmod(F.xxhash64("pass_id", "seq"), F.lit(60 * minutes))


@query("stream_tile_state", _STATE + "SELECT * FROM state", "fx_events")
def stream_tile_state(fx):
    events = as_it_came(fx, fx.numbered_events(), F.col("ts").cast("timestamp").cast("long") + F.pmod(F.xxhash64("event_id"), F.lit(3000)))
    emitted = S.run_available(S.stream_tile_state(events, patience_ms=3650 * 86_400_000), "update", "tile-state")
    return S.latest(emitted, ["pass_id", "tile_no"])


@query("stream_ledger", "SELECT pass_id, seq, tile_id, action, used_kb, remaining_kb FROM fx_ledger", "fx_ledger")
def stream_ledger(fx):
    return S.run_available(S.stream_ledger(as_it_came(fx, _decisions(fx), _late())), "append", "ledger").drop("batch")


@query("stream_summary", """
SELECT pass_id, count(*) AS tiles_processed, count(*) FILTER (action = 'flag') AS tiles_flagged, count(*) FILTER (action = 'downlink') AS tiles_downlinked,
  count(*) FILTER (action NOT IN ('flag', 'downlink')) AS tiles_discarded, max(used_kb) AS bandwidth_used_kb, min(remaining_kb) AS bandwidth_remaining_kb,
  coalesce(array_to_string(list_slice(list(description ORDER BY seq) FILTER (action IN ('flag', 'downlink')), 1, 10), '; '), '') AS flagged
FROM fx_ledger GROUP BY pass_id""", "fx_ledger")
def stream_summary(fx):
    """A row on each ``pass_complete``; one pass in five never completes and is summed up by its timer."""
    tiles = _decisions(fx).withColumn("event", F.lit("agent_decided"))
    ended = tiles.groupBy("pass_id").agg((F.max("seq") + 1).alias("seq"), F.max("ts").alias("ts"), F.first("budget_kb").alias("budget_kb"), F.first("tile_count").alias("tile_count"))
    ends = ended.filter(F.col("pass_id") % 5 != 0).withColumn("event", F.lit(S.PASS_END))
    # A last event of a pass of its own, long after: the timers of the others run out.
    beat = ended.agg((F.max("ts").cast("long") + 86_400).cast("timestamp").alias("ts")).select(F.lit(-1).cast("long").alias("pass_id"), F.lit(2).cast("long").alias("seq"), "ts", F.lit(S.PASS_END).alias("event"))
    rows = tiles.unionByName(ends, True).unionByName(beat.filter("ts IS NOT NULL"), True)
    late = F.when(F.col("pass_id") < 0, F.col("ts").cast("long")).otherwise(_late())
    out = S.run_available(S.stream_summary(as_it_came(fx, rows, late, 4)), "append", "summary")
    return out.withColumn("flagged", F.array_join("flagged_summary", "; ")).drop("batch", "flagged_summary")


@query("typed_event_stream", """
SELECT pass_id::varchar AS pass_id, count(*) AS n, count(*) FILTER (event = 'vlm_done') AS n_detections, max(seq) AS last_seq FROM fx_events GROUP BY 1""", "fx_events")
def typed_event_stream(fx):
    """Events as JSON lines, some files twice, through the typed source."""
    path = scratch_path(fx.spark, "json-events")
    events = fx.numbered_events().select(
        F.col("pass_id").cast("string").alias("pass_id"), "seq", "event", F.col("ts").cast("timestamp").alias("ts"), F.col("tile_no").cast("string").alias("tile_id"))
    for _ in range(2):
        write_json(events, path, "append")
    out = S.run_available(S.event_stream(fx.spark, path, "3650 days"), "append", "typed")
    seen = F.sum(F.when(F.col("event") == "vlm_done", 1).otherwise(0)).alias("n_detections")
    return out.groupBy("pass_id").agg(F.count(F.lit(1)).alias("n"), seen, F.max("seq").alias("last_seq"))


@query("stream_accuracy", """
SELECT gold_action, count(*) AS n, count(*) FILTER (pred_action = gold_action) AS n_correct, round(avg((pred_action = gold_action)::int), 6) AS accuracy
FROM fx_actions GROUP BY 1""", "fx_actions")
def stream_accuracy(fx):
    counts = S.stream_counts(_replayed(fx, fx.actions()), F.col("gold_action") == F.col("pred_action"), ["gold_action"])
    return S.latest(S.run_available(counts, "update", "accuracy"), ["gold_action"]).withColumn("accuracy", F.round("accuracy", 6))


@query("stream_once", "SELECT pass_id, count(*) AS n, max(seq) AS last_seq FROM fx_events GROUP BY 1", "fx_events")
def stream_once(fx):
    """Every event sent twice, counted once."""
    ev = fx.numbered_events().select("pass_id", "seq", "ts")
    seen = S.once_per_event(_replayed(fx, ev.unionByName(ev)), "3650 days")
    return S.run_available(seen, "append", "once").groupBy("pass_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))
