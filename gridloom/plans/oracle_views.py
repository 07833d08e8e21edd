"""DuckDB text of the derived views, composed into the reference SQL of each query."""

from gridloom.plans.call_cases import CASES, LONG_EVERY

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body)


_view("fx_tiles", """
SELECT o_orderkey AS tile_id, o_custkey AS pass_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
  count(*) OVER (PARTITION BY o_custkey) AS tile_count,
  -3e0 + cast(o_orderkey % 61 AS double) / 20e0 AS lon, 4e0 + cast(o_orderkey % 53 AS double) / 10e0 AS lat,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 1.403499e0
       ELSE cast(o_orderkey % 100 AS double) / 100e0 END AS cloud_cover,
  o_orderkey % 19 <> 0 AS image_available, o_orderdate AS captured_at, 512 AS budget_kb
FROM orders""")

_view("fx_boxes", """
SELECT l_orderkey AS tile_id, CASE WHEN l_returnflag = 'R' THEN 2016 ELSE 2022 END AS year, l_linenumber AS line,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS box_no,
  cast(l_partkey % 96 AS double) / 128e0 AS x1, cast(l_suppkey % 96 AS double) / 128e0 AS y1,
  CASE WHEN l_linenumber = 7 THEN cast(l_partkey % 96 AS double) / 128e0
       ELSE (cast(l_partkey % 96 AS double) + l_quantity) / 128e0 END AS x2,
  (cast(l_suppkey % 96 AS double) + 1e0 + cast(l_partkey % 40 AS double)) / 128e0 AS y2
FROM lineitem""")

_view("fx_valid", """
SELECT * FROM (
  SELECT tile_id, year, line, box_no, greatest(0e0, least(1e0, x1)) AS x1, greatest(0e0, least(1e0, y1)) AS y1,
    greatest(0e0, least(1e0, x2)) AS x2, greatest(0e0, least(1e0, y2)) AS y2 FROM fx_boxes)
WHERE x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) >= 1e-4""", "fx_boxes")


def iou(a: str, b: str) -> str:
    """IoU of two boxes given as column prefixes (``k.`` style)."""
    w = f"(least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"(least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area_a = f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1))"
    area_b = f"(({b}x2 - {b}x1) * ({b}y2 - {b}y1))"
    union = f"({area_a} + {area_b} - {w} * {h})"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 AND {union} > 0 THEN {w} * {h} / {union} ELSE 0e0 END)"


_view("fx_nested", """
SELECT * FROM (SELECT tile_id, box_no, greatest(0e0, least(1e0, x1)) AS x1, greatest(0e0, least(1e0, y1)) AS y1, greatest(0e0, least(1e0, x2)) AS x2, greatest(0e0, least(1e0, y2)) AS y2
  FROM (SELECT tile_id, i AS box_no, x / 128e0 AS x1, y / 128e0 AS y1, (x + cast((k + i * i) % 40 AS double)) / 128e0 AS x2, (y + 1e0 + cast((k + i) % 30 AS double)) / 128e0 AS y2
    FROM (SELECT o_orderkey AS tile_id, o_orderkey AS k, i, cast((o_custkey + i * 5 + (o_orderkey % 3) * i) % 96 AS double) AS x, cast((o_orderkey + i * 7) % 96 AS double) AS y
      FROM orders, range(6) AS r(i))))
WHERE x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) >= 1e-4""")

_view("fx_ranked", """
SELECT *, (x2 - x1) * (y2 - y1) AS area,
  row_number() OVER (PARTITION BY tile_id ORDER BY (x2 - x1) * (y2 - y1) DESC, box_no) AS rk FROM fx_valid""", "fx_valid")

_view("fx_walk", f"""
SELECT tile_id, rk, [{{'box_no': box_no, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM fx_ranked WHERE rk = 1
UNION ALL
SELECT r.tile_id, r.rk,
  CASE WHEN len(list_filter(w.kept, lambda k: {iou('r.', 'k.')} >= 0.5e0)) > 0 THEN w.kept
       ELSE list_append(w.kept, {{'box_no': r.box_no, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
FROM fx_walk w JOIN fx_ranked r ON r.tile_id = w.tile_id AND r.rk = w.rk + 1""", "fx_ranked")

_view("fx_kept", """
SELECT tile_id, k.box_no AS box_no, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2
FROM (SELECT tile_id, unnest(kept) AS k FROM (SELECT tile_id, arg_max(kept, rk) AS kept FROM fx_walk GROUP BY tile_id))""", "fx_walk")

_view("fx_nranked", """
SELECT *, (x2 - x1) * (y2 - y1) AS area,
  row_number() OVER (PARTITION BY tile_id ORDER BY (x2 - x1) * (y2 - y1) DESC, box_no) AS rk FROM fx_nested""", "fx_nested")

_view("fx_nwalk", f"""
SELECT tile_id, rk, [{{'box_no': box_no, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM fx_nranked WHERE rk = 1
UNION ALL
SELECT r.tile_id, r.rk,
  CASE WHEN len(list_filter(w.kept, lambda k: {iou('r.', 'k.')} >= 0.5e0)) > 0 THEN w.kept
       ELSE list_append(w.kept, {{'box_no': r.box_no, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
FROM fx_nwalk w JOIN fx_nranked r ON r.tile_id = w.tile_id AND r.rk = w.rk + 1""", "fx_nranked")

_view("fx_nkept", """
SELECT tile_id, k.box_no AS box_no, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2
FROM (SELECT tile_id, unnest(kept) AS k FROM (SELECT tile_id, arg_max(kept, rk) AS kept FROM fx_nwalk GROUP BY tile_id))""", "fx_nwalk")

_view("fx_conf", """
SELECT *, CASE WHEN n_boxes = 0 THEN 0e0 ELSE least(1e0, 0.5e0 + 0.2e0 * n_boxes + max_area * 1.5e0) END AS confidence FROM (
  SELECT t.*, coalesce(b.n, 0) AS n_boxes, coalesce(b.a, 0e0) AS max_area
  FROM fx_tiles t LEFT JOIN (SELECT tile_id, count(*) AS n, max((x2 - x1) * (y2 - y1)) AS a FROM fx_kept GROUP BY tile_id) b USING (tile_id))""",
      "fx_tiles", "fx_kept")

_view("fx_decided", """
SELECT *, CASE WHEN confidence >= 0.85e0 THEN 'downlink' WHEN confidence >= 0.65e0 THEN 'flag' ELSE 'discard' END AS action,
  n_boxes || ' boxes on tile ' || tile_id AS description FROM fx_conf""", "fx_conf")

_view("fx_ledger", """
SELECT *, used_kb - CASE WHEN action = 'downlink' THEN 80 ELSE 0 END AS used_before, greatest(0, budget_kb - used_kb) AS remaining_kb FROM (
  SELECT *, cast(80 * sum(CASE WHEN action = 'downlink' THEN 1 ELSE 0 END) OVER (PARTITION BY pass_id ORDER BY seq) AS bigint) AS used_kb
  FROM fx_decided)
WHERE seq = 1 OR used_kb - CASE WHEN action = 'downlink' THEN 80 ELSE 0 END < budget_kb""", "fx_decided")

for _name, _per in (("fx_mask_full", 128), ("fx_mask_dense", 512)):
    _view(_name, f"""
SELECT DISTINCT cast(floor(cast(l_orderkey AS double) / {_per}e0) AS bigint) AS patch_id,
  CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linestatus = 'O') THEN 2016 ELSE 2022 END AS year,
  cast(l_partkey % 32 AS int) AS x, cast(l_quantity AS int) % 32 AS y FROM lineitem""")

_view("fx_mask", """
SELECT DISTINCT patch_id, year, CASE WHEN patch_id % 7 IN (2, 5) THEN 5 ELSE x END AS x, CASE WHEN patch_id % 7 IN (2, 5) THEN 6 ELSE y END AS y
FROM fx_mask_full WHERE patch_id % 7 <> 4 AND NOT (patch_id % 7 = 3 AND year = 2022) AND NOT (patch_id % 7 = 2 AND year = 2016)""", "fx_mask_full")

_view("fx_change", """
SELECT patch_id, 2022 AS year, x, y FROM (SELECT patch_id, x, y FROM fx_mask WHERE year = 2022 EXCEPT SELECT patch_id, x, y FROM fx_mask WHERE year = 2016)""", "fx_mask")

for _name, _per in (("fx_patches", 128), ("fx_patches_dense", 512)):
    _view(_name, f"""
SELECT p.patch_id, y.year, 32 AS w, 32 AS h,
  CASE WHEN p.patch_id % 10 < 7 THEN 'train' WHEN p.patch_id % 10 < 9 OR y.year = 2016 THEN 'test' ELSE 'train' END AS split
FROM (SELECT DISTINCT cast(floor(cast(o_orderkey AS double) / {_per}e0) AS bigint) AS patch_id FROM orders) p
CROSS JOIN (SELECT 2016 AS year UNION ALL SELECT 2022 AS year) y""")


def _labels(mask: str) -> str:
    """Smallest reachable raster index of every pixel, by repeated propagation."""
    return f"""
SELECT patch_id, year, x, y, min(lab) AS comp FROM (
  SELECT patch_id, year, x, y, lab FROM {mask}_reach) GROUP BY 1, 2, 3, 4"""


for _m in ("fx_mask", "fx_mask_dense", "fx_change"):
    _view(f"{_m}_reach", f"""
SELECT patch_id, year, x, y, cast(y AS bigint) * 4294967296 + x AS lab FROM {_m}
UNION
SELECT m.patch_id, m.year, m.x, m.y, r.lab
FROM {_m}_reach r JOIN (SELECT *, unnest([-1, 1, 0, 0]) AS dx, unnest([0, 0, -1, 1]) AS dy FROM {_m}) m
  ON m.patch_id = r.patch_id AND m.year = r.year AND m.x + m.dx = r.x AND m.y + m.dy = r.y
WHERE r.lab < cast(m.y AS bigint) * 4294967296 + m.x""", _m)
    _view(f"{_m}_label", _labels(_m), f"{_m}_reach")
    _view(f"{_m}_comps", f"""
SELECT patch_id, year, comp, count(*) AS px, cast(min(x) AS bigint) AS x1, cast(min(y) AS bigint) AS y1,
  cast(max(x) + 1 AS bigint) AS x2, cast(max(y) + 1 AS bigint) AS y2 FROM {_m}_label GROUP BY 1, 2, 3""", f"{_m}_label")

_view("fx_stats", """
SELECT p.patch_id, p.year, p.split, p.w, p.h, coalesce(c.n, 0) AS pit_count, coalesce(c.px, 0) AS px,
  coalesce(c.px, 0) * 0.01e0 AS total_area_ha, coalesce(c.min_ha, 0e0) AS min_area_ha, coalesce(c.max_ha, 0e0) AS max_area_ha,
  coalesce(c.sx, 0e0) AS span_x, coalesce(c.sy, 0e0) AS span_y, c.big AS big
FROM fx_patches p LEFT JOIN (
  SELECT patch_id, year, count(*) AS n, cast(sum(px) AS bigint) AS px, min(px * 0.01e0) AS min_ha, max(px * 0.01e0) AS max_ha,
    max((bx1 + bx2) / 2e0) - min((bx1 + bx2) / 2e0) AS sx, max((by1 + by2) / 2e0) - min((by1 + by2) / 2e0) AS sy,
    first({'x1': bx1, 'y1': by1, 'x2': bx2, 'y2': by2} ORDER BY px DESC, comp) AS big
  FROM (SELECT *, round_even(x1 / 32e0, 4) AS bx1, round_even(y1 / 32e0, 4) AS by1, round_even(x2 / 32e0, 4) AS bx2,
          round_even(y2 / 32e0, 4) AS by2 FROM fx_mask_comps WHERE px >= __MIN__)
  GROUP BY 1, 2) c USING (patch_id, year)""".replace("__MIN__", "1"), "fx_patches", "fx_mask_comps")

_view("fx_bands", """
SELECT cast(floor(cast(l_orderkey AS double) / 128e0) AS bigint) AS patch_id,
  CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 6 WHEN 5 THEN 8 ELSE 9 END AS band,
  cast(l_partkey % 32 AS int) AS x, cast(l_quantity AS int) % 32 AS y, max(l_extendedprice) AS v
FROM lineitem GROUP BY 1, 2, 3, 4""")

_view("fx_levels", """
SELECT b.*, lo, hi, cast(floor((least(greatest(v, lo), hi) - lo) / greatest(hi - lo, 1e-9) * 255e0) AS int) AS level
FROM fx_bands b JOIN (
  SELECT patch_id, band, quantile_cont(v, 0.02e0) AS lo, quantile_cont(v, 0.98e0) AS hi FROM fx_bands GROUP BY 1, 2) q USING (patch_id, band)""",
      "fx_bands")

_view("fx_actions", """
SELECT o_orderkey AS tile_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'downlink_now' WHEN '2-HIGH' THEN 'flag_for_review'
    WHEN '3-MEDIUM' THEN 'request_higher_resolution' WHEN '5-LOW' THEN 'discard' ELSE 'request_neighbor_tile' END AS gold_action,
  CASE WHEN o_orderkey % 23 = 0 THEN '<unparseable>' WHEN o_orderkey % 29 = 0 THEN 'abort'
    WHEN o_orderkey % 4 = 0 THEN 'discard'
    WHEN o_orderpriority = '1-URGENT' THEN 'downlink_now' WHEN o_orderpriority = '2-HIGH' THEN 'flag_for_review'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'request_higher_resolution' WHEN o_orderpriority = '5-LOW' THEN 'discard'
    ELSE 'request_neighbor_tile' END AS pred_action
FROM orders""")

_view("fx_events", """
SELECT user_id AS pass_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_id,
  event_id % 12 AS tile_no,
  CASE event_type WHEN 'view' THEN 'tile_arrived' WHEN 'click' THEN 'vlm_done' WHEN 'error' THEN 'agent_thinking'
    WHEN 'purchase' THEN 'agent_decided' ELSE 'budget_update' END AS event, value
FROM events""")

_view("fx_raw_outputs", """
SELECT event_id,
  CASE event_id % 8
    WHEN 0 THEN '<|tool_call_start|>[downlink_now(reason="two clear pits")]<|tool_call_end|> done<|im_end|>'
    WHEN 1 THEN '<|tool_call_start|>[request_neighbor_tile(direction="east", reason="plume")]<|tool_call_end|>'
    WHEN 2 THEN 'I would discard this tile'
    WHEN 3 THEN '<|tool_call_start|>[discard(]<|tool_call_end|>'
    WHEN 4 THEN '<|tool_call_start|>[launch(reason="x")]<|tool_call_end|>'
    WHEN 5 THEN 'Answer: {"action": " Flag ", "reason": "small"} ok'
    WHEN 6 THEN '{"action": "explode"}'
    ELSE '{"action": "downlink", ' END AS raw
FROM events""")



def _literal(text: str | None) -> str:
    """Control characters and quotes as DuckDB writes them."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_view("fx_call_cases", "VALUES " + ",\n  ".join(
    f"({k}, {', '.join(_literal(x) for x in case)})" for k, case in enumerate(CASES)))

_view("fx_calls", f"""
SELECT event_id, event_id % {LONG_EVERY} = 4 AS long, replace(c.text, '{{id}}', cast(event_id AS varchar)) AS raw,
  c.action, c.tool, replace(c.reason, '{{id}}', cast(event_id AS varchar)) AS reason, c.direction, c.outcome
FROM events JOIN fx_call_cases AS c(k, text, action, tool, reason, direction, outcome) ON k = event_id % {len(CASES)}""", "fx_call_cases")

_view("fx_text_pairs", """
SELECT doc_id, lang, text AS gold, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, ' (the|de|la|die|el) ', ' ', 'g')
  WHEN doc_id % 3 = 1 THEN replace(text, ' and ', ' or ') ELSE lower(text) END AS pred FROM documents""")

_view("fx_sites", """
SELECT l_suppkey AS site_id, l_linenumber AS ring_no,
  -3e0 + cast(l_partkey % 300 AS double) / 100e0 AS lon, 4e0 + l_quantity / 10e0 AS lat,
  CASE l_suppkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'empty' WHEN 2 THEN 'fetch_error' ELSE NULL END AS status
FROM lineitem""")

_view("fx_paths", """
SELECT 'scenes/' || year || '/' || kind || '_AB_' || patch_id || '_' || year || CASE WHEN patch_id % 13 = 5 THEN '.txt' ELSE '.tif' END AS path
FROM (SELECT patch_id, year, unnest(['IMAGE', 'MASK']) AS kind FROM fx_patches)
WHERE NOT (kind = 'MASK' AND patch_id % 11 = 3 AND year = 2022)""", "fx_patches")

_view("fx_index", r"""
SELECT path, cast(regexp_extract(path, '_(\d+)_(2016|2022)\.tif$', 1) AS bigint) AS patch_num,
  cast(regexp_extract(path, '_(\d+)_(2016|2022)\.tif$', 2) AS int) AS year,
  CASE WHEN contains(path, 'IMAGE') THEN 'image' ELSE 'mask' END AS kind
FROM fx_paths WHERE ends_with(path, '.tif')""", "fx_paths")

_view("fx_splits", """
SELECT patch_id AS patch_num, year,
  CASE WHEN patch_id % 5 = 0 THEN 'test' WHEN patch_id % 17 = 0 OR patch_id % 19 = 0 THEN 'train' WHEN patch_id % 10 < 7 THEN 'train'
       WHEN patch_id % 10 < 9 OR year = 2016 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN patch_id % 23 = 0 OR patch_id % 3 = 0 THEN 0e0 ELSE cast(patch_id % 40 AS double) / 4e0 END AS class_percentage
FROM fx_patches""", "fx_patches")

_view("fx_roster", """
SELECT i.patch_num, i.year, i.path AS image, m.path AS mask, coalesce(s.split, 'train') AS split,
  coalesce(s.class_percentage, 0e0) AS class_percentage, coalesce(s.class_percentage, 0e0) > 0 AS is_positive
FROM (SELECT * FROM fx_index WHERE kind = 'image') i JOIN (SELECT * FROM fx_index WHERE kind = 'mask') m USING (patch_num, year)
LEFT JOIN fx_splits s USING (patch_num, year)""", "fx_index", "fx_splits")


def with_views(names: list[str], body: str) -> str:
    """``WITH`` clause of the named views and everything they need, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body
