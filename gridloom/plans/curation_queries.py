"""Queries on rosters, samples, training records, sites and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions.text import action_to_tool
from gridloom.operators import curation as C, dataset as D, messages as T, raster as R, sites as Z
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import Fixtures
from gridloom.plans.raster_queries import describe_sql
from gridloom.plans.tile_queries import detected, labelled
from gridloom.session import scratch_path, settle
from gridloom.sources import files as S

# --------------------------------------------------------------------------- files and rosters


def splits(fx: Fixtures) -> DataFrame:
    return S.clean_splits(fx.split_rows())


@query("read_splits", "SELECT patch_num, year, split, class_percentage FROM fx_splits", "fx_splits")
def read_splits(fx):
    """Split files written per year, repeats in a later file, then read back."""
    rows = fx.split_rows().withColumn("year", F.regexp_extract("patch_name", r"_(\d{4})(?:\.tif)?$", 1))
    paths = []
    for turn in (0, 1):
        for year in ("2016", "2022", ""):
            path = scratch_path(fx.spark, "splits")
            rows.filter((F.col("_row") == turn) & (F.col("year") == year)).select("patch_name", "split", "class_percentage").write.option(
                "ignoreLeadingWhiteSpace", False
            ).csv(path, header=True)
            paths.append(path)
    return S.read_splits(fx.spark, paths)


@query("clean_splits", "SELECT patch_num, year, split, class_percentage FROM fx_splits", "fx_splits")
def clean_splits(fx):
    return splits(fx)


@query("index_patch_files", "SELECT path, patch_num, year, kind FROM fx_index", "fx_index")
def index_patch_files(fx):
    return S.index_patch_files(fx.patch_paths())


def roster(fx: Fixtures) -> DataFrame:
    index = S.index_patch_files(fx.patch_paths())
    return C.build_roster(index.filter("kind = 'image'"), index.filter("kind = 'mask'"), splits(fx))


@query("build_roster", "SELECT * FROM fx_roster", "fx_roster")
def build_roster(fx):
    return roster(fx)


@query("unpaired_images", """
SELECT patch_num, year, path FROM fx_index i WHERE kind = 'image' AND NOT EXISTS (SELECT 1 FROM fx_index m WHERE m.kind = 'mask' AND m.patch_num = i.patch_num AND m.year = i.year)""", "fx_index")
def unpaired_images(fx):
    index = S.index_patch_files(fx.patch_paths())
    return C.unpaired_images(index.filter("kind = 'image'"), index.filter("kind = 'mask'")).select("patch_num", "year", "path")


_PAIRS = """SELECT a.patch_num, a.split AS split_before, b.split AS split_after, a.split = b.split AS same_split
FROM fx_roster a JOIN fx_roster b ON a.patch_num = b.patch_num AND a.year = 2016 AND b.year = 2022"""


@query("pair_years", _PAIRS, "fx_roster")
def pair_years(fx):
    return C.pair_years(roster(fx))


@query("paired_test_patches", f"SELECT patch_num FROM ({_PAIRS}) WHERE split_before = 'test' AND split_after = 'test'", "fx_roster")
def paired_test_patches(fx):
    return C.pair_years(roster(fx)).filter("split_before = 'test' AND split_after = 'test'").select("patch_num")


@query("complete_patches", "SELECT patch_num FROM (SELECT DISTINCT patch_num, year, kind FROM fx_index) GROUP BY 1 HAVING count(*) = 4", "fx_index")
def complete_patches(fx):
    return C.complete_patches(S.index_patch_files(fx.patch_paths()))


@query("years_in_common", """
SELECT patch_num FROM fx_splits WHERE year = 2016 INTERSECT SELECT patch_num FROM fx_splits WHERE year = 2022""", "fx_splits")
def years_in_common(fx):
    s = splits(fx)
    return s.filter("year = 2016").select("patch_num").intersect(s.filter("year = 2022").select("patch_num"))


@query("pending_items", """
SELECT o_orderkey AS tile_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 4)""")
def pending_items(fx):
    done = fx.table("lineitem").select(F.col("l_orderkey").alias("tile_id"), F.col("l_linenumber").cast("string").alias("kind"))
    return C.pending(fx.table("orders").select(F.col("o_orderkey").alias("tile_id")), done, "tile_id", ["1", "2", "3", "4"])


@query("already_done", """
SELECT o_orderkey AS tile_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def already_done(fx):
    done = fx.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("tile_id"))
    return fx.table("orders").select(F.col("o_orderkey").alias("tile_id")).join(done, "tile_id", "left_anti")


# --------------------------------------------------------------------------- sampling


@query("stratified_split", """
SELECT tile_id, gold_action, CASE WHEN rn <= CASE WHEN n >= 2 THEN greatest(1, round_even(n * 0.2e0, 0)) ELSE 0 END THEN 'eval' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY gold_action ORDER BY md5('42|' || tile_id), tile_id) AS rn, count(*) OVER (PARTITION BY gold_action) AS n FROM fx_actions)""", "fx_actions")
def stratified_split(fx):
    return C.stratified_split(fx.actions(), ["gold_action"], "tile_id").select("tile_id", "gold_action", "split")


@query("oversampled", """
SELECT tile_id, gold_action, unnest(range(1, 1 + CASE WHEN n >= t THEN 1 ELSE t // n + CASE WHEN rn <= t % n THEN 1 ELSE 0 END END)) AS copy
FROM (SELECT *, row_number() OVER (PARTITION BY gold_action ORDER BY md5('43|' || tile_id), tile_id) AS rn, count(*) OVER (PARTITION BY gold_action) AS n,
  (SELECT count(*) // 4 FROM fx_actions) AS t FROM fx_actions)""", "fx_actions")
def oversampled(fx):
    target = fx.actions().agg(F.floor(F.count(F.lit(1)) / 4).alias("t")).first()["t"]
    return C.oversample(fx.actions(), ["gold_action"], target, "tile_id").select("tile_id", "gold_action", "copy")


@query("repeated_singles", """
SELECT patch_id, year, unnest(range(1, CASE WHEN pit_count = 1 AND split = 'train' THEN 4 ELSE 2 END)) AS copy FROM fx_stats""", "fx_stats")
def repeated_singles(fx):
    t = R.patch_totals(R.components(fx.mask(), within_block=True), fx.patches())
    times = F.when((F.col("pit_count") == 1) & (F.col("split") == "train"), K.SINGLE_COMPONENT_COPIES).otherwise(1)
    return C.repeat_rows(t, times).select("patch_id", "year", "copy")


_NEG = """
SELECT tile_id, gold_action FROM fx_actions WHERE gold_action IN ('downlink_now') OR tile_id % 10 = 0
UNION ALL SELECT tile_id, gold_action FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || tile_id), tile_id) AS rn FROM fx_actions WHERE gold_action <> 'downlink_now' AND tile_id % 10 <> 0)
WHERE rn <= 2 * (SELECT count(*) FROM fx_actions WHERE gold_action = 'downlink_now' AND tile_id % 10 <> 0)"""


@query("downsampled_negatives", _NEG, "fx_actions")
def downsampled_negatives(fx):
    return C.downsample_negatives(fx.actions(), F.col("gold_action") == "downlink_now", "tile_id", only=F.col("tile_id") % 10 != 0).select("tile_id", "gold_action")


@query("systematic_sample", """
SELECT tile_id FROM (SELECT tile_id, row_number() OVER (ORDER BY tile_id) - 1 AS i, greatest(1, count(*) OVER () // 8) AS step FROM fx_actions) WHERE i % step = 0 AND i // step < 8""", "fx_actions")
def systematic_sample(fx):
    return C.systematic_sample(fx.actions().select("tile_id"), ["tile_id"], F.floor(F.col("tile_id") / 4096))


@query("sample_per_class", """
SELECT tile_id, gold_action FROM (SELECT *, row_number() OVER (PARTITION BY gold_action ORDER BY md5('42|' || tile_id), tile_id) AS rn FROM fx_actions) WHERE rn <= 125""", "fx_actions")
def sample_per_class(fx):
    return C.sample_per_group(fx.actions(), ["gold_action"], 125, "tile_id").select("tile_id", "gold_action")


@query("shuffled_rows", "SELECT tile_id, row_number() OVER (ORDER BY md5('44|' || tile_id), tile_id) AS position FROM fx_actions", "fx_actions")
def shuffled_rows(fx):
    return C.shuffle_rank(fx.actions().select("tile_id"), "tile_id")


@query("numbered_samples", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS sample_no FROM conversations")
def numbered_samples(fx):
    return C.number_samples(fx.table("conversations").select("conv_id", "turn"), ["conv_id", "turn"], F.floor(F.col("conv_id") / 256))


@query("first_rows_per_split", """
SELECT patch_id, year, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY patch_id, year) AS rn FROM fx_patches) WHERE rn <= 3""", "fx_patches")
def first_rows_per_split(fx):
    return C.first_rows(fx.patches(), ["split"], ["patch_id", "year"], 3).select("patch_id", "year", "split")


@query("held_out_range", "SELECT coord_id FROM (SELECT 'u' || lpad(cast(tile_id AS varchar), cast(greatest(4, length(cast(tile_id AS varchar))) AS int), '0') AS coord_id FROM fx_tiles) WHERE coord_id BETWEEN 'u0190' AND 'u0249'", "fx_tiles")
def held_out_range(fx):
    digits = F.col("o_orderkey").cast("string")
    ids = fx.table("orders").select(F.concat(F.lit("u"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0"))).alias("coord_id"))
    return ids.filter(F.col("coord_id").between("u0190", "u0249"))


@query("mixed_tasks", """
SELECT task, count(*) AS n FROM (SELECT 'action' AS task FROM fx_actions UNION ALL SELECT 'description' FROM documents UNION ALL SELECT 'grounding' FROM fx_patches) GROUP BY 1""", "fx_actions fx_patches")
def mixed_tasks(fx):
    parts = [
        fx.actions().select(F.lit("action").alias("task"), F.col("tile_id").alias("id")),
        fx.table("documents").select(F.lit("description").alias("task"), F.col("doc_id").alias("id")),
        fx.patches().select(F.lit("grounding").alias("task"), F.col("patch_id").alias("id")),
    ]
    return C.mix_tasks(*parts).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("appended_eval", """
SELECT tile_id, 0 AS source_no FROM fx_actions WHERE gold_action = 'discard' UNION ALL SELECT tile_id, 1 FROM fx_actions WHERE gold_action = 'flag_for_review'""", "fx_actions")
def appended_eval(fx):
    a = fx.actions()
    return C.append_eval(
        a.filter("gold_action = 'discard'").select("tile_id"), a.filter("gold_action = 'flag_for_review'").select("tile_id")
    )


# --------------------------------------------------------------------------- training records

_CONV = """
, m AS (SELECT conv_id, turn, text, 'img_' || conv_id || '_' || turn % 3 || '.png' AS a, 'img_' || conv_id || '_' || (turn + 1) % 3 || '.png' AS b,
  CASE turn % 5 WHEN 0 THEN 'downlink_now' WHEN 1 THEN 'flag_for_review' WHEN 2 THEN 'request_neighbor_tile' ELSE 'discard' END AS tool FROM conversations)"""


def chat_records(fx: Fixtures) -> DataFrame:
    """A decision record per conversation turn."""
    c, turn = F.col("conv_id").cast("string"), F.col("turn")

    def image(shift: int):
        return F.concat(F.lit("img_"), c, F.lit("_"), ((turn + shift) % 3).cast("string"), F.lit(".png"))

    tool = F.when(turn % 5 == 0, "downlink_now").when(turn % 5 == 1, "flag_for_review").when(turn % 5 == 2, "request_neighbor_tile").otherwise("discard")
    target = T.action_target(tool, F.when(turn % 5 == 2, "north"), F.col("text"))
    return fx.table("conversations").select(
        "conv_id", "turn", T.to_messages([image(0), image(1)], F.col("text"), target, F.lit("adjudicate")).alias("messages")
    )


@query("message_round_trip", "WITH RECURSIVE zz AS (SELECT 1)" + _CONV + """
SELECT 3 AS n_turns, a AS first_image, md5(text) AS text_digest, tool, count(*) AS n FROM m GROUP BY 1, 2, 3, 4""")
def message_round_trip(fx):
    """Records written as JSON lines and read back."""
    path = scratch_path(fx.spark, "records")
    S.write_messages(chat_records(fx).select("messages"), path)
    back = S.read_messages(fx.spark, path)
    m = F.col("messages")
    return back.select(
        F.size(m).alias("n_turns"), m[1]["content"][0]["image"].alias("first_image"), F.md5(T.user_text(m)).alias("text_digest"),
        T.gold_action(m).alias("tool"),
    ).groupBy("n_turns", "first_image", "text_digest", "tool").agg(F.count(F.lit(1)).alias("n"))


@query("gold_actions", "WITH RECURSIVE zz AS (SELECT 1)" + _CONV + "SELECT conv_id, turn, tool AS gold_action FROM m")
def gold_actions(fx):
    return chat_records(fx).select("conv_id", "turn", T.gold_action(F.col("messages")).alias("gold_action"))


@query("referenced_images", "WITH RECURSIVE zz AS (SELECT 1)" + _CONV + """
SELECT path FROM (SELECT a AS path FROM m UNION SELECT b FROM m) WHERE path NOT LIKE '%\\_2.png' ESCAPE '\\'""")
def referenced_images(fx):
    c = F.col("conv_id").cast("string")
    listing = fx.table("conversations").select(F.concat(F.lit("img_"), c, F.lit("_"), (F.col("turn") % 3).cast("string"), F.lit(".png")).alias("path"))
    every = listing.unionByName(fx.table("conversations").select(F.explode(F.array(*[F.concat(F.lit("img_"), c, F.lit(f"_{i}.png")) for i in (0, 1)])).alias("path")))
    return T.referenced_images(chat_records(fx), every.filter(~F.col("path").endswith("_2.png")).distinct())


def full_roster(fx: Fixtures) -> DataFrame:
    """Patches with a positivity flag from their mask."""
    has = fx.mask().select("patch_id", "year").distinct().withColumn("has", F.lit(True))
    return fx.patches().join(has, ["patch_id", "year"], "left").select(
        "patch_id", "year", "w", "h", "split", (F.coalesce("has", F.lit(False)) & (F.col("patch_id") % 3 != 0)).alias("is_positive"),
        F.concat_ws("-", F.col("patch_id").cast("string"), F.col("year").cast("string")).alias("patch_key"),
    )


def _records_sql(preset: str) -> str:
    """All records of a preset: components moved by each symmetry, told and boxed anew, numbered, named and shuffled."""
    p = D.PRESETS[preset]
    bank = "change" if p.sentences == "change" else "static"
    label = "fx_change_label" if p.change else "fx_mask_label"
    names = list(enumerate(R.SYMMETRIES[p.symmetries]))
    moved = [" ".join(f"WHEN '{n}' THEN {R.D4[n][i].replace('M', '31')}" for _, n in names) for i in (0, 1)]
    if p.change:
        sel = f"""sel AS (SELECT a.patch_num AS patch_id, 2022 AS year, b.split, true AS pos FROM fx_roster a JOIN fx_roster b ON a.patch_num = b.patch_num AND a.year = 2016 AND b.year = 2022 AND a.split = b.split
  WHERE a.patch_num IN (SELECT patch_num FROM (SELECT DISTINCT patch_num, year, kind FROM fx_index) GROUP BY 1 HAVING count(*) = 4))"""
    else:
        sel = """r AS (SELECT patch_id, year, split, px > 0 AND patch_id % 3 <> 0 AS pos, patch_id || '-' || year AS patch_key FROM fx_stats),
neg AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || patch_key), patch_key) AS rn FROM r WHERE split = 'train' AND NOT pos),
sel AS (SELECT patch_id, year, split, pos FROM r WHERE split <> 'train' OR pos
  UNION ALL SELECT patch_id, year, split, pos FROM neg WHERE rn <= 2 * (SELECT count(*) FROM r WHERE split = 'train' AND pos))"""
    view, told = describe_sql(T.BANKS[bank], p.change, "vstats", f"'{preset}-42|' || patch_id || '|' || year || '|' || variant", "patch_id, year, variant, pit_count, px, total_area_ha")
    if p.sentences == "plain":
        told = f"CASE WHEN pit_count = 0 THEN '{K.NEGATIVE_SENTENCES[0]}' ELSE pit_count || ' active excavation ' || CASE WHEN pit_count = 1 THEN 'pit' ELSE 'pits' END || ' visible, total affected area approximately ' || printf('%.2f', total_area_ha) || ' hectares.' END"
    elif p.sentences == "presence":
        told = f"CASE WHEN px > 0 THEN '{K.PRESENT_SENTENCE}' ELSE '{K.ABSENT_SENTENCE}' END"
    box = K.NEW_BOX_LABEL if p.change else K.BOX_LABEL
    heads = [f"{preset}_"] if len(p.composites) == 1 else [f"{preset}_{c}_" for c in p.composites]
    images = " || ' ' || ".join(f"'{h}' || lpad(cast(sample_no AS varchar), cast(greatest({p.digits}, length(cast(sample_no AS varchar))) AS int), '0') || '.png'" for h in heads)
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    tasks = f"SELECT sample_no, split, 'description' AS task, images, md5({quote(p.description_prompt)}) AS prompt, description AS target FROM named"
    if p.grounding:
        tasks += f" UNION ALL SELECT sample_no, split, 'grounding', images, md5({quote(p.grounding_prompt)}), boxes FROM named"
    place = "CASE WHEN split = 'train' THEN row_number() OVER (PARTITION BY split ORDER BY md5('44|' || task || '-' || sample_no), task || '-' || sample_no) END" if p.mixed else "cast(NULL AS bigint)"
    return f"""
, {sel},
v AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in names)}) AS t(variant_no, variant)),
sv AS (SELECT sel.*, v.* FROM sel JOIN v ON split = 'train' OR variant_no = 0),
vpx AS (SELECT patch_id, year, variant, l.comp AS c0, CASE variant {moved[0]} END AS x, CASE variant {moved[1]} END AS y FROM sv JOIN {label} l USING (patch_id, year)),
vcomps AS (SELECT patch_id, year, variant, min(cast(y AS bigint) * 4294967296 + x) AS comp, count(*) AS px, round_even(min(x) / 32e0, 4) AS bx1, round_even(min(y) / 32e0, 4) AS by1,
  round_even((max(x) + 1) / 32e0, 4) AS bx2, round_even((max(y) + 1) / 32e0, 4) AS by2 FROM vpx GROUP BY patch_id, year, variant, c0 HAVING count(*) >= {p.min_pixels}),
vsum AS (SELECT patch_id, year, variant, count(*) AS n, cast(sum(px) AS bigint) AS px, min(px * 0.01e0) AS min_ha, max(px * 0.01e0) AS max_ha,
  max((bx1 + bx2) / 2e0) - min((bx1 + bx2) / 2e0) AS sx, max((by1 + by2) / 2e0) - min((by1 + by2) / 2e0) AS sy,
  first({{'x1': bx1, 'y1': by1, 'x2': bx2, 'y2': by2}} ORDER BY px DESC, comp) AS big,
  string_agg('{{"label": "{box}", "bbox": [' || bx1 || ', ' || by1 || ', ' || bx2 || ', ' || by2 || ']}}', ', ' ORDER BY comp) AS boxes FROM vcomps GROUP BY 1, 2, 3),
vstats AS (SELECT sv.*, coalesce(n, 0) AS pit_count, coalesce(px, 0) AS px, coalesce(px, 0) * 0.01e0 AS total_area_ha, coalesce(min_ha, 0e0) AS min_area_ha, coalesce(max_ha, 0e0) AS max_area_ha,
  coalesce(sx, 0e0) AS span_x, coalesce(sy, 0e0) AS span_y, big, '[' || coalesce(boxes, '') || ']' AS boxes FROM sv LEFT JOIN vsum USING (patch_id, year, variant)){view},
said AS (SELECT patch_id, year, variant, {told} AS description FROM d),
copied AS (SELECT vstats.*, unnest(range(1, 1 + CASE WHEN split = 'train' AND pos AND pit_count = 1 THEN {p.single_copies} ELSE 1 END)) AS copy FROM vstats),
lit AS (SELECT copied.*, unnest(range(0, CASE WHEN split = 'train' THEN {2 if p.jitter else 1} ELSE 1 END)) AS light_no FROM copied),
numbered AS (SELECT lit.*, description, row_number() OVER (ORDER BY split <> 'train', patch_id, year, variant_no, copy, light_no) - 1 AS sample_no FROM lit JOIN said USING (patch_id, year, variant)),
named AS (SELECT *, {images} AS images FROM numbered{'' if p.first is None else f' WHERE sample_no < {p.first}'}),
tasks AS ({tasks})
SELECT *, {place} AS position FROM tasks"""


def records(fx: Fixtures, preset: str) -> DataFrame:
    p = D.PRESETS[preset]
    chosen = D.change_roster(roster(fx), S.index_patch_files(fx.patch_paths()), fx.patches()) if p.change else D.select_patches(full_roster(fx))
    samples = D.build_samples(fx.mask(), chosen, p, within_block=True)
    return D.to_records(D.number_images(samples, p), p)


def _register_preset(preset: str) -> None:
    @query(f"dataset_{preset}", _records_sql(preset), "fx_stats fx_change_label fx_roster fx_index" if D.PRESETS[preset].change else "fx_stats fx_mask_label")
    def build(fx: Fixtures) -> DataFrame:
        m = F.col("messages")
        images = F.array_join(F.filter(F.transform(m[0]["content"], lambda c: c["image"]), lambda i: i.isNotNull()), " ")
        return records(fx, preset).select("sample_no", "split", "task", images.alias("images"), F.md5(T.user_text(m)).alias("prompt"), T.last_text(m).alias("target"), "position")


for _preset in D.PRESETS:
    _register_preset(_preset)


@query("build_report", _records_sql("v10").replace("SELECT *, CASE WHEN split", ", all_tasks AS (SELECT *, CASE WHEN split") + """)
SELECT count(*) FILTER (split = 'train' AND task = 'description') AS train_desc, count(*) FILTER (split <> 'train' AND task = 'description') AS eval_desc,
  count(*) FILTER (split = 'train' AND task = 'grounding') AS train_grounding, count(*) FILTER (split = 'train') AS multitask,
  count(DISTINCT target) FILTER (split = 'train' AND task = 'description') AS unique_descriptions FROM all_tasks""", "fx_stats fx_mask_label")
def build_report(fx):
    return D.build_report(records(fx, "v10"))


@query("distinct_descriptions", """
, d AS (SELECT pit_count, CASE WHEN pit_count = 0 THEN 'none' ELSE pit_count || ' active excavation ' || CASE WHEN pit_count = 1 THEN 'pit' ELSE 'pits' END
  || ' visible, total affected area approximately ' || printf('%.2f', total_area_ha) || ' hectares.' END AS t, split FROM fx_stats)
SELECT split, count(DISTINCT t) AS n FROM d GROUP BY 1""", "fx_stats")
def distinct_descriptions(fx):
    """Exact distinct sentences per split."""
    from gridloom.functions.text import plain_description

    t = R.patch_totals(R.components(fx.mask(), within_block=True), fx.patches())
    said = t.select("split", plain_description(F.col("pit_count"), F.col("total_area_ha")).alias("t"))
    return said.groupBy("split").agg(F.count_distinct("t").alias("n"))


@query("decision_records", """
SELECT tile_id, '{"action": "' || CASE action WHEN 'downlink' THEN 'downlink_now' WHEN 'flag' THEN 'flag_for_review' ELSE 'discard' END
  || '", "reason": "' || description || '"' || CASE WHEN tile_id % 7 = 0 THEN ', "direction": "east"' ELSE '' END || '}' AS target, 'u' || tile_id || '/swir.png' AS second_image FROM fx_decided""", "fx_decided")
def decision_records(fx):
    t = labelled(fx).withColumn("coord_id", F.concat(F.lit("u"), F.col("tile_id").cast("string"))).select(
        "coord_id", "tile_id", F.col("decision").alias("action"), F.col("description").alias("reason"), F.when(F.col("tile_id") % 7 == 0, "east").alias("direction"), "message"
    )
    m = F.col("messages")
    return D.label_records(t, F.col("message"), True, F.lit("adjudicate")).select(
        "tile_id", T.last_text(m).alias("target"), m[1]["content"][1]["image"].alias("second_image")
    )


@query("tile_manifest", """
SELECT 'u' || tile_id AS coord_id, 'cache/u' || tile_id || '/rgb.png' AS rgb_path, 'cache/u' || tile_id || '/context.json' AS context_path,
  substr(repeat(description || ' ', 20), 1, 200) AS user_message_preview FROM fx_decided""", "fx_decided")
def tile_manifest(fx):
    """Written as JSON lines and read back."""
    described = detected(fx).select(
        F.concat(F.lit("u"), F.col("tile_id").cast("string")).alias("coord_id"), "lon", "lat", F.lit("mining").alias("stratum"),
        F.concat(F.col("n_boxes").cast("string"), F.lit(" boxes on tile "), F.col("tile_id").cast("string")).alias("d"),
    )
    path = scratch_path(fx.spark, "manifest")
    S.write_json(S.build_manifest(described, F.repeat(F.concat("d", F.lit(" ")), 20)), path)
    return fx.spark.read.schema("coord_id string, rgb_path string, context_path string, user_message_preview string").json(path)


@query("label_round_trip", """
SELECT stratum, action, count(*) AS n, round(sum(lon), 4) AS lon, count(cloud) AS n_cloud, cast(sum(boxes) AS bigint) AS boxes FROM (
  SELECT CASE WHEN n_boxes >= 3 THEN 'cluster' WHEN n_boxes >= 1 THEN 'mixed' ELSE 'forest' END AS stratum, action, lon, cloud_cover AS cloud, n_boxes AS boxes FROM fx_decided) GROUP BY 1, 2""", "fx_decided")
def label_round_trip(fx):
    """Nested label records written as JSON lines and read back with their schema."""
    t = labelled(fx)
    rows = t.select(
        F.concat(F.lit("u"), F.col("tile_id").cast("string")).alias("coord_id"), "lon", "lat", F.col("scene_hint").alias("stratum"),
        F.struct(
            F.col("remaining_kb").cast("int").alias("budget_remaining_kb"), F.lit(512).alias("budget_total_kb"), F.col("prior").cast("int").alias("prior_tiles_downlinked"),
            "cloud_cover", F.col("captured_at").cast("string").alias("captured_at"), F.lit("known area").alias("mission_priors"),
            F.map_from_entries(F.array(F.struct(F.lit("self"), F.struct("action", "boxes", "scene_hint")))).alias("neighbor_summary"),
        ).alias("context"),
        F.struct(F.col("decision").alias("action"), F.col("description").alias("reason")).alias("label"),
    )
    path = scratch_path(fx.spark, "labels")
    S.write_json(rows, path)
    back = S.read_labels(fx.spark, path)
    return back.groupBy("stratum", F.col("label.action").alias("action")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("lon"), 4).alias("lon"), F.count("context.cloud_cover").alias("n_cloud"),
        F.sum(F.try_element_at("context.neighbor_summary", F.lit("self"))["boxes"]).alias("boxes"),
    )


# --------------------------------------------------------------------------- sites and metadata


@query("site_centroids", """
SELECT site_id, round_even(avg(lon), 5) AS lng, round_even(avg(lat), 5) AS lat, count(*) AS n_vertices FROM fx_sites GROUP BY 1""", "fx_sites")
def site_centroids(fx):
    return Z.site_centroids(fx.site_rows())


@query("site_counts", """
SELECT CASE WHEN status IS NULL OR status IN ('unverified', 'fetch_error') THEN 'unverified' ELSE status END AS bucket, count(*) AS n FROM (SELECT DISTINCT site_id, status FROM fx_sites) GROUP BY 1""", "fx_sites")
def site_counts(fx):
    return Z.site_counts(fx.site_rows().select("site_id", "status").distinct())


@query("site_status", """
SELECT tile_id, CASE WHEN NOT image_available THEN 'fetch_error' WHEN n_boxes > 0 THEN 'confirmed' ELSE 'empty' END AS status FROM fx_conf""", "fx_conf")
def site_status(fx):
    return detected(fx).select("tile_id", Z.site_status(F.col("image_available"), F.col("n_boxes")).alias("status"))


@query("geojson_sites", """
SELECT cast(o_orderkey AS varchar) AS site_id, round_even((4 * lon + 1e0 + 2e0) / 4, 5) AS lng, round_even((4 * lat + 0.5e0) / 4, 5) AS lat, 4 AS n_vertices
FROM (SELECT o_orderkey, o_orderkey % 5 AS k, -3e0 + (o_custkey % 300) / 100e0 AS lon, 4e0 + (o_orderkey % 50) / 10e0 AS lat FROM orders) WHERE k <> 4""")
def geojson_sites(fx):
    """Polygons, multi-polygons and skipped shapes as GeoJSON lines, read back to centroids."""
    lon, lat = F.lit(-3.0) + (F.col("o_custkey") % 300) / 100.0, F.lit(4.0) + (F.col("o_orderkey") % 50) / 10.0

    def point(dx: float, dy: float):
        return F.concat(F.lit("["), (lon + dx).cast("string"), F.lit(", "), (lat + dy).cast("string"), F.lit("]"))

    pts = F.concat_ws(", ", point(0.0, 0.0), point(1.0, 0.0), point(2.0, 0.5), point(0.0, 0.0))
    k = F.col("o_orderkey") % 5
    ring = F.concat(F.lit("[["), pts, F.lit("]]"))
    shape = F.when(k == 4, F.concat(F.lit('{"type": "LineString", "coordinates": ['), pts, F.lit("]}"))).when(
        k == 3, F.concat(F.lit('{"type": "MultiPolygon", "coordinates": ['), ring, F.lit(", [[]]]}"))
    ).otherwise(F.concat(F.lit('{"type": "Polygon", "coordinates": '), ring, F.lit("}")))
    line = F.concat(F.lit('{"type": "Feature", "properties": {"id": "'), F.col("o_orderkey").cast("string"), F.lit('"}, "geometry": '), shape, F.lit("}"))
    path = scratch_path(fx.spark, "geojson")
    fx.table("orders").select(line.alias("value")).write.text(path)
    return Z.site_centroids(S.read_site_vertices(fx.spark, path))


@query("tile_metadata", """
SELECT event_id, coalesce(event_id % 4 <> 1, true) AS image_available, CASE WHEN event_id % 3 = 0 AND event_id % 6 <> 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 6 = 0 THEN NULL ELSE value END AS cloud_cover,
  CASE WHEN event_id % 7 = 0 OR event_id % 5 <> 0 THEN 1.28e0 ELSE 2.5e0 END AS size_km, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'sim' END AS source
FROM (SELECT event_id, value FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, value FROM events WHERE false)
UNION ALL SELECT event_id, true, NULL, 1.28e0, NULL FROM events WHERE event_id % 7 = 0""")
def tile_metadata(fx):
    """Header JSON with gaps, wrong types and broken text."""
    k = F.col("event_id")
    cloud = F.when(k % 6 == 0, '"unknown"').when(k % 3 == 0, "null").otherwise(F.col("value").cast("string"))
    text = F.concat(
        F.lit('{"cloud_cover": '), cloud, F.lit(', "source": "sim"'), F.when(k % 4 == 1, ', "image_available": false').otherwise(""),
        F.when(k % 5 == 0, ', "size_km": 2.5').otherwise(""), F.lit("}"),
    )
    raw = fx.table("events").select("event_id", F.when(k % 7 == 0, F.lit("{broken")).otherwise(text).alias("metadata"))
    return S.normalize_tile_metadata(raw).select("event_id", "image_available", "cloud_cover", "size_km", "source")


# --------------------------------------------------------------------------- unified presets


# Rows per task of the published multi-task sets, and the oversampling target is K.OVERSAMPLE_TARGET.
UNIFIED_TASKS = {"v4": {"description": 500, "grounding": 500, "action": 327}, "v4_1": {"description": 125, "grounding": 125, "action": 327}}


def _actions(fx: Fixtures) -> DataFrame:
    """Decided tiles with the tool call to learn, without and with its reason."""
    t = labelled(fx).withColumn("coord_id", F.concat(F.lit("u"), F.col("tile_id").cast("string"))).select(
        "coord_id", F.col("decision").alias("action"), F.col("description").alias("reason"), F.lit(None).cast("string").alias("direction")
    )
    tool = action_to_tool(F.col("action"))
    return t.select("coord_id", "action", T.action_target(tool, F.col("direction")).alias("short"), T.action_target(tool, F.col("direction"), F.col("reason")).alias("long"))


_ACTIONS = """
, acts AS (SELECT 'u' || tile_id AS coord_id, action, CASE action WHEN 'downlink' THEN 'downlink_now' WHEN 'flag' THEN 'flag_for_review' ELSE 'discard' END AS tool, description FROM fx_decided),
told AS (SELECT coord_id, action, '{"action": "' || tool || '"}' AS short, '{"action": "' || tool || '", "reason": "' || description || '"}' AS long FROM acts),
parted AS (SELECT *, CASE WHEN rn <= CASE WHEN n >= 2 THEN greatest(1, round_even(n * 0.2e0, 0)) ELSE 0 END THEN 'eval' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY md5('42|' || coord_id), coord_id) AS rn, count(*) OVER (PARTITION BY action) AS n FROM told))
"""


@query("dataset_unified_v1", _ACTIONS + "SELECT coord_id, split, long AS target FROM parted", "fx_decided")
def dataset_unified_v1(fx):
    """Actions with reasons, split by class."""
    return C.stratified_split(_actions(fx), ["action"], "coord_id").select("coord_id", "split", F.col("long").alias("target"))


@query("dataset_unified_v2", _ACTIONS + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY md5('43|' || coord_id), coord_id) AS r2, count(*) OVER (PARTITION BY action) AS n2 FROM parted WHERE split = 'train')
SELECT coord_id, split, short AS target, unnest(range(1, 1 + CASE WHEN n2 >= {K.OVERSAMPLE_TARGET} THEN 1 ELSE {K.OVERSAMPLE_TARGET} // n2 + CASE WHEN r2 <= {K.OVERSAMPLE_TARGET} % n2 THEN 1 ELSE 0 END END)) AS copy FROM ranked
UNION ALL SELECT coord_id, split, short, 1 FROM parted WHERE split = 'eval'""", "fx_decided")
def dataset_unified_v2(fx):
    """Actions alone, rare classes of the training part oversampled."""
    parted = settle(C.stratified_split(_actions(fx), ["action"], "coord_id"), "parted")
    train = C.oversample(parted.filter("split = 'train'"), ["action"], K.OVERSAMPLE_TARGET, "coord_id")
    both = train.unionByName(parted.filter("split = 'eval'").withColumn("copy", F.lit(1).cast("long")))
    return both.select("coord_id", "split", F.col("short").alias("target"), "copy")


def _unified_sql(version: str) -> str:
    limits = " ".join(f"WHEN '{t}' THEN {n}" for t, n in UNIFIED_TASKS[version].items())
    view, told = describe_sql(T.BANKS["static"], False, "fx_stats", "'42|' || patch_id || '|' || year", "patch_id, year")
    return _ACTIONS + f"""{view},
boxes AS (SELECT p.patch_id, p.year, '[' || coalesce(string_agg('{{"label": "mining_pit", "bbox": [' || nx1 || ', ' || ny1 || ', ' || nx2 || ', ' || ny2 || ']}}', ', ' ORDER BY comp), '') || ']' AS target
  FROM fx_patches p LEFT JOIN (SELECT patch_id, year, comp, cast(round_even(x1 / 32e0, 4) AS varchar) AS nx1, cast(round_even(y1 / 32e0, 4) AS varchar) AS ny1,
    cast(round_even(x2 / 32e0, 4) AS varchar) AS nx2, cast(round_even(y2 / 32e0, 4) AS varchar) AS ny2 FROM fx_mask_comps) c USING (patch_id, year) GROUP BY 1, 2),
pool AS (SELECT 'action' AS task, coord_id AS key, short AS target FROM told
  UNION ALL SELECT 'description', patch_id || '-' || year, {told} FROM d
  UNION ALL SELECT 'grounding', patch_id || '-' || year, target FROM boxes),
picked AS (SELECT task, key, target FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('42|' || key), key) AS rn FROM pool) WHERE rn <= CASE task {limits} END)
SELECT *, row_number() OVER (ORDER BY md5('44|' || task || '-' || key), task || '-' || key) AS position FROM picked"""


def _register_unified(version: str) -> None:
    @query(f"dataset_unified_{version}", _unified_sql(version), "fx_decided fx_stats fx_patches fx_mask_comps")
    def build(fx: Fixtures) -> DataFrame:
        """A sample of each of three tasks, shuffled together."""
        comps = settle(R.components(fx.mask(), within_block=True), "components")
        patch = F.concat_ws("-", F.col("patch_id").cast("string"), F.col("year").cast("string")).alias("key")
        told = T.describe(R.patch_totals(comps, fx.patches()), ["patch_id", "year"]).select(F.lit("description").alias("task"), patch, F.col("description").alias("target"))
        boxed = R.patch_stats(comps, fx.patches()).select(F.lit("grounding").alias("task"), patch, T.grounding_target(F.col("bboxes")).alias("target"))
        acted = _actions(fx).select(F.lit("action").alias("task"), F.col("coord_id").alias("key"), F.col("short").alias("target"))
        parts = [C.sample_per_group(settle(rows, task), ["task"], UNIFIED_TASKS[version][task], "key") for task, rows in (("action", acted), ("description", told), ("grounding", boxed))]
        mixed = C.mix_tasks(*parts).withColumn("_id", F.concat_ws("-", "task", "key"))
        return C.shuffle_rank(settle(mixed, "mixed"), "_id").drop("_id")


for _version in UNIFIED_TASKS:
    _register_unified(_version)
