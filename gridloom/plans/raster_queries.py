"""Queries on masks, bands and pixel scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions.text import plain_description, presence_description
from gridloom.operators import curation as C, dataset as D, evaluate as E, messages as T, raster as R
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import Fixtures
from gridloom.plans.tile_queries import as_it_came, valid
from gridloom.streaming import events as ST

_COMPS = "SELECT patch_id, year, comp, px, x1, y1, x2, y2 FROM {}"


@query("components", _COMPS.format("fx_mask_comps"), "fx_mask_comps")
def components(fx):
    return R.components(fx.mask(), within_block=True)


@query("components_stitched", _COMPS.format("fx_mask_comps"), "fx_mask_comps")
def components_stitched(fx):
    """Blocks of eight pixels on patches of 32: nearly every component crosses a seam."""
    return R.components(fx.mask(), block=8)


@query("components_dense", _COMPS.format("fx_mask_dense_comps"), "fx_mask_dense_comps")
def components_dense(fx):
    return R.components(fx.dense_mask(), within_block=True)


@query("components_dense_stitched", _COMPS.format("fx_mask_dense_comps"), "fx_mask_dense_comps")
def components_dense_stitched(fx):
    return R.components(fx.dense_mask(), block=8)


@query("components_filtered", """
SELECT patch_id, year, count(*) FILTER (px >= 5) AS n_kept, count(*) FILTER (px < 5) AS n_filtered FROM fx_mask_comps GROUP BY 1, 2""", "fx_mask_comps")
def components_filtered(fx):
    small = F.col("px") < K.MIN_COMPONENT_PIXELS
    return R.components(fx.mask(), within_block=True).groupBy("patch_id", "year").agg(
        F.sum(F.when(small, 0).otherwise(1)).alias("n_kept"), F.sum(F.when(small, 1).otherwise(0)).alias("n_filtered")
    )


@query("patch_stats", """
SELECT p.patch_id, p.year, count(c.comp) AS pit_count, round(cast(coalesce(sum(px), 0) AS double) * 0.01e0, 6) AS total_area_ha,
  coalesce(string_agg(px || ':' || printf('%.4f', round_even(x1 / 32e0, 4)) || ':' || printf('%.4f', round_even(y2 / 32e0, 4)), ' ' ORDER BY comp), '') AS listed
FROM fx_patches p LEFT JOIN (SELECT * FROM fx_mask_comps WHERE px >= 5) c USING (patch_id, year) GROUP BY 1, 2""", "fx_patches fx_mask_comps")
def patch_stats(fx):
    s = R.patch_stats(R.components(fx.mask(), min_pixels=K.MIN_COMPONENT_PIXELS, within_block=True), fx.patches())
    each = F.zip_with(
        "areas_ha", "bboxes",
        lambda a, b: F.concat(F.round(a / 0.01).cast("int").cast("string"), F.lit(":"), F.format_string("%.4f", b["x1"]), F.lit(":"), F.format_string("%.4f", b["y2"])),
    )
    return s.select("patch_id", "year", "pit_count", F.round("total_area_ha", 6).alias("total_area_ha"), F.array_join(each, " ").alias("listed"))


@query("largest_components", """
SELECT patch_id, year, comp, px, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, year ORDER BY px DESC, comp) AS rn FROM fx_mask_comps) WHERE rn = 1""", "fx_mask_comps")
def largest_components(fx):
    return R.largest(R.components(fx.mask(), within_block=True))


@query("single_or_multi", """
SELECT CASE pit_count WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multi' END AS kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM fx_stats GROUP BY 1""", "fx_stats")
def single_or_multi(fx):
    t = R.patch_totals(R.components(fx.mask(), within_block=True), fx.patches())
    kind = F.when(F.col("pit_count") == 0, "none").when(F.col("pit_count") == 1, "single").otherwise("multi")
    counted = t.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / counted.agg(F.sum("n").alias("s")).scalar(), 6))


# --------------------------------------------------------------------------- masks


@query("change_mask", """
SELECT patch_id, x, y FROM fx_mask WHERE year = 2022 EXCEPT SELECT patch_id, x, y FROM fx_mask WHERE year = 2016""", "fx_mask")
def change_mask(fx):
    return R.change_mask(fx.mask())


def _change_classes(fx: Fixtures) -> DataFrame:
    """Class per patch: one grouping to pixels, one to patches."""
    y = F.col("year")
    px = fx.mask().groupBy("patch_id", "x", "y").agg(F.max(y == 2016).alias("before"), F.max(y == 2022).alias("after"))
    has = px.groupBy("patch_id").agg(
        F.max("before").alias("h16"), F.max("after").alias("h22"), F.max(F.col("after") & ~F.col("before")).alias("new")
    )
    patches = fx.patches().groupBy("patch_id").agg(F.max(F.when(y == 2016, F.col("split"))).alias("s16"), F.max(F.when(y == 2022, F.col("split"))).alias("s22"))
    return patches.join(has, "patch_id", "left").fillna(False).withColumn("change", C.change_class(F.col("h16"), F.col("h22"), F.col("new")))


@query("change_classes", """
, h AS (SELECT p.patch_id, max(p.split) FILTER (p.year = 2016) AS s16, max(p.split) FILTER (p.year = 2022) AS s22,
  coalesce(bool_or(m.year = 2016), false) AS h16, coalesce(bool_or(m.year = 2022), false) AS h22 FROM fx_patches p
  LEFT JOIN (SELECT DISTINCT patch_id, year FROM fx_mask) m ON m.patch_id = p.patch_id GROUP BY 1),
n AS (SELECT DISTINCT patch_id FROM (SELECT patch_id, x, y FROM fx_mask WHERE year = 2022 EXCEPT SELECT patch_id, x, y FROM fx_mask WHERE year = 2016))
SELECT CASE WHEN n.patch_id IS NOT NULL THEN 'new' WHEN h16 AND h22 THEN 'stable' WHEN h16 THEN 'reclaimed' ELSE 'none' END AS change,
  count(*) AS n, count(*) FILTER (s16 <> s22) AS n_split_mismatch FROM h LEFT JOIN n USING (patch_id) GROUP BY 1""", "fx_patches fx_mask")
def change_classes(fx):
    return _change_classes(fx).groupBy("change").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("s16") != F.col("s22"), 1).otherwise(0)).alias("n_split_mismatch")
    )


_PRED_PX = """
, small AS (SELECT cast(floor(tile_id / 128e0) AS bigint) AS patch_id, year, x1, x1 + (x2 - x1) / 8e0 AS x2, y1, y1 + (y2 - y1) / 8e0 AS y2 FROM fx_valid),
span AS (SELECT patch_id, year,
  cast(greatest(0, least(32, round_even(x1 * 32, 0))) AS int) AS ax, cast(greatest(0, least(32, round_even(x2 * 32, 0))) AS int) AS bx,
  cast(greatest(0, least(32, round_even(y1 * 32, 0))) AS int) AS ay, cast(greatest(0, least(32, round_even(y2 * 32, 0))) AS int) AS by_ FROM small WHERE patch_id % 5 <> 1),
pred AS (SELECT DISTINCT patch_id, year, x, unnest(range(ay, by_)) AS y FROM (SELECT *, unnest(range(ax, bx)) AS x FROM span WHERE bx > ax AND by_ > ay))
"""


def predicted_boxes(fx: Fixtures) -> DataFrame:
    """All valid boxes at an eighth of their size, as predictions for their patch and year; one patch in five has none."""
    placed = valid(fx).withColumn("patch_id", F.floor(F.col("tile_id") / 128)).filter("patch_id % 5 <> 1")
    return placed.withColumns({"x2": F.col("x1") + (F.col("x2") - F.col("x1")) / 8, "y2": F.col("y1") + (F.col("y2") - F.col("y1")) / 8})


def _pred_bits(fx: Fixtures) -> DataFrame:
    return R.box_bits(predicted_boxes(fx), F.lit(32), F.lit(32), R.YEARLY)


@query("rasterize_boxes", _PRED_PX + "SELECT patch_id, year, x, y FROM pred", "fx_valid")
def rasterize_boxes(fx):
    return R.rasterize(predicted_boxes(fx), F.lit(32), F.lit(32), R.YEARLY)


_CONF = _PRED_PX + """,
conf AS (SELECT p.patch_id, p.year, p.split, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, 1024 - coalesce(tp, 0) - coalesce(fp, 0) - coalesce(fn, 0) AS tn
  FROM fx_patches p LEFT JOIN (
    SELECT coalesce(a.patch_id, b.patch_id) AS patch_id, coalesce(a.year, b.year) AS year, count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS tp,
      count(*) FILTER (b.x IS NULL) AS fp, count(*) FILTER (a.x IS NULL) AS fn
    FROM pred a FULL OUTER JOIN fx_mask b ON a.patch_id = b.patch_id AND a.year = b.year AND a.x = b.x AND a.y = b.y GROUP BY 1, 2) c USING (patch_id, year))
"""


def confusion(fx: Fixtures) -> DataFrame:
    return R.confusion_of_bits(_pred_bits(fx), R.mask_bits(fx.mask(), R.YEARLY), fx.patches(), R.YEARLY)


@query("pixel_confusion", _CONF + "SELECT patch_id, year, tp, fp, fn, tn FROM conf", "fx_valid fx_mask fx_patches")
def pixel_confusion(fx):
    return confusion(fx).select("patch_id", "year", "tp", "fp", "fn", "tn")


_SCORES = """
  round_even(sum(tp) / cast(sum(tp + fp + fn) AS double), 4) AS pixel_iou, round_even(sum(tp) / cast(sum(tp + fp) AS double), 4) AS pixel_precision,
  round_even(sum(tp) / cast(sum(tp + fn) AS double), 4) AS pixel_recall, round_even(2 * sum(tp) / cast(sum(2 * tp + fp + fn) AS double), 4) AS pixel_sdc_f1,
  round_even(sum(tp + tn) / cast(sum(tp + fp + fn + tn) AS double), 4) AS pixel_accuracy,
  round_even(avg(tp / cast(tp + fp + fn AS double)) FILTER (tp + fp + fn > 0), 4) AS mean_per_patch_iou """


@query("pixel_scores", _CONF + f"SELECT split, {_SCORES} FROM conf GROUP BY split", "fx_valid fx_mask fx_patches")
def pixel_scores(fx):
    return E.pixel_metrics(confusion(fx), ["split"])


@query("stream_pixel_scores", _CONF + f"SELECT split, {_SCORES} FROM conf GROUP BY split", "fx_valid fx_mask fx_patches")
def stream_pixel_scores(fx):
    """Predictions and truth as two streams that are joined as they arrive, truth some minutes late."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long") + F.pmod(F.xxhash64("patch_id", "year"), F.lit(36_000))

    def side(bits: DataFrame, name: str) -> DataFrame:
        rows = bits.groupBy(*R.YEARLY, "y", "word").agg(F.bit_or("bits").alias("bits")).groupBy(*R.YEARLY).agg(F.collect_list(F.struct("y", "word", "bits")).alias(name))
        none = F.expr("cast(array() as array<struct<y:bigint,word:bigint,bits:bigint>>)")
        return fx.patches().join(rows, list(R.YEARLY), "left").withColumn(name, F.coalesce(F.col(name).cast("array<struct<y:bigint,word:bigint,bits:bigint>>"), none))

    pred = side(_pred_bits(fx), "pred").withColumn("ts", at.cast("timestamp"))
    truth = side(R.mask_bits(fx.mask(), R.YEARLY), "truth").select(*R.YEARLY, "truth", (at + F.pmod(F.xxhash64("year", "patch_id"), F.lit(1500))).cast("timestamp").alias("ts"))
    joined = ST.stream_confusion(as_it_came(fx, pred, F.unix_timestamp("ts")), as_it_came(fx, truth, F.unix_timestamp("ts")), R.YEARLY)
    return E.pixel_metrics(ST.run_available(joined, "append", "confusion"), ["split"])


@query("presence_scores", _CONF + """,
b AS (SELECT DISTINCT patch_id, year, true AS has FROM span),
j AS (SELECT tp + fn > 0 AS truth, coalesce(has, false) AS pred FROM conf LEFT JOIN b USING (patch_id, year))
SELECT count(*) FILTER (truth AND pred) AS patch_tp, count(*) FILTER (NOT truth AND pred) AS patch_fp, count(*) FILTER (truth AND NOT pred) AS patch_fn,
  count(*) FILTER (NOT truth AND NOT pred) AS patch_tn, round_even(count(*) FILTER (truth = pred) / cast(count(*) AS double), 4) AS patch_accuracy FROM j""", "fx_valid fx_mask fx_patches")
def presence_scores(fx):
    boxes = predicted_boxes(fx).select("patch_id", "year").distinct().withColumn("has", F.lit(True))
    joined = confusion(fx).join(boxes, ["patch_id", "year"], "left").fillna(False, ["has"])
    return E.presence_metrics(joined, F.col("tp") + F.col("fn") > 0, F.col("has"))


@query("box_ceiling", """
, cells AS (SELECT DISTINCT patch_id, year, x, unnest(range(y1, y2)) AS y FROM (SELECT patch_id, year, y1, y2, unnest(range(x1, x2)) AS x FROM fx_mask_comps)),
conf AS (SELECT p.patch_id, p.year, p.split, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(nt, 0) - coalesce(tp, 0) AS fn,
  1024 - coalesce(np, 0) - coalesce(nt, 0) + coalesce(tp, 0) AS tn FROM fx_patches p
  LEFT JOIN (SELECT patch_id, year, count(*) AS np FROM cells GROUP BY 1, 2) USING (patch_id, year)
  LEFT JOIN (SELECT patch_id, year, count(*) AS nt FROM fx_mask GROUP BY 1, 2) USING (patch_id, year)
  LEFT JOIN (SELECT patch_id, year, count(*) AS tp FROM cells JOIN fx_mask USING (patch_id, year, x, y) GROUP BY 1, 2) USING (patch_id, year))
""" + f"SELECT split, {_SCORES} FROM conf GROUP BY split", "fx_mask_comps fx_patches")
def box_ceiling(fx):
    return E.pixel_metrics(R.box_ceiling(fx.mask(), fx.patches(), within_block=True), ["split"])


@query("model_comparison", _CONF + """,
shifted AS (SELECT m.patch_id, m.year, p.split FROM fx_mask m JOIN fx_patches p USING (patch_id, year)),
base AS (SELECT round_even(sum(tp) / cast(sum(tp + fp + fn) AS double), 4) AS b1, round_even(sum(tp + tn) / cast(sum(tp + fp + fn + tn) AS double), 4) AS b2 FROM conf WHERE split = 'train'),
cand AS (SELECT round_even(sum(tp) / cast(sum(tp + fp + fn) AS double), 4) AS c1, round_even(sum(tp + tn) / cast(sum(tp + fp + fn + tn) AS double), 4) AS c2 FROM conf WHERE split = 'test')
SELECT metric, base, candidate, round(candidate - base, 4) AS delta, CASE WHEN candidate > base THEN '↑' WHEN candidate < base THEN '↓' ELSE '=' END AS arrow,
  CASE WHEN metric = 'pixel_iou' THEN CASE WHEN candidate > base THEN 'candidate' ELSE 'base' END END AS winner
FROM (SELECT 'pixel_iou' AS metric, b1 AS base, c1 AS candidate FROM base, cand UNION ALL SELECT 'pixel_accuracy', b2, c2 FROM base, cand)""", "fx_valid fx_mask fx_patches")
def model_comparison(fx):
    """Two score rows side by side; here the two splits stand for two models."""
    scores = E.pixel_metrics(confusion(fx), ["split"])
    return E.compare_models(scores.filter("split = 'train'"), scores.filter("split = 'test'"), ("pixel_iou", "pixel_accuracy"))


@query("running_iou", _CONF + """
SELECT patch_id, year, round(sum(tp) OVER w / cast(greatest(1, sum(tp + fp + fn) OVER w) AS double), 6) AS iou FROM conf
WINDOW w AS (ORDER BY patch_id, year)""", "fx_valid fx_mask fx_patches")
def running_iou(fx):
    union = F.col("tp") + F.col("fp") + F.col("fn")
    out = E.running_ratio(confusion(fx), ["patch_id", "year"], F.floor(F.col("patch_id") / 64), F.col("tp"), union, "iou")
    return out.select("patch_id", "year", F.round("iou", 6).alias("iou"))


# --------------------------------------------------------------------------- rendering


@query("augmented_masks", """
, v AS (SELECT patch_id, year, x, y, unnest(['orig', 'hflip', 'vflip', 'hvflip', 'rot90', 'rot270', 'rot90_hflip', 'rot90_vflip']) AS variant FROM fx_mask)
SELECT patch_id, year, variant, CASE variant WHEN 'orig' THEN x WHEN 'hflip' THEN 31 - x WHEN 'vflip' THEN x WHEN 'hvflip' THEN 31 - x WHEN 'rot90' THEN y WHEN 'rot270' THEN 31 - y WHEN 'rot90_hflip' THEN 31 - y ELSE y END AS x,
  CASE variant WHEN 'orig' THEN y WHEN 'hflip' THEN y WHEN 'vflip' THEN 31 - y WHEN 'hvflip' THEN 31 - y WHEN 'rot90' THEN 31 - x WHEN 'rot270' THEN x WHEN 'rot90_hflip' THEN 31 - x ELSE x END AS y FROM v""", "fx_mask")
def augmented_masks(fx):
    return R.augment(fx.mask().distinct(), F.lit(32)).select("patch_id", "year", "variant", "x", "y")


@query("augmented_components", """
SELECT v.variant, count(*) AS n, cast(sum(px) AS bigint) AS px FROM fx_mask_comps CROSS JOIN (SELECT unnest(['orig', 'hflip', 'vflip', 'hvflip', 'rot90', 'rot270', 'rot90_hflip', 'rot90_vflip']) AS variant) v GROUP BY 1""", "fx_mask_comps")
def augmented_components(fx):
    """Boxes are taken anew from every transformed mask."""
    comps = R.components(fx.mask(), within_block=True, symmetries="d4", size=F.lit(32))
    return comps.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("px").alias("px"))


@query("band_bounds", """
SELECT patch_id, band, round(quantile_cont(v, 0.02e0), 4) AS lo, round(quantile_cont(v, 0.98e0), 4) AS hi FROM fx_bands GROUP BY 1, 2""", "fx_bands")
def band_bounds(fx):
    return R.band_bounds(fx.bands()).select("patch_id", "band", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


_LEVELS = "SELECT patch_id, band, x, y, level FROM fx_levels"


@query("stretched_bands", _LEVELS, "fx_levels")
def stretched_bands(fx):
    return R.stretch(fx.bands()).select("patch_id", "band", "x", "y", "level")


@query("stretched_scenes", _LEVELS, "fx_levels")
def stretched_scenes(fx):
    """The same of pixels that lie scattered over many partitions."""
    return R.stretch(fx.bands().repartition(16)).select("patch_id", "band", "x", "y", "level")


@query("false_colour", """
SELECT patch_id, x, y, max(level) FILTER (band = 9) AS r, max(level) FILTER (band = 8) AS g, max(level) FILTER (band = 6) AS b
FROM fx_levels WHERE band IN (9, 8, 6) GROUP BY 1, 2, 3""", "fx_levels")
def false_colour(fx):
    return R.composite(fx.bands(), K.SWIR_BANDS)


def true_colour(fx: Fixtures) -> DataFrame:
    return R.composite(fx.bands(), K.RGB_BANDS).fillna(0, ["r", "g", "b"])


_RGB = """
, rgb AS (SELECT patch_id, x, y, coalesce(max(level) FILTER (band = 2), 0) AS r, coalesce(max(level) FILTER (band = 1), 0) AS g, coalesce(max(level) FILTER (band = 0), 0) AS b
FROM fx_levels WHERE band IN (2, 1, 0) GROUP BY 1, 2, 3)"""


@query("true_colour", _RGB + "SELECT * FROM rgb", "fx_levels")
def true_colour_query(fx):
    return true_colour(fx)


def _lum(r: str, g: str, b: str) -> str:
    return f"floor(({r} * 19595 + {g} * 38470 + {b} * 7471 + 32768) / 65536e0)"


def _clip(e: str) -> str:
    return f"floor(greatest(0e0, least(255e0, {e})))"


@query("jittered_images", _RGB + f"""
, f AS (SELECT *, 0.8e0 + 0.4e0 * cast('0x' || substr(h, 1, 8) AS bigint) / 4294967296e0 AS fb, 0.8e0 + 0.4e0 * cast('0x' || substr(h, 9, 8) AS bigint) / 4294967296e0 AS fc,
  0.8e0 + 0.4e0 * cast('0x' || substr(h, 17, 8) AS bigint) / 4294967296e0 AS fs FROM (SELECT *, md5('rgb|' || patch_id) AS h FROM rgb)),
a AS (SELECT patch_id, x, y, fc, fs, {_clip('r * fb')} AS r, {_clip('g * fb')} AS g, {_clip('b * fb')} AS b FROM f),
m AS (SELECT *, floor(avg({_lum('r', 'g', 'b')}) OVER (PARTITION BY patch_id) + 0.5e0) AS mean FROM a),
c AS (SELECT patch_id, x, y, fs, {_clip('mean + (r - mean) * fc')} AS r, {_clip('mean + (g - mean) * fc')} AS g, {_clip('mean + (b - mean) * fc')} AS b FROM m),
l AS (SELECT *, {_lum('r', 'g', 'b')} AS lum FROM c)
SELECT patch_id, x, y, cast({_clip('lum + (r - lum) * fs')} AS int) AS r, cast({_clip('lum + (g - lum) * fs')} AS int) AS g, cast({_clip('lum + (b - lum) * fs')} AS int) AS b FROM l""", "fx_levels")
def jittered_images(fx):
    return R.jitter(true_colour(fx), "rgb")


_RENDERED = f"""
, swir AS (SELECT patch_id, x, y, coalesce(max(level) FILTER (band = 9), 0) AS r, coalesce(max(level) FILTER (band = 8), 0) AS g, coalesce(max(level) FILTER (band = 6), 0) AS b
  FROM fx_levels WHERE band IN (9, 8, 6) GROUP BY 1, 2, 3),
every AS (SELECT 'rgb' AS kind, * FROM rgb UNION ALL SELECT 'swir', * FROM swir),
moved AS (SELECT kind, patch_id * 4 + no AS sample_no, CASE WHEN no IN (1, 3) THEN 31 - x ELSE x END AS x, CASE WHEN no IN (2, 3) THEN 31 - y ELSE y END AS y, r, g, b FROM every, range(4) AS v(no)),
f AS (SELECT *, 0.8e0 + 0.4e0 * cast('0x' || substr(h, 1, 8) AS bigint) / 4294967296e0 AS fb, 0.8e0 + 0.4e0 * cast('0x' || substr(h, 9, 8) AS bigint) / 4294967296e0 AS fc,
  0.8e0 + 0.4e0 * cast('0x' || substr(h, 17, 8) AS bigint) / 4294967296e0 AS fs FROM (SELECT *, md5(kind || '|' || sample_no) AS h FROM moved WHERE sample_no % 4 IN (1, 2))),
a AS (SELECT kind, sample_no, x, y, fc, fs, {_clip('r * fb')} AS r, {_clip('g * fb')} AS g, {_clip('b * fb')} AS b FROM f),
m AS (SELECT *, floor(avg({_lum('r', 'g', 'b')}) OVER (PARTITION BY kind, sample_no) + 0.5e0) AS mean FROM a),
c AS (SELECT kind, sample_no, x, y, fs, {_clip('mean + (r - mean) * fc')} AS r, {_clip('mean + (g - mean) * fc')} AS g, {_clip('mean + (b - mean) * fc')} AS b FROM m),
l AS (SELECT *, {_lum('r', 'g', 'b')} AS lum FROM c),
px AS (SELECT kind, sample_no, x, y, {_clip('lum + (r - lum) * fs')} AS r, {_clip('lum + (g - lum) * fs')} AS g, {_clip('lum + (b - lum) * fs')} AS b FROM l
  UNION ALL SELECT kind, sample_no, x, y, r, g, b FROM moved WHERE sample_no % 4 NOT IN (1, 2))
SELECT kind, sample_no, count(*) AS n, cast(sum(r * (x + 1)) AS bigint) AS sx, cast(sum(g * (y + 1)) AS bigint) AS sy, cast(sum(b) AS bigint) AS sb FROM px GROUP BY 1, 2"""


@query("rendered_images", _RGB + _RENDERED, "fx_levels")
def rendered_images(fx):
    """Flipped and partly jittered sample images of every patch, as checksums."""
    names = R.SYMMETRIES["flips"]
    rows = fx.bands().select("patch_id").distinct().select("patch_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("no", "variant"))
    numbered = rows.withColumn("sample_no", F.col("patch_id") * 4 + F.col("no")).withColumn("light", F.when(F.col("no").isin(1, 2), "jitter").otherwise("orig"))
    px = D.render_images(fx.bands(), numbered, F.lit(32), ("rgb", "swir"))
    return px.groupBy("kind", "sample_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * (F.col("x") + 1)).alias("sx"), F.sum(F.col("g") * (F.col("y") + 1)).alias("sy"), F.sum("b").alias("sb")
    )


@query("imagery_issues", _RGB + """
SELECT patch_id, round(avg((r + g + b = 0)::int), 6) AS black_share, avg((r + g + b = 0)::int) >= 0.002e0 AS partial FROM rgb GROUP BY 1""", "fx_levels")
def imagery_issues(fx):
    return R.imagery_issue(true_colour(fx), frac=0.002).withColumn("black_share", F.round("black_share", 6))


# --------------------------------------------------------------------------- descriptions


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in items) + "]"


def describe_sql(bank: tuple, change: bool, source: str, hashed: str, keep: str) -> tuple[str, str]:
    """A view ``d`` of slot values over ``source`` with the columns ``keep``, and the sentence made from it."""
    draw = f"cast('0x' || substr(md5({hashed}), 1, 8) AS bigint)"
    area = "greatest((big.x2 - big.x1) * (big.y2 - big.y1), 0e0)"
    h = "CASE WHEN (big.x1 + big.x2) / 2 < 0.33e0 THEN 'left' WHEN (big.x1 + big.x2) / 2 > 0.67e0 THEN 'right' ELSE 'center' END"
    v = "CASE WHEN (big.y1 + big.y2) / 2 < 0.33e0 THEN 'upper' WHEN (big.y1 + big.y2) / 2 > 0.67e0 THEN 'lower' ELSE 'middle' END"
    tight = "clustered together" if change else "clustered together in a tight group"
    sentence = f"CASE WHEN pit_count = 0 THEN {_sql_list(bank[0])}[{draw} % {len(bank[0])} + 1] WHEN pit_count = 1 THEN {_sql_list(bank[1])}[{draw} % {len(bank[1])} + 1] ELSE {_sql_list(bank[2])}[{draw} % {len(bank[2])} + 1] END"
    body = "sentence"
    for slot in ("count", "size", "region", "area", "adjacency", "phrase"):
        body = f"replace({body}, '{{{slot}}}', coalesce(s_{slot}, ''))"
    tidy = f"replace(replace(regexp_replace({body}, ' {{2,}}', ' ', 'g'), ' .', '.'), ' ,', ',')"
    view = f"""
, d AS (SELECT {keep}, {sentence} AS sentence, cast(pit_count AS varchar) AS s_count,
  CASE WHEN {area} < 0.01e0 THEN 'very small' WHEN {area} < 0.04e0 THEN 'small' WHEN {area} < 0.15e0 THEN 'moderate' WHEN {area} < 0.40e0 THEN 'large' ELSE 'very large' END AS s_size,
  CASE WHEN {h} = 'center' AND {v} = 'middle' THEN 'center of the scene' WHEN {h} = 'center' THEN {v} || ' portion of the scene' WHEN {v} = 'middle' THEN {h} || ' side of the scene' ELSE {v} || '-' || {h} || ' quadrant' END AS s_region,
  printf('%.2f', total_area_ha) AS s_area,
  CASE WHEN pit_count < 2 THEN '' WHEN span_x + span_y < 0.3e0 THEN '{tight}' WHEN span_x + span_y < 0.7e0 THEN 'spread across a connected area' ELSE 'scattered across the scene' END AS s_adjacency,
  CASE WHEN pit_count <= 1 THEN '' WHEN (max_area_ha - min_area_ha) / greatest(total_area_ha / pit_count, 1e-9) < 0.4e0 THEN 'with roughly uniform pit sizes'
    WHEN (max_area_ha - min_area_ha) / greatest(total_area_ha / pit_count, 1e-9) < 1.5e0 THEN 'with mixed pit sizes' ELSE 'dominated by one or two large pits among smaller satellite pits' END AS s_phrase
  FROM {source})"""
    return view, tidy if not change else body


def _describe_sql(bank: tuple, change: bool, source: str = "fx_stats") -> str:
    view, sentence = describe_sql(bank, change, source, "'42|' || patch_id || '|' || year", "patch_id, year")
    return f"{view}\nSELECT patch_id, year, {sentence} AS description FROM d"


@query("descriptions", _describe_sql(T.BANKS["static"], False), "fx_stats")
def descriptions(fx):
    totals = R.patch_totals(R.components(fx.mask(), within_block=True), fx.patches())
    return T.describe(totals, ["patch_id", "year"]).select("patch_id", "year", "description")


@query("change_descriptions", _describe_sql(T.BANKS["change"], True), "fx_stats")
def change_descriptions(fx):
    totals = R.patch_totals(R.components(fx.mask(), within_block=True), fx.patches())
    return T.describe(totals, ["patch_id", "year"], bank="change").select("patch_id", "year", "description")


@query("plain_descriptions", f"""
SELECT patch_id, year, CASE WHEN pit_count = 0 THEN '{K.NEGATIVE_SENTENCES[0]}' ELSE pit_count || ' active excavation ' || CASE WHEN pit_count = 1 THEN 'pit' ELSE 'pits' END
  || ' visible, total affected area approximately ' || printf('%.2f', total_area_ha) || ' hectares.' END AS plain,
  CASE WHEN px > 0 THEN '{K.PRESENT_SENTENCE}' ELSE '{K.ABSENT_SENTENCE}' END AS presence FROM fx_stats""", "fx_stats")
def plain_descriptions(fx):
    t = R.patch_totals(R.components(fx.mask(), within_block=True), fx.patches())
    return t.select(
        "patch_id", "year", plain_description(F.col("pit_count"), F.col("total_area_ha")).alias("plain"), presence_description(F.col("px")).alias("presence")
    )


@query("grounding_targets", """
SELECT p.patch_id, p.year, '[' || coalesce(string_agg('{"label": "mining_pit", "bbox": [' || nx1 || ', ' || ny1 || ', ' || nx2 || ', ' || ny2 || ']}', ', ' ORDER BY comp), '') || ']' AS target
FROM fx_patches p LEFT JOIN (SELECT patch_id, year, comp, cast(round_even(x1 / 32e0, 4) AS varchar) AS nx1, cast(round_even(y1 / 32e0, 4) AS varchar) AS ny1,
  cast(round_even(x2 / 32e0, 4) AS varchar) AS nx2, cast(round_even(y2 / 32e0, 4) AS varchar) AS ny2 FROM fx_mask_comps WHERE px >= 5) c USING (patch_id, year) GROUP BY 1, 2""", "fx_patches fx_mask_comps")
def grounding_targets(fx):
    s = R.patch_stats(R.components(fx.mask(), min_pixels=K.MIN_COMPONENT_PIXELS, within_block=True), fx.patches())
    return s.select("patch_id", "year", T.grounding_target(F.col("bboxes")).alias("target"))
