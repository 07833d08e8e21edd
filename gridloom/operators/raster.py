"""Rasters as tables: sparse masks, long band pixels, bit rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom import constants as K
from gridloom.functions.keyed import key_hash, uniform
from gridloom.functions.numbers import half_even
from gridloom.operators.graph import connected
from gridloom.operators.ranking import exact_quantiles
from gridloom.session import cut_lineage

BLOCK = 128
PATCH = ("patch_id",)
YEARLY = ("patch_id", "year")

# --------------------------------------------------------------------------- components

_COMPONENT = pa.struct([(n, pa.int32()) for n in ("root", "px", "x1", "y1", "x2", "y2")])
_SEAM = pa.struct([("side", pa.int32()), ("pos", pa.int32()), ("root", pa.int32())])
_LABELLED = (
    "struct<parts:array<struct<root:int,px:int,x1:int,y1:int,x2:int,y2:int>>,"
    "seam:array<struct<side:int,pos:int,root:int>>>"
)


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of every node: hook roots to smaller roots, then compress."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            upper = root[root]
            if np.array_equal(upper, root):
                break
            root = upper


def _linked(codes: np.ndarray, step: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted codes that differ by ``step``."""
    at = np.searchsorted(codes, codes + step)
    at[at == len(codes)] = 0
    hit = inside & (codes[at] == codes + step)
    return np.flatnonzero(hit), at[hit]


def _list_of(values: list[np.ndarray], kind: pa.StructType, group: np.ndarray, n_groups: int) -> pa.Array:
    offsets = np.zeros(n_groups + 1, dtype=np.int32)
    np.cumsum(np.bincount(group, minlength=n_groups), out=offsets[1:])
    fields = [pa.array(v.astype(np.int32)) for v in values]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(kind)))


#: Pixels labelled at once: a batch of many blocks is worked off in runs of so many, one block at least.
LABELLED_PIXELS = 1 << 18


def _runs(lists: pa.ListArray, most: int) -> list[tuple[int, int]]:
    """Spans of consecutive lists with ``most`` items or fewer in all, or a single list; one empty span where there is none."""
    ends = lists.offsets.to_numpy()
    spans, a = [], 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        spans.append((a, b))
        a = b
    return spans or [(0, 0)]


def _label_blocks(size: int):
    """Arrow function: pixel codes of many blocks at once to their components and border labels.

    A block holds at most ``size * size`` pixels, whatever the patch's extent. A worker's memory follows
    ``LABELLED_PIXELS``, not the number of blocks in a batch.
    """

    def label_some(cells: pa.Array) -> pa.Array:
        n_groups = len(cells)
        lengths = np.diff(cells.offsets.to_numpy())
        local = cells.flatten().to_numpy().astype(np.int64)
        group = np.repeat(np.arange(n_groups), lengths)
        codes = np.sort(group * (size * size) + local)
        group, local = codes // (size * size), codes % (size * size)
        x, y = local % size, local // size
        across, down = _linked(codes, 1, x < size - 1), _linked(codes, size, y < size - 1)
        root = _settle(len(codes), np.concatenate([across[0], down[0]]), np.concatenate([across[1], down[1]]))
        heads, member = np.unique(root, return_inverse=True)
        order = np.argsort(member, kind="stable")
        starts = np.flatnonzero(np.diff(member[order], prepend=-1))

        def over(how: np.ufunc, v: np.ndarray) -> np.ndarray:
            return how.reduceat(v[order], starts) if len(starts) else v[:0]

        parts = [
            local[heads], np.bincount(member, minlength=len(heads)),
            over(np.minimum, x), over(np.minimum, y), over(np.maximum, x) + 1, over(np.maximum, y) + 1,
        ]
        sides = [x == 0, x == size - 1, y == 0, y == size - 1]
        on = np.concatenate([np.flatnonzero(s) for s in sides])
        side = np.repeat(np.arange(4), [int(s.sum()) for s in sides])
        by_group = np.argsort(group[on], kind="stable")
        on, side = on[by_group], side[by_group]
        seam = [side, np.where(side < 2, y[on], x[on]), local[root[on]]]
        return pa.StructArray.from_arrays(
            [_list_of(parts, _COMPONENT, group[heads], n_groups), _list_of(seam, _SEAM, group[on], n_groups)],
            names=["parts", "seam"],
        )

    @F.arrow_udf(_LABELLED)
    def label(cells: pa.Array) -> pa.Array:
        cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
        return pa.concat_arrays([label_some(cells.slice(a, b - a)) for a, b in _runs(cells, LABELLED_PIXELS)])

    return label


def components(
    mask: DataFrame, keys: Sequence[str] = YEARLY, min_pixels: int = 1,
    block: int = BLOCK, within_block: bool = False, symmetries: str | None = None, size: Column | None = None,
) -> DataFrame:
    """4-connected components: ``keys…, comp, px, x1, y1, x2, y2`` (exclusive maxima).

    ``comp`` is the raster-first pixel as ``y << 32 | x``, so it orders components as a raster scan.
    Pixels are gathered per fixed-size block, never per patch. Where a mask spans several blocks the
    block results are stitched over their seams, so a scene of any extent, or a whole archive under
    one key, is labelled by the same call. ``within_block`` declares that no patch reaches beyond one
    block, which leaves the stitching out; a pixel that does so fails the job. With ``within_block`` every patch can be
    labelled once per symmetry of a square of ``size``, named by one more key ``variant``: as ``augment`` before, but
    pixels are gathered once and moved inside their row. ``size`` is the same for all patches, or made of ``keys``.
    """
    keys = list(keys)
    if symmetries and (not within_block or size is None):
        raise ValueError("symmetries need within_block and size")
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    bx, by = F.floor(x / block), F.floor(y / block)
    if within_block:
        beyond = F.raise_error(F.lit(f"within_block, but a pixel lies outside the first block of {block}")).cast("long")
        bx, by = (F.when(b == 0, F.lit(0).cast("long")).otherwise(beyond) for b in (bx, by))
    cells = (
        mask.select(*keys, bx.alias("_bx"), by.alias("_by"), x.alias("x"), y.alias("y"))
        .groupBy(*keys, "_bx", "_by")
        .agg(F.collect_set(((F.col("y") - F.col("_by") * block) * block + F.col("x") - F.col("_bx") * block).cast("int")).alias("_cells"))
    )
    if symmetries:
        cells = _moved(cells, symmetries, size, block, keys)
        keys.append("variant")
    several = not within_block
    labelled = cells.select(*keys, "_bx", "_by", _label_blocks(block)("_cells").alias("_l"))
    x0, y0 = F.col("_bx") * block, F.col("_by") * block

    def node(root: Column, ox: Column = x0, oy: Column = y0) -> Column:
        gx, gy = ox + root % block, oy + F.floor(root / block)
        return F.shiftleft(gy, 32) + gx

    if several:
        labelled = cut_lineage(labelled)
    parts = labelled.select(*keys, "_bx", "_by", F.explode("_l.parts").alias("p")).select(
        *keys, node(F.col("p.root")).alias("node"), F.col("p.px").cast("long").alias("px"),
        (x0 + F.col("p.x1")).alias("x1"), (y0 + F.col("p.y1")).alias("y1"),
        (x0 + F.col("p.x2")).alias("x2"), (y0 + F.col("p.y2")).alias("y2"),
    )
    if not several:
        found = parts.withColumnRenamed("node", "comp")
        return found.filter(F.col("px") >= min_pixels)
    seams = labelled.select(*keys, "_bx", "_by", F.explode("_l.seam").alias("s")).select(
        *keys, "_bx", "_by", F.col("s.side").alias("side"), F.col("s.pos").alias("pos"), node(F.col("s.root")).alias("node")
    )

    def facing(low: int, high: int, dx: int, dy: int) -> DataFrame:
        far = seams.filter(F.col("side") == high).select(
            *keys, (F.col("_bx") + dx).alias("_bx"), (F.col("_by") + dy).alias("_by"), "pos", F.col("node").alias("a")
        )
        near = seams.filter(F.col("side") == low).select(*keys, "_bx", "_by", "pos", F.col("node").alias("b"))
        return far.join(near, [*keys, "_bx", "_by", "pos"]).select(*keys, "a", "b")

    edges = facing(0, 1, 1, 0).unionByName(facing(2, 3, 0, 1))
    roots = connected(edges, keys)
    return (
        parts.join(roots, [*keys, "node"], "left")
        .groupBy(*keys, F.coalesce("root", "node").alias("comp"))
        .agg(
            F.sum("px").alias("px"), F.min("x1").alias("x1"), F.min("y1").alias("y1"),
            F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        )
        .filter(F.col("px") >= min_pixels)
    )


def normalized_box(w: Column, h: Column, places: int = 4) -> Column:
    return F.struct(
        half_even(F.col("x1") / w, places).alias("x1"), half_even(F.col("y1") / h, places).alias("y1"),
        half_even(F.col("x2") / w, places).alias("x2"), half_even(F.col("y2") / h, places).alias("y2"),
    )


def patch_totals(
    comps: DataFrame, patches: DataFrame, keys: Sequence[str] = YEARLY, ha_per_px: float = K.HECTARES_PER_PIXEL
) -> DataFrame:
    """One row per patch with mergeable figures only: counts, areas, centroid span, largest box.

    Nothing is collected, so patches with millions of components are safe.
    """
    keys = list(keys)
    boxed = comps.join(patches.select(*keys, "w", "h"), keys).withColumn("box", normalized_box(F.col("w"), F.col("h")))
    area = F.col("px") * F.lit(ha_per_px)
    cx, cy = (F.col("box.x1") + F.col("box.x2")) / 2.0, (F.col("box.y1") + F.col("box.y2")) / 2.0
    totals = boxed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pit_count"),
        F.sum("px").alias("px"),
        F.min(area).alias("min_area_ha"), F.max(area).alias("max_area_ha"),
        (F.max(cx) - F.min(cx)).alias("span_x"), (F.max(cy) - F.min(cy)).alias("span_y"),
        F.max_by("box", F.struct(F.col("px"), (-F.col("comp")).alias("first"))).alias("largest"),
    )
    return (
        patches.join(totals, keys, "left")
        .withColumn("total_area_ha", F.coalesce(F.col("px"), F.lit(0)) * F.lit(ha_per_px))
        .fillna(0, ["pit_count", "px"])
        .fillna(0.0, ["min_area_ha", "max_area_ha", "span_x", "span_y"])
    )


def patch_stats(
    comps: DataFrame, patches: DataFrame, keys: Sequence[str] = YEARLY, ha_per_px: float = K.HECTARES_PER_PIXEL
) -> DataFrame:
    """Per patch ``pit_count, areas_ha, bboxes, total_area_ha``; the lists in raster order.

    The lists are the output format; ``patch_totals`` gives the same figures without them.
    """
    keys = list(keys)
    boxed = comps.join(patches.select(*keys, "w", "h"), keys).withColumn("box", normalized_box(F.col("w"), F.col("h")))
    listed = boxed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("comp", (F.col("px") * F.lit(ha_per_px)).alias("area_ha"), "box"))).alias("_c"),
        F.sum("px").alias("_px"),
    )
    return patches.join(listed, keys, "left").select(
        *patches.columns,
        F.coalesce(F.size("_c"), F.lit(0)).alias("pit_count"),
        F.coalesce(F.transform("_c", lambda c: c["area_ha"]), F.expr("cast(array() as array<double>)")).alias("areas_ha"),
        F.coalesce(
            F.transform("_c", lambda c: c["box"]),
            F.expr("cast(array() as array<struct<x1:double,y1:double,x2:double,y2:double>>)"),
        ).alias("bboxes"),
        (F.coalesce("_px", F.lit(0)) * F.lit(ha_per_px)).alias("total_area_ha"),
    ).withColumn("pit_count", F.greatest("pit_count", F.lit(0)))


def largest(comps: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    """Largest component per patch; the raster-first one on ties."""
    cols = ["comp", "px", "x1", "y1", "x2", "y2"]
    best = F.max_by(F.struct(*cols), F.struct(F.col("px"), (-F.col("comp")).alias("first")))
    return comps.groupBy(*keys).agg(best.alias("c")).select(*keys, *[F.col(f"c.{c}").alias(c) for c in cols])


# --------------------------------------------------------------------------- masks and bit rows

WORD = 32


def mask_bits(mask: DataFrame, keys: Sequence[str] = PATCH) -> DataFrame:
    """Pixels as bit rows ``keys…, y, word, bits``: 32 columns per value, merged map-side."""
    return (
        mask.select(*keys, F.col("y").cast("long").alias("y"), F.floor(F.col("x") / WORD).alias("word"),
                    F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x"), F.lit(WORD)).cast("int")).alias("bits"))
        .groupBy(*keys, "y", "word")
        .agg(F.bit_or("bits").alias("bits"))
    )


def _pixel_spans(boxes: DataFrame, w: Column, h: Column) -> DataFrame:
    def edge(c: str, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size, F.rint(F.col(c) * size))).cast("long")

    return boxes.select(
        "*", edge("x1", w).alias("_x1"), edge("x2", w).alias("_x2"), edge("y1", h).alias("_y1"), edge("y2", h).alias("_y2")
    ).filter((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")))


def _spans_to_bits(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half-open pixel spans ``_x1.._y2`` to bit rows: one row per line and word, not per pixel."""
    words = spans.select(
        *keys, "_x1", "_x2", "_y1", "_y2",
        F.explode(F.sequence(F.floor(F.col("_x1") / WORD), F.floor((F.col("_x2") - 1) / WORD))).alias("word"),
    )
    lo = F.greatest(F.col("_x1") - F.col("word") * WORD, F.lit(0)).cast("int")
    hi = F.least(F.col("_x2") - F.col("word") * WORD, F.lit(WORD)).cast("int")
    one = F.lit(1).cast("long")
    bits = F.call_function("shiftleft", one, hi) - F.call_function("shiftleft", one, lo)
    return (
        words.select(*keys, "word", bits.alias("bits"), F.explode(F.sequence(F.col("_y1"), F.col("_y2") - 1)).alias("y"))
        .groupBy(*keys, "y", "word")
        .agg(F.bit_or("bits").alias("bits"))
        .select(*keys, "y", "word", "bits")
    )


def box_bits(boxes: DataFrame, w: Column, h: Column, keys: Sequence[str] = PATCH) -> DataFrame:
    """Normalised boxes to bit rows; corners rounded half-even and clamped to the grid."""
    return _spans_to_bits(_pixel_spans(boxes, w, h), keys)


def component_bits(comps: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    """Each component's own bounding box as bit rows."""
    return _spans_to_bits(
        comps.select(*keys, *[F.col(c).cast("long").alias(f"_{c}") for c in ("x1", "x2", "y1", "y2")]), keys
    )


def bits_to_pixels(bits: DataFrame, keys: Sequence[str] = PATCH) -> DataFrame:
    offsets = F.sequence(F.lit(0), F.lit(WORD - 1))
    return (
        bits.select(*keys, "y", "word", "bits", F.explode(offsets).alias("_o"))
        .filter(F.expr("shiftright(bits, _o) & 1") == 1)
        .select(*keys, (F.col("word") * WORD + F.col("_o")).alias("x"), "y")
    )


def rasterize(boxes: DataFrame, w: Column, h: Column, keys: Sequence[str] = PATCH) -> DataFrame:
    """Distinct pixels ``keys…, x, y`` covered by normalised boxes."""
    return bits_to_pixels(box_bits(boxes, w, h, keys), keys)


def confusion_of_bits(
    pred: DataFrame, truth: DataFrame, patches: DataFrame, keys: Sequence[str] = PATCH
) -> DataFrame:
    """Pixel confusion ``keys…, tp, fp, fn, tn`` per patch from two bit-row tables."""
    keys = list(keys)
    zero = F.lit(0).cast("long")
    sides = pred.select(*keys, "y", "word", F.col("bits").alias("p"), zero.alias("t")).unionByName(
        truth.select(*keys, "y", "word", zero.alias("p"), F.col("bits").alias("t"))
    )
    rows = sides.groupBy(*keys, "y", "word").agg(F.bit_or("p").alias("p"), F.bit_or("t").alias("t"))
    per_patch = rows.groupBy(*keys).agg(
        F.sum(F.bit_count(F.expr("p & t")).cast("long")).alias("tp"),
        F.sum(F.bit_count(F.expr("p & ~t")).cast("long")).alias("fp"),
        F.sum(F.bit_count(F.expr("t & ~p")).cast("long")).alias("fn"),
    )
    return (
        patches.join(per_patch, keys, "left")
        .fillna(0, ["tp", "fp", "fn"])
        .withColumn("tn", F.col("w").cast("long") * F.col("h") - F.col("tp") - F.col("fp") - F.col("fn"))
    )


def pixel_confusion(pred: DataFrame, truth: DataFrame, patches: DataFrame, keys: Sequence[str] = PATCH) -> DataFrame:
    """Pixel confusion per patch from two sparse pixel tables; true negatives by arithmetic."""
    return confusion_of_bits(mask_bits(pred, keys), mask_bits(truth, keys), patches, keys)


def change_mask(mask: DataFrame, y0: int = K.YEARS[0], y1: int = K.YEARS[1]) -> DataFrame:
    """Pixels ``patch_id, x, y`` positive in ``y1`` and not in ``y0``: one grouping, no self join."""
    return (
        mask.filter(F.col("year").isin(y0, y1))
        .groupBy("patch_id", "x", "y")
        .agg(F.max(F.col("year") == y0).alias("_before"), F.max(F.col("year") == y1).alias("_after"))
        .filter(F.col("_after") & ~F.col("_before"))
        .select("patch_id", "x", "y")
    )


def box_ceiling(
    mask: DataFrame, patches: DataFrame, keys: Sequence[str] = YEARLY, block: int = BLOCK, within_block: bool = False
) -> DataFrame:
    """Per-patch confusion of the truth against its own component boxes: the best boxes can do."""
    comps = components(mask, keys, 1, block, within_block)
    return confusion_of_bits(component_bits(comps, keys), mask_bits(mask, keys), patches, keys)


# --------------------------------------------------------------------------- symmetries and colour

# The eight symmetries of a square of side N, as (new x, new y); M stands for N - 1.
D4 = {
    "orig": ("x", "y"),
    "hflip": ("M - x", "y"),
    "vflip": ("x", "M - y"),
    "hvflip": ("M - x", "M - y"),
    "rot90": ("y", "M - x"),
    "rot270": ("M - y", "x"),
    "rot90_hflip": ("M - y", "M - x"),
    "rot90_vflip": ("y", "x"),
}
SYMMETRIES = {
    "none": ("orig",),
    "hflip": ("orig", "hflip"),
    "flips": ("orig", "hflip", "vflip", "hvflip"),
    "d4": tuple(D4),
}


def augment(pixels: DataFrame, size: Column, group: str = "d4", only: Column | None = None) -> DataFrame:
    """Every pixel once per symmetry, with the ``variant`` named; rows outside ``only`` stay single."""
    m = size - 1
    x, y = F.col("x"), F.col("y")
    terms = {"x": x, "y": y, "M - x": m - x, "M - y": m - y}

    def variant(name: str) -> Column:
        nx, ny = D4[name]
        return F.struct(F.lit(name).alias("variant"), terms[nx].alias("nx"), terms[ny].alias("ny"))

    all_variants = F.array(*[variant(n) for n in SYMMETRIES[group]])
    chosen = all_variants if only is None else F.when(only, all_variants).otherwise(F.array(variant("orig")))
    rest = [c for c in pixels.columns if c not in ("x", "y")]
    return pixels.select(*rest, F.explode(chosen).alias("v")).select(
        *rest, F.col("v.variant").alias("variant"), F.col("v.nx").alias("x"), F.col("v.ny").alias("y")
    )


def _moved(cells: DataFrame, group: str, size: Column, block: int, keys: Sequence[str]) -> DataFrame:
    """Gathered pixels of a block, a row for each symmetry: codes ``y * block + x`` are moved where they lie."""
    m = size - 1
    beyond = F.raise_error(F.lit("a pixel lies outside the square or the square outside the block")).cast("int")

    def moved(name: str) -> Column:
        def code(c: Column) -> Column:
            x, y = c % block, F.floor(c / block)
            terms = {"x": x, "y": y, "M - x": m - x, "M - y": m - y}
            nx, ny = (terms[t] for t in D4[name])
            return F.when((x <= m) & (y <= m) & (m < block), ny * block + nx).otherwise(beyond).cast("int")

        return F.struct(F.lit(name).alias("variant"), F.transform("_cells", code).alias("_cells"))

    every = F.explode(F.array(*[moved(n) for n in SYMMETRIES[group]])).alias("_v")
    return cells.select(*keys, "_bx", "_by", every).select(*keys, "_bx", "_by", "_v.variant", "_v._cells")


def band_bounds(
    pixels: DataFrame, keys: Sequence[str] = PATCH, lo: float = K.STRETCH_LOW, hi: float = K.STRETCH_HIGH
) -> DataFrame:
    """Exact interpolated percentiles per patch and band: ``keys…, band, lo, hi``; null for a band without values.

    A patch's values are sorted as they are; in a scene under one key the two ranks are closed in by rounds, so no task
    holds a scene's values (``exact_quantiles``).
    """
    found = exact_quantiles(pixels, [*keys, "band"], "v", (lo, hi))
    return found.select(*keys, "band", F.col("q0").alias("lo"), F.col("q1").alias("hi"))


def _stretched(v: Column, lo: Column, hi: Column) -> Column:
    clipped = F.least(F.greatest(v, lo), hi)
    return F.floor((clipped - lo) / F.greatest(hi - lo, F.lit(1e-9)) * F.lit(255.0)).cast("int")


def stretch(
    pixels: DataFrame, bands: Sequence[int] | None = None, keys: Sequence[str] = PATCH,
    lo: float = K.STRETCH_LOW, hi: float = K.STRETCH_HIGH,
) -> DataFrame:
    """Percentile stretch of every patch and band to 0..255, column ``level``; null where ``v`` is null.

    The bounds, one row per patch and band, are joined to the pixels, so a scene under one key is spread
    over tasks like many small patches.
    """
    keys = list(keys)
    source = pixels if bands is None else pixels.filter(F.col("band").isin(*bands))
    bounds = band_bounds(source, keys, lo, hi)
    level = _stretched(F.col("v"), F.col("lo"), F.col("hi")).alias("level")
    return source.join(bounds, [*keys, "band"]).select(*source.columns, level)


def composite(
    pixels: DataFrame, bands: Sequence[int] = K.SWIR_BANDS, keys: Sequence[str] = PATCH,
    stretched: DataFrame | None = None,
) -> DataFrame:
    """Three stretched bands as one row per pixel: ``keys…, x, y, r, g, b``."""
    levels = stretch(pixels, bands, keys) if stretched is None else stretched.filter(F.col("band").isin(*bands))
    return levels.groupBy(*keys, "x", "y").agg(
        *[F.max(F.when(F.col("band") == band, F.col("level"))).alias(name) for name, band in zip("rgb", bands)]
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 luma with integer weights, as 8-bit greyscale conversion defines it."""
    return F.floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536)


def jitter(rgb: DataFrame, seed: int | str, keys: Sequence[str] = PATCH, amount: float = 0.2) -> DataFrame:
    """Keyed brightness, contrast and saturation shifts per image, each factor within ``1 ± amount``.

    Contrast blends with the mean luminance of the brightened image, saturation with each pixel's own.
    """
    keys = list(keys)
    h = key_hash(seed, *keys)

    def factor(start: int) -> Column:
        return F.lit(1.0 - amount) + F.lit(2.0 * amount) * uniform(h, start)

    def level(c: Column) -> Column:
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)))

    bright = rgb.select(
        "*", factor(9).alias("_contrast"), factor(17).alias("_saturation"),
        *[level(F.col(c) * factor(1)).alias(f"_{c}") for c in "rgb"],
    )
    grey = luminance(F.col("_r"), F.col("_g"), F.col("_b"))
    mean = bright.groupBy(*keys).agg(F.floor(F.avg(grey) + F.lit(0.5)).alias("_mean"))
    contrasted = bright.join(mean, keys).select(
        *[c for c in rgb.columns if c not in "rgb"], "_saturation",
        *[level(F.col("_mean") + (F.col(f"_{c}") - F.col("_mean")) * F.col("_contrast")).alias(f"_{c}") for c in "rgb"],
    )
    own = luminance(F.col("_r"), F.col("_g"), F.col("_b"))
    return contrasted.select(
        *[c for c in rgb.columns if c not in "rgb"],
        *[level(own + (F.col(f"_{c}") - own) * F.col("_saturation")).cast("int").alias(c) for c in "rgb"],
    )


def imagery_issue(rgb: DataFrame, keys: Sequence[str] = PATCH, frac: float = 0.4) -> DataFrame:
    """Share of black pixels per patch, and whether it reaches ``frac`` (a partly imaged tile)."""
    black = F.avg(F.when((F.col("r") + F.col("g") + F.col("b")) == 0, 1.0).otherwise(0.0))
    return rgb.groupBy(*keys).agg(black.alias("black_share")).withColumn("partial", F.col("black_share") >= frac)
