"""Whole training-set builds: one function, parameterised by a preset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions.text import plain_description, presence_description
from gridloom.operators import curation as C, messages as T, raster as R
from gridloom.session import settle


@dataclass(frozen=True)
class Preset:
    """How one dataset version differs from the others."""

    name: str
    composites: tuple[str, ...]
    symmetries: str = "none"
    jitter: bool = False
    min_pixels: int = 1
    sentences: str = "static"
    grounding: bool = True
    mixed: bool = True
    single_copies: int = 1
    change: bool = False
    description_prompt: str = K.DESCRIPTION_PROMPT
    grounding_prompt: str = K.GROUNDING_PROMPT
    digits: int = 6
    first: int | None = None


_PAIR = {"description_prompt": K.PAIR_DESCRIPTION_PROMPT, "grounding_prompt": K.PAIR_GROUNDING_PROMPT}
_CHANGE = {"description_prompt": K.CHANGE_DESCRIPTION_PROMPT, "grounding_prompt": K.CHANGE_GROUNDING_PROMPT, "digits": 5}


# The published versions.
PRESETS = {
    p.name: p
    for p in (
        Preset("tiny", ("swir",), sentences="presence", grounding=False, mixed=False, digits=3, first=20),
        Preset("v1", ("swir",), sentences="plain", mixed=False),
        Preset("v2", ("swir",)),
        Preset("v3", ("swir",), single_copies=K.SINGLE_COMPONENT_COPIES),
        Preset("v4", ("rgb",), description_prompt=K.RGB_DESCRIPTION_PROMPT),
        Preset("v5", ("rgb", "swir"), **_PAIR),
        Preset("v6", ("2016", "2022"), sentences="change", change=True, **_CHANGE),
        Preset("v7", ("rgb", "swir"), "hflip", **_PAIR),
        Preset("v8", ("rgb", "swir"), "flips", min_pixels=K.MIN_COMPONENT_PIXELS, **_PAIR),
        Preset("v9", ("rgb", "swir"), "d4", min_pixels=K.MIN_COMPONENT_PIXELS, **_PAIR),
        Preset("v10", ("rgb", "swir"), "d4", True, K.MIN_COMPONENT_PIXELS, **_PAIR),
    )
}


def select_patches(roster: DataFrame, key: str = "patch_key", seed: int = 42) -> DataFrame:
    """Train positives, at most twice as many train negatives, and all test patches."""
    return C.downsample_negatives(roster, F.col("is_positive"), key, only=F.col("split") == "train", seed=seed)


def change_roster(roster: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
    """Patches for change presets: both years in one split, all four files there; no negatives are left out."""
    pairs = C.pair_years(roster).filter("same_split").join(C.complete_patches(index), "patch_num", "left_semi")
    located = pairs.select(F.col("patch_num").alias("patch_id"), F.lit(K.YEARS[1]).alias("year"), F.col("split_after").alias("split"), F.lit(True).alias("is_positive"))
    return located.join(sizes.select("patch_id", "year", "w", "h"), ["patch_id", "year"])


def build_samples(mask: DataFrame, roster: DataFrame, preset: Preset, seed: int = 42, within_block: bool = False) -> DataFrame:
    """One row per sample: patch, symmetry, light, description and grounding target.

    ``roster`` brings ``patch_id, year, w, h, split, is_positive``; ``mask`` their positive pixels.
    Symmetries and jitter apply to train patches only. ``variant_no`` and ``light_no`` give the published order.
    """
    keys = ["patch_id", "year"]
    train = F.col("split") == "train"
    names = F.array(*[F.lit(n) for n in R.SYMMETRIES[preset.symmetries]])
    variants = roster.select("*", F.posexplode(F.when(train, names).otherwise(F.array(F.lit("orig")))).alias("variant_no", "variant"))
    source = R.change_mask(mask).withColumn("year", F.lit(K.YEARS[1])) if preset.change else mask.select(*keys, "x", "y")
    chosen = source.join(roster.select(*keys, "w", train.alias("_train")), keys)
    moved = R.augment(chosen, F.col("w"), preset.symmetries, F.col("_train")).drop("w", "_train")
    vkeys = [*keys, "variant"]
    comps = settle(R.components(moved, vkeys, preset.min_pixels, within_block=within_block), "components")
    totals = R.patch_totals(comps, variants, vkeys)
    bank = "change" if preset.sentences == "change" else "static"
    told = T.describe(totals, [*vkeys], f"{preset.name}-{seed}", bank)
    if preset.sentences == "plain":
        told = told.withColumn("description", plain_description(F.col("pit_count"), F.col("total_area_ha")))
    elif preset.sentences == "presence":
        told = told.withColumn("description", presence_description(F.col("px")))
    label = K.NEW_BOX_LABEL if preset.change else K.BOX_LABEL
    boxes = R.patch_stats(comps, variants.select(*vkeys, "w", "h"), vkeys).select(*vkeys, T.grounding_target(F.col("bboxes"), label).alias("target"))
    samples = told.join(boxes, vkeys)
    if preset.single_copies > 1:
        single = train & F.col("is_positive") & (F.col("pit_count") == 1)
        samples = C.repeat_rows(samples, F.when(single, preset.single_copies).otherwise(1))
    else:
        samples = samples.withColumn("copy", F.lit(1).cast("long"))
    light = F.array(F.lit("orig"), F.lit("jitter")) if preset.jitter else F.array(F.lit("orig"))
    lit = F.posexplode(F.when(train, light).otherwise(F.array(F.lit("orig")))).alias("light_no", "light")
    return settle(samples.select("*", lit), "samples")


def number_images(samples: DataFrame, preset: Preset, per_block: int = 64) -> DataFrame:
    """Consecutive numbers over train, then test samples in the published order, and the image names made from them."""
    staged = samples.withColumn("_part", F.when(F.col("split") == "train", 0).otherwise(1))
    order = ["_part", "patch_id", "year", "variant_no", "copy", "light_no"]
    numbered = C.number_samples(staged, order, F.struct("_part", F.floor(F.col("patch_id") / per_block).alias("b"))).drop("_part")
    if preset.first is not None:
        numbered = numbered.filter(F.col("sample_no") < preset.first)

    def name(kind: str) -> Column:
        # Names of single images don't tell the kind.
        head = f"{preset.name}_" if len(preset.composites) == 1 else f"{preset.name}_{kind}_"
        no = F.col("sample_no").cast("string")
        return F.concat(F.lit(head), F.lpad(no, F.greatest(F.lit(preset.digits), F.length(no)), F.lit("0")), F.lit(".png"))

    return numbered.withColumn("images", F.array(*[name(c) for c in preset.composites]))


# Bands of each composite kind.
COMPOSITES = {"rgb": K.RGB_BANDS, "swir": K.SWIR_BANDS}


def render_images(pixels: DataFrame, numbered: DataFrame, size: Column, kinds: tuple[str, ...], keys: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """Pixels of every sample image: ``sample_no, kind, x, y, r, g, b``.

    Symmetries leave percentiles as they are, so each patch is stretched once and its pixels then
    moved per sample; jittered samples draw their factors from the image's own key.
    """
    used = sorted({b for k in kinds for b in COMPOSITES[k]})
    levels = R.stretch(pixels, used, keys)
    out = None
    for kind in kinds:
        rgb = R.composite(pixels, COMPOSITES[kind], keys, stretched=levels).fillna(0, list("rgb"))
        moved = R.augment(rgb, size).join(numbered.select(*keys, "variant", "light", "sample_no"), [*keys, "variant"])
        plain = moved.filter("light = 'orig'").select("sample_no", "x", "y", *"rgb")
        lit = R.jitter(moved.filter("light = 'jitter'").select("sample_no", "x", "y", *"rgb"), kind, ["sample_no"])
        both = plain.unionByName(lit).select("sample_no", F.lit(kind).alias("kind"), "x", "y", *"rgb")
        out = both if out is None else out.unionByName(both)
    return out


def to_records(numbered: DataFrame, preset: Preset, seed: int = 44) -> DataFrame:
    """Message records: a description row and, where the preset has it, a grounding row per sample.

    ``position`` is the place of a training record in the shuffled mix of both tasks; null for records outside it.
    """
    images = [F.col("images")[i] for i in range(len(preset.composites))]

    def rows(task: str, prompt: str, target: str) -> DataFrame:
        return numbered.select("sample_no", "split", F.lit(task).alias("task"), T.to_messages(images, F.lit(prompt), F.col(target)).alias("messages"))

    records = rows("description", preset.description_prompt, "description")
    if preset.grounding:
        records = C.mix_tasks(records, rows("grounding", preset.grounding_prompt, "target"))
    if not preset.mixed:
        return records.withColumn("position", F.lit(None).cast("long"))
    keyed = settle(records.withColumn("_key", F.concat_ws("-", "task", F.col("sample_no").cast("string"))), "records")
    mixed = C.shuffle_rank(keyed.filter("split = 'train'"), "_key", seed)
    return mixed.unionByName(keyed.filter("split <> 'train'"), allowMissingColumns=True).drop("_key")


def build_report(records: DataFrame) -> DataFrame:
    """Row counts per split and task, and the number of distinct training descriptions."""
    train, described = F.col("split") == "train", F.col("task") == "description"

    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")

    return records.agg(
        n(train & described).alias("train_desc"), n(~train & described).alias("eval_desc"),
        n(train & ~described).alias("train_grounding"), n(train).alias("multitask"),
        F.count_distinct(F.when(train & described, T.last_text(F.col("messages")))).alias("unique_descriptions"),
    )


def label_records(labels: DataFrame, message: Column, with_reason: bool = False, system: Column | None = None) -> DataFrame:
    """Labelled tiles (``coord_id, action, direction, reason``) as decision records."""
    from gridloom.functions.text import action_to_tool

    base = F.col("coord_id")
    images = [F.concat(base, F.lit("/rgb.png")), F.concat(base, F.lit("/swir.png"))]
    target = T.action_target(action_to_tool(F.col("action")), F.col("direction"), F.col("reason") if with_reason else None)
    return labels.withColumn("messages", T.to_messages(images, message, target, system))
