"""Dataset curation: rosters, pairing over years, splits and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom import constants as K
from gridloom.functions.keyed import hash_block, key_hash
from gridloom.operators.ranking import block_rank

PATCH_YEAR = ["patch_num", "year"]


def is_positive(class_percentage: Column) -> Column:
    return F.coalesce(class_percentage, F.lit(0.0)) > 0


def build_roster(images: DataFrame, masks: DataFrame, splits: DataFrame) -> DataFrame:
    """Images with a mask, their split (``train`` by default) and class percentage (0 by default)."""
    return (
        images.select(*PATCH_YEAR, F.col("path").alias("image"))
        .join(masks.select(*PATCH_YEAR, F.col("path").alias("mask")), PATCH_YEAR)
        .join(splits, PATCH_YEAR, "left")
        .fillna({"split": "train", "class_percentage": 0.0})
        .withColumn("is_positive", is_positive(F.col("class_percentage")))
    )


def unpaired_images(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.join(masks.select(*PATCH_YEAR), PATCH_YEAR, "left_anti")


def pair_years(roster: DataFrame, y0: int = K.YEARS[0], y1: int = K.YEARS[1]) -> DataFrame:
    """Patches seen in both years, with both splits and whether they agree.

    One grouping instead of a self join; filter on ``same_split`` for usable pairs.
    """
    return (
        roster.filter(F.col("year").isin(y0, y1))
        .groupBy("patch_num")
        .agg(
            F.max(F.when(F.col("year") == y0, F.col("split"))).alias("split_before"),
            F.max(F.when(F.col("year") == y1, F.col("split"))).alias("split_after"),
        )
        .filter(F.col("split_before").isNotNull() & F.col("split_after").isNotNull())
        .withColumn("same_split", F.col("split_before") == F.col("split_after"))
    )


def complete_patches(index: DataFrame, kinds: Sequence[str] = ("image", "mask"), years: Sequence[int] = K.YEARS) -> DataFrame:
    """Patches for which every kind of file exists in every year."""
    wanted = F.col("kind").isin(*kinds) & F.col("year").isin(*years)
    return (
        index.filter(wanted)
        .groupBy("patch_num")
        .agg(F.count_distinct("kind", "year").alias("_n"))
        .filter(F.col("_n") == len(kinds) * len(years))
        .select("patch_num")
    )


def change_class(before: Column, after: Column, new: Column) -> Column:
    """``new`` wins over ``stable`` over ``reclaimed``."""
    return F.when(new, "new").when(before & after, "stable").when(before, "reclaimed").otherwise("none")


def pending(plan: DataFrame, done: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """Planned rows whose artefacts are not all present yet."""
    complete = (
        done.filter(F.col("kind").isin(*kinds)).groupBy(key).agg(F.count_distinct("kind").alias("_n")).filter(F.col("_n") == len(kinds))
    )
    return plan.join(complete.select(key), key, "left_anti")


def stratified_split(
    df: DataFrame, by: Sequence[str], key: str, frac: float = K.EVAL_FRACTION, seed: int = 42
) -> DataFrame:
    """Adds ``split``: per class ``max(1, round(n * frac))`` rows for eval, none from classes of one."""
    staged = df.withColumn("_h", key_hash(seed, key))
    ranked = block_rank(staged, by, ["_h", key], hash_block(F.col("_h")), "_rn", "_total")
    n_eval = F.when(F.col("_total") >= 2, F.greatest(F.lit(1.0), F.rint(F.col("_total") * F.lit(frac)))).otherwise(0.0)
    return ranked.withColumn("split", F.when(F.col("_rn") <= n_eval, "eval").otherwise("train")).drop("_h", "_rn", "_total")


def oversample(df: DataFrame, by: Sequence[str], target: int, key: str, seed: int = 43) -> DataFrame:
    """Classes below ``target`` repeated whole, plus a keyed sample for the remainder; adds ``copy``."""
    staged = df.withColumn("_h", key_hash(seed, key))
    ranked = block_rank(staged, by, ["_h", key], hash_block(F.col("_h")), "_rn", "_total")
    full, rest = F.floor(F.lit(target) / F.col("_total")), F.lit(target) % F.col("_total")
    copies = F.when(F.col("_total") >= target, F.lit(1)).otherwise(full + F.when(F.col("_rn") <= rest, 1).otherwise(0))
    return repeat_rows(ranked.withColumn("_copies", copies), F.col("_copies")).drop("_h", "_rn", "_total", "_copies")


def repeat_rows(df: DataFrame, times: Column, chunk: int = 1024) -> DataFrame:
    """Every row ``times`` times with its ``copy`` number; large factors unfold in two steps."""
    n = times.cast("long")
    return (
        df.withColumn("_n", n)
        .filter(F.col("_n") > 0)
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
        .withColumn(
            "copy",
            F.explode(F.sequence(F.col("_c") * chunk + 1, F.least(F.col("_n"), (F.col("_c") + 1) * chunk))),
        )
        .drop("_n", "_c")
    )


def downsample_negatives(
    df: DataFrame, positive: Column, key: str, ratio: int = K.NEGATIVE_RATIO, seed: int = 42, only: Column | None = None
) -> DataFrame:
    """At most ``ratio`` negatives per positive among the rows of ``only``; all other rows stay."""
    scope = F.lit(True) if only is None else only
    staged = df.withColumn("_neg", scope & ~positive).withColumn("_h", key_hash(seed, key))
    n_pos = staged.filter(scope & positive).agg(F.count(F.lit(1)).alias("n")).scalar()
    negatives = block_rank(staged.filter("_neg"), [], ["_h", key], hash_block(F.col("_h")), "_rn")
    kept = negatives.filter(F.col("_rn") <= n_pos * ratio).drop("_rn")
    return staged.filter(~F.col("_neg")).unionByName(kept).drop("_neg", "_h")


def systematic_sample(df: DataFrame, order: Sequence[str], block: Column, n: int = 8) -> DataFrame:
    """Every ``max(1, total / n)``-th row in order, the first ``n`` of them."""
    ranked = block_rank(df, [], list(order), block, "_rn", "_total")
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / n))
    at = F.col("_rn") - 1
    return ranked.filter((at % step == 0) & (F.floor(at / step) < n)).drop("_rn", "_total")


def sample_per_group(df: DataFrame, by: Sequence[str], k: int, key: str, seed: int = 42) -> DataFrame:
    """``k`` keyed-random rows per group; a group of any size is ranked over its hash blocks."""
    staged = df.withColumn("_h", key_hash(seed, key))
    ranked = block_rank(staged, by, ["_h", key], hash_block(F.col("_h")), "_rn")
    return ranked.filter(F.col("_rn") <= k).drop("_h", "_rn")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows per group in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def shuffle(df: DataFrame, key: str, seed: int = 44) -> DataFrame:
    """Keyed random order: a range sort on a hash, even by construction."""
    h = key_hash(seed, key)
    return df.orderBy(h, key)


def shuffle_rank(df: DataFrame, key: str, seed: int = 44, name: str = "position") -> DataFrame:
    """The place of every row in the keyed random order, without a total sort in one task."""
    staged = df.withColumn("_h", key_hash(seed, key))
    return block_rank(staged, [], ["_h", key], hash_block(F.col("_h")), name).drop("_h")


def number_samples(df: DataFrame, order: Sequence[str], block: Column, name: str = "sample_no") -> DataFrame:
    """Consecutive numbers from 0 in a stable global order."""
    return block_rank(df, [], list(order), block, name).withColumn(name, F.col(name) - 1)


def mix_tasks(*parts: DataFrame) -> DataFrame:
    """Rows of several task datasets in one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def append_eval(old: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows first, new rows second; ``source_no`` keeps that order."""
    return old.withColumn("source_no", F.lit(0)).unionByName(new.withColumn("source_no", F.lit(1)))
