"""Scores: pixels, presence, output hygiene, actions, grounding, running figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions.numbers import half_even, safe_div
from gridloom.operators.ranking import block_running_sums

PIXEL_METRICS = (
    "pixel_iou", "pixel_precision", "pixel_recall", "pixel_sdc_f1", "pixel_accuracy", "mean_per_patch_iou",
)


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def pixel_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro scores over all pixels and the macro IoU over patches with a non-empty union."""
    union = F.col("tp") + F.col("fp") + F.col("fn")
    sums = confusion.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.coalesce(F.avg(F.when(union > 0, F.col("tp") / union)), F.lit(0.0)).alias("_macro"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select(
        *by,
        half_even(safe_div(tp, tp + fp + fn)).alias("pixel_iou"),
        half_even(safe_div(tp, tp + fp)).alias("pixel_precision"),
        half_even(safe_div(tp, tp + fn)).alias("pixel_recall"),
        half_even(safe_div(2 * tp, 2 * tp + fp + fn)).alias("pixel_sdc_f1"),
        half_even(safe_div(tp + tn, tp + fp + fn + tn)).alias("pixel_accuracy"),
        half_even(F.col("_macro")).alias("mean_per_patch_iou"),
    )


def presence_metrics(patches: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion of "has any": truth by pixels, prediction by boxes."""
    counted = patches.groupBy(*by).agg(
        _n(truth & pred).alias("patch_tp"), _n(~truth & pred).alias("patch_fp"),
        _n(truth & ~pred).alias("patch_fn"), _n(~truth & ~pred).alias("patch_tn"),
    )
    right = F.col("patch_tp") + F.col("patch_tn")
    return counted.withColumn(
        "patch_accuracy", half_even(safe_div(right, right + F.col("patch_fp") + F.col("patch_fn")))
    )


def hygiene(pred: DataFrame, unparseable: Column, n_boxes: Column, truth: Column, by: Sequence[str] = (), parseable: Column | None = None) -> DataFrame:
    """Unparseable outputs, and empty outputs on negatives and on positives; with ``parseable`` also how many are so."""
    return pred.groupBy(*by).agg(
        _n(unparseable).alias("n_unparseable"),
        _n((n_boxes == 0) & ~truth).alias("empty_on_negative"),
        _n((n_boxes == 0) & truth).alias("empty_on_positive"),
        F.count(F.lit(1)).alias("n"),
        *([] if parseable is None else [_n(parseable).alias("n_parseable")]),
    )


def compare_models(
    base: DataFrame, candidate: DataFrame, metrics: Sequence[str] = PIXEL_METRICS, decide_on: str = "pixel_iou"
) -> DataFrame:
    """Metric rows of two models side by side: delta, arrow, and the winner on one metric."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*metrics).unpivot([], list(metrics), "metric", name)

    delta = F.col("candidate") - F.col("base")
    joined = long(base, "base").join(long(candidate, "candidate"), "metric")
    arrow = F.when(delta > 0, "↑").when(delta < 0, "↓").otherwise("=")
    winner = F.when(F.col("metric") == decide_on, F.when(delta > 0, "candidate").otherwise("base"))
    return joined.select(
        "metric", "base", "candidate", F.round(delta, 4).alias("delta"), arrow.alias("arrow"), winner.alias("winner")
    )


# --------------------------------------------------------------------------- actions


def join_predictions(gold: DataFrame, pred: DataFrame, key: str = "tile_id") -> DataFrame:
    """Gold rows with their prediction; a missing one counts as unparseable."""
    return gold.join(pred, key, "left").fillna({"pred_action": K.PSEUDO_LABELS[0]})


def action_confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "gold_action", "pred_action").agg(F.count(F.lit(1)).alias("n"))


def action_accuracy(
    df: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = tuple(K.TOOL_TO_ACTION)
) -> DataFrame:
    """Accuracy with unparseable outputs and labels outside the vocabulary counted apart."""
    pred = F.col("pred_action")
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            _n(pred == F.col("gold_action")).alias("n_correct"),
            _n(pred == K.PSEUDO_LABELS[0]).alias("n_unparseable"),
            _n(~pred.isin(*labels, *K.PSEUDO_LABELS)).alias("n_invalid"),
        )
        .withColumn("accuracy", safe_div(F.col("n_correct"), F.col("n")))
    )


def per_class(df: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = tuple(K.TOOL_TO_ACTION)) -> DataFrame:
    """Precision, recall and support per gold class; classes without gold rows are left out.

    Each row counts once for its gold and once for its predicted class, so one grouping serves both.
    """
    gold, pred = F.col("gold_action"), F.col("pred_action")
    hit = F.when(gold == pred, 1).otherwise(0)
    counted = (
        df.groupBy(*by, "gold_action", "pred_action").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *by,
            F.explode(
                F.array(
                    F.struct(gold.alias("action"), F.col("_n").alias("g"), F.lit(0).cast("long").alias("p"), (F.col("_n") * hit).alias("t")),
                    F.struct(pred.alias("action"), F.lit(0).cast("long").alias("g"), F.col("_n").alias("p"), F.lit(0).cast("long").alias("t")),
                )
            ).alias("c"),
        )
        .groupBy(*by, F.col("c.action").alias("action"))
        .agg(F.sum("c.g").alias("support"), F.sum("c.p").alias("_p"), F.sum("c.t").alias("_t"))
    )
    return counted.filter((F.col("support") > 0) & F.col("action").isin(*labels)).select(
        *by, "action", safe_div(F.col("_t"), F.col("_p")).alias("precision"),
        safe_div(F.col("_t"), F.col("support")).alias("recall"), "support",
    )


def action_reward(pred: Column, gold: Column) -> Column:
    """1 where the parsed action equals the gold one, else 0 (also on parse failures)."""
    return F.when(pred == gold, 1.0).otherwise(0.0)


def class_distribution(df: DataFrame, by: Sequence[str], order: str = "name") -> DataFrame:
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(*by) if order == "name" else counted.orderBy(F.desc("n"), *by)


def grounding_summary(best: DataFrame, thresholds: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """Mean IoU, box-count match rate, and per threshold the tile hit rate and gold-box recall."""
    extra: list[Column] = []
    for i, t in enumerate(thresholds):
        pct = int(round(t * 100))
        extra += [
            F.avg(F.when(F.col("iou") >= t, 1.0).otherwise(0.0)).alias(f"hit_rate_{pct}"),
            safe_div(F.sum(f"hit_{i}"), F.sum("n_gold")).alias(f"recall_{pct}"),
        ]
    return best.groupBy(*by).agg(
        F.avg("iou").alias("mean_iou"),
        F.avg(F.when(F.col("n_pred") == F.col("n_gold"), 1.0).otherwise(0.0)).alias("count_match_rate"),
        *extra,
    )


def running_ratio(
    df: DataFrame, order: Sequence[str], block: Column, num: Column, den: Column, name: str, by: Sequence[str] = ()
) -> DataFrame:
    """``sum(num) / sum(den)`` over the rows up to each row (running accuracy, running IoU)."""
    both = block_running_sums(df, by, list(order), block, {"_cn": num, "_cd": den})
    return both.withColumn(name, safe_div(F.col("_cn"), F.col("_cd"))).drop("_cn", "_cd")
