"""Box algebra as Column functions. A box is a struct with fields x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridloom import constants as K
from gridloom.functions.numbers import clamp01

CORNERS = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def box_area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def box_centroid(b: Column) -> Column:
    return F.struct(
        ((b["x1"] + b["x2"]) / 2.0).alias("x"), ((b["y1"] + b["y2"]) / 2.0).alias("y")
    )


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the boxes do not overlap or the union is empty."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = w * h
    union = box_area(a) + box_area(b) - inter
    return F.when((w > 0) & (h > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def clamp_box(b: Column) -> Column:
    return box(*[clamp01(b[c].cast("double")) for c in CORNERS])


def is_valid_box(b: Column) -> Column:
    """All four numbers present and a positive extent."""
    present = b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull()
    return present & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def corners_to_box(values: Column) -> Column:
    """``array<double>`` of four numbers to a box; null for any other length."""
    parts = [F.get(values, F.lit(i)) for i in range(4)]
    return F.when(F.size(values) == 4, box(*parts))


def valid_boxes(boxes: Column, clamp: bool = True, min_area: float = 0.0) -> Column:
    """Clamp every box to the unit square, then keep those with extent and enough area."""
    shaped = F.transform(boxes, clamp_box) if clamp else boxes
    return F.filter(shaped, lambda b: is_valid_box(b) & (box_area(b) >= F.lit(float(min_area))))


def max_box_area(boxes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(boxes, box_area)), F.lit(0.0))


def confidence(n: Column, max_area: Column) -> Column:
    """0 without boxes, else ``min(1, 0.5 + 0.2 n + 1.5 max_area)``."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.2) * n + max_area * F.lit(1.5))
    )


def confidence_from_boxes(boxes: Column) -> Column:
    return confidence(F.coalesce(F.size(boxes), F.lit(0)), max_box_area(boxes))


def confidence_eval(n: Column) -> Column:
    """The evaluation harness' formula: ``min(0.95, 0.4 + 0.15 n)``, 0 without boxes."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(0.95), F.lit(0.4) + F.lit(0.15) * n)
    )


def nms(boxes: Column, iou: float = K.NMS_IOU) -> Column:
    """Greedy non-maximum suppression of one row's box array: larger area first, list order on ties."""

    def settled(boxes: Column) -> Column:
        ranked = F.sort_array(
            F.transform(
                boxes, lambda b, i: F.struct((-box_area(b)).alias("neg_area"), i.alias("ord"), b.alias("b"))
            )
        )
        return F.aggregate(
            F.transform(ranked, lambda r: r["b"]),
            F.filter(boxes, lambda b: F.lit(False)),
            lambda kept, b: F.when(
                F.exists(kept, lambda k: box_iou(b, k) >= F.lit(float(iou))), kept
            ).otherwise(F.array_append(kept, b)),
        )

    return F.get(F.transform(F.array(boxes), settled), F.lit(0))  # a variable: what makes the boxes runs once


def match_change(past: Column, present: Column, min_iou: float = K.CHANGE_IOU) -> Column:
    """Greedy one-to-one matching of present boxes to past boxes, in list order.

    Each present box takes the remaining past box with the highest IoU (the earliest on ties) if it
    reaches ``min_iou`` and is then ``persistent``; otherwise it is ``new``.
    """
    left = F.transform(past, lambda b, i: F.struct(i.alias("ord"), b.alias("b")))
    start = F.struct(
        left.alias("left"),
        F.transform(
            F.filter(present, lambda b: F.lit(False)),
            lambda b: F.struct(b.alias("b"), F.lit("").alias("status")),
        ).alias("out"),
    )

    def step(state: Column, p: Column) -> Column:
        scored = F.transform(
            state["left"],
            lambda q: F.struct(box_iou(p, q["b"]).alias("iou"), (-q["ord"]).alias("neg_ord")),
        )
        best = F.array_max(F.filter(scored, lambda s: s["iou"] >= F.lit(float(min_iou))))
        return F.struct(
            F.filter(
                state["left"], lambda q: best["neg_ord"].isNull() | (q["ord"] != -best["neg_ord"])
            ).alias("left"),
            F.array_append(
                state["out"],
                F.struct(
                    p.alias("b"),
                    F.when(best["neg_ord"].isNull(), F.lit("new")).otherwise(F.lit("persistent")).alias("status"),
                ),
            ).alias("out"),
        )

    return F.aggregate(present, start, step, lambda s: s["out"])
