"""Joins and greedy selections between boxes of the same tile."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions import boxes as B
from gridloom.functions.numbers import clamp01
from gridloom.operators.graph import connected
from gridloom.session import cut_lineage

TILE = ("tile_id",)
MAX_ARRAY = 4096
#: Cells halve with every level; boxes smaller than the last level's cells share it.
LEVELS = 16
#: Pairs of overlapping boxes up to which a tile's decisions are one sweep; beyond, each component of its graph is one.
TILE_EDGES = 1_000_000
#: Pairs of a component that one task sweeps; larger components take rounds of joins.
BLOCK_EDGES = 5_000_000


def _level(box: Column) -> Column:
    """The level whose cells are just as wide as the box, so that it touches few of them."""
    extent = F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"])
    return F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.floor(-F.log2(extent)))).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(clamp01(v) * F.pow(F.lit(2.0), level)).cast("int")


def _in_cells(boxes: DataFrame, box: str, keys: Sequence[str], other: DataFrame, left: bool) -> DataFrame:
    """Each box in the cells it touches, on its own level and on the coarser ones that hold boxes of the other side.

    ``_meets`` keeps apart who meets there: boxes of this level (0), left ones of this level and finer right ones (1), and
    the reverse (2). Two finer boxes meet on a finer level, so they must not meet here."""
    b = F.col(box)
    placed = boxes.withColumn("_l", _level(b)).join(other, list(keys))
    levels = F.array_distinct(F.concat(F.array("_l"), F.filter("_levels", lambda x: x < F.col("_l"))))
    own, finer = ((0, 1), 2) if left else ((0, 2), 1)
    placed = placed.withColumn("_level", F.explode(levels)).withColumn(
        "_meets", F.explode(F.when(F.col("_level") == F.col("_l"), F.array(*map(F.lit, own))).otherwise(F.array(F.lit(finer))))
    )
    return _touched(placed, b).drop("_l", "_levels")


def _touched(boxes: DataFrame, b: Column) -> DataFrame:
    """A row per cell of ``_level`` that the box touches."""
    columns = F.sequence(_cell(b["x1"], F.col("_level")), _cell(b["x2"], F.col("_level")))
    rows = F.sequence(_cell(b["y1"], F.col("_level")), _cell(b["y2"], F.col("_level")))
    return boxes.withColumn("_cx", F.explode(columns)).withColumn("_cy", F.explode(rows))


def _in_lower_cell(a: Column, b: Column) -> Column:
    """Whether this cell holds the lower corner of the intersection."""
    return (_cell(F.greatest(a["x1"], b["x1"]), F.col("_level")) == F.col("_cx")) & (
        _cell(F.greatest(a["y1"], b["y1"]), F.col("_level")) == F.col("_cy")
    )


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pairs of overlapping boxes of the same tile, with their ``iou``.

    Boxes lie in cells of about their own size, so however many crowd into a corner of a tile, only near ones of like size
    meet there; a box meets larger ones in those boxes' cells. The join is on tile, level and cell, so a crowded tile is
    spread over its cells. A pair counts only in the cell that holds the lower corner of its intersection. ``a`` and ``b``
    name the box columns of the two sides.
    """
    pa, pb = F.col(a), F.col(b)
    left, right = left.filter(B.is_valid_box(pa)), right.filter(B.is_valid_box(pb))
    levels = lambda df, box: df.groupBy(*keys).agg(F.collect_set(_level(box)).alias("_levels"))
    la = _in_cells(left, a, keys, levels(right, pb), True)
    rb = _in_cells(right, b, keys, levels(left, pa), False)
    return (
        la.join(rb, [*keys, "_level", "_cx", "_cy", "_meets"])
        .filter(_in_lower_cell(pa, pb))
        .withColumn("iou", B.box_iou(pa, pb))
        .filter(F.col("iou") > 0)
        .drop("_level", "_cx", "_cy", "_meets")
    )


def overlapping_pairs(boxes: DataFrame, keys: Sequence[str], box: str, number: str) -> DataFrame:
    """Pairs of overlapping boxes of one table, each once: ``keys…, ia, ib, iou`` with the lower ``number`` as ``ia``.

    The cells are those of ``overlapping``. One side lies in its own cells alone, the other also in the coarser ones of its
    tile, so a pair of one level meets twice and counts in one order, and a finer box meets a coarser one there once. Only
    numbers and corners are shuffled.
    """
    b = F.col(box)
    placed = boxes.filter(B.is_valid_box(b)).select(*keys, F.col(number).alias("_n"), b.alias("_b")).withColumn("_level", _level(F.col("_b")))
    levels = placed.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    coarser = F.array_distinct(F.concat(F.array("_l"), F.filter("_levels", lambda x: x < F.col("_l"))))
    either = placed.withColumnRenamed("_level", "_l").join(levels, list(keys)).withColumn("_level", F.explode(coarser))
    either = either.select(*keys, F.col("_n").alias("_m"), F.col("_b").alias("_c"), "_level", (F.col("_level") < F.col("_l")).alias("_finer"))
    met = _touched(placed, F.col("_b")).join(_touched(either, F.col("_c")), [*keys, "_level", "_cx", "_cy"])
    once = met.filter((F.col("_finer") | (F.col("_n") < F.col("_m"))) & _in_lower_cell(F.col("_b"), F.col("_c")))
    ends = [F.least("_n", "_m").alias("ia"), F.greatest("_n", "_m").alias("ib")]
    return once.select(*keys, *ends, B.box_iou(F.col("_b"), F.col("_c")).alias("iou")).filter(F.col("iou") > 0)


def _by_component(edges: DataFrame, keys: Sequence[str], a: str, b: str) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` with the group (``root``) whose decisions hang together, settled: a tile, or a component of the graph where a
    tile has more than ``TILE_EDGES``; and the edges of components beyond ``BLOCK_EDGES`` (None where there are none).

    ``a`` and ``b`` name the ends' numbers, which no two nodes share, so tiles whose hashes meet do not disturb each other."""
    placed = edges.withColumn("root", F.xxhash64(*keys))
    full = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TILE_EDGES).select(*keys)
    if full.isEmpty():
        return placed, None
    full = cut_lineage(full)
    dense = edges.join(full, list(keys), "left_semi")
    roots = connected(dense.select(F.col(a).alias("a"), F.col(b).alias("b")), [])
    rooted = cut_lineage(dense.join(roots.withColumnRenamed("node", a), a, "left").withColumn("root", F.coalesce("root", a)))
    placed = placed.join(full, list(keys), "left_anti").unionByName(rooted)
    large = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK_EDGES).select("root")
    if large.isEmpty():
        return placed, None
    large = cut_lineage(large)
    return placed.join(large, "root", "left_anti"), rooted.join(large, "root", "left_semi").drop("root")


def _swept(edges: DataFrame, order: Sequence[Column | str], a: str, b: str, one_to_one: bool) -> DataFrame:
    """One sweep over the edges of whole groups in the order of decisions: ``a``, ``b`` of those that take effect.

    An edge takes effect unless an earlier one took its first end as a second (``one_to_one``: either end). A task holds
    the numbers of what is taken in one group."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken, first = None, set(), set()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for root, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if root != at:
                    at, taken, first = root, set(), set()
                if one_to_one:
                    if x in first or y in taken:
                        continue
                    first.add(x)
                elif x in taken:
                    continue
                taken.add(y)
                out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=[a, b])

    dealt = edges.repartition("root").sortWithinPartitions("root", *order)
    return dealt.select("root", a, b).mapInArrow(sweep, f"`{a}` bigint, `{b}` bigint")


def _boxed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.select(*keys, B.box(*[F.col(c).cast("double") for c in B.CORNERS]).alias(name))


def best_iou(
    pred: DataFrame, gold: DataFrame, tiles: DataFrame, keys: Sequence[str] = TILE,
    thresholds: Sequence[float] = (), max_array: int = MAX_ARRAY,
) -> DataFrame:
    """Per tile ``n_gold, n_pred, iou``: mean over gold boxes of the best IoU with any prediction.

    No boxes on either side scores 1, boxes on one side only score 0. ``thresholds`` adds ``hit_<i>``:
    gold boxes whose best IoU reaches the threshold. Tiles of up to ``max_array`` boxes take one shuffle
    and an array expression; crowded ones are joined cell by cell.
    """
    keys = list(keys)
    sides = _boxed(gold, keys, "b").withColumn("_side", F.lit(0)).unionByName(_boxed(pred, keys, "b").withColumn("_side", F.lit(1)))
    crowded = _crowded(sides, keys, max_array)
    few = sides if crowded is None else sides.join(crowded, keys, "left_anti")

    def side(n: int) -> Column:
        return F.collect_list(F.when(F.col("_side") == n, F.col("b")))

    lists = few.groupBy(*keys).agg(side(0).alias("_g"), side(1).alias("_p"))
    best = F.transform(
        "_g", lambda g: F.aggregate("_p", F.lit(0.0), lambda top, p: F.greatest(top, B.box_iou(g, p)))
    )

    def reaching(t: float) -> Column:
        return F.size(F.filter("_best", lambda s: s >= F.lit(float(t)))).cast("long")

    hits = [reaching(t).alias(f"hit_{i}") for i, t in enumerate(thresholds)]
    scored = lists.withColumn("_best", best).select(
        *keys, F.size("_g").cast("long").alias("n_gold"), F.size("_p").cast("long").alias("n_pred"),
        F.aggregate("_best", F.lit(0.0), lambda s, v: s + v).alias("_s"), *hits,
    )
    if crowded is not None:
        dense = sides.join(crowded, keys, "left_semi")
        scored = scored.unionByName(_best_by_cells(dense, keys, thresholds))
    names = [f"hit_{i}" for i in range(len(thresholds))]
    out = tiles.select(*keys).join(scored, keys, "left").fillna(0, ["n_gold", "n_pred", *names])
    iou = F.when(F.col("n_gold") > 0, F.col("_s") / F.col("n_gold")).otherwise(
        F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)
    )
    return out.select(*keys, "n_gold", "n_pred", iou.alias("iou"), *names)


def _best_by_cells(sides: DataFrame, keys: list[str], thresholds: Sequence[float]) -> DataFrame:
    """The same sums by joins: equal boxes folded and weighted, the maximum merged map-side."""
    golds = sides.filter("_side = 0").groupBy(*keys, F.col("b").alias("g")).agg(F.count(F.lit(1)).alias("m"))
    preds = sides.filter("_side = 1").groupBy(*keys, F.col("b").alias("p")).agg(F.count(F.lit(1)).alias("m"))
    best = overlapping(golds.select(*keys, "g"), preds.select(*keys, "p"), keys, "g", "p").groupBy(
        *keys, "g"
    ).agg(F.max("iou").alias("best"))
    zero = F.lit(0).cast("long")
    hits = [F.when(F.col("best") >= F.lit(float(t)), F.col("m")).otherwise(zero).alias(f"hit_{i}") for i, t in enumerate(thresholds)]
    per_gold = golds.join(best, [*keys, "g"], "left").select(
        *keys, F.col("m").alias("n_gold"), zero.alias("n_pred"), (F.coalesce("best", F.lit(0.0)) * F.col("m")).alias("_s"), *hits
    )
    per_pred = preds.select(
        *keys, zero.alias("n_gold"), F.col("m").alias("n_pred"), F.lit(0.0).alias("_s"), *[zero.alias(f"hit_{i}") for i in range(len(thresholds))]
    )
    both = per_gold.unionByName(per_pred)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in both.columns if c not in keys])


def _crowded(boxes: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more boxes than one array should hold; None where there are none (checked now)."""
    found = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    return None if found.isEmpty() else cut_lineage(found)


def nms_table(
    boxes: DataFrame, order: str, keys: Sequence[str] = TILE, iou: float = K.NMS_IOU, max_array: int = MAX_ARRAY
) -> DataFrame:
    """Boxes that survive greedy suppression (larger area first, then ``order``).

    Tiles of up to ``max_array`` boxes run as one array expression. Larger ones take the same decisions in one sweep over
    the pairs of boxes that overlap, tile by tile or component by component.
    """
    keys = list(keys)
    valid = boxes.filter(B.is_valid_box(F.struct(*B.CORNERS)))
    crowded = _crowded(valid, keys, max_array)
    few = valid if crowded is None else valid.join(crowded, keys, "left_anti")
    rest = [c for c in boxes.columns if c not in (*keys, order)]
    ranked = F.struct((-B.box_area(F.struct(*B.CORNERS))).alias("neg"), F.col(order).alias(order), *rest)
    rows = few.groupBy(*keys).agg(F.array_sort(F.collect_list(ranked)).alias("_r"))
    kept = F.aggregate(
        "_r",
        F.filter("_r", lambda b: F.lit(False)),
        lambda acc, b: F.when(F.exists(acc, lambda k: B.box_iou(b, k) >= F.lit(float(iou))), acc).otherwise(F.array_append(acc, b)),
    )
    # explode would run the suppression a second time, in a filter of empty arrays; there are none.
    out = rows.select(*keys, F.explode_outer(kept).alias("b")).select(*keys, "b.*").select(*boxes.columns)
    if crowded is None:
        return out
    return out.unionByName(_nms_components(valid.join(crowded, keys, "left_semi"), order, keys, iou).select(*boxes.columns))


def _nms_components(boxes: DataFrame, order: str, keys: list[str], iou: float) -> DataFrame:
    """The same over the graph of boxes that exclude each other: one sweep from the strongest box on settles all.

    The jobs grow with the logarithm of the boxes, not with the length of chains of overlaps."""
    rest = [c for c in boxes.columns if c not in keys]
    rank = F.struct((-B.box_area(F.struct(*B.CORNERS))).alias("neg"), F.col(order).alias("ord"), *[F.col(c) for c in B.CORNERS])
    # Copies of a box overlap it fully: only the first can survive, so copies are folded before pairing.
    single = boxes.groupBy(*keys, *B.CORNERS).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*")
    # Numbers follow the ranks within a tile, so pairs need no ranks.
    ranked = single.withColumn("_rank", rank).orderBy(*keys, "_rank").drop("_rank")
    nodes = cut_lineage(ranked.withColumn("_no", F.monotonically_increasing_id()))
    pairs = overlapping_pairs(nodes.select(*keys, "_no", B.box(*[F.col(c) for c in B.CORNERS]).alias("b")), keys, "b", "_no")
    edges = cut_lineage(pairs.filter(F.col("iou") >= iou).select(*keys, "ia", "ib"))
    few, large = _by_component(edges, keys, "ia", "ib")
    lost = _swept(few, ["ia", "ib"], "ia", "ib", False).select("ib")
    if large is not None:
        lost = lost.unionByName(_lost_by_rounds(large.select("ia", "ib")))
    return nodes.join(lost.select(F.col("ib").alias("_no")).distinct(), "_no", "left_anti").drop("_no")


def _lost_by_rounds(edges: DataFrame) -> DataFrame:
    """Of components beyond a task: a box that nothing open outranks is kept and drops all it overlaps, round by round."""
    dropped, edges = edges.select("ib").limit(0), cut_lineage(edges)
    while not edges.isEmpty():
        winning = edges.join(edges.select(F.col("ib").alias("ia")).distinct(), "ia", "left_anti")
        lost = cut_lineage(winning.select("ib").distinct())
        dropped = dropped.unionByName(lost)
        edges = cut_lineage(edges.join(lost.withColumnRenamed("ib", "ia"), "ia", "left_anti").join(lost, "ib", "left_anti"))
    return dropped


def match_change_table(
    past: DataFrame, present: DataFrame, order: str, keys: Sequence[str] = TILE,
    min_iou: float = K.CHANGE_IOU, max_array: int = MAX_ARRAY,
) -> DataFrame:
    """Present boxes with ``status`` new or persistent, greedily matched one-to-one in ``order``.

    Small tiles run as one array expression, crowded ones in a sweep over the overlapping pairs with the same outcome.
    """
    keys = list(keys)
    sides = past.select(*keys, F.lit(0).alias("_side"), F.col(order).alias("ord"), F.struct(*B.CORNERS).alias("b")).unionByName(
        present.select(*keys, F.lit(1).alias("_side"), F.col(order).alias("ord"), F.struct(*B.CORNERS).alias("b"))
    )
    crowded = _crowded(sides, keys, max_array)
    few = sides if crowded is None else sides.join(crowded, keys, "left_anti")

    def side(n: int) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("_side") == n, F.struct("ord", "b"))))

    lists = few.groupBy(*keys).agg(side(0).alias("_past"), side(1).alias("_present"))
    matched = B.match_change(F.transform("_past", lambda r: r["b"]), F.transform("_present", lambda r: r["b"]), min_iou)
    zipped = F.explode_outer(F.arrays_zip(F.col("_present"), matched.alias("_m"))).alias("z")  # as in nms_table
    out = lists.select(*keys, zipped).filter(F.col("z").isNotNull()).select(
        *keys, F.col("z._present.ord").alias(order), *[F.col(f"z._present.b.{c}").alias(c) for c in B.CORNERS],
        F.col("z._m.status").alias("status"),
    )
    if crowded is None:
        return out
    return out.unionByName(_match_components(sides.join(crowded, keys, "left_semi"), order, keys, min_iou))


def _match_components(sides: DataFrame, order: str, keys: list[str], min_iou: float) -> DataFrame:
    """The same over the overlap graph: one sweep over the pairs, in the order of the present boxes and, for each,
    from the best past box on (ties: the earliest), matches them all."""
    number = F.monotonically_increasing_id()
    present = cut_lineage(sides.filter("_side = 1").select(*keys, F.col("ord").alias("op"), (number * 2).alias("ip"), F.col("b").alias("p")))
    past = cut_lineage(sides.filter("_side = 0").select(*keys, F.col("ord").alias("oq"), (number * 2 + 1).alias("iq"), F.col("b").alias("q")))
    pairs = overlapping(present, past, keys, "p", "q").filter(F.col("iou") >= min_iou)
    edges = cut_lineage(pairs.select(*keys, "op", "ip", "oq", "iq", "iou"))
    few, large = _by_component(edges, keys, "ip", "iq")
    matched = _swept(few, ["op", "ip", F.desc("iou"), "oq", "iq"], "ip", "iq", True).select("ip")
    if large is not None:
        matched = matched.unionByName(_matched_by_rounds(large))
    flagged = present.join(matched.withColumn("_m", F.lit(1)), "ip", "left")
    status = F.when(F.col("_m") == 1, "persistent").otherwise("new")
    return flagged.select(*keys, F.col("op").alias(order), *[F.col(f"p.{c}").alias(c) for c in B.CORNERS], status.alias("status"))


def _matched_by_rounds(edges: DataFrame) -> DataFrame:
    """Of components beyond a task: who is first at its best past box takes it, round by round."""
    matched, edges = edges.select("ip").limit(0), cut_lineage(edges)
    turn, worth = F.struct("op", "ip"), F.struct((-F.col("iou")).alias("less"), "oq", "iq")
    while not edges.isEmpty():
        choice = edges.groupBy("ip").agg(F.min(worth)["iq"].alias("iq"))
        first = edges.groupBy("iq").agg(F.min(turn)["ip"].alias("ip"))
        won = cut_lineage(choice.join(first, ["iq", "ip"]))
        matched = matched.unionByName(won.select("ip"))
        edges = cut_lineage(edges.join(won.select("ip"), "ip", "left_anti").join(won.select("iq"), "iq", "left_anti"))
    return matched
