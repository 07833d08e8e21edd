import random
import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.operators import evaluate as E, matching as M
from gridloom.operators.detect import detect
from gridloom.plans import all_queries


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def brute_nms(boxes, t=0.5):
    kept = []
    for b in sorted(boxes, key=lambda r: -(r[2] - r[0]) * (r[3] - r[1])):
        if all(iou(b, k) < t for k in kept):
            kept.append(b)
    return kept


def brute_match(past, present, t=0.3):
    left, out = list(past), []
    for p in present:
        best, at = 0.0, -1
        for i, q in enumerate(left):
            if iou(p, q) > best:
                best, at = iou(p, q), i
        if at >= 0 and best >= t:
            left.pop(at)
            out.append("persistent")
        else:
            out.append("new")
    return out


def crowd(seed, n, span=64):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = r.randrange(span), r.randrange(span)
        out.append((x / 96, y / 96, (x + r.randrange(4, 30)) / 96, (y + r.randrange(4, 30)) / 96))
    return out


def table(spark, tiles):
    rows = [(t, i, *map(float, b)) for t, bs in tiles.items() for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, "tile_id long, no long, x1 double, y1 double, x2 double, y2 double")


def test_nms_paths_agree_with_brute_force_and_are_idempotent(spark):
    tiles = {1: crowd(1, 60), 2: crowd(2, 7), 3: [(0.1, 0.1, 0.5, 0.5)] * 9, 4: crowd(4, 25, 6)}
    df = table(spark, tiles)
    want = {(t, *k) for t, bs in tiles.items() for k in brute_nms(bs)}
    for limit in (1000, 10, 0):
        kept = M.nms_table(df, "no", max_array=limit)
        got = [(r.tile_id, r.x1, r.y1, r.x2, r.y2) for r in kept.collect()]
        assert len(got) == len(want) and set(got) == want
    again = M.nms_table(M.nms_table(df, "no"), "no")
    assert again.count() == len(want)


def test_each_overlapping_pair_of_a_table_is_found_once_from_numbers_and_corners(spark):
    boxes = {t: list(dict.fromkeys(crowd(t, 40))) + [(0.0, 0.0, 1.0, 1.0), (0.3, 0.3, 0.3001, 0.3001)] for t in (1, 2)}
    rows = [(t, i, *b) for t, bs in boxes.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "tile_id long, no long, x1 double, y1 double, x2 double, y2 double")
    pairs = M.overlapping_pairs(df.withColumn("b", F.struct(*B.CORNERS)), ["tile_id"], "b", "no")
    meet = lambda a, b: min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
    want = [(t, i, j) for t, bs in boxes.items() for j, b in enumerate(bs) for i in range(j) if meet(bs[i], b)]
    assert sorted((r.tile_id, r.ia, r.ib) for r in pairs.collect()) == sorted(want)


def test_suppression_runs_once_a_row(spark):
    """No filter of empty arrays repeats it; rows without boxes are left out all the same."""
    df = table(spark, {1: crowd(1, 9), 2: crowd(2, 4)})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "size(aggregate(" not in plan(M.nms_table(df, "no"))
    assert "size(arrays_zip(" not in plan(M.match_change_table(df, df, "no"))
    spark.range(3).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(folder := tempfile.mkdtemp() + "/orders.parquet")
    found = all_queries.QUERIES["explode_detections"](spark, folder.removesuffix("/orders.parquet"))
    assert "size(" not in plan(found) and found.count() > 0


def test_change_matching_paths_agree_with_brute_force(spark):
    past, now = {t: crowd(10 + t, 18, 30) for t in range(4)}, {t: crowd(20 + t, 22, 30) for t in range(1, 5)}
    past[1] = past[1] + past[1][:4]
    want = {(t, i): s for t, bs in now.items() for i, s in enumerate(brute_match(past.get(t, []), bs))}
    for limit in (1000, 0):
        out = M.match_change_table(table(spark, past), table(spark, now), "no", max_array=limit)
        got = {(r.tile_id, r.no): r.status for r in out.collect()}
        assert got == want


def test_best_iou_paths(spark):
    gold, pred = {1: crowd(1, 9), 2: crowd(2, 4), 3: []}, {1: crowd(5, 12), 3: crowd(6, 2)}
    tiles = spark.createDataFrame([(t,) for t in (1, 2, 3, 4)], "tile_id long")
    want = {2: 0.0, 3: 0.0, 4: 1.0, 1: sum(max(iou(g, p) for p in pred[1]) for g in gold[1]) / 9}
    for limit in (1000, 0):
        out = M.best_iou(table(spark, pred), table(spark, gold), tiles, max_array=limit, thresholds=(0.5,))
        got = {r.tile_id: r.iou for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)


def test_iou_is_symmetric_and_zero_when_touching(spark):
    df = table(spark, {1: crowd(3, 40)})
    a, b = F.struct(*B.CORNERS), F.struct(*[F.col("b")[c].alias(c) for c in B.CORNERS])
    pairs = df.withColumn("b", F.struct(F.col("y1").alias("x1"), F.col("x1").alias("y1"), F.col("y2").alias("x2"), F.col("x2").alias("y2")))
    assert pairs.filter(B.box_iou(a, b) != B.box_iou(b, a)).count() == 0
    edge = spark.range(1).select(B.box_iou(B.box(*map(F.lit, (0.0, 0.0, 0.5, 0.5))), B.box(*map(F.lit, (0.5, 0.0, 1.0, 0.5)))).alias("v"))
    assert edge.first().v == 0.0


def test_published_confusion_matrix(spark):
    """99 tiles, 76 right; recall of the review class 16 of 18."""
    cells = {
        ("discard", "discard"): 47, ("discard", "downlink_now"): 3, ("discard", "flag_for_review"): 9,
        ("flag_for_review", "downlink_now"): 2, ("flag_for_review", "flag_for_review"): 16,
        ("request_higher_resolution", "flag_for_review"): 1,
        ("downlink_now", "discard"): 1, ("downlink_now", "downlink_now"): 13, ("downlink_now", "flag_for_review"): 7,
    }
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "gold_action string, pred_action string")
    acc = E.action_accuracy(df).first()
    assert (acc.n, acc.n_correct) == (99, 76) and round(acc.accuracy, 4) == 0.7677
    scores = {r.action: r for r in E.per_class(df).collect()}
    assert scores["flag_for_review"].support == 18 and abs(scores["flag_for_review"].recall - 16 / 18) < 1e-12
    assert "request_neighbor_tile" not in scores and scores["request_higher_resolution"].precision == 0.0
    assert {(r.gold_action, r.pred_action): r.n for r in E.action_confusion(df).collect()} == cells


def test_least_iou_counts_on_both_paths(spark):
    """A pair at IoU 0.5: persistent at 0.3, new at 0.6, for few boxes and for many."""
    past, now = {1: [(0.0, 0.0, 0.5, 0.5)]}, {1: [(0.0, 0.0, 0.5, 0.25)]}
    for limit in (4096, 0):
        for least, status in ((0.3, "persistent"), (0.6, "new")):
            out = M.match_change_table(table(spark, past), table(spark, now), "no", min_iou=least, max_array=limit)
            assert [r.status for r in out.collect()] == [status]


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


@pytest.mark.parametrize("most", [(1_000_000, 5_000_000), (0, 5_000_000), (0, 0)])
def test_tiles_components_and_rounds_agree(spark, monkeypatch, most):
    """Whole tiles in a sweep, components in a sweep, and rounds for components beyond a task."""
    monkeypatch.setattr(M, "TILE_EDGES", most[0])
    monkeypatch.setattr(M, "BLOCK_EDGES", most[1])
    tiles = {1: crowd(1, 40), 2: crowd(2, 7), 4: crowd(4, 20, 6)}
    got = {(r.tile_id, r.x1, r.y1, r.x2, r.y2) for r in M.nms_table(table(spark, tiles), "no", max_array=0).collect()}
    assert got == {(t, *k) for t, bs in tiles.items() for k in brute_nms(bs)}
    past, now = {t: crowd(10 + t, 18, 30) for t in range(2)}, {t: crowd(20 + t, 22, 30) for t in range(2)}
    out = M.match_change_table(table(spark, past), table(spark, now), "no", max_array=0)
    assert {(r.tile_id, r.no): r.status for r in out.collect()} == {(t, i): s for t, bs in now.items() for i, s in enumerate(brute_match(past[t], bs))}


def test_a_long_chain_of_overlaps_takes_few_jobs(spark):
    """5,000 boxes, each over the next: every other one stays, and rounds don't grow with the chain."""
    chain = {7: [(i * 1.8e-4, 0.0, i * 1.8e-4 + 6e-4, 0.5 - i * 1e-6) for i in range(5000)]}
    before = jobs(spark)
    kept = {r.no for r in M.nms_table(table(spark, chain), "no", max_array=0).collect()}
    assert kept == set(range(0, 5000, 2)) and jobs(spark) - before < 60
    # Each present box prefers the past box that the one before it takes.
    past = {7: [(i * 1.8e-4, 0.0, i * 1.8e-4 + 6e-4, 0.5) for i in range(2000)]}
    now = {7: [(i * 1.8e-4 + 1.0e-4, 0.0, i * 1.8e-4 + 7.0e-4, 0.5) for i in range(2000)]}
    before = jobs(spark)
    got = {r.no: r.status for r in M.match_change_table(table(spark, past), table(spark, now), "no", max_array=0).collect()}
    assert got == dict(enumerate(brute_match(past[7], now[7]))) and jobs(spark) - before < 60


def test_many_boxes_in_a_corner_of_one_tile(spark):
    """100,000 small boxes and a few large ones within a sixteenth of a tile's sides, against a bucketed greedy pass."""
    r = random.Random(11)
    boxes = []
    for k in range(100_000):
        x, y, w, h = r.random() / 16, r.random() / 16, r.uniform(1e-4, 3e-4), r.uniform(1e-4, 3e-4)
        if k % 10 == 9:
            x, y, w, h = (v * r.uniform(0.98, 1.02) for v in (boxes[-1][0], boxes[-1][1], boxes[-1][2] - boxes[-1][0], boxes[-1][3] - boxes[-1][1]))
        boxes.append((x, y, x + w, y + h))
    boxes += [(0.0, 0.0, 0.05, 0.05), (0.001, 0.0, 0.05, 0.05), (0.2, 0.2, 0.9, 0.9)]
    buckets = defaultdict(list)
    kept = set()
    for k in sorted(range(len(boxes)), key=lambda k: (-(boxes[k][2] - boxes[k][0]) * (boxes[k][3] - boxes[k][1]), k)):
        b = boxes[k]
        cells = [(i, j) for i in range(int(b[0] * 3000), int(b[2] * 3000) + 1) for j in range(int(b[1] * 3000), int(b[3] * 3000) + 1)] if b[2] - b[0] < 0.01 else [("large",)]
        if not any(iou(b, boxes[o]) >= 0.5 for c in cells for o in buckets[c]):
            kept.add(k)
            for c in cells:
                buckets[c].append(k)
    df = table(spark, {3: boxes})
    assert {row.no for row in M.nms_table(df, "no").collect()} == kept and len(kept) < len(boxes) - 1000
    # Few candidates meet, and those are dealt over cells.
    side = df.select("tile_id", F.struct(*B.CORNERS).alias("b"))
    levels = side.groupBy("tile_id").agg(F.collect_set(M._level(F.col("b"))).alias("_levels"))
    cell = ["tile_id", "_level", "_cx", "_cy", "_meets"]
    counts = [M._in_cells(side, "b", ["tile_id"], levels, left).groupBy(*cell).agg(F.count("*").alias(f"n{left:d}")) for left in (True, False)]
    met = counts[0].join(counts[1], cell).select((F.col("n0") * F.col("n1")).alias("met")).agg(F.max("met").alias("top"), F.sum("met").alias("all")).first()
    assert met["all"] < 40 * len(boxes) and met.top < 3 * len(boxes)
    best = M.best_iou(df, df.filter("no % 2 = 0"), spark.createDataFrame([(3,)], "tile_id long")).first()
    assert abs(best.iou - 1.0) < 1e-12 and best.n_pred == len(boxes)


def test_detector_function(spark):
    """Loaded by name, shown few tiles at once, held to one answer a tile; columns kept, nulls passed on."""
    def load():
        def boxes_of(batch):
            assert batch.num_rows <= 3
            return [[(0, 0, v, 1.0)] * (v % 3) if v is not None else [] for v in batch.column(batch.schema.get_field_index("v")).to_pylist()]
        return boxes_of

    df = spark.createDataFrame([(i, i if i % 4 else None, "clash") for i in range(20)], "tile_id long, v long, raw string")
    rows = detect(df, load, "by-number", keep=["tile_id", "raw"], rows=3).collect()
    assert {r.tile_id: len(r.raw) for r in rows} == {i: i % 3 if i % 4 else 0 for i in range(20)}
    assert {(b.label, b.x1, b.y2) for r in rows for b in r.raw if r.tile_id == 5} == {("mining_pit", 0.0, 1.0)}
    assert detect(df.limit(0), load, "by-number").collect() == []
    with pytest.raises(Exception, match="answered for 0"):
        detect(df, lambda: lambda batch: [], "silent").collect()
