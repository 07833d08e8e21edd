import itertools
import random
import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evaluate as E, messages as T, raster as R
from gridloom.operators.ranking import exact_quantiles

SPIRAL = """
#########
........#
#######.#
#.....#.#
#.###.#.#
#.#...#.#
#.#####.#
#.......#
#########"""
COMB = """
#.#.#.#.#
#.#.#.#.#
#.#.#.#.#
#########"""
U_SHAPE = """
##....##
##....##
########"""
DIAGONAL = """
#...
.#..
..#.
#..#"""


def pixels(art, name):
    lines = art.strip("\n").split("\n")
    return [(name, x, y) for y, row in enumerate(lines) for x, c in enumerate(row) if c == "#"]


def brute(points):
    left, out = set(points), []
    while left:
        todo, comp = [left.pop()], []
        while todo:
            x, y = todo.pop()
            comp.append((x, y))
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        xs, ys = [p[0] for p in comp], [p[1] for p in comp]
        first = min((y, x) for x, y in comp)
        out.append((first[0] * 2**32 + first[1], len(comp), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return sorted(out)


def check(spark, rows, blocks):
    df = spark.createDataFrame(rows, "patch_id string, x int, y int")
    want = {p: brute([(x, y) for q, x, y in rows if q == p]) for p in {r[0] for r in rows}}
    for b in blocks:
        got = {}
        for r in R.components(df, ["patch_id"], block=b).collect():
            got.setdefault(r.patch_id, []).append((r.comp, r.px, r.x1, r.y1, r.x2, r.y2))
        assert {p: sorted(v) for p, v in got.items()} == want


def test_components_of_hard_shapes(spark):
    rows = [p for art, n in ((SPIRAL, "spiral"), (COMB, "comb"), (U_SHAPE, "u"), (DIAGONAL, "diagonal")) for p in pixels(art, n)]
    check(spark, rows + rows[:5], (128, 4, 2))


def test_components_of_random_scenes(spark):
    r = random.Random(1)
    rows = [(f"s{i}", x, y) for i, d in enumerate((0.3, 0.55, 0.62)) for x in range(40) for y in range(33) if r.random() < d]
    check(spark, rows, (64, 8))


def test_symmetries_are_the_group_and_keep_components(spark):
    df = spark.createDataFrame(pixels(SPIRAL, "a") + pixels(U_SHAPE, "b"), "patch_id string, x int, y int")
    out = R.augment(df, F.lit(9))
    shapes = {}
    for row in out.collect():
        shapes.setdefault((row.patch_id, row.variant), set()).add((row.x, row.y))
    assert len(shapes) == 16 and all(0 <= x < 9 and 0 <= y < 9 for s in shapes.values() for x, y in s)
    twice = {}
    for row in R.augment(out.withColumnRenamed("variant", "first"), F.lit(9)).collect():
        twice.setdefault((row.patch_id, row.first, row.variant), set()).add((row.x, row.y))
    closed = {frozenset(v) for (p, _), v in shapes.items() if p == "b"}
    assert all(frozenset(v) in closed for (p, _, _), v in twice.items() if p == "b")
    comps = R.components(out, ["patch_id", "variant"])
    sizes = {}
    for row in comps.collect():
        sizes.setdefault((row.patch_id, row.variant), []).append(row.px)
    assert all(sorted(v) == sorted(sizes[(p, "orig")]) for (p, _), v in sizes.items())


def test_rasterising_rounds_half_even_and_clamps(spark):
    rows = [(1, 0.5 / 8, 0.0, 2.5 / 8, 0.25), (1, -0.5, 0.9, 2.0, 1.5), (1, 0.5, 0.5, 0.51, 0.9), (2, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "patch_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.patch_id, r.x, r.y) for r in R.rasterize(df, F.lit(8), F.lit(8)).collect()}
    want = {(1, x, y) for x in (0, 1) for y in (0, 1)} | {(1, x, 7) for x in range(8)} | set(itertools.product([2], range(8), range(8)))
    assert got == want


def test_confusion_counts_every_pixel_on_wide_patches(spark):
    r = random.Random(3)
    p = {(i, r.randrange(100), r.randrange(70)) for i in (1, 2) for _ in range(900)}
    t = {(i, r.randrange(100), r.randrange(70)) for i in (2, 3) for _ in range(900)}
    schema = "patch_id long, x int, y int"
    patches = spark.createDataFrame([(i, 100, 70) for i in (1, 2, 3, 4)], "patch_id long, w int, h int")
    out = {c.patch_id: c for c in R.pixel_confusion(spark.createDataFrame(list(p), schema), spark.createDataFrame(list(t), schema), patches).collect()}
    for i in (1, 2, 3, 4):
        a, b = {q for q in p if q[0] == i}, {q for q in t if q[0] == i}
        assert (out[i].tp, out[i].fp, out[i].fn) == (len(a & b), len(a - b), len(b - a))
        assert out[i].tp + out[i].fp + out[i].fn + out[i].tn == 7000


def test_ceiling_recall_is_one(spark):
    rows = pixels(SPIRAL, "a") + pixels(DIAGONAL, "b")
    df = spark.createDataFrame(rows, "patch_id string, x int, y int")
    patches = spark.createDataFrame([("a", 9, 9), ("b", 9, 9), ("c", 9, 9)], "patch_id string, w int, h int")
    conf = R.box_ceiling(df, patches, ["patch_id"])
    assert E.pixel_metrics(conf).first().pixel_recall == 1.0
    assert conf.agg(F.sum("fn")).first()[0] == 0


@pytest.mark.parametrize("span_rows", [20, 100_000])
def test_quantiles_of_one_hot_group(spark, span_rows):
    """By rounds and sorted as it is: outliers, ties at and beside the ranks, one value alone, nulls, an empty group."""
    r = random.Random(5)
    values = [r.lognormvariate(0, 3) for _ in range(3001)] + [1e300, -1e300, 5.0, 5.0, 5.0, None]
    rows = [("hot", v) for v in values] + [("one", 4.0), ("none", None)] + [("flat", 7.0)] * 90
    rows += [("ties", float(v)) for v in [1] * 500 + [2] * 3 + list(range(3, 300)) + [400] * 500] + [("steps", float(r.choice([1, 2, 3]))) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = (0.02, 0.5, 0.98, 0.0, 1.0)
    got = {row.k: tuple(row)[1:] for row in exact_quantiles(df, ["k"], "v", probs, span_rows).collect()}
    want = df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()
    assert got == {w.k: tuple(w.q) if w.q else (None,) * 5 for w in want}


def test_quantiles_of_a_scene_of_millions_of_values(spark):
    """Ten million distinct values and outliers under one key, beside a small patch."""
    n = 10_000_000
    scene = spark.range(0, n, 1, 16).select(F.lit(1).alias("k"), F.when(F.col("id") % 3_000_000 == 7, 1e200).otherwise(F.pmod(F.col("id") * 7_654_321, F.lit(n)).cast("double")).alias("v"))
    df = scene.unionByName(spark.range(101).select(F.lit(2).alias("k"), F.col("id").cast("double").alias("v")))
    got = {r.k: (r.q0, r.q1) for r in exact_quantiles(df, ["k"], "v", (0.02, 0.98)).collect()}
    values = sorted([float(i * 7_654_321 % n) for i in range(n) if i % 3_000_000 != 7] + [1e200] * 4)

    def at(p):
        r = (n - 1) * p
        f, c = values[int(r)], values[int(r) + 1]
        return (int(r) + 1 - r) * f + (r - int(r)) * c

    assert got == {1: (at(0.02), at(0.98)), 2: (2.0, 98.0)}


def test_stretch_truncates_and_flat_bands_are_black(spark):
    df = spark.createDataFrame([(1, 0, i, 0, float(i)) for i in range(101)] + [(2, 0, i, 0, 7.0) for i in range(5)], "patch_id long, band int, x int, y int, v double")
    levels = {(r.patch_id, r.x): r.level for r in R.stretch(df).collect()}
    assert levels[(1, 0)] == 0 and levels[(1, 100)] == 255 and levels[(1, 50)] == int((50 - 2) / 96 * 255)
    assert all(levels[(2, i)] == 0 for i in range(5))


def test_patch_stats_keep_empty_patches_and_raster_order(spark):
    df = spark.createDataFrame(pixels(DIAGONAL, "a"), "patch_id string, x int, y int")
    patches = spark.createDataFrame([("a", 4, 4), ("none", 4, 4)], "patch_id string, w int, h int")
    out = {r.patch_id: r for r in R.patch_stats(R.components(df, ["patch_id"]), patches, ["patch_id"]).collect()}
    assert out["none"].pit_count == 0 and out["none"].bboxes == [] and out["none"].total_area_ha == 0.0
    assert [tuple(b) for b in out["a"].bboxes] == [(0.0, 0.0, 0.25, 0.25), (0.25, 0.25, 0.5, 0.5), (0.5, 0.5, 0.75, 0.75), (0.0, 0.75, 0.25, 1.0), (0.75, 0.75, 1.0, 1.0)]
    sentence = T.describe(R.patch_totals(R.components(df, ["patch_id"]), patches, ["patch_id"]), ["patch_id"]).collect()
    assert Counter(r.pit_count for r in sentence) == {0: 1, 5: 1} and all("{" not in r.description and "  " not in r.description for r in sentence)


def test_stretch_keeps_bands_without_values(spark):
    rows = [(1, 0, i, 0, float(i)) for i in range(50)] + [(1, 1, i, 0, None) for i in range(50)]
    out = R.stretch(spark.createDataFrame(rows, "patch_id long, band int, x int, y int, v double")).collect()
    assert len(out) == 100 and all((r.level is None) == (r.band == 1) for r in out)


def test_declared_extent_is_checked(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "patch_id long, x int, y int")
    assert [r.px for r in R.components(df, ["patch_id"], within_block=True).collect()] == [2]
    with pytest.raises(Exception, match="within_block"):
        R.components(spark.createDataFrame([(1, 500, 3)], "patch_id long, x int, y int"), ["patch_id"], within_block=True).collect()


@pytest.mark.parametrize("span_rows", [100_000, 3])
def test_quantiles_equal_duckdb_to_the_last_bit(spark, span_rows):
    r = random.Random(5)
    price = lambda: round(r.uniform(900, 100_000), 2)
    rows = [(k, v) for k in range(300) for n in [r.randrange(2, 60)] for v in ([price()] * n if k % 3 == 0 else [price() for _ in range(n)])]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {k: (a, b) for k, a, b in con.execute("SELECT k, quantile_cont(v, 0.02e0), quantile_cont(v, 0.98e0) FROM t GROUP BY k").fetchall()}
    df = spark.createDataFrame(rows, "k long, v double")
    assert {q.k: (q.q0, q.q1) for q in exact_quantiles(df, ["k"], "v", (0.02, 0.98), span_rows).collect()} == want


def test_labelling_a_large_batch_takes_bounded_memory(spark):
    """4,000 full blocks in one batch: a worker's arrays follow the runs, and every block is labelled as if alone."""
    label, full = R._label_blocks(32).func, list(range(1024))
    cells = pa.array([full, [0, 2, 34], []] * 4_000, pa.list_(pa.int32()))
    tracemalloc.start()
    got = label(cells.slice(1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert len(got) == 11_999 and got[0].as_py()["parts"] == [dict(zip(("root", "px", "x1", "y1", "x2", "y2"), v)) for v in ((0, 1, 0, 0, 1, 1), (2, 2, 2, 0, 3, 2))]
    assert got.slice(3, 9).equals(got.slice(0, 9)) and got[11_997] == got[0]
    assert len(label(cells.slice(0, 0))) == 0


def test_symmetries_are_labelled_from_pixels_gathered_once(spark):
    rows = pixels(SPIRAL, "a") + pixels(U_SHAPE, "b") + pixels(DIAGONAL, "c")
    df = spark.createDataFrame(rows + rows[:9], "patch_id string, x int, y int")
    for group in ("d4", "flips", "none"):
        want = R.components(R.augment(df, F.lit(9), group), ["patch_id", "variant"], 2, within_block=True)
        got = R.components(df, ["patch_id"], 2, within_block=True, symmetries=group, size=F.lit(9))
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for size in (8, 129):  # a pixel beyond the square, a square beyond the block
        with pytest.raises(Exception, match="outside"):
            R.components(df, ["patch_id"], within_block=True, symmetries="d4", size=F.lit(size)).collect()
