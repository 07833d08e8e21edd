import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.keyed import hash_block, key_hash
from gridloom.operators import budget as U, curation as C, passes as P
from gridloom.operators.ranking import block_rank
from gridloom.streaming import events as S


def tiles(spark, wants, budget=512):
    rows = [(1, i + 1, i, a, budget, len(wants)) for i, a in enumerate(wants)]
    return spark.createDataFrame(rows, "pass_id long, seq long, tile_id long, want string, budget_kb int, tile_count long")


def test_pass_overshoots_and_replay_does_not(spark):
    t = tiles(spark, ["downlink"] * 10)
    loop = P.ledger(t, F.col("want")).orderBy("seq").collect()
    assert len(loop) == 7 and loop[-1].used_kb == 560 and loop[-1].remaining_kb == 0
    fit = P.ledger(t, F.col("want"), check_fit=True, block=3).orderBy("seq").collect()
    assert len(fit) == 10 and fit[-1].used_kb == 480 and [r.action for r in fit][5:8] == ["downlink", "discard", "discard"]
    assert [r.prior_downlinked for r in loop] == list(range(7))


def test_first_tile_is_processed_even_without_budget(spark):
    assert P.ledger(tiles(spark, ["downlink", "flag"], 0), F.col("want")).count() == 1
    assert P.ledger(tiles(spark, ["flag", "downlink", "flag"], 80), F.col("want")).count() == 2


def test_requests_count_as_discarded(spark):
    t = tiles(spark, ["flag", "request_hires", "request_neighbor", "discard", "downlink"]).withColumn("description", F.concat(F.lit("d"), "seq"))
    s = P.pass_summary(P.ledger(t, F.col("want"))).first()
    assert (s.tiles_flagged, s.tiles_downlinked, s.tiles_discarded, s.flagged_summary) == (1, 1, 3, ["d1", "d5"])


def test_grid(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 5), (2, 0.0, 0.0, 0.1, 9.0, 3), (3, 1.0, 1.0, 1.0, 2.0, 2), (4, 0.0, 0.0, 1.0, 1.0, 0)], "id long, lon_min double, lat_min double, lon_max double, lat_max double, tile_count int")
    got = {}
    for r in P.plan_grid(df).orderBy("id", "tile_no").collect():
        got.setdefault(r.id, []).append((r.tile_id, round(r.lon, 4), round(r.lat, 4)))
    assert [len(got.get(i, [])) for i in (1, 2, 3, 4)] == [5, 3, 2, 0]
    assert got[3] == [("t000", 1.0, 1.5), ("t001", 1.0, 1.5)]
    assert max(lat for _, _, lat in got[2]) < 4.5


def test_block_rank_with_null_groups_and_hot_group(spark):
    r = random.Random(2)
    rows = [(("hot", None, f"g{i % 7}")[r.randrange(3)], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long").withColumn("h", key_hash(1, "k"))
    out = block_rank(df, ["g"], ["h", "k"], hash_block(F.col("h")), "rn", "total").collect()
    by = {}
    for row in out:
        by.setdefault(row.g, []).append(row)
    assert sum(map(len, by.values())) == 3000
    for group in by.values():
        group.sort(key=lambda x: (x.h, x.k))
        assert [x.rn for x in group] == list(range(1, len(group) + 1)) and {x.total for x in group} == {len(group)}


def test_split_and_oversampling_counts(spark):
    df = spark.createDataFrame([("a", i) for i in range(103)] + [("b", 200), ("c", 300), ("c", 301)], "c string, k long")
    s = {(r.c, r.split): r.n for r in C.stratified_split(df, ["c"], "k").groupBy("c", "split").agg(F.count("*").alias("n")).collect()}
    assert s == {("a", "eval"): 21, ("a", "train"): 82, ("b", "train"): 1, ("c", "eval"): 1, ("c", "train"): 1}
    o = {r.c: r.n for r in C.oversample(df, ["c"], 50, "k").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert o == {"a": 103, "b": 50, "c": 50}
    assert C.repeat_rows(df.limit(1), F.lit(5000)).agg(F.count_distinct("copy")).first()[0] == 5000


def test_stream_ledger_waits_for_gaps_and_equals_batch(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for p in range(6):
        wants = [r.choice(["downlink", "downlink", "flag", "discard"]) for _ in range(r.randrange(3, 30))]
        t0 = datetime.datetime(2024, 1, 1)
        rows += [(p, i + 1, t0 + datetime.timedelta(minutes=i), p * 100 + i, w, 512, len(wants)) for i, w in enumerate(wants)]
    schema = "pass_id long, seq long, ts timestamp, tile_id long, action string, budget_kb int, tile_count long"
    batch = spark.createDataFrame(rows, schema)
    r.shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def source():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    cols = ["pass_id", "seq", "tile_id", "action", "used_kb", "remaining_kb"]
    got = sorted(map(tuple, S.run_available(S.stream_ledger(source(), watermark="30 days"), "append").select(*cols).collect()))
    want = sorted(map(tuple, P.ledger(batch, F.col("action")).select(*cols).collect()))
    assert got == want
    sums = {s.pass_id: (s.tiles_processed, s.bandwidth_used_kb) for s in S.run_available(S.stream_summary(source(), watermark="30 days"), "append").collect()}
    ref = {s.pass_id: (s.tiles_processed, s.bandwidth_used_kb) for s in P.pass_summary(P.ledger(batch, F.col("action")).withColumn("description", F.lit("d"))).collect()}
    assert sums == ref


def test_abandoned_pass_is_settled_once_the_watermark_is_past_it(spark, tmp_path):
    schema = "pass_id long, seq long, ts timestamp, tile_id long, action string, budget_kb int, tile_count long"
    t0 = datetime.datetime(2024, 1, 1)
    batches = [
        [(1, 1, t0, 1, "flag", 512, 9), (1, 3, t0, 3, "downlink", 512, 9)],
        [(2, 1, t0 + datetime.timedelta(days=2), 1, "discard", 512, 1)],
        [(2, 1, t0 + datetime.timedelta(days=4), 1, "discard", 512, 1)],
    ]
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.pass_id, r.seq, r.used_kb) for r in S.run_available(S.stream_ledger(stream, watermark="1 hour"), "append").collect()}
    assert got == {(1, 1, 0), (1, 3, 80), (2, 1, 0)}


def test_typed_events_from_json_lines_arrive_once(spark, tmp_path):
    lines = [
        '{"event": "vlm_done", "pass_id": "p", "seq": 2, "ts": "2024-01-01T00:00:02Z", "tile_id": "t1", "detection": {"tile_id": "t1", "boxes": [{"label": "x", "bbox": [0, 0, 1, 1], "confidence": 1.0}], "description": "d", "overall_confidence": 0.9}}',
        '{"event": "budget_update", "pass_id": "p", "seq": 3, "ts": "2024-01-01T00:00:03Z", "bandwidth_used_kb": 80, "bandwidth_remaining_kb": 432}',
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines + lines[:1]) + "\n\n")
    rows = S.run_available(S.event_stream(spark, str(tmp_path / "in")), "append").orderBy("seq").collect()
    assert [(r.seq, r.event) for r in rows] == [(2, "vlm_done"), (3, "budget_update")]
    assert rows[0].detection.boxes[0].bbox == [0.0, 0.0, 1.0, 1.0] and rows[1].bandwidth_used_kb == 80


PASS = "pass_id long, seq long, ts timestamp, tile_id long, action string, budget_kb int, tile_count long"


def _stream(spark, path, schema, batches):
    """Each list of rows is a micro-batch."""
    import time

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_many_tiles_wait_in_one_pass(spark, tmp_path):
    """All tiles but the first come first, in any order, some twice."""
    n, t0 = 100_000, datetime.datetime(2024, 1, 1)
    rows = spark.range(2, n + 1).select(
        F.lit(1).cast("long").alias("pass_id"), F.col("id").alias("seq"), F.lit(t0).alias("ts"), F.col("id").alias("tile_id"),
        F.when(F.col("id") % 1000 == 0, "downlink").otherwise("flag").alias("action"), F.lit(10**6).alias("budget_kb"), F.lit(n).cast("long").alias("tile_count"))
    rows.unionByName(rows.filter("seq < 700")).orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = _stream(spark, tmp_path / "in", PASS, [[(1, 1, t0, 1, "discard", 10**6, n)]])
    out = S.run_available(S.stream_ledger(stream), "append").cache()
    r = out.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d"), F.max("used_kb").alias("kb"), F.min("batch").alias("b")).first()
    assert (r.n, r.d, r.kb, r.b) == (n, n, 8000, 1)


def test_summary_comes_on_the_terminal_event_and_passes_leave_the_state(spark, tmp_path):
    schema = PASS + ", description string, event string"
    t0, hour = datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)
    tile = lambda p, s, at, action, d: (p, s, at, s, action, 800, 20, d, "agent_decided")
    end = lambda p, s, at: (p, s, at, None, None, None, None, None, "pass_complete")
    batches = [
        [end(1, 13, t0), *[tile(1, s, t0, "flag", f"d{s}") for s in range(12, 1, -1)], tile(2, 1, t0, "flag", "left")],
        [tile(1, 1, t0, "discard", "d1")],
        [tile(3, s, t0 + 4 * hour, "downlink", f"x{s}") for s in range(1, 13)],  # the budget ends it at the tenth; no terminal event yet
        [tile(4, 1, t0 + 8 * hour, "flag", "y"), end(3, 13, t0 + 8 * hour), end(1, 13, t0 + 8 * hour)],
        [end(5, 2, t0 + 16 * hour)],
    ]
    stream = _stream(spark, tmp_path / "in", schema, batches)
    spark.conf.set(S.STORE, S.ROCKS)
    seen, log = [], str(tmp_path / "log")
    query = S.stream_summary(stream).writeStream.outputMode("append").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(
        lambda rows, batch: seen.extend((batch, r.pass_id, r.tiles_processed, r.bandwidth_used_kb, tuple(r.flagged_summary)) for r in rows.collect())).start()
    query.awaitTermination()
    spark.conf.unset(S.STORE)
    by_pass = {p: (b, *rest) for b, p, *rest in seen}
    assert len(by_pass) == len(seen) and set(by_pass) == {1, 2, 3, 4}
    assert by_pass[1] == (1, 12, 0, tuple(f"d{s}" for s in range(2, 12)))  # in order, though the end came first
    assert by_pass[2][1:] == (1, 0, ("left",)) and by_pass[3] == (3, 10, 800, tuple(f"x{s}" for s in range(1, 11)))
    assert by_pass[4][1:] == (1, 0, ("y",))
    # All passes but the last one (whose timer has not run out) have left.
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_tile_state_is_forgotten_and_copies_change_nothing(spark, tmp_path):
    schema = "pass_id long, tile_no long, ts timestamp, seq long, event string, value double"
    t0, day = datetime.datetime(2024, 1, 1), datetime.timedelta(days=1)
    first = [(1, 1, t0, 1, "tile_arrived", 5.0), (1, 1, t0, 3, "agent_decided", 7.0), (1, 1, t0, 2, "vlm_done", None), (1, 2, t0, 4, "vlm_done", 1.0)]
    again = [first[1], (1, 1, t0, 5, "tile_arrived", 6.0)]
    stream = _stream(spark, tmp_path / "in", schema, [first, first, again, [(2, 1, t0 + day, 1, "vlm_done", 2.0)], [(1, 1, t0 + 2 * day, 9, "agent_decided", 8.0)]])
    got = {(r.batch, r.pass_id, r.tile_no): (r.has_arrived, r.arrived, r.detection, r.decision, r.last_seq) for r in S.run_available(S.stream_tile_state(stream), "update").collect()}
    assert got == {
        (0, 1, 1): (True, 5.0, None, 7.0, 3), (0, 1, 2): (False, None, 1.0, None, 4),
        (2, 1, 1): (True, 6.0, None, None, 5),
        (3, 2, 1): (False, None, 2.0, None, 1), (4, 1, 1): (False, None, None, 8.0, 9),  # the finished pass was forgotten
    }


def test_neighbors_across_blocks_repeats_and_missing_cells(spark):
    """Blocks of three cells a side: rims meet, the newest earlier tile of a cell counts, tiles without a cell have none."""
    r = random.Random(8)
    rows = [(p, i, r.randrange(-4, 8), r.randrange(0, 9), i // 2, r.choice("abc"), i, "h") for p in (1, 2) for i in range(150)]
    rows += [(1, 900, None, 2, 5, "a", 1, "h"), (None, 901, 1, 1, 9, "a", 1, "h"), (None, 902, 1, 2, 8, "b", 2, "h")]
    df = spark.createDataFrame(rows, "pass_id long, tile_id long, row int, col int, seq long, action string, boxes long, scene_hint string")
    got = {x.tile_id + 1000 * (x.pass_id or 0): {d: s.boxes for d, s in x.neighbors.items()} for x in P.neighbor_summary(df, side=3).collect()}
    assert len(got) == len(rows)
    for p, t, row, col, seq, *_ in rows:
        want = {}
        for d, (dr, dc) in P.STEPS.items():
            near = [(x[4], x[6]) for x in rows if row is not None and x[0] == p and (x[2], x[3]) == (row + dr, col + dc) and x[4] < seq]
            if near:
                want[d] = {b for s, b in near if s == max(near)[0]}
        mine = got[t + 1000 * (p or 0)]
        assert mine.keys() == want.keys() and all(mine[d] in want[d] for d in want), (t, mine, want)
    plan = P.neighbor_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 1 and "Join" not in plan


@pytest.mark.parametrize("block", [3, 4096])
def test_unequal_costs_equal_a_sequential_replay(spark, block):
    r = random.Random(5)
    rows = [(p, i, r.choice(["downlink", "downlink", "flag"]), r.choice([0, 1, 7, 40, 300, None, -3]), 10 ** (p or 1)) for p in (1, 2, 3, None) for i in range(1, 200)]
    rows += [(9, i, "downlink", 1, 5000) for i in range(1, 6001)] + [(8, 1, "downlink", 5, 0), (7, 4, "downlink", 5, 9), (7, 2, "downlink", 5, 9)]
    df = spark.createDataFrame(rows, "pass_id long, seq long, want string, kb int, budget_kb int").repartition(5)
    got = {(x.pass_id, x.seq): (x.action, x.cost_kb, x.used_kb, x.remaining_kb) for x in U.cost_ledger(df, F.col("want"), F.col("kb"), block=block).collect()}
    want, left = {}, {}
    for p, i, action, kb, budget in sorted(rows, key=lambda x: (x[0] or 0, x[1])):
        now = left.get(p, budget)
        cost = max(0, kb or 0) if action == "downlink" else 0
        if cost > now:
            action = "discard"
        else:
            now -= cost
        left[p] = now
        want[(p, i)] = (action, cost, budget - now, now)
    assert got == want
    assert U.cost_ledger(df.limit(0), F.col("want"), F.col("kb")).collect() == []


def test_streamed_confusion_joins_both_sides_once(spark, tmp_path):
    """Sides in either order, a late one that stays unmatched, empty sides; scores as the batch's."""
    rows = "array<struct<y:bigint,word:bigint,bits:bigint>>"
    t0, minute = datetime.datetime(2024, 1, 1), datetime.timedelta(minutes=1)
    pred = [(1, t0, 8, 8, [(0, 0, 0b1110), (1, 0, 0b1)]), (2, t0 + minute, 8, 8, []), (3, t0, 8, 8, [(0, 0, 1)])]
    truth = [(1, t0 + 30 * minute, [(0, 0, 0b0111), (5, 0, 0b1)]), (2, t0, [(2, 0, 0b11)]), (3, t0 + 90 * minute, [(0, 0, 1)]), (4, t0, [])]
    p = _stream(spark, tmp_path / "p", f"k long, ts timestamp, w int, h int, pred {rows}", [pred[:1], pred[1:]])
    t = _stream(spark, tmp_path / "t", f"k long, ts timestamp, truth {rows}", [truth[2:], truth[:2]])
    got = {r.k: (r.tp, r.fp, r.fn, r.tn) for r in S.run_available(S.stream_confusion(p, t, ["k"], watermark="2 hours"), "append").collect()}
    assert got == {1: (2, 2, 2, 58), 2: (0, 0, 2, 62)}


def test_tile_state_costs_a_state_row_for_each_bucket(spark, tmp_path):
    """Keys share buckets: state rows and timers don't grow with the tiles; null and text keys stay as they are."""
    schema = "pass_id long, tile_no string, ts timestamp, seq long, event string, value double"
    t0, n = datetime.datetime(2024, 1, 1), 20_000
    tile = lambda i: (None if i % 7 == 0 else 2**53 + i, None if i % 5 == 0 else f"t{i}")
    stream = _stream(spark, tmp_path / "in", schema, [[(*tile(i), t0, 1, "vlm_done", float(i)) for i in range(1, n)]])
    spark.conf.set(S.STORE, S.ROCKS)
    seen = []
    query = S.stream_tile_state(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(
        lambda rows, batch: seen.extend((r.pass_id, r.tile_no, r.detection, r.last_seq) for r in rows.collect())).start()
    query.awaitTermination()
    spark.conf.unset(S.STORE)
    want = {}
    for i in range(1, n):
        want.setdefault(tile(i), set()).add(float(i))
    assert len(seen) == len(want) and all(v in want[(p, t)] and s == 1 for p, t, v, s in seen)
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 3 * 4096


def test_passes_share_state_rows(spark, tmp_path):
    """Every pass waits for its first tile; null and large numbers of passes and tiles stay whole."""
    t0, n, big = datetime.datetime(2024, 1, 1), 15_000, 2**53
    name = lambda i: None if i == 7 else big + i
    stream = _stream(spark, tmp_path / "in", PASS, [[(name(i), s, t0, big + s, "downlink", 512, 2) for i in range(n) for s in (k,)] for k in (2, 1)])
    spark.conf.set(S.STORE, S.ROCKS)
    seen = []
    query = S.stream_ledger(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(
        lambda rows, batch: seen.extend(tuple(r) for r in rows.collect())).start()
    query.awaitTermination()
    spark.conf.unset(S.STORE)
    assert sorted(seen, key=str) == sorted([(name(i), s, big + s, "downlink", 80 * s, 512 - 80 * s) for i in range(n) for s in (1, 2)], key=str)
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 3 * 4096
