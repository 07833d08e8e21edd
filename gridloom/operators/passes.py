"""Passes: tile grids, decisions under a downlink budget, summaries and policy comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom import constants as K
from gridloom.functions.keyed import gauss, key_hash, pick, uniform
from gridloom.functions.numbers import safe_div
from gridloom.operators.ranking import block_rank, block_running_sum, seq_block

Policy = Callable[[DataFrame], Column]


def validate_passes(passes: DataFrame, max_tiles: int = K.MAX_TILES_PER_PASS) -> DataFrame:
    """Adds ``is_valid``: 1 to ``max_tiles`` tiles, a known mode."""
    mode = F.col("mode").isin("threshold", "rules", "agent") if "mode" in passes.columns else F.lit(True)
    return passes.withColumn("is_valid", F.coalesce(F.col("tile_count").between(1, max_tiles) & mode, F.lit(False)))


def pass_id(*request: Column | str) -> Column:
    """Twelve hex digits derived from the request."""
    return F.substring(key_hash("pass", *request), 1, 12)


def plan_grid(passes: DataFrame) -> DataFrame:
    """Tile centres of every pass: adds ``tile_no, tile_id, row, col, lon, lat``.

    Rows follow the area's aspect in kilometres; the first ``tile_count`` cells in row-major order are
    used. An area without extent repeats its centre.
    """
    n = F.col("tile_count")
    height, width = F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min")
    mid_lat, mid_lon = (F.col("lat_min") + F.col("lat_max")) / 2, (F.col("lon_min") + F.col("lon_max")) / 2
    aspect = (width * F.lit(K.KM_PER_DEG_LAT) * F.cos(F.radians(mid_lat))) / (height * F.lit(K.KM_PER_DEG_LAT))
    rows = F.greatest(F.lit(1), F.rint(F.sqrt(n / aspect)).cast("int"))
    sized = (
        passes.filter(n > 0)
        .withColumn("_flat", (height <= 0) | (width <= 0))
        .withColumn("_rows", F.when(F.col("_flat"), F.lit(1)).otherwise(rows))
        .withColumn("_cols", F.greatest(F.lit(1), F.ceil(n / F.col("_rows"))).cast("int"))
    )
    placed = (
        sized.withColumn("tile_no", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
        .withColumn("row", F.floor(F.col("tile_no") / F.col("_cols")).cast("int"))
        .withColumn("col", (F.col("tile_no") % F.col("_cols")).cast("int"))
        .filter(F.col("_flat") | (F.col("row") < F.col("_rows")))
    )
    lat = F.col("lat_min") + (F.col("row") + 0.5) * (height / F.col("_rows"))
    lon = F.col("lon_min") + (F.col("col") + 0.5) * (width / F.col("_cols"))
    digits = F.col("tile_no").cast("string")
    return (
        placed.withColumn("tile_id", F.concat(F.lit("t"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0"))))
        .withColumn("lon", F.when(F.col("_flat"), mid_lon).otherwise(lon))
        .withColumn("lat", F.when(F.col("_flat"), mid_lat).otherwise(lat))
        .drop("_flat", "_rows", "_cols")
    )


def sample_coordinates(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A stratified coordinate per id: stratum by weight, area within it evenly, Gaussian scatter.

    Adds ``stratum, area, lon, lat``, the area's ``mission_priors`` and ``coord_id``, ``u`` and the number in four digits or
    more. The standard deviation is half the area's radius. Draws are keyed by id, so any partitioning and
    any subset of ids gives the same coordinates.
    """
    h, h2 = key_hash(seed, key), key_hash(seed + 1, key)
    u = uniform(h, 1)
    stratum = F.lit(None).cast("string")
    upto = 1.0
    for name, weight in reversed(list(K.STRATUM_WEIGHTS.items())):
        stratum = F.when(u < F.lit(round(upto, 10)), F.lit(name)).otherwise(stratum)
        upto -= weight
    by_stratum: dict[str, list[tuple]] = {}
    for area in K.SAMPLING_AREAS:
        by_stratum.setdefault(area[4], []).append(area)

    def choices(areas: Sequence[tuple]) -> Column:
        return F.array(
            *[
                F.struct(*[F.lit(v).alias(n) for n, v in zip(("area", "lon", "lat", "radius", "stratum", "prior"), a)]) for a in areas
            ]
        )

    area = F.lit(None)
    for name, areas in by_stratum.items():
        area = F.when(F.col("stratum") == name, F.get(choices(areas), pick(h, len(areas), 9))).otherwise(area)
    sigma = F.col("_a.radius") / 2
    return (
        ids.withColumn("stratum", stratum)
        .withColumn("_a", area)
        .withColumn("area", F.col("_a.area"))
        .withColumn("lon", F.col("_a.lon") + sigma * gauss(h2, 1, 9))
        .withColumn("lat", F.col("_a.lat") + sigma * gauss(h2, 17, 25))
        .withColumn("mission_priors", F.col("_a.prior"))
        .withColumn("coord_id", F.when(F.col(key).isNotNull(), F.format_string("u%04d", F.col(key).cast("long"))))
        .drop("_a")
    )


# --------------------------------------------------------------------------- decisions


def threshold_action(conf: Column, hi: float = K.DOWNLINK_CONFIDENCE, lo: float = K.FLAG_CONFIDENCE) -> Column:
    """``struct(action, reason)`` of the threshold policy."""

    def outcome(action: str, reason: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))

    return (
        F.when(conf >= hi, outcome("downlink", K.REASON_DOWNLINK))
        .when(conf >= lo, outcome("flag", K.REASON_FLAG))
        .otherwise(outcome("discard", K.REASON_DISCARD))
    )


def restrict_actions(df: DataFrame, allowed: Sequence[str] = K.MINIMAL_TOOLS, column: str = "tool") -> DataFrame:
    return df.filter(F.col(column).isin(*allowed))


def send_everything(_: DataFrame) -> Column:
    return F.lit("downlink")


def random_policy(seed: int = 42, key: str = "tile_id") -> Policy:
    def choose(_: DataFrame) -> Column:
        return F.get(F.array(F.lit("downlink"), F.lit("flag"), F.lit("discard")), pick(key_hash(seed, key), 3))

    return choose


def threshold_policy(_: DataFrame) -> Column:
    return threshold_action(F.col("confidence"))["action"]


def decided_policy(column: str = "decided_action") -> Policy:
    """A model's decisions, already joined to the tiles as a column."""
    return lambda _: F.coalesce(F.col(column), F.lit("discard"))


def apply_policies(tiles: DataFrame, policies: Mapping[str, Policy]) -> DataFrame:
    """Every tile once per policy with the ``action`` that policy wants: one scan for all."""
    wanted = F.array(*[F.struct(F.lit(n).alias("policy"), p(tiles).alias("action")) for n, p in policies.items()])
    return tiles.withColumn("_p", F.explode(wanted)).select("*", "_p.policy", "_p.action").drop("_p")


def ledger(
    tiles: DataFrame, action: Column, cost_kb: int = K.DOWNLINK_KB, check_fit: bool = False,
    by: Sequence[str] = ("pass_id",), block: int = 4096,
) -> DataFrame:
    """Budget account per pass in ``seq`` order (from 1): adds ``action, used_kb, remaining_kb, prior_downlinked``.

    Without ``check_fit`` a pass ends after the tile that exhausts the budget, which it may overshoot.
    With it a downlink that no longer fits becomes a discard and the pass goes on. Both are running
    sums over blocks of ``seq``, so a pass of any length is spread over tasks.
    """
    staged = tiles.withColumn("action", action)
    wants = F.when(F.col("action") == "downlink", 1).otherwise(0)
    run = block_running_sum(staged, by, ["seq"], seq_block(F.col("seq"), block), wants, "_run")
    budget = F.col("budget_kb")
    if check_fit:
        cap = F.greatest(F.lit(0), F.floor(budget / cost_kb))
        used = F.least(F.col("_run"), cap) * cost_kb
        out = run.withColumn("used_kb", used).withColumn(
            "action", F.when((F.col("action") == "downlink") & (F.col("_run") > cap), "discard").otherwise(F.col("action"))
        )
        before = F.col("used_kb") - F.when(F.col("action") == "downlink", cost_kb).otherwise(0)
    else:
        out = run.withColumn("used_kb", F.col("_run") * cost_kb)
        before = F.col("used_kb") - F.when(F.col("action") == "downlink", cost_kb).otherwise(0)
        out = out.filter((F.col("seq") == 1) | (before < budget))
    return (
        out.withColumn("used_kb", F.col("used_kb").cast("long"))
        .withColumn("remaining_kb", F.greatest(F.lit(0), budget - F.col("used_kb")).cast("long"))
        .withColumn("prior_downlinked", F.floor(before / cost_kb).cast("long"))
        .drop("_run")
    )


def pass_summary(account: DataFrame, by: Sequence[str] = ("pass_id",), first: int = 10) -> DataFrame:
    """Counts and KB per pass, and the first descriptions of flagged or downlinked tiles.

    Neighbour and higher-resolution requests count as discarded.
    """
    by = list(by)

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    action = F.col("action")
    totals = account.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tiles_processed"),
        n(action == "flag").alias("tiles_flagged"),
        n(action == "downlink").alias("tiles_downlinked"),
        n(~action.isin("flag", "downlink")).alias("tiles_discarded"),
        F.max("used_kb").alias("bandwidth_used_kb"),
        F.min("remaining_kb").alias("bandwidth_remaining_kb"),
    )
    w = Window.partitionBy(*by).orderBy("seq")
    noted = (
        account.filter(action.isin("flag", "downlink"))
        .select(*by, "seq", "description")
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= first)
        .groupBy(*by)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda r: r["description"]).alias("flagged_summary"))
    )
    return totals.join(noted, by, "left").withColumn(
        "flagged_summary", F.coalesce("flagged_summary", F.expr("cast(array() as array<string>)"))
    )


def compare_policies(
    tiles: DataFrame, policies: Mapping[str, Policy], cost_kb: int = K.DOWNLINK_KB,
    by: Sequence[str] = ("pass_id",), per_pass: bool = False,
) -> DataFrame:
    """Replay of several policies on the same tiles under the fit-checked budget.

    ``tiles`` brings ``seq, budget_kb, has_pit`` and what the policies read.
    """
    account = ledger(apply_policies(tiles, policies), F.col("action"), cost_kb, True, ["policy", *by])
    sent = F.col("action") == "downlink"
    out = account.groupBy("policy", *(by if per_pass else ())).agg(
        F.sum(F.when(sent, 1).otherwise(0)).cast("long").alias("tiles_downlinked"),
        F.sum(F.when(sent & F.col("has_pit"), 1).otherwise(0)).cast("long").alias("pits_captured"),
        F.sum(F.when(F.col("has_pit"), 1).otherwise(0)).cast("long").alias("pits_total"),
        F.sum(F.when(sent, cost_kb).otherwise(0)).cast("long").alias("kb_used"),
    )
    return out.withColumn("pits_per_kb", safe_div(F.col("pits_captured"), F.col("kb_used")))


# --------------------------------------------------------------------------- neighbours and events

# Grid step from a tile to its neighbour, rows counted from south to north.
STEPS = {"north": (1, 0), "south": (-1, 0), "east": (0, 1), "west": (0, -1)}


#: Sides of the blocks of the grid that are dealt to tasks.
GRID_BLOCK = 16


def neighbor_summary(tiles: DataFrame, by: Sequence[str] = ("pass_id",), side: int = GRID_BLOCK) -> DataFrame:
    """Adds ``neighbors``: direction to action, boxes and scene hint of tiles decided earlier (the newest of each cell).

    ``tiles`` brings ``row, col, seq, action, boxes, scene_hint``. Blocks of ``side`` by ``side`` cells get their tiles and
    the rim around them in one exchange, so a pass of any size is dealt over tasks. Inside a block every tile is offered to
    the four cells around it and met there in one running window; nothing is joined. A tile without a cell has no neighbors.
    """
    by = list(by)
    block = lambda r, c: F.struct(F.floor(r / side).alias("br"), F.floor(c / side).alias("bc"))
    around = [F.struct(F.lit(d).alias("direction"), (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col")) for d, (dr, dc) in STEPS.items()]
    row, col = F.col("row"), F.col("col")
    blocks = F.array_distinct(F.array(block(row, col), *[block(row - dr, col - dc) for dr, dc in STEPS.values()]))
    sent = tiles.withColumn("_at", F.explode(blocks)).select(
        *by, F.col("_at.br").alias("_br"), F.col("_at.bc").alias("_bc"), "row", "col", "seq", F.struct("action", "boxes", "scene_hint").alias("_seen"),
        # Only the tile's own block needs its other columns.
        F.when(F.col("_at").eqNullSafe(block(row, col)), F.struct(*tiles.columns)).alias("_tile"),
    )
    dealt = sent.repartition(*by, "_br", "_bc")
    asks = F.struct(F.lit(None).cast("string").alias("direction"), row.alias("row"), col.alias("col"))
    here = F.filter(F.array(*around), lambda o: (F.floor(o["row"] / side) == F.col("_br")) & (F.floor(o["col"] / side) == F.col("_bc")))
    offers = F.concat(here, F.when(F.col("_tile").isNotNull(), F.array(asks)).otherwise(F.filter(F.array(asks), lambda o: F.lit(False))))
    met = dealt.withColumn("_o", F.explode(offers)).select(
        *by, "_br", "_bc", F.col("_o.row").alias("_row"), F.col("_o.col").alias("_col"), "seq", F.col("_o.direction").alias("_d"),
        F.when(F.col("_o.direction").isNotNull(), F.col("_seen")).alias("_seen"), F.when(F.col("_o.direction").isNull(), F.col("_tile")).alias("_tile"),
    )
    before = Window.partitionBy(*by, "_br", "_bc", "_row", "_col").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    latest = [F.last(F.when(F.col("_d") == d, F.col("_seen")), ignorenulls=True).over(before).alias(f"_{d}") for d in STEPS]
    pairs = F.filter(
        F.array(*[F.struct(F.lit(d).alias("key"), F.col(f"_{d}").alias("value")) for d in STEPS]), lambda e: e["value"].isNotNull()
    )
    seen = met.select("_tile", *latest).filter(F.col("_tile").isNotNull())
    return seen.select("_tile.*", F.map_from_entries(pairs).alias("neighbors"))


def number_events(events: DataFrame, order: Sequence[str] = ("ts", "event_id"), block: Column | None = None) -> DataFrame:
    """Sequence numbers from 1 per pass in event order, ranked within days."""
    day = F.date_trunc("day", F.col(order[0])) if block is None else block
    return block_rank(events, ["pass_id"], list(order), day, "seq")


# Which event kind sets which field of a tile's state.
TILE_FIELDS = {
    "arrived": "tile_arrived",
    "detection": "vlm_done",
    "scratchpad": "agent_thinking",
    "decision": "agent_decided",
}


def tile_state(events: DataFrame, by: Sequence[str] = ("pass_id", "tile_no")) -> DataFrame:
    """Latest value of each event kind per tile, folded into one row. Works on batch and stream alike.

    A later arrival starts the tile afresh: what came before it no longer shows.
    """
    of = {name: F.when(F.col("event") == kind, F.col("seq")) for name, kind in TILE_FIELDS.items()}
    folded = events.filter(F.col("event").isin(*TILE_FIELDS.values())).groupBy(*by).agg(
        *[F.max(seq).alias(f"_{name}") for name, seq in of.items()],
        *[F.max_by("value", seq).alias(name) for name, seq in of.items()],
        F.max("seq").alias("last_seq"),
    )
    fresh = [
        F.when(F.coalesce(F.col(f"_{n}") > F.col("_arrived"), F.col(f"_{n}").isNotNull()), F.col(n)).alias(n)
        for n in TILE_FIELDS if n != "arrived"
    ]
    return folded.select(*by, F.col("_arrived").isNotNull().alias("has_arrived"), "arrived", *fresh, "last_seq")


def activity_feed(events: DataFrame, n: int = 10, by: Sequence[str] = ("pass_id",)) -> DataFrame:
    """The newest ``n`` events per pass; the rank limit also runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("seq"))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pass_counters(state: DataFrame, budget: DataFrame | None = None, by: Sequence[str] = ("pass_id",)) -> DataFrame:
    """Live figures per pass from tile state (``action``) and, where given, used and total KB."""

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    out = state.groupBy(*by).agg(
        n(F.col("has_arrived")).alias("processed"),
        n(F.col("action") == "flag").alias("flagged"),
        n(F.col("action") == "downlink").alias("downlinked"),
        n(F.col("action") == "discard").alias("discarded"),
    )
    if budget is None:
        return out
    pct = F.when(F.col("total_kb") > 0, F.least(F.lit(100.0), F.col("used_kb") / F.col("total_kb") * 100)).otherwise(0.0)
    return out.join(budget, list(by), "left").withColumn("budget_pct", pct)
