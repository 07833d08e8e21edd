"""Ranks, running sums and quantiles that never gather one group in one task.

A plain window sorts a whole group in a single task. Here the caller names a *block*: any coarse,
monotone function of the ordering (leading hash digits, ``seq div 4096``, a month). Block totals,
pre-aggregated map-side, give each block an opening balance, and that balance enters the block as
one more row ahead of its data. Rows are shuffled once, by ``(group, block)``, and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.session import cut_lineage

SEQ_BLOCK = 4096


def seq_block(seq: Column, size: int = SEQ_BLOCK) -> Column:
    return F.floor(seq / size)


def _openings(per_block: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Block totals with what stands before each block (``_val…``) and the group's totals (``_blk_total…``).

    Groups keep their blocks in one window. Without a group the blocks of all rows are range-sorted, summed within each
    partition, and only the partitions' totals, one row each, meet in one task.
    """
    if by:
        before, whole = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
        return per_block.select(
            *by, "_blk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_val{c}") for c in sums], *[F.sum(c).over(whole).alias(f"_blk_total{c}") for c in sums]
        )
    ordered = cut_lineage(per_block.orderBy("_blk").withColumn("_part", F.spark_partition_id()))
    parts = ordered.groupBy("_part").agg(*[F.sum(c).alias(f"_of{c}") for c in sums])
    upto, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = parts.select(
        "_part", *[F.coalesce(F.sum(f"_of{c}").over(upto), F.lit(0)).alias(f"_start{c}") for c in sums], *[F.sum(f"_of{c}").over(every).alias(f"_blk_total{c}") for c in sums]
    )
    inside = Window.partitionBy("_part").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    within = ordered.select("_part", "_blk", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in{c}") for c in sums])
    return within.join(F.broadcast(starts), "_part").select(
        "_blk", *[(F.col(f"_start{c}") + F.col(f"_in{c}")).alias(f"_val{c}") for c in sums], *[f"_blk_total{c}" for c in sums]
    )


def block_running_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], block: Column, values: dict[str, Column], total: str | None = None,
) -> DataFrame:
    """Exact running sums per group, up to and including each row: new name → value.

    ``total`` additionally names the group's sum of the first value. Null groups count as groups of their own. ``df`` is
    read twice: settle it first where it is costly.
    """
    sums = [f"_{i}" for i in range(len(values))]
    keyed = df.withColumn("_blk", block).withColumns({f"_val{c}": v for c, v in zip(sums, values.values())})
    per_block = keyed.groupBy(*by, "_blk").agg(*[F.sum(f"_val{c}").alias(c) for c in sums])
    opening = _openings(per_block, by, sums).withColumn("_data", F.lit(0))
    rows = keyed.withColumn("_data", F.lit(1)).unionByName(opening, allowMissingColumns=True)
    upto = (
        Window.partitionBy(*by, "_blk").orderBy("_data", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.withColumns({name: F.sum(f"_val{c}").over(upto) for name, c in zip(values, sums)})
    if total:
        summed = summed.withColumn(total, F.first("_blk_total_0").over(upto))
    return summed.filter(F.col("_data") == 1).drop("_blk", "_data", *[f"_val{c}" for c in sums], *[f"_blk_total{c}" for c in sums])


def block_running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], block: Column,
    value: Column, name: str, total: str | None = None,
) -> DataFrame:
    """``block_running_sums`` of one value."""
    return block_running_sums(df, by, order, block, {name: value}, total)


def block_rank(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], block: Column,
    name: str = "rn", total: str | None = None,
) -> DataFrame:
    """Exact ``row_number`` per group. ``total`` additionally names the group's row count."""
    return block_running_sum(df, by, order, block, F.lit(1).cast("long"), name, total)


#: Splitters of one round of selection, and the error they may have: far less than the step between two of them.
GRID, ACCURACY = 256, 5000
#: Rows between the ends of a span that need no further round, whatever the group's size.
SPAN_ROWS = 100_000


def _spanned(df: DataFrame, spans: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows of ``df`` inside each span of their group. The spans of a group are few; its rows stay where the join's skew
    handling deals them."""
    return df.join(spans, list(by)).filter(F.col(value).between(F.col("_lo"), F.col("_hi")))


def _narrowed(df: DataFrame, spans: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One round: each span cut down to a few steps of its own splitters around the wanted rank, counted exactly."""
    keys = [*by, "_i"]
    grid = F.percentile_approx(value, [k / GRID for k in range(GRID + 1)], ACCURACY).alias("_grid")
    splitters = _spanned(df, spans.select(*keys, "_lo", "_hi"), by, value).groupBy(*keys).agg(grid)
    place, apart = (F.col("_rank") - F.col("_off")) / F.col("_in") * GRID, F.greatest(F.lit(2), F.ceil(2 * GRID / F.col("_in")))
    at = lambda step: F.get("_grid", F.greatest(F.lit(0), F.least(F.lit(GRID), step)).cast("int"))
    cut = spans.join(splitters, keys).withColumns({"_a": at(F.floor(place) - apart), "_b": at(F.ceil(place) + apart)}).drop("_grid")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    v = F.col(value)
    inside = _spanned(df, cut.select(*keys, "_lo", "_hi", "_a", "_b"), by, value).groupBy(*keys).agg(
        count(v < F.col("_a")).alias("_below"), count(v.between(F.col("_a"), F.col("_b"))).alias("_within"),
        count((v > F.col("_a")) & (v < F.col("_b"))).alias("_between"),
    )
    start = F.col("_off") + F.col("_below")
    holds = (F.floor("_rank") >= start) & (F.ceil("_rank") < start + F.col("_within"))
    new = {"_lo": "_a", "_hi": "_b", "_in": "_within"}
    picked = {name: F.when(holds, F.col(better)).otherwise(F.col(name)) for name, better in new.items()}
    picked["_inner"] = F.when(holds, F.col("_between")).otherwise(0)  # a sketch that erred: the whole span is sorted
    met = cut.join(inside, keys).withColumns({**picked, "_off": F.when(holds, start).otherwise(F.col("_off"))})
    return met.select(*spans.columns)


def _between(low: Column, high: Column, rank: Column) -> Column:
    """``low * (1 - w) + high * w`` with the last product and sum rounded once, as DuckDB's ``quantile_cont``: levels on the
    edge of two steps depend on the last bit. ``rank`` on a row gives that row's value."""
    w = rank - F.floor(rank)
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, F.lit(1.0) - w, high * w).cast("double")
    return F.when(w == 0, low).when(low.isNotNull() & high.isNotNull(), fused)


def _sorted_quantiles(df: DataFrame, by: Sequence[str], v: Column, probs: Sequence[float]) -> DataFrame:
    """Quantiles of groups whose values one task may sort."""
    listed = df.groupBy(*by).agg(F.sort_array(F.collect_list(v.cast("double"))).alias("_s"))
    at = lambda r: F.get("_s", r.cast("int"))
    ranks = [(F.size("_s") - 1) * F.lit(p) for p in probs]
    return listed.select(*by, *[_between(at(F.floor(r)), at(F.ceil(r)), r).alias(f"q{i}") for i, r in enumerate(ranks)])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], span_rows: int = SPAN_ROWS) -> DataFrame:
    """Linearly interpolated quantiles of groups of any size: ``by…, q0, q1, …``; null for groups without values.

    Groups of ``span_rows`` rows or fewer are sorted as they are. In larger ones the rank is closed in by rounds: quantiles of
    bounded sketches, pre-aggregated, cut the span around it, rows are counted exactly, and the next round looks at a
    fiftieth of them. Outliers cost nothing, for ranks and not widths are cut; values that many rows share become ends of
    the span, which don't count. No task holds more than a span's distinct values. ``df`` is read several times.
    """
    by, probs = list(by), [float(p) for p in probs]
    v = F.col(value)
    sizes = df.groupBy(*by).agg(F.count(v).alias("_in"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    large = cut_lineage(sizes.filter(F.col("_in") > span_rows))
    if not large.limit(1).count():
        return _sorted_quantiles(df, by, v, probs)
    small = _sorted_quantiles(df.join(large.select(*by), by, "left_anti"), by, v, probs)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), ((F.col("_in") - 1) * p).alias("_rank")) for i, p in enumerate(probs)])).alias("_w")
    inner = F.when(F.col("_lo") < F.col("_hi"), F.col("_in")).otherwise(0).alias("_inner")
    spans = large.select(*by, wanted, "_lo", "_hi", F.lit(0).cast("long").alias("_off"), "_in", inner)
    spans = spans.select(*by, "_w.*", "_lo", "_hi", "_off", "_in", "_inner")
    done = None
    while True:
        spans = cut_lineage(spans)
        ready = spans.filter(F.col("_inner") <= span_rows)
        done = ready if done is None else done.unionByName(ready)
        spans = spans.filter(F.col("_inner") > span_rows)
        if not spans.limit(1).count():
            break
        spans = _narrowed(df, spans, by, value)
    keys = [*by, "_i"]
    local = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        _spanned(df, done.select(*keys, "_rank", "_lo", "_hi", "_off"), by, value)
        .groupBy(*keys, "_rank", "_off", value).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(local) + F.col("_off")).withColumn("_start", F.col("_end") - F.col("_n"))
    )
    rank = F.col("_rank")
    at = lambda r: F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), F.col(value)))
    found = placed.groupBy(*keys, "_rank").agg(at(F.floor(rank)).alias("_f"), at(F.ceil(rank)).alias("_c"))
    wide = found.withColumn("_v", _between(F.col("_f").cast("double"), F.col("_c").cast("double"), rank)).groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"q{i}") for i in range(len(probs))])
    return small.unionByName(wide)
