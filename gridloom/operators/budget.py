"""The fit-checked budget account for downlinks of unequal cost.

What a tile may take depends on all earlier ones, but a run of tiles is a function from "KB left before" to "KB left after",
and for whole KB a table of budget + 1 entries. Blocks of a pass work out their tables side by side; the tables, one row a
block, are followed from the full budget on; then every block replays its tiles from its own opening.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.session import settle

#: Tiles of a pass that one task replays at a time.
BLOCK = 4096


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows in which none of the columns changes."""
    if not len(columns[0]):
        return []
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
    return list(zip(edges, edges[1:]))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block KB left after it, by KB left before it. Rows come sorted by pass, block and ``seq``."""
    at, left, out = None, None, []

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
            names=["_pass", "_blk", "left"])

    for batch in batches:
        passes, blocks, budgets, costs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        for start, end in _runs(passes, blocks):
            key = (passes[start], int(blocks[start]))
            if key != at:
                if at is not None:
                    out.append((*at, left))
                at, left = key, np.arange(int(budgets[start]) + 1, dtype=np.int32)
            for cost in costs[start:end]:
                if cost:
                    left = np.where(left >= cost, left - cost, left)
        if len(out) > 200:
            yield told(out)
            out = []
    if at is not None:
        yield told([*out, (*at, left)])


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """KB left before each block: the tables of a pass followed from its budget on. Rows come sorted by pass and block."""
    at, left = None, 0
    for batch in batches:
        passes, blocks, tables = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        before = []
        for k, pass_no in enumerate(passes):
            table = tables[k].values.to_numpy()
            if pass_no != at:
                at, left = pass_no, len(table) - 1
            before.append(left)
            left = int(table[left])
        yield pa.RecordBatch.from_arrays([pa.array(passes, pa.string()), blocks, pa.array(before, pa.int64())], names=["_pass", "_blk", "_open"])


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each tile finds and leaves. Rows come sorted by pass, block, and a block's opening before its tiles by ``seq``."""
    left = 0
    for batch in batches:
        row, costs, opens = batch.column("_row").to_numpy(zero_copy_only=False), batch.column("_cost").to_numpy(zero_copy_only=False), batch.column("_open").to_pylist()
        rows, found = [], []
        for no, cost, opening in zip(row.tolist(), costs.tolist(), opens):
            if opening is not None:
                left = opening
                continue
            fits = cost <= left
            found.append((left, fits))
            rows.append(no)
            left -= cost if fits else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.bool_())], names=["_row", "_before", "_fits"])


def cost_ledger(tiles: DataFrame, action: Column, cost_kb: Column, by: Sequence[str] = ("pass_id",), block: int = BLOCK) -> DataFrame:
    """``tiles`` with ``action, cost_kb, used_kb, remaining_kb``: a downlink that no longer fits becomes a discard.

    ``tiles`` brings ``seq`` and ``budget_kb`` (whole KB, the same for all tiles of a pass). ``cost_kb`` is what a downlink of
    the tile takes, in whole KB; null and negative costs count as 0. A pass of any length is spread over its blocks;
    what follows the blocks one by one are their tables, ``budget + 1`` numbers each.
    """
    by = list(by)
    cost = F.greatest(F.lit(0), F.coalesce(cost_kb.cast("long"), F.lit(0)))
    staged = settle(
        tiles.withColumn("action", action).withColumn("cost_kb", F.when(F.col("action") == "downlink", cost).otherwise(F.lit(0).cast("long")))
        .withColumn("_row", F.monotonically_increasing_id()), "costs")
    named = F.concat_ws(":", F.hex(F.xxhash64(*by)), F.hex(F.xxhash64(F.lit(1), *by))).alias("_pass")  # 128 bits
    marked = staged.select("_row", named, F.floor(F.col("seq") / block).alias("_blk"), "seq", F.greatest(F.lit(0), F.col("budget_kb")).cast("long").alias("_kb"), F.col("cost_kb").alias("_cost"))
    key = ["_pass", "_blk"]
    dealt = marked.repartition(*key).sortWithinPartitions(*key, "seq", "_row")
    tables = dealt.select(*key, "_kb", "_cost").mapInArrow(_tables, "_pass string, _blk bigint, left array<int>")
    opened = tables.repartition("_pass").sortWithinPartitions(*key).mapInArrow(_openings, "_pass string, _blk bigint, _open bigint")
    none = F.lit(None).cast("long")
    rows = marked.select(*key, "seq", "_row", "_cost", none.alias("_open")).unionByName(
        settle(opened, "openings").select(*key, none.alias("seq"), none.alias("_row"), none.alias("_cost"), "_open"))
    replayed = rows.repartition(*key).sortWithinPartitions(*key, F.col("_open").isNull(), "seq", "_row").select("_row", "_cost", "_open").mapInArrow(
        _replayed, "_row bigint, _before bigint, _fits boolean")
    met = staged.join(replayed, "_row").drop("_row")
    left = F.col("_before") - F.when(F.col("_fits"), F.col("cost_kb")).otherwise(0)
    return (
        met.withColumn("remaining_kb", left).withColumn("used_kb", F.greatest(F.lit(0), F.col("budget_kb")).cast("long") - left)
        .withColumn("action", F.when((F.col("action") == "downlink") & ~F.col("_fits"), "discard").otherwise(F.col("action")))
        .drop("_before", "_fits")
    )
