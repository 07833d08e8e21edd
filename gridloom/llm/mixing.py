"""Mixing sources to target weights by entropy balancing. DataFrame functions throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.llm.common import numbered
from gridloom.session import cut_lineage, settle

#: Stops of the dual iterations: words off the target as a share of it, and rounds (bisection alone needs 70).
TOLERANCE, ROUNDS = 1e-9, 100
#: Bracket of the multipliers, for texts measured in their source's mean size.
STEEPEST = 1e4
#: Blocks into which the documents of one source and size are dealt by hash.
BLOCKS = 4096


def word_count(text: Column) -> Column:
    """Runs of anything but ``[\\x20\\x09-\\x0D]``; null: 0."""
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blanks, " ", -1), "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: float) -> DataFrame:
    """``key``, ``source``, ``source_size`` → with ``target``: weights repeat over the sources in code point order, null
    last; a target stops at ``max_epochs`` times its source, and the excess is shared anew by weight until none is above.

    The level of the others only rises from one round to the next; a round needs two sums over the sources."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = numbered(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    weighted = cut_lineage(
        ranked.withColumn("w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(max_epochs))
    )
    total, level, full = weighted.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        above = F.col("cap") < F.col("w") * level
        n, held, free = weighted.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))
        ).first()
        if not free or n == full:
            return weighted.select("key", "source", "source_size", F.least("cap", F.col("w") * level).alias("target"))
        full, level = n, (total - held) / free


def tilts(cells: DataFrame, targets: DataFrame, max_epochs: float) -> DataFrame:
    """The dual solution: ``key``, ``source_size``, ``target``, ``mean``, ``tilt``.

    Entropy balancing: of all rates up to ``max_epochs`` that meet the sources' word targets, those nearest to one for
    each document (in relative entropy) tilt exponentially in its size: min(max_epochs, exp(tilt * size / mean)). A
    source's dual is convex in one multiplier: Newton steps on the logarithm of its words, kept within a bracket that
    shrinks each round. A round sums over the cells (sources by sizes), never the documents; multipliers stay a table.
    """
    stats = cells.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    full = (F.col("target") >= F.col("source_size") * (max_epochs * (1 - 1e-12))) | (F.col("mean") <= 0)
    state = cut_lineage(
        targets.join(stats, "key").select(
            "key", "source_size", "target", "mean", F.when(full, STEEPEST).otherwise(0.0).alias("tilt"), full.alias("done"),
            F.lit(-STEEPEST).alias("low"), F.lit(STEEPEST).alias("high"),
        )
    )
    x = F.col("size") / F.col("mean")
    for _ in range(ROUNDS):
        if state.filter(~F.col("done")).isEmpty():
            break
        tilted = cells.join(state.filter(~F.col("done")).select("key", "mean", "tilt"), "key")
        words = F.col("n") * F.col("size") * F.least(F.lit(float(max_epochs)), F.exp(F.col("tilt") * x))
        free = F.col("tilt") * x < F.log(F.lit(float(max_epochs)))
        sums = tilted.groupBy("key").agg(F.sum(words).alias("words"), F.sum(F.when(free, words * x).otherwise(0.0)).alias("slope"))
        got = state.join(sums, "key", "left")
        off = F.col("words") - F.col("target")
        low, high = F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") + F.log(F.col("target") / F.col("words")) * F.col("words") / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("words") > 0) & (step > low) & (step < high)
        met = F.col("done") | (F.abs(off) <= F.lit(TOLERANCE) * F.col("target")) | (high - low < 1e-12)
        tilt = F.when(met, F.col("tilt")).when(inside, step).otherwise((low + high) / 2)
        state = cut_lineage(got.select("key", "source_size", "target", "mean", tilt.alias("tilt"), met.alias("done"), low.alias("low"), high.alias("high")))
    return state.select("key", "source_size", "target", "mean", "tilt")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3, keep: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, else all) with ``size`` (words), ``source_size``, ``target`` (of the source),
    ``rate`` and ``copies``.

    Sources weigh ``weights``, repeating, in code point order with null last, and share all words; see
    ``source_targets`` and ``tilts``. Rates are rounded into whole copies, at most ``max_epochs``: within a source,
    documents in ascending size carry the fractions over, so that after any number of them copies and rates differ by
    less than one; hence a source's words miss its target by no more than its largest document. Among documents of a
    size, a hash of id and text decides who gets the copy more. The same rows give the same copies on any partitioning.

    Targets, multipliers and rounding run on counts by (source, size). Documents of one source and size are dealt into
    blocks by hash, whose counts give each block its share, so no group is ranked in one task. Rows are shuffled once.

    Null text or text of blanks: size 0, copied once, no words. Null source: a source of its own, last. Null ids and
    repeated rows are documents like others. Columns of the input named like the added ones are replaced. An empty
    table gives an empty one.
    """
    names = [c for c in (keep or docs.columns) if c not in ("size", "source_size", "target", "rate", "copies")]
    source = F.col(source_col)
    rows = docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"), source.alias("source"),
        F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)).alias("key"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"),
    ).withColumn("block", F.pmod("h", F.lit(BLOCKS)))
    blocks = settle(rows.groupBy("key", "source", "size", "block").agg(F.count(F.lit(1)).alias("m")), "blocks")
    cells = settle(blocks.groupBy("key", "source", "size").agg(F.sum("m").alias("n")), "cells")
    sizes = cells.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = settle(tilts(cells, source_targets(sizes, weights, max_epochs), max_epochs), "tilts")

    rate = F.least(F.lit(float(max_epochs)), F.exp(F.col("tilt") * F.col("size") / F.col("mean")))
    rated = cells.join(solved, "key").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0)).withColumn("whole", F.floor("rate"))
    upto = Window.partitionBy("key").orderBy("size")
    rated = rated.withColumn("end", F.floor(F.sum(F.col("n") * (F.col("rate") - F.col("whole"))).over(upto) + 0.5))
    rated = rated.withColumn("extra", F.col("end") - F.lag("end", 1, 0).over(upto)).select("key", "size", "source_size", "target", "rate", "whole", "extra")
    before = Window.partitionBy("key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shares = blocks.join(rated, ["key", "size"]).withColumn("opening", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m", "source")
    within = F.row_number().over(Window.partitionBy("key", "size", "block").orderBy("h"))
    more = F.when(F.col("opening") + within <= F.col("extra"), 1).otherwise(0)
    taken = rows.join(shares, ["key", "size", "block"]).withColumn("copies", (F.col("whole") + more).cast("long"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in names], "size", "source_size", "target", "rate", "copies")


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: a row for each copy of a document, with the named columns."""
    taken = mixed.filter("copies > 0").select(F.struct(*[mixed[c] for c in columns]).alias("row"), F.explode(F.sequence(F.lit(1), mixed["copies"].cast("int"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in columns])
