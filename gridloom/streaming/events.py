"""Structured Streaming over pass events: the same folds and accounts as the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridloom import constants as K
from gridloom.operators import passes
from gridloom.session import scratch_path
from gridloom.sources.files import read_events
from gridloom.streaming.processors import BUCKETS, LEDGER_ROWS, ROCKS, STORE, SUMMARY_ROWS, PassAccount, TileFold

# Fixed value: the event that ends a pass.
PASS_END = "pass_complete"


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    """Event time as a timestamp (files may carry it without a zone), with its watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def once_per_event(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each ``(pass_id, seq)`` once; copies are forgotten when the watermark has passed them."""
    return _timed(events, watermark).dropDuplicatesWithinWatermark(["pass_id", "seq"])


def event_stream(spark: SparkSession, path: str, watermark: str = "1 hour") -> DataFrame:
    """Typed, deduplicated events from a folder of JSON lines."""
    return once_per_event(read_events(spark, path, streaming=True), watermark)


def _millis() -> Column:
    return F.unix_millis("ts").alias("at_ms")


def stream_tile_state(events: DataFrame, watermark: str = "1 hour", patience_ms: int = 3_600_000, by: Sequence[str] = ("pass_id", "tile_no")) -> DataFrame:
    """Per-tile fold, as the batch operator's; a row for each batch in which a tile changes (update mode).

    ``seq`` counts from 1. Copies change nothing. A tile leaves the state when the watermark is ``patience_ms`` past its
    last event."""
    kinds = list(passes.TILE_FIELDS)
    number = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(kinds) for x in (passes.TILE_FIELDS[name], k)]), F.col("event")).alias("kind")
    names = [k.cast("string").alias(name) for k, name in zip(map(F.col, by), by)]  # lossless, and whole numbers stay whole beside nulls
    rows = _timed(events, watermark).select(
        F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).alias("_bucket"), *names, "ts", _millis(), "seq", number, F.col("value").cast("double").alias("value")).filter("kind IS NOT NULL")
    layout = [*[T.StructField(k, T.StringType()) for k in by], T.StructField("has_arrived", T.BooleanType()), *[T.StructField(k, T.DoubleType()) for k in kinds], T.StructField("last_seq", T.LongType())]
    folded = rows.groupBy("_bucket").transformWithStateInPandas(TileFold(kinds, list(by), patience_ms), T.StructType(layout), "Update", "eventTime")
    return folded.withColumns({k: F.col(k).cast(events.schema[k].dataType) for k in by})


def stream_counts(events: DataFrame, num: Column, by: Sequence[str] = ()) -> DataFrame:
    """Running accuracy as rows arrive."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(num, 1).otherwise(0)).alias("n_correct"), F.avg(F.when(num, 1.0).otherwise(0.0)).alias("accuracy")
    )


def stream_confusion(pred: DataFrame, truth: DataFrame, keys: Sequence[str], watermark: str = "1 hour", apart: str = "1 hour") -> DataFrame:
    """Pixel confusion of each patch as its two sides arrive, ``apart`` at most: the columns of ``pred`` but for its rows, and
    ``tp, fp, fn, tn``. Feed it to ``evaluate.pixel_metrics`` for running scores.

    ``pred`` brings ``ts, w, h`` and ``pred``, ``truth`` brings ``ts`` and ``truth``: lists of ``y, word, bits``, each ``(y, word)``
    once. A side whose other one does not come in time leaves the state unmatched.
    """
    right = _timed(truth, watermark).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ts").alias("_ts"), "truth")
    near = F.expr(f"_ts BETWEEN ts - INTERVAL {apart} AND ts + INTERVAL {apart}")
    for k in keys:
        near = near & (F.col(k) == F.col(f"_{k}"))
    joined = _timed(pred, watermark).join(right, near)
    place = lambda r: F.struct(r["y"].alias("y"), r["word"].alias("word"))
    other = F.map_from_entries(F.transform("truth", lambda r: F.struct(place(r), r["bits"])))
    count = lambda rows, bits: F.aggregate(F.transform(rows, lambda r: F.bit_count(bits(r)).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    both = lambda r: r["bits"].bitwiseAND(F.coalesce(F.try_element_at(F.col("_other"), place(r)), F.lit(0).cast("long")))
    counted = joined.withColumn("_other", other).withColumns(
        {"tp": count("pred", both), "_p": count("pred", lambda r: r["bits"]), "_t": count("truth", lambda r: r["bits"])})
    fp, fn = F.col("_p") - F.col("tp"), F.col("_t") - F.col("tp")
    rest = [c for c in pred.columns if c not in ("ts", "pred")]
    return counted.select(*rest, "tp", fp.alias("fp"), fn.alias("fn"), (F.col("w").cast("long") * F.col("h") - F.col("tp") - fp - fn).alias("tn"))


def _accounted(decided: DataFrame, cost_kb: int, summarize: bool, watermark: str, patience_ms: int) -> DataFrame:
    by_event = "event" in decided.columns
    ends = F.coalesce(F.col("event") == PASS_END, F.lit(False)) if by_event else F.lit(False)
    number = lambda c: F.when(ends, F.lit(0).cast("long")).otherwise(F.col(c).cast("long")).alias(c)  # noqa: E731  # ends carry none
    rows = _timed(decided, watermark).select(
        F.pmod(F.xxhash64(F.col("pass_id").cast("long")), F.lit(BUCKETS)).alias("_bucket"), F.col("pass_id").cast("long").cast("string").alias("pass_id"),
        "ts", _millis(), F.col("seq").cast("long").alias("seq"), F.col("tile_id").cast("long").cast("string").alias("tile_id"), "action",
        (F.col("description") if "description" in decided.columns else F.lit(None).cast("string")).alias("description"),
        number("budget_kb"), number("tile_count"), ends.alias("ends"),
    )
    account = PassAccount(cost_kb, patience_ms, summarize, by_event)
    told = rows.groupBy("_bucket").transformWithStateInPandas(account, SUMMARY_ROWS if summarize else LEDGER_ROWS, "Append", "eventTime")
    return told.withColumns({c: F.col(c).cast("long") for c in ("pass_id", "tile_id") if c in told.columns})


def stream_ledger(decided: DataFrame, cost_kb: int = K.DOWNLINK_KB, watermark: str = "1 hour", patience_ms: int = 3_600_000) -> DataFrame:
    """Budget account of every pass as its decisions arrive, in any order.

    ``decided`` brings ``pass_id, seq, ts, tile_id, action, budget_kb, tile_count``; tiles that come early wait as rows of
    the state. A pass without events for ``patience_ms`` of event time is settled as far as it came and forgotten.
    """
    return _accounted(decided, cost_kb, False, watermark, patience_ms)


def stream_summary(decided: DataFrame, cost_kb: int = K.DOWNLINK_KB, watermark: str = "1 hour", patience_ms: int = 3_600_000) -> DataFrame:
    """One summary row of every pass, with its first ten descriptions of flagged or downlinked tiles.

    ``decided`` as for ``stream_ledger``, with ``description`` and, where the stream tells the end of a pass, ``event``: the
    row comes on ``pass_complete``, whose ``seq`` follows the last tile's, once all earlier tiles are settled. Without that
    column it comes with the last planned tile or when the budget is used up. Abandoned passes are summed up by the timer.
    """
    return _accounted(decided, cost_kb, True, watermark, patience_ms)


def run_available(stream: DataFrame, mode: str, label: str = "stream") -> DataFrame:
    """Process all available input and return what was emitted, with its ``batch``.

    Every micro-batch overwrites its own folder, so a repeated batch leaves no copies.
    """
    spark = stream.sparkSession
    out, log = scratch_path(spark, label), scratch_path(spark, f"{label}-log")

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    store = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # read when the query starts
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(save).start()
    finally:
        spark.conf.set(STORE, store) if store else spark.conf.unset(STORE)
    query.awaitTermination()
    return spark.read.option("basePath", out).schema(f"{_ddl(stream)}, batch int").parquet(out)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def latest(emitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest emitted row per key of an update-mode stream."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
