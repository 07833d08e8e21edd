"""Tile, box, mask, band and event views derived from the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.operators.ranking import block_rank
from gridloom.plans.call_cases import CASES, LONG_EVERY


class Fixtures:
    """Lazily derived views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tiles(self) -> DataFrame:
        """One row per planned tile; a customer is a pass, numbered by order date within months."""
        o = block_rank(
            self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"],
            ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"), "seq", "tile_count",
        )
        k = F.col("o_orderkey")
        cloud = F.when(k % 17 == 0, F.lit(None)).when(k % 13 == 0, F.lit(1.403499)).otherwise((k % 100).cast("double") / 100.0)
        return o.select(
            k.alias("tile_id"), F.col("o_custkey").alias("pass_id"), "seq", "tile_count",
            (F.lit(-3.0) + (k % 61).cast("double") / 20.0).alias("lon"),
            (F.lit(4.0) + (k % 53).cast("double") / 10.0).alias("lat"),
            cloud.alias("cloud_cover"), (k % 19 != 0).alias("image_available"),
            F.col("o_orderdate").alias("captured_at"), F.lit(512).alias("budget_kb"),
        )

    def boxes(self) -> DataFrame:
        """Raw boxes per tile and year; ``ord`` is their list order. Some are degenerate."""
        x, y, q = (F.col("l_partkey") % 96).cast("double"), (F.col("l_suppkey") % 96).cast("double"), F.col("l_quantity")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("tile_id"),
            F.when(F.col("l_returnflag") == "R", 2016).otherwise(2022).alias("year"),
            F.col("l_linenumber").alias("line"),
            F.struct(
                "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
            ).alias("ord"),
            (x / 128.0).alias("x1"), (y / 128.0).alias("y1"),
            F.when(F.col("l_linenumber") == 7, x / 128.0).otherwise((x + q) / 128.0).alias("x2"),
            ((y + 1.0 + (F.col("l_partkey") % 40).cast("double")) / 128.0).alias("y2"),
        )

    def detections(self) -> DataFrame:
        """Nested detections: one row per tile with an array of six raw boxes."""
        k = F.col("o_orderkey")

        def box(i: Column) -> Column:
            x, y = ((F.col("o_custkey") + i * 5 + (k % 3) * i) % 96).cast("double"), ((k + i * 7) % 96).cast("double")
            return F.struct(
                F.lit("mining_pit").alias("label"), (x / 128.0).alias("x1"), (y / 128.0).alias("y1"),
                ((x + ((k + i * i) % 40).cast("double")) / 128.0).alias("x2"), ((y + 1.0 + ((k + i) % 30).cast("double")) / 128.0).alias("y2"),
            )

        return self.table("orders").select(k.alias("tile_id"), F.transform(F.sequence(F.lit(0), F.lit(5)), box).alias("raw"))

    def answers(self) -> DataFrame:
        """Model answers with box lists: clean, wrapped in prose, broken, with odd elements, or none."""
        k, t = F.col("l_partkey"), F.col("l_orderkey")
        x, y, q = (k % 96).cast("double"), (F.col("l_suppkey") % 96).cast("double"), F.col("l_quantity")
        x2 = F.when(F.col("l_linenumber") == 7, x).otherwise(x + q)

        def item(shift: float) -> Column:
            corners = [(x + shift) / 128.0, y / 128.0, (x2 + shift) / 128.0, (y + 1.0 + (k % 40).cast("double")) / 128.0]
            return F.concat(F.lit('{"label": "mining_pit", "bbox": ['), F.concat_ws(", ", *[c.cast("string") for c in corners]), F.lit("]}"))

        odd = F.when(k % 7 == 0, "17").when(k % 11 == 0, '{"label": "note"}').when(k % 13 == 0, '{"bbox": [0.1, 0.2]}').when(
            k % 17 == 0, '{"bbox": [0.1, "wide", 0.3, 0.4]}'
        ).otherwise(item(8.0))
        body = F.concat(F.lit("["), item(0.0), F.lit(", "), odd, F.lit("]"))
        text = (
            F.when(t % 9 == 0, "[]").when(t % 9 == 1, "no boxes here").when(t % 9 == 2, F.concat(F.lit("Boxes: "), body, F.lit(" as asked.")))
            .when(t % 9 == 3, F.concat(body, F.lit(" and [1]"))).when(t % 9 == 4, F.concat(F.lit("["), body)).otherwise(body)
        )
        return self.table("lineitem").select(t.alias("tile_id"), text.alias("answer"))

    def _mask(self, per_patch: int) -> DataFrame:
        early = (F.col("l_returnflag") == "R") | ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"))
        return self.table("lineitem").select(
            F.floor(F.col("l_orderkey") / per_patch).alias("patch_id"),
            F.when(early, 2016).otherwise(2022).alias("year"),
            (F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_quantity").cast("int") % 32).alias("y"),
        )

    def mask(self) -> DataFrame:
        """Sparse positives on a 32 x 32 grid, two years (pixels may repeat). Of seven patches, one is empty, one has
        the earlier year alone, one has one pixel in the later year alone, and one has the same pixel in both."""
        kind = F.col("patch_id") % 7
        chosen = self._mask(128).filter((kind != 4) & ~((kind == 3) & (F.col("year") == 2022)) & ~((kind == 2) & (F.col("year") == 2016)))
        single = kind.isin(2, 5)
        return chosen.withColumns({"x": F.when(single, 5).otherwise(F.col("x")), "y": F.when(single, 6).otherwise(F.col("y"))})

    def dense_mask(self) -> DataFrame:
        return self._mask(512)

    def _patches(self, per_patch: int) -> DataFrame:
        p = self.table("orders").select(F.floor(F.col("o_orderkey") / per_patch).alias("patch_id")).distinct()
        both = p.withColumn("year", F.explode(F.array(F.lit(2016), F.lit(2022))))
        split = F.when(F.col("patch_id") % 10 < 7, "train").when(
            (F.col("patch_id") % 10 < 9) | (F.col("year") == 2016), "test"
        ).otherwise("train")
        return both.select("patch_id", "year", F.lit(32).alias("w"), F.lit(32).alias("h"), split.alias("split"))

    def patches(self) -> DataFrame:
        return self._patches(128)

    def dense_patches(self) -> DataFrame:
        return self._patches(512)

    def bands(self) -> DataFrame:
        """Long band pixels; the six bands that composites use."""
        band = (
            F.when(F.col("l_linenumber") == 1, 0).when(F.col("l_linenumber") == 2, 1).when(F.col("l_linenumber") == 3, 2)
            .when(F.col("l_linenumber") == 4, 6).when(F.col("l_linenumber") == 5, 8).otherwise(9)
        )
        return self.table("lineitem").groupBy(
            F.floor(F.col("l_orderkey") / 128).alias("patch_id"), band.alias("band"),
            (F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_quantity").cast("int") % 32).alias("y"),
        ).agg(F.max("l_extendedprice").alias("v"))

    def actions(self) -> DataFrame:
        p, k = F.col("o_orderpriority"), F.col("o_orderkey")

        def by_priority() -> Column:
            return (
                F.when(p == "1-URGENT", "downlink_now").when(p == "2-HIGH", "flag_for_review")
                .when(p == "3-MEDIUM", "request_higher_resolution").when(p == "5-LOW", "discard")
                .otherwise("request_neighbor_tile")
            )

        pred = F.when(k % 23 == 0, "<unparseable>").when(k % 29 == 0, "abort").when(k % 4 == 0, "discard").otherwise(by_priority())
        return self.table("orders").select(k.alias("tile_id"), by_priority().alias("gold_action"), pred.alias("pred_action"))

    def events(self) -> DataFrame:
        """Pass events without their sequence number."""
        kind = (
            F.when(F.col("event_type") == "view", "tile_arrived").when(F.col("event_type") == "click", "vlm_done")
            .when(F.col("event_type") == "error", "agent_thinking").when(F.col("event_type") == "purchase", "agent_decided")
            .otherwise("budget_update")
        )
        return self.table("events").select(
            F.col("user_id").alias("pass_id"), "ts", "event_id", (F.col("event_id") % 12).alias("tile_no"), kind.alias("event"), "value"
        )

    def numbered_events(self) -> DataFrame:
        return block_rank(self.events(), ["pass_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "seq")

    def raw_outputs(self) -> DataFrame:
        """Model texts for every parser branch."""
        texts = [
            '<|tool_call_start|>[downlink_now(reason="two clear pits")]<|tool_call_end|> done<|im_end|>',
            '<|tool_call_start|>[request_neighbor_tile(direction="east", reason="plume")]<|tool_call_end|>',
            "I would discard this tile",
            "<|tool_call_start|>[discard(]<|tool_call_end|>",
            '<|tool_call_start|>[launch(reason="x")]<|tool_call_end|>',
            'Answer: {"action": " Flag ", "reason": "small"} ok',
            '{"action": "explode"}',
            '{"action": "downlink", ',
        ]
        pick = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 8).cast("int"))
        return self.table("events").select("event_id", pick.alias("raw"))

    def call_outputs(self) -> DataFrame:
        """Model texts with a tool call in every shape that the parser tells apart; one in some thousand is a megabyte long."""
        k = F.col("event_id")
        texts = F.array(*[F.lit(case[0]) for case in CASES])
        text = F.replace(F.get(texts, (k % len(CASES)).cast("int")), F.lit("{id}"), k.cast("string"))
        long = F.concat(F.lit('<|tool_call_start|>[discard(reason="'), F.repeat(F.lit("x"), 1_000_000), F.lit('")]<|tool_call_end|>'))
        return self.table("events").select("event_id", F.when(k % LONG_EVERY == 4, long).otherwise(text).alias("raw"))

    def text_pairs(self) -> DataFrame:
        """Whole documents against a copy with some words changed or dropped."""
        worded = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", " (the|de|la|die|el) ", " ")).when(
            F.col("doc_id") % 3 == 1, F.replace("text", F.lit(" and "), F.lit(" or "))
        ).otherwise(F.lower("text"))
        return self.table("documents").select("doc_id", "lang", F.col("text").alias("gold"), worded.alias("pred"))

    def site_rows(self) -> DataFrame:
        status = (
            F.when(F.col("l_suppkey") % 4 == 0, "confirmed").when(F.col("l_suppkey") % 4 == 1, "empty")
            .when(F.col("l_suppkey") % 4 == 2, "fetch_error")
        )
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("site_id"), F.col("l_linenumber").alias("ring_no"),
            (F.lit(-3.0) + (F.col("l_partkey") % 300).cast("double") / 100.0).alias("lon"),
            (F.lit(4.0) + F.col("l_quantity") / 10.0).alias("lat"), status.alias("status"),
        )

    def patch_paths(self) -> DataFrame:
        """A file listing: images and masks of every patch and year, some missing, some unrelated."""
        p = self.patches().select("patch_id", "year").withColumn("kind", F.explode(F.array(F.lit("IMAGE"), F.lit("MASK"))))
        there = ~((F.col("kind") == "MASK") & (F.col("patch_id") % 11 == 3) & (F.col("year") == 2022))
        ext = F.when(F.col("patch_id") % 13 == 5, ".txt").otherwise(".tif")
        return p.filter(there).select(
            F.concat(F.lit("scenes/"), F.col("year").cast("string"), F.lit("/"), F.col("kind"), F.lit("_AB_"),
                     F.col("patch_id").cast("string"), F.lit("_"), F.col("year").cast("string"), ext).alias("path")
        )

    def split_rows(self) -> DataFrame:
        """Split file lines as text, with blanks, odd values, repeated keys and unreadable names."""
        k, y = F.col("patch_id"), F.col("year")
        base = self.patches().select(
            "patch_id", "year",
            F.concat(F.lit("AB_"), k.cast("string"), F.lit("_"), y.cast("string"), F.when(k % 7 == 0, ".tif").otherwise("")).alias("patch_name"),
            F.when(k % 17 == 0, "").when(k % 19 == 0, "VAL").when(k % 10 < 7, " Train").otherwise(F.when((k % 10 < 9) | (y == 2016), "test").otherwise("train")).alias("split"),
            F.when(k % 23 == 0, "n/a").when(k % 3 == 0, "0").otherwise(((k % 40).cast("double") / 4.0).cast("string")).alias("class_percentage"),
            F.lit(0).alias("_row"),
        )
        again = base.filter(k % 5 == 0).withColumn("split", F.lit("test")).withColumn("_row", F.lit(1))
        odd = base.filter(k % 6 == 0).withColumn("patch_name", F.concat(F.lit("broken_"), k.cast("string")))
        return base.unionByName(again).unionByName(odd)
