"""Document fingerprints of closed syncmers over words. DataFrame functions throughout."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Words in a k-mer, and in the inner substrings whose minimum decides.
K, S = 5, 2
#: Scripts written without blanks: each letter is a word.
UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words: runs between white space, letters of unspaced scripts one by one."""
    spaced = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(text, f"({UNSPACED})", " $1 "))
    words = F.array_remove(F.split(F.translate(spaced, "\t\n\x0b\x0c\r", "     "), " ", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_anchors(df: DataFrame, text_col: str, name: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with ``name``: array of (pos, hash), the closed syncmers of a text in order.

    A k-mer is ``k`` consecutive words; it is chosen where the smallest hash of its inner runs of ``s`` words is that of
    the first or last run. Whether a k-mer is chosen depends on its own words alone, so equal passages give equal
    anchors wherever they stand, and at least one in every k - s + 1 k-mers is chosen. A text of 1 to k - 1 words has
    one anchor of all its words; one without words (or null) has none. Hashes have 32 bits.
    """
    if not 0 < s < k:
        raise ValueError("s must lie between 0 and k")
    runs = k - s + 1
    mixed = "xxhash64(" + ", ".join(f"_w[i + {j}]" for j in range(s)) + ")"
    edge = f"least(_s[i], _s[i + {runs - 1}])"
    inner = f"least({', '.join(f'_s[i + {j}]' for j in range(1, runs - 1))})" if runs > 3 else "_s[i + 1]"
    rule = f"{edge} <= {inner}" if runs > 2 else "true"
    whole = "xxhash64(" + ", ".join(f"_s[i + {j}]" for j in range(runs)) + ")"
    chosen = f"transform(filter(sequence(0, size(_w) - {k}), i -> {rule}), i -> named_struct('pos', i, 'hash', {whole} & 4294967295L))"
    short = "array(named_struct('pos', 0, 'hash', aggregate(_w, 42L, (a, w) -> xxhash64(a, w)) & 4294967295L))"
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = df.withColumn("_w", word_hashes(text)).withColumn("_s", F.expr(f"if(size(_w) < {k}, array(0L), transform(sequence(0, size(_w) - {s}), i -> {mixed}))"))
    empty = "cast(array() as array<struct<pos:int,hash:bigint>>)"
    return hashed.withColumn(name, F.expr(f"case when size(_w) = 0 then {empty} when size(_w) < {k} then {short} else {chosen} end")).drop("_w", "_s")


def fingerprint(anchors: Column) -> Column:
    """The anchors' hashes in order of position, in hex, blank between; empty without anchors."""
    return F.array_join(F.transform(anchors, lambda a: F.hex(a["hash"])), " ")


def likeness(a: Column, b: Column) -> Column:
    """Twice the anchors shared over all anchors, by distinct hash; 1 for two texts without anchors."""
    x, y = F.array_distinct(a["hash"]), F.array_distinct(b["hash"])
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def matches(left: DataFrame, right: DataFrame, id_col: str, anchors_col: str) -> DataFrame:
    """Aligned passages of two tables of anchors: ``left_id``, ``right_id``, ``shift``, ``n`` (anchors that agree on the shift).

    Anchors found at the same distance from each other in both texts support one shift; one row per pair and shift.
    Anchors met in many texts make many pairs: give it the texts to be compared, not two whole collections."""
    a = left.select(F.col(id_col).alias("left_id"), F.explode(anchors_col).alias("a")).select("left_id", "a.pos", "a.hash")
    b = right.select(F.col(id_col).alias("right_id"), F.explode(anchors_col).alias("b")).select("right_id", F.col("b.pos").alias("pos_b"), F.col("b.hash").alias("hash"))
    return a.join(b, "hash").groupBy("left_id", "right_id", (F.col("pos_b") - F.col("pos")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))


def with_next(
    docs: DataFrame, order: str, following: dict[str, str], derive: Callable[[DataFrame], DataFrame] = lambda df: df, blocks: int | None = None,
) -> DataFrame:
    """``docs`` (``order`` an integer) with columns of the row that follows in ascending ``order``: new name → column. The
    last row is followed by the first. ``derive`` adds columns that ``following`` may name, after the shuffle.

    Rows are dealt into ``blocks`` ranges, cut at approximate quantiles, and sorted within them; the first row of a block
    is also sent to the block before it. Rows are shuffled once and no task sees more than its blocks. Rows of equal
    ``order`` follow each other by a hash of their columns. A null ``order`` comes first."""
    blocks = blocks or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_o", F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))).withColumn("_tie", F.xxhash64(*docs.columns))
    shares = [i / blocks for i in range(1, blocks)] or [0.5]
    cuts = sorted(set(keyed.agg(F.percentile_approx("_o", shares, 20 * blocks)).first()[0] or [0]))
    wide = math.isqrt(len(cuts)) or 1
    rows = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    # The block of a value: the cuts at or below it, by the first of each row of cuts and then within the row.
    row = F.size(F.filter(_array([r[0] for r in rows]), lambda c: c <= F.col("_o")))
    in_row = F.size(F.filter(F.element_at(F.array(*[_array(r) for r in rows]), F.col("_row")), lambda c: c <= F.col("_o")))
    placed = keyed.withColumn("_row", row).withColumn("_block", F.when(F.col("_row") == 0, 0).otherwise((F.col("_row") - 1) * wide + in_row))
    firsts = placed.groupBy("_block").agg(F.min(F.struct("_o", "_tie")).alias("f")).orderBy("_block").collect()  # a row for each block
    starts, before = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, f in enumerate(firsts):
        starts[f["_block"]], before[f["_block"]] = f["f"], firsts[i - 1]["_block"]
    start = [F.element_at(_array([x[c] if x else 0 for x in starts]), F.col("_block") + 1) for c in ("_o", "_tie")]
    first = (F.col("_o") == start[0]) & (F.col("_tie") == start[1])
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("halo"))
    halo = F.struct(F.element_at(_array(before), F.col("_block") + 1).cast("int").alias("block"), F.lit(True).alias("halo"))
    dealt = placed.withColumn("_to", F.explode(F.when(first, F.array(own, halo)).otherwise(F.array(own)))).withColumns({"_at": F.col("_to.block"), "_halo": F.col("_to.halo")})
    dealt = derive(dealt.drop("_row", "_block", "_to").repartition("_at"))
    by = Window.partitionBy("_at").orderBy("_halo", "_o", "_tie")
    led = dealt.withColumns({new: F.lead(old).over(by) for new, old in following.items()})
    return led.filter(~F.col("_halo")).drop("_o", "_tie", "_at", "_halo")


def _array(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "bigint(-9223372036854775808)" for v in values) + ")")
