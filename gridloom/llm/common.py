"""What several of the text operators need: word bytes, hashes inside tasks, joins that withstand hot keys, numbering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.session import cut_lineage

#: ASCII white space, as the contracts name it: ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A-Z to a-z, all other bytes as they are.
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Rows whose keys are broadcast, at most, by ``join_unique``.
HEAVY_KEYS = 4096


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else. ``lower`` does the same, faster, where a text has ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null for null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


class WordHashes(dict):
    """Word bytes to eight hash bytes, kept for the words met last; holds ``most`` words at most."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + len(out)]
    return mixed(out)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A text column as bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of few rows, so that what is made of long texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, row_id: Sequence[Column], heavy: int = HEAVY_KEYS) -> DataFrame:
    """``left`` with the columns of ``right`` (unique by ``keys``), or nulls, however many rows of ``left`` share a key.

    The ``heavy`` keys of greatest ``weight`` are broadcast: that many rows, whatever the size. No other key
    holds more than one row in ``heavy``; those meet in a shuffle, where rows already served are dealt out by a
    hash of ``row_id``. Keys are integers and not null. ``right`` is read twice: settle it first. ``weight`` is dropped.
    """
    gains = [c for c in right.columns if c not in (*keys, weight)]
    top = right.orderBy(F.desc(weight), *keys).limit(heavy).select(*keys, F.struct(*gains).alias("_heavy"))
    served = left.join(F.broadcast(top), list(keys), "left")
    own = [F.when(F.col("_heavy").isNull(), F.col(k)).otherwise(F.xxhash64(F.lit(i), *row_id)).alias(f"_k{i}") for i, k in enumerate(keys)]
    dealt = served.select("*", *own, F.col("_heavy").isNotNull().alias("_done"))
    other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(False).alias("_done"), F.struct(*gains).alias("_light"))
    met = dealt.join(other, [*[f"_k{i}" for i in range(len(keys))], "_done"], "left")
    return met.select(*left.columns, *[F.coalesce(F.col(f"_heavy.{c}"), F.col(f"_light.{c}")).alias(c) for c in gains])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """0, 1, 2 … in the given order, without a task that sees all rows: range-sorted, numbered by partition."""
    ordered = cut_lineage(
        df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    )
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ordered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


#: Hash slots of ``likely_in``: a broadcast of that many small integers at most.
SLOTS = 1 << 18


def likely_in(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose ``col`` may be among ``ids``, so that a following join shuffles less. No row is missed.

    What is broadcast are hash slots, ``SLOTS`` of them at most, whatever the number of ids."""
    slot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(SLOTS)).cast("int").alias("_slot")
    return df.join(F.broadcast(ids.select(slot).distinct()), F.pmod(F.xxhash64(F.col(col)), F.lit(SLOTS)).cast("int") == F.col("_slot"), "left_semi")
