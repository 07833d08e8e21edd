"""Line deduplication: lines that many documents hold stay in one of them only. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import BLANKS, ascii_lower, join_unique
from gridloom.session import settle


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20,
) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` cut, and ``n_lines`` and ``n_dropped``.

    A text is split at line feeds. A line's key is the line without white space at its ends, A-Z in lower case. Keys
    of ``min_chars`` code points or more in ``min_docs`` documents or more lose all their lines, except in the document
    with the largest id holding it. Other lines stay, in their order.

    Lines are exploded as (document, position, 128-bit hash), so no text is shuffled for the count; distinct documents
    per hash are counted in two steps with map-side sums. The hashes over the threshold meet the lines through
    ``join_unique``: a line found in a third of all documents is broadcast, not sent to one task. The dropped positions
    meet the text once.

    Null or empty text: one empty line, kept as an empty text. Null id: the row isn't counted as a document and never
    holds the kept copy. Rows that repeat an id count as one document, each with its own text. Columns of the input
    named like the added ones are replaced. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.struct("*").alias("row"))
    keyed = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = keyed.filter(F.char_length("line") >= min_chars)
    keyed = keyed.withColumn("key", ascii_lower(F.btrim("line", F.lit(BLANKS)))).filter(F.char_length("key") >= min_chars)
    lines = settle(
        keyed.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")), "lines"
    )
    common = settle(
        lines.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n_docs"), F.max("id").alias("keeper")).filter(F.col("n_docs") >= min_docs),
        "common-lines",
    )
    met = join_unique(lines, common, ["h1", "h2"], "n_docs", [F.col("id"), F.col("text_hash"), F.col("pos")])
    dropped = (
        met.filter(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("d_id"), F.col("text_hash").alias("d_hash")).agg(F.collect_set("pos").alias("gone"))
    )
    joined = rows.withColumn("text_hash", F.xxhash64("text")).join(
        dropped, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")), "left"
    )
    kept = F.expr("array_join(transform(array_except(sequence(0, n_lines - 1), gone), i -> lines[i]), chr(10))")
    out = joined.withColumn("lines", F.split("text", "\n", -1)).withColumn("n_lines", F.size("lines"))
    done = out.select(
        "row", F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("new_text"),
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(
        *[F.col("new_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names], "n_lines", "n_dropped"
    )
