"""Phrase collocations from a weighted de Bruijn graph of words.

Edges are runs of four words between the overlapping three-word nodes they start and end with. One pass over the texts
counts the longest run from every word, at most four words, shorter where a piece ends: an edge, or an end correction. A
node's count is what flows out of it plus its ends, and so on down to single words. Edges of weight ``min_count`` or more
are compacted: nodes with one way in, one way out and nothing else are merged into paths, which hold the long candidates.

Before that, a sketch (a fixed number of hash slots) tells which runs of two and three words may reach ``min_count``. A run
stops before one that can't: no phrase across it counts, and all counts that matter stay as they are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.llm.common import LOWER, UPPER, WordHashes, join_unique, mixed, numbered, utf8
from gridloom.session import cut_lineage, settle

#: Words in an edge.
LONGEST = 4
#: Slots of the sketch (2 to that power), and slots a row of it holds.
SLOT_BITS, ROW_SLOTS = 24, 1 << 16
#: Words looked at in one step; counts a task holds before it hands them on.
BLOCK, HELD = 200_000, 300_000
#: Parts into which a language's candidates are dealt before its first ones are taken.
DEALT = 64
#: A-Z in lower case, and all that ends a piece as a line feed.
PIECES = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r", LOWER.encode() + b"\n" * 9)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Group, words, and whether a word is followed by another of its piece: some thousand words of one group at a time."""
    by_group: dict[str, list[bytes]] = defaultdict(list)
    for group, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
        if text:
            by_group[group].append(text)
    for group, texts in by_group.items():
        words: list[bytes] = []
        sizes: list[int] = []
        for text in texts:
            for piece in text.translate(PIECES).split(b"\n"):
                own = piece.split()  # blanks and tabs: the rest of white space has ended a piece
                if own:
                    words += own
                    sizes.append(len(own))
                if len(words) >= BLOCK:
                    yield group, words, followed(sizes)
                    words, sizes = [], []
        if words:
            yield group, words, followed(sizes)


def followed(sizes: list[int]) -> np.ndarray:
    more = np.ones(sum(sizes), bool)
    more[np.cumsum(sizes) - 1] = False
    return more


def run_slots(group: str, words: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    """Slots of the runs of two, and of three words, that start at each word (those beyond the last word mean nothing)."""
    h = hashes.of(words)
    key = h + np.uint64(xxhash.xxh3_64_intdigest(group.encode()))
    out = []
    for k in range(1, LONGEST - 1):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -k))
        out.append((key >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return out


def running(more: np.ndarray, k: int) -> np.ndarray:
    """Whether ``k`` further words of the piece follow."""
    out = more.copy()
    for j in range(1, k):
        out[: max(0, len(out) - j)] &= more[j:]
    return out


def sketch(texts: DataFrame, min_count: int) -> tuple[list[bytes], dict[str, int]]:
    """For runs of two and of three words a bit for each slot whose runs are met ``min_count`` times together; and each
    group's words.

    To the driver go twice ``2 ** SLOT_BITS`` bits, whatever the input, and a row for each group. Counts stop at
    ``min_count`` (255 at most, above which the sketch only rules out less)."""
    cap = min(min_count, 255)
    n_rows = (1 << SLOT_BITS) // ROW_SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, slots, sizes = WordHashes(), np.zeros((LONGEST - 2, 1 << SLOT_BITS), np.uint8), Counter()
        for batch in batches:
            for group, words, more in blocks(batch):
                sizes[group] += len(words)
                for k, own in enumerate(run_slots(group, words, hashes)):
                    at, n = np.unique(own[running(more, k + 1)], return_counts=True)
                    slots[k, at] = np.minimum(slots[k, at] + n, cap)
        if sizes:
            packed = [zstandard.compress(r.tobytes(), 1) if r.any() else None for r in slots.reshape(-1, ROW_SLOTS)]
            at = [k for k, p in enumerate(packed) if p]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*at, *[-1] * len(sizes)], pa.int32()), pa.array([*[packed[k] for k in at], *[None] * len(sizes)], pa.binary()),
                 pa.array([*[None] * len(at), *sizes], pa.string()), pa.array([*[0] * len(at), *sizes.values()], pa.int64())],
                names=["row", "counts", "grp", "n"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zstandard.decompress(counts.as_buffer()), np.uint8)
                sums[row] = np.minimum(sums[row].astype(np.uint16) + own, cap).astype(np.uint8) if row in sums else own
        if sums:
            bits = [np.packbits(s >= cap, bitorder="little").tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(bits, pa.binary())], names=["row", "bits"])

    parts = settle(texts.mapInArrow(count, "row int, counts binary, grp string, n bigint"), "sketch")
    full = np.zeros((LONGEST - 2, n_rows, ROW_SLOTS // 8), np.uint8)
    for r in parts.filter("row >= 0").select("row", "counts").repartition("row").mapInArrow(add, "row int, bits binary").toLocalIterator():
        full[r.row // n_rows, r.row % n_rows] = np.frombuffer(r.bits, np.uint8)
    sizes = parts.filter("row < 0").groupBy("grp").agg(F.sum("n").alias("n")).collect()
    return [bits.tobytes() for bits in full], {r.grp: r.n for r in sizes}


def longest_runs(texts: DataFrame, bits: list[bytes]) -> DataFrame:
    """``grp``, ``gram``, ``w``: how often each run of up to four words is the longest from its first word on."""
    packed = [zstandard.compress(b, 3) for b in bits]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = [np.frombuffer(zstandard.decompress(b), np.uint8) for b in packed]
        hashes, held = WordHashes(), defaultdict(Counter)
        for batch in batches:
            for group, words, more in blocks(batch):
                may = [((own[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) for own, at in zip(flags, run_slots(group, words, hashes))]
                two = more & may[0]
                three = running(two, 2) & may[1]
                four = three.copy()
                four[:-1] &= three[1:]
                four[-1:] = False
                size = 1 + two.astype(np.int64) + three + four
                own = held[group]
                own.update([w for w, alone in zip(words, (size == 1).tolist()) if alone])
                starts = np.flatnonzero(size > 1)
                own.update([b" ".join(words[i:j]) for i, j in zip(starts.tolist(), (starts + size[starts]).tolist())])
                if sum(map(len, held.values())) > HELD:
                    yield from counted(held)
                    held.clear()
        yield from counted(held)

    return texts.mapInArrow(count, "grp string, gram string, w bigint").groupBy("grp", "gram").agg(F.sum("w").alias("w"))


def counted(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for group, counts in held.items():
        grams = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(counts), pa.string()), grams, pa.array(counts.values(), pa.int64())], names=["grp", "gram", "w"])


def n_words(gram: Column) -> Column:
    return F.char_length(gram) - F.char_length(F.replace(gram, F.lit(" "), F.lit(""))) + 1


def first_words(gram: Column, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def last_words(gram: Column, k: int) -> Column:
    return F.substring_index(gram, " ", -k)


def flows(runs: DataFrame) -> dict[int, DataFrame]:
    """Counts of all runs of 4, 3, 2 and 1 words (``grp``, ``gram``, ``f``): what flows out of a node plus what ends there.

    Counts are whole where the sketch rules out no part of a run."""
    sized = runs.withColumn("size", n_words(F.col("gram")))
    out = {LONGEST: sized.filter(F.col("size") == LONGEST).select("grp", "gram", F.col("w").alias("f"))}
    for k in range(LONGEST - 1, 0, -1):
        longer = out[k + 1].select("grp", first_words(F.col("gram"), k).alias("gram"), "f")
        ends = sized.filter(F.col("size") == k).select("grp", "gram", F.col("w").alias("f"))
        out[k] = settle(longer.unionByName(ends).groupBy("grp", "gram").agg(F.sum("f").alias("f")), f"flow-{k}", "zstd")
    return out


def inner_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``grp``, ``node``, ``before``, ``after``: nodes between two heavy edges of the same weight where no piece starts or ends
    and nothing branches off."""
    outs = edges.groupBy("grp", first_words(F.col("gram"), LONGEST - 1).alias("node")).agg(
        F.count(F.lit(1)).alias("n_out"), F.min("gram").alias("after"), F.sum("f").alias("w_out"))
    ins = edges.groupBy("grp", last_words(F.col("gram"), LONGEST - 1).alias("node")).agg(
        F.count(F.lit(1)).alias("n_in"), F.min("gram").alias("before"), F.sum("f").alias("w_in"))
    met = outs.filter("n_out = 1").join(ins.filter("n_in = 1"), ["grp", "node"]).filter("w_in = w_out")
    return met.join(nodes.select("grp", F.col("gram").alias("node"), "f"), ["grp", "node"]).filter("f = w_out").select("grp", "node", "before", "after")


def compact(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """Unary paths: ``grp``, ``words`` (array), ``f`` (weight of each of its edges).

    By doubling: after r rounds an edge knows the edge 2**r before it. No path is a circle: whoever walks a circle leaves it
    or ends on it, so one of its nodes has more than one way. A path is no longer than one piece of a text."""
    edges = edges.select("grp", F.col("gram").alias("edge"), "f")
    steps = edges.join(inner.select("grp", F.col("after").alias("edge"), F.col("before").alias("first")), ["grp", "edge"], "left")
    steps = cut_lineage(steps.select("grp", "edge", "f", F.coalesce("first", "edge").alias("first"), F.col("first").isNotNull().cast("int").alias("at")))
    span = 1
    while steps.filter(F.col("at") == span).limit(1).count():  # those that may have further to go
        onward = steps.filter("at > 0").select("grp", F.col("edge").alias("first"), F.col("first").alias("_first"), F.col("at").alias("_at"))
        met = steps.join(onward, ["grp", "first"], "left")
        steps = cut_lineage(met.select("grp", "edge", "f", F.coalesce("_first", "first").alias("first"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at")))
        span *= 2
    ordered = F.array_sort(F.collect_list(F.struct("at", last_words(F.col("edge"), 1).alias("word"))))
    paths = steps.groupBy("grp", "first").agg(F.max("f").alias("f"), ordered.alias("_on"))
    start = F.split(first_words(F.col("first"), LONGEST - 1), " ", -1)
    return paths.select("grp", F.concat(start, F.transform("_on", lambda x: x["word"])).alias("words"), "f")


def windows(words: Column, size: int) -> Column:
    """All runs of ``size`` words, joined by blanks."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))


def uncovered(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates but those inside a longer one with ``percent`` of their count."""
    words = F.split("gram", " ", -1)
    inside = F.when(n_words(F.col("gram")) == 3, windows(words, 2)).when(n_words(F.col("gram")) == 4, F.concat(windows(words, 3), windows(words, 2)))
    around = candidates.filter(n_words(F.col("gram")) > 2).select("grp", F.explode(inside).alias("gram"), "f")
    most = around.groupBy("grp", "gram").agg(F.max("f").alias("_around"))
    met = candidates.join(most, ["grp", "gram"], "left")
    return met.filter(F.col("_around").isNull() | (100 * F.col("_around") < percent * F.col("f"))).drop("_around")


def keyed(df: DataFrame, gram: str) -> DataFrame:
    """With two hashes of group and words: 128 bits in all."""
    return df.withColumn("_a", F.xxhash64("grp", gram)).withColumn("_b", F.xxhash64(F.lit(1), gram, "grp"))


def best_cut(candidates: DataFrame, counts: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """With ``l``, ``r`` and ``score`` of the cut that scores lowest. Counts of a word that many phrases hold are broadcast."""
    size = n_words(F.col("gram"))
    cuts = F.expr("flatten(transform(sequence(1, size - 1), k -> array("
                  "named_struct('k', k, 'left', true, 'part', substring_index(gram, ' ', k)), "
                  "named_struct('k', k, 'left', false, 'part', substring_index(gram, ' ', k - size)))))")
    parts = candidates.withColumn("size", size).select("grp", "gram", "f", F.explode(cuts).alias("cut")).select("grp", "gram", "f", "cut.*")
    known = settle(keyed(counts, "gram").select("_a", "_b", F.col("f").alias("part_f"), F.col("f").alias("weight")), "parts")
    met = join_unique(keyed(parts, "part"), known, ["_a", "_b"], "weight", [F.col("gram"), F.col("k"), F.col("left")])
    sides = met.groupBy("grp", "gram", "f", "k").agg(F.max(F.when(F.col("left"), F.col("part_f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("part_f"))).alias("r"))
    wide = F.col("f").cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    total = F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    rated = sides.withColumn("score", F.call_function("div", wide, total))
    best = rated.groupBy("grp", "gram", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("grp", "gram", "f", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))


def collocations(
    docs: DataFrame, min_count: int = 30, top: int = 2000, cover_percent: int = 80, text: str = "text", group: str = "lang", no_group: str = "und",
) -> DataFrame:
    """The ``top`` phrases of two to four words of each group: ``grp``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase has a = its count >= ``min_count``; of its cuts in two, with counts l and r, that with the lowest
    floor(2000000 a / (l + r)) scores it, ties to the first. It is left out where a longer phrase around it has
    ``cover_percent`` of its count. Order: score and a, both descending, then phrase by bytes. Pieces end at ``. , ; : ! ?``
    and line ends, words at blanks and tabs; A-Z count as a-z. Null texts are empty, null groups ``no_group``; every row
    counts, repeated ones too; other columns are not read. An empty table has no phrases.
    """
    texts = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(no_group)).alias("grp"), F.col(text).alias("text"))
    bits, sizes = sketch(texts, min_count)
    counts = flows(settle(longest_runs(texts, bits), "runs", "zstd"))
    heavy = {k: df.filter(F.col("f") >= min_count) for k, df in counts.items()}
    inner = settle(inner_nodes(heavy[4], heavy[3]), "inner")
    paths = compact(heavy[4], inner)
    long = paths.select("grp", F.explode(windows(F.col("words"), LONGEST)).alias("gram"), "f")
    # An inner node lies in an edge of its own count, which also holds all that the node holds.
    middle = heavy[3].join(inner.select("grp", F.col("node").alias("gram")), ["grp", "gram"], "left_anti")
    candidates = settle(long.unionByName(middle).unionByName(heavy[2]), "candidates")
    kept = uncovered(candidates, cover_percent)
    rated = best_cut(kept, heavy[1].unionByName(heavy[2]).unionByName(heavy[3]))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    named = rated.select("grp", F.col("gram").alias("phrase"), F.col("f").alias("a"), "l", "r", "score", F.pmod(F.xxhash64("gram"), F.lit(DEALT)).alias("_part"))
    few = named.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    ordered = numbered(few.drop("rank"), ["grp", *order])
    firsts = ordered.groupBy("grp").agg(F.min("rn").alias("_first"))
    totals = firsts.join(docs.sparkSession.createDataFrame(list(sizes.items()), "grp string, n bigint"), "grp")
    ranked = ordered.join(F.broadcast(totals), "grp").withColumn("rank", F.col("rn") - F.col("_first") + 1).filter(F.col("rank") <= top)
    return ranked.select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
