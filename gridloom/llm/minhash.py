"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning of signatures, exact checks of the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm.common import TO_LOWER, WordHashes, join_unique, likely_in, mixed, pieces, utf8, window_hashes
from gridloom.operators.graph import connected
from gridloom.session import settle

#: Bands and hashes in each: of pairs at similarity 0.8, (1 - 0.8^6)^50 = 2.5e-7 share no band.
BANDS, ROWS = 50, 6
#: Signatures keep 16 bits of a hash. Hashes compared at a time, and the chance to prune a pair at the threshold, over all batches.
BATCH, MISS = 50, 1e-6
#: Rows of a bucket that meet in one comparison: those outside its largest class, and any.
REST, CHUNK = 128, 512
#: Ends of pairs whose texts are broadcast, at most.
HEAVY_ENDS = 128
_random = np.random.Generator(np.random.PCG64(20))
FLIPS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of fewer words, one hash of all; none without words.
    Words stand between ASCII white space, A-Z in lower case."""
    h = hashes.of((text or b"").translate(TO_LOWER).split())
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else h


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(FLIPS), np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):
        np.minimum(out, ((x[None, at : at + 2048] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1), out=out)
    return out


def fewest_matches(percent: int) -> np.ndarray:
    """For each number of batches, the fewest matches at which the posterior of the threshold isn't below the allowed
    miss. With every similarity as likely beforehand, P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    t, steps = percent / 100, BANDS * ROWS // BATCH
    out = []
    for k in range(1, steps + 1):
        n, total, m = k * BATCH, 0.0, 0
        while (total := total + math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < MISS / steps:
            m += 1
        out.append(m)
    return np.array(out)


def _likely(a: np.ndarray, b: np.ndarray, fewest: np.ndarray) -> np.ndarray:
    """Which rows of two signature tables may reach the threshold: batch by batch, those still in the race."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(fewest):
        at = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, at] == b[alive, at]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    return alive


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sets of hashes reach the threshold."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BANDS * ROWS)


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``id``, ``tie`` (hash of the text), ``n_shingles``, ``k1``, ``k2`` (of the set, 0 if empty), ``sig`` (16 bits a hash),
    ``bands`` (a bucket each)."""
    band = np.arange(BANDS, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, 500):
                sizes, k1, k2, sigs = [], [], [], np.zeros((part.num_rows, BANDS * ROWS), np.uint32)
                for i, text in enumerate(utf8(part.column(1))):
                    s = shingles(text, n, hashes)
                    sizes.append(len(s))
                    k1.append(int(np.bitwise_xor.reduce(mixed(s)).astype(np.int64)) if len(s) else 0)
                    k2.append(int((mixed(s ^ np.uint64(0x5555)).sum(dtype=np.uint64)).astype(np.int64)) if len(s) else 0)
                    if len(s):
                        sigs[i] = signature(s)
                buckets = np.repeat(mixed(band + np.uint64(77))[None, :], len(sigs), axis=0)
                short = (sigs >> np.uint32(16)).astype(np.uint16)
                for j in range(ROWS):
                    buckets = mixed(buckets ^ short[:, j::ROWS].astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * BANDS), pa.array(buckets.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([x.tobytes() for x in short], pa.binary()), lists],
                    names=["id", "tie", "n_shingles", "k1", "k2", "sig", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    return rows.mapInArrow(sketch, "id bigint, tie bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary, bands array<bigint>")


def _first_of(rows: DataFrame, name: str) -> DataFrame:
    """Of rows that repeat an id, that with the smallest hash of ``name``."""
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(name)))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def _with(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the ``name`` of both ends from ``values`` (``id``, ``name``), however many pairs one end has. Where an
    id repeats, the value with the smallest hash stands for it."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    own = settle(_first_of(likely_in(values, "id", ends, "id").join(ends, "id"), name), "ends")
    for end in ("a", "b"):
        pairs = join_unique(pairs, own.select(F.col("id").alias(end), F.col(name).alias(f"{name}_{end}"), "n"), [end], "n", [F.col("a"), F.col("b")], HEAVY_ENDS)
    return pairs


def likely_pairs(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Those candidate pairs whose signatures survive the sequential test."""
    fewest = fewest_matches(percent)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 4000):
                alive = _likely(_signatures(part.column(2)), _signatures(part.column(3)), fewest)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(alive)), part.column(1).take(pa.array(alive))], names=["a", "b"])

    return _with(pairs, sigs, "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a bigint, b bigint")


def true_pairs(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Those pairs whose full shingle sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), (None, None)
        for batch in batches:
            for part in pieces(batch, 500):
                keep = []
                for i, (a, x, y) in enumerate(zip(part.column(0).to_pylist(), utf8(part.column(2)), utf8(part.column(3)))):
                    if last[0] != a:
                        last = a, shingles(x, n, hashes)
                    if _linked(last[1], shingles(y, n, hashes), percent):
                        keep.append(i)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    return _with(pairs, texts, "text").select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows equal in the first columns, across batches; the input is sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = np.stack([np.asarray(table.column(i)) for i in range(keys)])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        starts = [0, *cuts.tolist(), table.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(values[:, a].tolist())
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def cross_links(members: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Links between different classes within a bucket, of buckets whose members aren't one class yet.

    ``members``: ``bucket``, ``band``, ``id``, ``class``, ``pivot``. Pairs with the pivot are known and left out. A bucket's
    members outside its largest class are cut into blocks, all its members into chunks, and each block meets each chunk:
    a bucket of one large class and few others costs its size times the few. A pair is compared in the first band that
    it shares, in the task: signatures batch by batch, then full sets. Once two classes are linked there, their other
    pairs are skipped, so a task emits fewer links than it has classes.
    """
    fewest = fewest_matches(percent)
    counted = members.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    open_ = counted.groupBy("bucket").agg(F.sum("n").alias("m"), F.max(F.struct("n", "class")).alias("top")).filter((F.col("m") > 2) & (F.col("m") > F.col("top.n")))
    open_ = settle(open_.select("bucket", "m", F.col("top.class").alias("bulk"), F.ceil((F.col("m") - F.col("top.n")) / REST).alias("blocks"), F.ceil(F.col("m") / CHUNK).alias("chunks")), "open-buckets")
    met = settle(join_unique(members, open_, ["bucket"], "m", [F.col("id")]).filter(F.col("blocks").isNotNull() & (F.col("id") != F.col("pivot"))), "open-members")
    owned = met.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    own = settle(_first_of(likely_in(texts, "id", owned, "id").join(owned, "id").drop("n"), "text").join(likely_in(sigs, "id", owned, "id"), "id"), "open-rows")
    signed = met.join(own, "id")
    h = F.xxhash64("id")
    rest = signed.filter(F.col("class") != F.col("bulk")).select("bucket", F.pmod(h, F.col("blocks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), F.lit(0).alias("side"), "band", "id", "class", "sig", "text")
    every = signed.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), F.pmod(h, F.col("chunks")).alias("c"), F.lit(1).alias("side"), "band", "id", "class", "sig", "text")
    dealt = rest.unionByName(every).repartition("bucket", "i", "c").sortWithinPartitions("bucket", "i", "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in _groups(batches, 3):
            side, band, ids, classes = (np.asarray(group.column(i)) for i in (3, 4, 5, 6))
            sig, sets, root = _signatures(group.column(7).combine_chunks()), {}, {}
            texts_ = utf8(group.column(8))

            def set_of(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingles(texts_[i], n, hashes)
                return sets[i]

            def up(k: int) -> int:
                while root.get(k, k) != k:
                    k = root[k]
                return k

            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            first, found = int(band[0]), []
            for x in left.tolist():
                y = right[classes[right] != classes[x]]
                y = y[_likely(np.broadcast_to(sig[x], (len(y), sig.shape[1])), sig[y], fewest)]
                before = (sig[x, : first * ROWS] == sig[y, : first * ROWS]).reshape(len(y), first, ROWS).all(axis=2).any(axis=1)
                for k in y[~before].tolist():
                    a, b = up(int(classes[x])), up(int(classes[k]))
                    if a != b and _linked(set_of(x), set_of(k), percent):
                        root[max(a, b)] = min(a, b)
                        found.append((int(ids[x]), int(ids[k])))
                sets.pop(x, None)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for each row: classes of documents linked, also over others,
    by sets of ``n``-word shingles whose intersection is ``percent`` hundredths of the union or more.

    1. A vectorised pass makes set keys, MinHash signatures and band buckets. Equal sets fold into their smallest id.
    2. In each bucket, all members pair with one alone, that which shares most buckets with others, so a bucket of any
       size gives as many pairs as members, and copies of a text meet it or one close to it. Signatures are compared in batches; a pair goes as soon as the posterior chance of reaching the threshold
       falls under the allowed miss. Survivors are checked on full sets. Linked documents form classes.
    3. Buckets that still hold several classes compare across these, in full again (``cross_links``). Links within a class change nothing, so no link between different classes is lost.

    A pair at the threshold is missed with a chance of about 1e-6. Nothing is capped; hot sets, buckets and ends of pairs
    are dealt out.

    Null or blank text: an empty set, linked with nothing. Null id: a class of its own, ``component_id`` null, kept. Of
    rows that repeat an id, that with the smallest text hash is linked; the others take the class of sets equal to
    theirs, or else their id. Other columns aren't read. An empty table gives an empty one.
    """
    drawn = settle(sketches(docs, id_col, text_col, n), "sketches")
    again = settle(drawn.groupBy(F.col("id").alias("again")).agg(F.min("tie").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated-ids")
    found = drawn.filter("n_shingles > 0 and id is not null").join(again, (F.col("id") == F.col("again")) & (F.col("tie") != F.col("first")), "left_anti")
    sets = settle(found.groupBy("k1", "k2").agg(F.min(F.struct("id", "sig", "bands")).alias("x"), F.count(F.lit(1)).alias("n")).select("k1", "k2", "n", "x.*"), "sets")
    sigs = sets.select("id", "sig")
    entries = sets.select("id", F.posexplode("bands").alias("band", "bucket"))
    crowds = settle(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumn("size", F.col("m")), "crowds")
    shared = settle(join_unique(entries, crowds, ["bucket"], "m", [F.col("id")]).filter("size is not null"), "shared")
    central = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    hubs = shared.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("pivot"), F.first("size").alias("m"))
    members = settle(join_unique(shared.select("id", "band", "bucket"), settle(hubs, "hubs"), ["bucket"], "m", [F.col("id")]), "members")
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    pairs = settle(members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = settle(true_pairs(settle(likely_pairs(pairs, sigs, percent), "likely"), texts, percent, n), "links")
    classes = settle(connected(links, []).select(F.col("node").alias("id"), F.col("root").alias("class")), "classes")
    placed = members.join(classes, "id", "left").select("bucket", "band", "id", "pivot", F.coalesce("class", "id").alias("class"))
    more = settle(cross_links(placed, sigs, texts, percent, n), "more-links")

    roots = connected(links.unionByName(more), [])
    whole = settle(sets.select("k1", "k2", "n", "id").join(roots, F.col("id") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("root", "id").alias("root")), "roots")
    done = join_unique(drawn.select("id", "n_shingles", "k1", "k2"), whole, ["k1", "k2"], "n", [F.col("id")])
    root = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.least("root", "id")).otherwise(F.col("id"))
    return done.select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each class: that with the smallest id. Of rows that repeat an id, one;
    of rows without id, all. See ``near_duplicates``."""
    kept = near_duplicates(docs, id_col, text_col, n, percent).filter(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_kept")).distinct()
    row = docs.select(F.col(id_col).alias("_id"), F.struct("*").alias("_row"), F.xxhash64(text_col).alias("_tie"))
    first = row.join(kept, F.col("_id") == F.col("_kept")).withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("_tie")))
    rows = first.filter("_n = 1").select("_row").unionByName(row.filter("_id is null").select("_row"))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
