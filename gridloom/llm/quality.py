"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text, scores by perplexity."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridloom.llm.common import pieces
from gridloom.session import release, scratch_path, settle, shuffles_freed

#: Characters in a gram, and bits of each: grams of five fit one integer.
ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
#: Code points from here on share the last 512 symbols; the text starts with ORDER - 1 marks.
PLAIN, START = SYMBOLS - 512, 1
#: Characters in a shard, at most (but for one longer text).
SHARD = 32 << 20
#: Trusted ids that are broadcast, at most; beyond that they meet the documents in a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Trusted documents are dealt into so many folds; each is judged by a model of the other folds. Model 0 has all of them.
FOLDS = 10


def symbols(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one run of symbols, each after its start marks; and the texts' lengths. White space is one symbol."""
    sizes = np.array([len(t) for t in texts], np.int64)
    mark = "\x01" * (ORDER - 1)
    points = np.frombuffer(("".join(mark + t.replace("\x01", "\x02") for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    s, high = points.astype(np.int64), np.flatnonzero(points >= PLAIN)
    s[high] = PLAIN + s[high] % (SYMBOLS - PLAIN)
    s[(points >= 9) & (points <= 13)] = 32
    return s, sizes


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """One gram for each character of the texts (itself and the four before it, packed), and the texts' lengths."""
    s, sizes = symbols(texts)
    if len(s) < ORDER:
        return np.empty(0, np.int64), sizes
    g = np.zeros(len(s) - ORDER + 1, np.int64)
    for j in range(ORDER):
        g <<= BITS
        g |= s[j : j + len(g)]
    return g[s[ORDER - 1 :] != START], sizes


def keys(texts: Sequence[str], models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` with the number of the text's model (or fold) in the bits above."""
    g, sizes = grams(texts)
    g |= np.repeat(models.astype(np.int64) << ORDER * BITS, sizes)
    return g, sizes


def _apart(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams and models of ``keys``."""
    return key & ((1 << ORDER * BITS) - 1), key.view(np.uint64) >> np.uint64(ORDER * BITS)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, as met, and where each item's value stands among them: by hashing, which spares sorting every character."""
    coded = pa.array(key).dictionary_encode()
    return np.asarray(coded.dictionary), np.asarray(coded.indices)


def _suffix(k: int) -> Column:
    """The last k - 1 characters of a gram of k."""
    return F.col("g").bitwiseAND((1 << BITS * (k - 1)) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams with their counts in all and by fold, summed within the task as far as a million distinct ones of a fold."""
    found, waiting = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, at = _distinct(np.concatenate([x[0] for x in found]))
        return key, np.bincount(at, np.concatenate([x[1] for x in found]), len(key)).astype(np.int64)

    def table() -> pa.RecordBatch:
        kept, sums = merged()
        bare, fold = _apart(kept)
        g, at = np.unique(bare, return_inverse=True)
        counts = np.zeros((FOLDS + 1, len(g)), np.int64)
        counts[fold.astype(np.int64), at] = sums
        counts[0] = counts.sum(0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g, *counts)], names=["g", *(f"f{i}" for i in range(FOLDS + 1))])

    for batch in batches:
        for part in pieces(batch, 500):
            g, at = _distinct(keys([t or "" for t in part.column(0).to_pylist()], np.asarray(part.column(1)))[0])
            found.append((g, np.bincount(at, minlength=len(g))))
            waiting += len(g)
            if waiting > 1_000_000:
                found, waiting = [merged()], 0
                if len(found[0][0]) > 1_000_000:
                    yield table()
                    found = [(g[:0], g[:0])]
    yield table()


class KneserNey:
    """Tables of an interpolated modified Kneser-Ney model; all stay distributed.

    ``levels[k]``: grams of k characters with their counts; ``contexts[k]``: contexts with their ``total`` and ``back`` (the
    weight left to the shorter gram). The highest order counts occurrences, the lower ones distinct
    characters before. Discounts follow Chen and Goodman from the counts of counts one to four.

    With a column ``fold`` (1 to ``FOLDS``) there are models 1 to ``FOLDS`` too, each of all texts outside its fold. The texts
    are counted once. A gram has one row, with a column for each model (``c0``, ``c1`` …).
    """

    def __init__(self, texts: DataFrame):
        self.spark = texts.sparkSession
        cross = "fold" in texts.columns
        self.models = range(FOLDS + 1 if cross else 1)
        self.path, self.tables = scratch_path(self.spark, "model"), []
        found = texts.select("text", F.col("fold").cast("int") if cross else F.lit(0)).mapInArrow(
            _count, ", ".join(["g bigint", *(f"f{i} bigint" for i in range(FOLDS + 1))])
        )
        sums = found.groupBy("g").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in self.models])
        counts = settle(sums.select("g", *[(F.col("f0") - (F.col(f"f{i}") if i else 0)).alias(f"c{i}") for i in self.models]), "grams", below=self.path)
        self.levels, self.contexts = {}, {}
        for k in range(ORDER, 0, -1):
            self.levels[k] = (counts, self._discounts(counts))
            by = counts.groupBy(F.shiftrightunsigned("g", BITS).alias("h")).agg(
                *[F.sum(f"c{i}").alias(f"total{i}") for i in self.models], *[F.sum(F.least(self._off(k, i), F.col(f"c{i}"))).alias(f"off{i}") for i in self.models]
            )
            by = by.select("h", *[F.nullif(F.col(f"total{i}"), F.lit(0)).alias(f"total{i}") for i in self.models], *[f"off{i}" for i in self.models])
            back = [(F.col(f"off{i}") / F.col(f"total{i}")).alias(f"back{i}") for i in self.models]
            self.contexts[k] = settle(by.select("h", *[f"total{i}" for i in self.models], *back), f"contexts-{k}", below=self.path)
            if k > 1:
                shorter = counts.groupBy(_suffix(k).alias("g")).agg(*[F.count_if(F.col(f"c{i}") > 0).alias(f"c{i}") for i in self.models])
                counts = settle(shorter, f"grams-{k - 1}", below=self.path)

    def _discounts(self, counts: DataFrame) -> list[tuple[float, float, float]]:
        """For each model."""
        of = [F.count_if(F.col(f"c{i}") == n) for i in self.models for n in (1, 2, 3, 4)]
        with shuffles_freed(self.spark):
            seen = tuple(counts.agg(*of).first())
        found = []
        for n1, n2, n3, n4 in zip(*[iter(seen)] * 4):
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                found.append(tuple(min(max(i - (i + 1) * y * b / a, 0.0), float(i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))))
            else:
                found.append((0.5, 1.0, 1.5))  # too little text to tell
        return found

    def _off(self, k: int, i: int) -> Column:
        """What is taken off a count."""
        d, c = self.levels[k][1][i], F.col(f"c{i}")
        return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])

    def log2(self, wanted: DataFrame) -> DataFrame:
        """``g``, ``bits`` (negative log2 of the probability under each model) of distinct grams, seen or not: joins by gram and by
        context at each order, on keys that 4096 rows share at most."""
        path = f"{self.path}/answers-{uuid.uuid4().hex}"
        need = {ORDER: wanted}
        for k in range(ORDER - 1, 0, -1):
            need[k] = settle(need[k + 1].select(_suffix(k + 1).alias("g")).distinct(), f"need-{k}", below=path)
        lower = None
        for k in range(1, ORDER + 1):
            rows = need[k].withColumn("h", F.shiftrightunsigned("g", BITS)).join(self.contexts[k], "h", "left")
            if lower is not None:
                rows = rows.withColumn("low", _suffix(k)).join(lower.withColumnRenamed("g", "low"), "low")
            else:
                rows = rows.select("*", *[F.lit(1.0 / SYMBOLS).alias(f"p{i}") for i in self.models])
            over = [F.greatest(F.col(f"c{i}") - self._off(k, i), F.lit(0.0)).alias(f"over{i}") for i in self.models]
            rows = rows.join(self.levels[k][0].select("g", *over), "g", "left")
            p = [F.coalesce(F.col(f"over{i}") / F.col(f"total{i}"), F.lit(0.0)) + F.coalesce(f"back{i}", F.lit(1.0)) * F.col(f"p{i}") for i in self.models]
            if k == ORDER:
                found = settle(rows.select("g", F.array(*[(-F.log2(x)).cast("float") for x in p]).alias("bits")), "bits", below=path)
            else:
                lower = settle(rows.select("g", *[x.alias(f"p{i}") for i, x in enumerate(p)]), f"shares-{k}", below=path)
                release(self.spark, f"{path}/need-{k}")
            release(self.spark, f"{path}/shares-{k - 1}")
        return found

    def forget(self) -> None:
        """Remove counts and contexts; answers and shards stay."""
        for k in range(1, ORDER + 1):
            release(self.spark, f"{self.path}/contexts-{k}")
            release(self.spark, f"{self.path}/grams" if k == ORDER else f"{self.path}/grams-{k}")

    def release(self) -> None:
        """Remove the tables, and the shards of ``score``, once all that was asked for is settled."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        release(self.spark, self.path)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (struct ``row``, ``text``, ``model``) packed into shards: id, the distinct grams in order, a bit for each model that
    they are asked of, and the rows compressed."""
    made, held = 0, None

    def open_shard(schema: pa.Schema) -> tuple:
        sink = io.BytesIO()
        packer = zstandard.ZstdCompressor(6).stream_writer(sink, closefd=False)
        return sink, packer, pa.ipc.new_stream(packer, schema)

    def shard() -> pa.RecordBatch:
        out.close()
        packer.close()
        bare, model = _apart(_distinct(np.concatenate(known))[0])
        order = np.argsort(bare, kind="stable")
        bare, asks = bare[order], np.int64(1) << model[order].astype(np.int64)
        first = np.flatnonzero(np.diff(bare, prepend=-1))
        asks = (np.bitwise_or.reduceat(asks, first) if len(first) else asks).astype(np.int32)
        ends = pa.array([0, len(first)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (bare[first], asks)]
        name = TaskContext.get().partitionId() << 32 | made
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *lists, pa.array([sink.getvalue()], pa.binary())], names=["shard", "grams", "asks", "blob"])

    for batch in batches:
        for part in pieces(batch, 500):
            if held is None:
                (sink, packer, out), size, known, waiting = open_shard(part.schema), 0, [], 0
            held = out.write_batch(part) or True
            key, sizes = keys([t or "" for t in part.column(1).to_pylist()], np.asarray(part.column(2)))
            size += int(sizes.sum())
            known.append(_distinct(key)[0])
            waiting += len(known[-1])
            if waiting > 2_000_000:
                known, waiting = [_distinct(np.concatenate(known))[0]], 0
            if size >= SHARD:
                yield shard()
                made, held = made + 1, None
    if held:
        yield shard()


def _gather(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Answers (``shard``, ``at``, ``asks``, ``bits`` of model 0 or of all) as two lists a shard, of the models asked alone, for
    about ``most`` answers at a time; ``at`` as steps, which are small."""
    held: list[list[np.ndarray]] = []

    def lists() -> pa.RecordBatch:
        shard, at, asks, n, bits = (np.concatenate(x) for x in zip(*held))
        row = np.repeat(np.arange(len(n)), n)
        bit = np.arange(len(bits)) - np.repeat(np.cumsum(n) - n, n)
        of = (asks[row] >> bit) & 1 == 1
        order, by_row = np.argsort(shard[row[of]], kind="stable"), np.argsort(shard, kind="stable")
        names, first = np.unique(shard[by_row], return_index=True)
        ends, at = np.append(first, len(shard)), at[by_row]
        at[1:], at[first[1:]] = np.diff(at), at[first[1:]]
        sums = np.append(0, np.cumsum(np.bitwise_count(asks[by_row]), dtype=np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(names), *(pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v)) for e, v in ((ends, at), (sums[ends], bits[of][order])))],
            names=["shard", "at", "bits"],
        )

    for batch in batches:
        if batch.num_rows:
            ends = np.asarray(batch.column(3).offsets)
            held.append([*(np.asarray(batch.column(k)) for k in range(3)), np.diff(ends), np.asarray(batch.column(3).values)[ends[0] : ends[-1]]])
        if sum(len(x[0]) for x in held) >= most:
            yield lists()
            held.clear()
    if held:
        yield lists()


def _score(texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            known, asks = (np.asarray(batch.column(k)[i].values) for k in (1, 2))
            starts = np.append(0, np.cumsum(np.bitwise_count(asks), dtype=np.int64))
            bits = np.zeros(starts[-1], np.float32)
            for told in batch.column(3)[i].values or ():  # none where its texts are all empty
                at, values = np.cumsum(np.asarray(told["at"].values), dtype=np.int64), np.asarray(told["bits"].values)
                n = np.diff(starts)[at]
                bits[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(len(values))] = values
            with zstandard.ZstdDecompressor().stream_reader(batch.column(0)[i].as_buffer()) as packed, pa.ipc.open_stream(packed) as rows:
                for part in (x for some in rows for x in pieces(some, 125)):
                    key, sizes = keys([t or "" for t in part.column(1).to_pylist()], np.asarray(part.column(2)))
                    distinct, of = _distinct(key)
                    bare, model = _apart(distinct)
                    to = np.searchsorted(known, bare)
                    below = np.bitwise_count(asks[to] & ((1 << model.astype(np.int32)) - 1))
                    ends = np.append(0.0, np.cumsum(bits[starts[to] + below][of], dtype=np.float64))
                    at = np.append(0, np.cumsum(sizes))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[: 1 + texts], pa.array(sizes), pa.array((ends[at[1:]] - ends[at[:-1]]).round(6))], names=["row", *["text"] * texts, "n_chars", "bits"]
                    )
            del known, asks, starts, bits
        del batch  # a shard is large: gone before the next is read


def score(docs: DataFrame, model: KneserNey, row: Column, text: Column, number: Column | None = None, texts: bool = False, last: bool = False) -> DataFrame:
    """``row`` (a struct), with ``texts`` the ``text``, ``n_chars`` and ``bits`` (of the whole text under the model) for each row
    of ``docs``. ``number``: which of the models, 0 unless given. Reads tables that go with ``model.release``; ``last``: the model's other tables go as soon as its answers are settled.

    Documents are packed into shards that know their distinct grams. These meet the model once per shard and gram, and
    come back to the shards' rows, which lie bucketed by shard and aren't shuffled. So what moves are distinct grams of
    millions of characters each, not documents or their grams."""
    spark = docs.sparkSession
    rows = docs.select(row.alias("row"), text.alias("text"), (F.lit(0) if number is None else number).cast("int").alias("model"))
    name, buckets = f"gridloom_shards_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(_pack, "shard bigint, grams array<bigint>, asks array<int>, blob binary")
    with shuffles_freed(spark):
        packed.write.bucketBy(buckets, "shard").option("path", f"{model.path}/shards").option("compression", "zstd").format("parquet").saveAsTable(name)
    model.tables.append(name)
    held = spark.table(name)
    asked = held.select("shard", F.posexplode(F.arrays_zip("grams", "asks")).alias("at", "x")).select("shard", "at", "x.grams", "x.asks")
    asked = asked.withColumnRenamed("grams", "g")
    answers = model.log2(settle(asked.select("g").distinct(), "asked", below=model.path))
    release(spark, f"{model.path}/asked")
    if last:
        model.forget()
    bits = F.when(F.col("asks") == 1, F.slice("bits", 1, 1)).otherwise(F.col("bits"))
    told = asked.join(answers, "g").select("shard", "at", "asks", bits.alias("bits")).mapInArrow(_gather, "shard bigint, at array<int>, bits array<float>")
    looked = told.groupBy("shard").agg(F.collect_list(F.struct("at", "bits")).alias("looked"))
    schema = T.StructType([rows.schema["row"], *[rows.schema["text"]] * texts, *T.StructType.fromDDL("n_chars bigint, bits double").fields])
    met = held.select("shard", "blob", "grams", "asks").join(looked, "shard", "left")
    return met.select("blob", "grams", "asks", "looked").mapInArrow(partial(_score, texts), schema)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
    quantile: float = 0.985, keep: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, else all) with ``n_chars``, ``perplexity`` (per character), ``threshold`` (of
    the language) and ``accepted``.

    Trusted text: documents that ``labels`` mark 1, in ten folds (by crc32 of the id). Each is scored by a model of the
    other nine folds, all other documents by a model of all ten. The ``quantile`` of the bits per character of a language's
    trusted documents, however few, is the language's threshold. A document above it is rejected. Counts cover all
    trusted text, quantiles all trusted documents: bits are counted by thousandths, so groups of any size are summed, not
    sorted.

    Empty or null text: perplexity 1, accepted. Null language: a language of its own. A language without any trusted
    document takes the threshold of all; where there are none at all, every document is accepted.
    Null ids are never trusted. Repeated labels of an id: trusted if any is 1. Columns of the input named like the added
    ones are replaced. An empty table gives an empty one.
    """
    added = ("n_chars", "perplexity", "threshold", "accepted")
    names = [c for c in (keep or docs.columns) if c not in added]
    trusted = settle(labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("trusted")).filter("trusted is not null").distinct(), "trusted")
    trusted = trusted.withColumn("fold", (F.crc32(F.col("trusted").cast("string").cast("binary")) % FOLDS + 1).cast("int"))
    few = trusted.count() <= MAX_BROADCAST_IDS
    own = [c for c in names if c != text_col]  # the text is carried once
    row = F.struct(F.struct(*[docs[c] for c in own] or [F.lit(True).alias("_")]).alias("kept"), docs[lang_col].alias("lang"))
    rows = docs.select(row.alias("row"), docs[text_col].alias("text"), docs[id_col].alias("id"))
    rows = rows.join(F.broadcast(trusted) if few else trusted, F.col("id") == F.col("trusted"), "left")
    model = KneserNey(rows.filter("fold is not null").select("text", "fold"))
    number = F.coalesce("fold", F.lit(0))
    scored = score(rows, model, F.struct("row.kept", "row.lang", number.alias("fold")), F.col("text"), number, texts=text_col in names, last=True)
    rate = F.when(F.col("n_chars") > 0, F.col("bits") / F.col("n_chars")).otherwise(0.0)
    scored = settle(scored.withColumn("rate", rate).withColumn("bin", F.ceil(F.col("rate") * 1000)), "scored", "zstd")
    model.release()

    bins = settle(scored.filter("bin > 0 and row.fold > 0").groupBy(F.col("row.lang").alias("lang"), "bin").agg(F.count(F.lit(1)).alias("n")), "bins")

    def cut(by: Sequence[str]) -> DataFrame:
        whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        marked = bins.withColumn("all", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(upto))
        return marked.filter(F.col("upto") >= F.col("all") * quantile).groupBy(*by).agg(F.min("bin").alias("cut"))

    everywhere = cut([]).first()
    shared = F.lit(everywhere["cut"] if everywhere else None).cast("long")
    by_lang = cut(["lang"]).select(F.col("lang").alias("_of"), "cut")
    done = scored.join(by_lang, F.col("row.lang").eqNullSafe(F.col("_of")), "left").withColumn("cut", F.coalesce("cut", shared))
    return done.select(
        *[(F.col("text") if c == text_col else F.col("row.kept").getField(c)).alias(c) for c in names], "n_chars", F.pow(F.lit(2.0), F.col("rate")).alias("perplexity"),
        F.pow(F.lit(2.0), F.col("cut") / 1000).alias("threshold"), F.coalesce(F.col("bin") <= F.col("cut"), F.lit(True)).alias("accepted"),
    )


def accept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, with their own columns."""
    text_col = options.get("text_col", "text")
    others = F.struct(*[docs[c] for c in docs.columns if c != text_col], F.lit(True).alias("_")).alias("_others")
    judged = classify(docs.select("*", others), labels, keep=["_others", text_col], **options)
    return judged.filter("accepted").select(*[F.col("_others").getField(c).alias(c) if c != text_col else F.col(c) for c in docs.columns])
