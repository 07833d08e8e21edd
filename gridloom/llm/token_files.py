"""Token files: Parquet with a list of ids per document, in id order, for selective reads of tokens or metadata."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer

from gridloom.llm.common import TO_LOWER, utf8
from gridloom.session import small_batches

#: White space at which a text may be cut without changing its ids, for tokenizers that drop white space.
SPACES = bytes.maketrans(b"\t\n\r", b"   ")
#: The same, with A-Z in lower case, for tokenizers that lower it anyway.
LOWERED = bytes(SPACES).translate(TO_LOWER)
#: Signs that stand behind a word as tokens of their own, however many.
SIGNS = b".,;:?!#$%&*"
#: Bytes of text worked off at once, one text at least; new words that the library encodes at once.
RUN_BYTES, TOGETHER = 3 << 20, 1000


def plain(piece: bytes) -> bool:
    """Latin letters that stay letters, and nothing else, when composed and lowered; U+0130 does not."""
    text = piece.decode()
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


class Encoder:
    """Texts to their ids. Pieces between blanks are remembered: the ``most`` met last, and as many before.

    A worker process keeps one encoder for a tokenizer file, so its tasks share what it has met."""

    held: dict[str, Encoder] = {}

    def __init__(self, path: str, most: int = 200_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.lowers = self.encode(["AbC É"]) == self.encode(["abc É"]) and self.encode(["XYZ"]) == self.encode(["xyz"]) and all("<|" in t for t in added.values())
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # of ids: ends a word
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.mark = None  # a token to put between pieces, and its id
        probes = [w.encode() for w in ("a", "qzxvoe", "straße", "élèveó", "ñandúşık", "ÀÉ")]
        alone = self.encode([w.decode() for w in probes])
        self.by_words = self.words(probes) == alone
        signs = [chr(x) for x in SIGNS] + ["***", "?!", "..."]
        self.parts = self.encode([f"straße{x}" for x in signs]) == [alone[2] + x for x in self.encode(signs)]
        for self.mark in [*((t, i) for i, t in added.items() if "<|" in t), None]:
            if self.mark is None or self.marked([*probes, b"1,2", b"x)"]) == [*alone, *self.encode(["1,2", "x)"])]:
                break

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> list[bytes] | None:
        """Words of letters alone, encoded as one text and parted where an id ends a word; None if that isn't once in each."""
        ids = np.frombuffer(self.encode([b" ".join(words).decode()])[0], np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None
        return [ids[a:z].tobytes() for a, z in zip([0, *ends.tolist()], ends.tolist())]

    def marked(self, found: list[bytes]) -> list[bytes] | None:
        """Any pieces, encoded as one text with ``mark`` after each; None if its id isn't there once for each."""
        text, number = self.mark
        ids = np.frombuffer(self.encode([text.encode().join([*found, b""]).decode()])[0], np.uint32)
        ends = np.flatnonzero(ids == number)
        if len(ends) != len(found) or ends[-1] != len(ids) - 1:
            return None
        return [ids[a:z].tobytes() for a, z in zip([0, *(ends + 1).tolist()], ends.tolist())]

    def encode_new(self, found: list[bytes]) -> dict[bytes, bytes]:
        """``encode`` of pieces, many in one call where that gives the same: a call and a result for each takes longer than its merges."""
        letters, others, alone = [], [], []
        for piece in found:
            if self.by_words and plain(piece):
                letters.append(piece)
            else:
                (alone if self.mark is None or b"<|" in piece else others).append(piece)
        made: dict[bytes, bytes] = {}
        for some, how in ((letters, self.words), (others, self.marked)):
            for at in range(0, len(some), TOGETHER):
                part = some[at : at + TOGETHER]
                ids = how(part)
                if ids is None:
                    alone += part
                else:
                    made.update(zip(part, ids))
        made.update(zip(alone, self.encode([x.decode() for x in alone])))
        return made

    def split(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """Pieces between blanks of all texts, each with a blank behind it, and for each text the number of pieces up to its end.

        Those of ASCII alone are in lower case if the tokenizer lowers them: of others, letters may compose with a following
        mark, which it does before it lowers. Nor are those that may hold a special token."""
        text = np.frombuffer((b" ".join(texts) + b" ").translate(SPACES), np.uint8)
        blank = text == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        upto = np.searchsorted(np.flatnonzero(blank & keep), np.cumsum([len(t) + 1 for t in texts]))
        text = text[keep]
        ends = np.flatnonzero(text == 32)
        offsets = np.append(0, ends + 1).astype(np.int32)
        if self.lowers:
            odd = text >= 128
            odd[:-1] |= (text[:-1] == ord("<")) & (text[1:] == ord("|"))
            as_is = np.zeros(len(ends), bool)
            as_is[np.searchsorted(ends, np.flatnonzero(odd))] = True
            lowered = np.frombuffer(text.tobytes().translate(LOWERED), np.uint8)
            text = np.where(np.repeat(as_is, np.diff(offsets)), text, lowered)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text)]), upto

    def remembered(self, found: list[bytes]) -> list[bytes]:
        """Ids of different pieces."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, found))
        new, todo = [], {}
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = found[i]
            if w in old:
                young[w] = out[i] = old[w]
                continue
            new.append(i)
            stem = w.rstrip(SIGNS)
            if self.parts and len(stem) < len(w) and plain(stem):
                todo[stem] = todo[w[len(stem) :]] = True
            else:
                todo[w] = True
        young.update(self.encode_new([w for w in todo if w not in young]))
        for i in new:
            w = found[i]
            if w not in young:
                stem = w.rstrip(SIGNS)
                young[w] = young[stem] + young[w[len(stem) :]]
            out[i] = young[w]
        for i in new:
            if len(found[i]) > self.longest:
                del young[found[i]]
        return out

    def encode_run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each ends; of tokenizers that drop white space."""
        words, upto = self.split(texts)
        if not len(words):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        words = words.dictionary_encode()
        text = words.dictionary.buffers()[2].to_pybytes()
        found = text[: int(np.frombuffer(words.dictionary.buffers()[1], np.int32)[len(words.dictionary)])].split(b" ")[:-1]
        placed = pa.array(self.remembered(found), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(placed.buffers()[1], np.int64)[: len(placed) + 1][upto] // 4
        return np.frombuffer(placed.buffers()[2], np.int32)[: ends[-1]], ends

    def encode_pieces(self, texts: list[bytes]) -> list[bytes]:
        """As ``encode``, of tokenizers that drop white space."""
        ids, ends = self.encode_run(texts)
        return [ids[a:z].tobytes() for a, z in zip(np.append(0, ends), ends)]


def _runs(batch: pa.RecordBatch, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of ``most`` bytes of text (its second column) or fewer, or of one row."""
    ends = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
    drops_space: bool = False, files: int | None = None, row_group_bytes: int = 32 << 20, page_rows: int = 2000,
) -> None:
    """Encode every text with the tokenizer file and write the ids, ``end_id`` last, in ascending order of ``id_col``.

    Columns: the id, ``keep``, ``n_tokens``, ``tokens`` (list of int), and where the document stands: ``part`` (file
    number) and ``at`` (ids before it in the file). Rows are range-partitioned and sorted, so files follow each other;
    ids are dictionary-encoded where that is shorter and delta-encoded where not (version 2 pages), row groups and
    pages are of the given sizes, and page indexes let a reader skip to a span of ids or read metadata alone.
    Only texts are shuffled, once; a lost task is encoded again and nothing else.

    ``drops_space``: the tokenizer drops white space; pieces between blanks are then encoded once and remembered; those of a run of texts are
    numbered first, so each different one is looked up once a run, and new ones are given to the library many at once.

    Null text: as empty, ``end_id`` alone. Null ids come first. Rows that repeat an id follow each other in the order of
    a hash of their text. Only the named columns are written, so others may have any name.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), *[F.col(c) for c in keep]).alias("row"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange(files, "row.id", "tie").sortWithinPartitions("row.id", "tie").select("row", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what other operators' tasks left in this worker
        encoder, at, part_id = Encoder.of(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in _runs(batch):
                if drops_space:
                    ids, ends = encoder.encode_run(utf8(part.column(1)))
                else:
                    made = encoder.encode(part.column(1).to_pylist())
                    ids, ends = np.frombuffer(b"".join(made), np.int32), np.cumsum([len(x) // 4 for x in made])
                ids = np.insert(ids, ends, end_id)
                ends = np.append(0, ends + np.arange(1, len(ends) + 1))
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends)), tokens, pa.array(np.full(len(tokens), part_id, np.int32)), pa.array(at + ends[:-1])],
                    names=["row", "n_tokens", "tokens", "part", "at"],
                )
                at += int(ends[-1])

    schema = T.StructType([ordered.schema["row"], *T.StructType.fromDDL("n_tokens bigint, tokens array<int>, part int, at bigint").fields])
    names = [id_col, *keep]
    out = ordered.mapInArrow(encode, schema).select(
        *[F.col("row").getField("id" if i == 0 else c).alias(c) for i, c in enumerate(names)], "n_tokens", "tokens", "part", "at"
    )
    options = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true", "compression": "zstd",
    }
    with small_batches(spark):
        out.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of ``write_tokens`` with ``start``: ids of all documents before it.

    Ids in a file are summed from ``n_tokens`` alone; the sums, a row for each file, are broadcast. Filters on the id and
    selections of columns reach the files' page indexes.
    """
    held = spark.read.parquet(path)
    sizes = held.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each file
    starts, before = [], 0
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, before bigint"))
    return held.join(offsets, "part").withColumn("start", F.col("before") + F.col("at")).drop("part", "at", "before")


def with_crc(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, ``start``, ``n_tokens`` and ``ids_crc32``: unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.struct(F.col(id_col), "start", "n_tokens").alias("row"), "tokens")

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values, at = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["row", "ids_crc32"])

    schema = T.StructType([rows.schema["row"], T.StructField("ids_crc32", T.LongType())])
    return rows.mapInArrow(crc, schema).select("row.*", "ids_crc32")
