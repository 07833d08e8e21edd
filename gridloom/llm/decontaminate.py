"""Benchmark decontamination: test passages found in training texts by a broadcast set of window hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.llm.common import TO_LOWER, WordHashes, pieces, utf8, window_hashes
from gridloom.session import settle

#: Bytes that end a word: ASCII other than digits and letters. A-Z become a-z.
CUT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(TO_LOWER)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Windows in one broadcast, at most: about 100 bytes each. Larger benchmarks are scanned for in several blocks.
MAX_WINDOWS = 500_000


def _benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct windows with the items that hold them: ``window`` (words, blank between), ``words``, ``items``."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 100):
                out: list[tuple] = []
                for item, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                    words = text.translate(CUT).split()
                    size = min(n, len(words))
                    if size:
                        out += {(b" ".join(words[i : i + size]), size, item) for i in range(len(words) - size + 1)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())],
                    names=["window", "words", "item"],
                )

    known = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    found = known.mapInArrow(windows, "window binary, words int, item string")
    return found.groupBy("window", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Windows:
    """A broadcast block: window hashes by length for the search, the words themselves for the check."""

    def __init__(self, rows: list):
        self.items = {bytes(r.window): r.items for r in rows}
        by: dict[int, list[bytes]] = {}
        for r in rows:
            by.setdefault(r.words, []).append(bytes(r.window))
        hashes = WordHashes(1)
        self.by = {k: np.unique(np.concatenate([window_hashes(hashes.of(w.split(b" ")), k) for w in v])) for k, v in by.items()}

    def hits(self, words: list[bytes], h: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of every verified occurrence."""
        for size, known in self.by.items():
            found = window_hashes(h, size)
            if len(found):
                at = np.searchsorted(known, found)
                at[at == len(known)] = 0
                for i in np.flatnonzero(known[at] == found).tolist():
                    if (items := self.items.get(b" ".join(words[i : i + size]))) is not None:
                        yield i, size, items


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words [first, end) that the windows cover."""
    spans: list[tuple[int, int]] = []
    for i, size in sorted(hits):
        if spans and i <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], i + size))
        else:
            spans.append((i, i + size))
    return spans


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its hit words; what stands between two words of a span goes too."""
    words, out, at, k = WORD.finditer(text), [], 0, -1
    m = None
    for first, end in spans:
        while k < first:
            m, k = next(words), k + 1
        out.append(text[at : m.start()])
        while k < end - 1:
            m, k = next(words), k + 1
        at = m.end()
    return b"".join([*out, text[at:]])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = 13, max_windows: int = MAX_WINDOWS, keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, else all) with ``n_words``, ``n_hit``, ``items`` (sorted), ``spans`` of words
    [first, end) and ``clean_text``: the text without hit words, null where no word is hit.

    Words are runs of ASCII digits and letters and of all other code points beyond ASCII, A-Z in lower case. A window is
    ``n`` consecutive words of an item, or all words of a shorter one. Every word inside any occurrence of a window is
    hit.

    Documents are not shuffled: each task scans its rows against a broadcast block of at most ``max_windows`` windows, and
    checks every hash hit by its words. A benchmark of more windows is cut into blocks by hash: one scan each, with the
    hits so far settled in the shared folder between two scans.

    Null text: no words. Null items or item ids are left out. Items with equal text are all reported. Rows that repeat
    are judged alike. Columns of the input named like the added ones are replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    windows = settle(_benchmark_windows(benchmark, item_col, item_text_col, n), "windows")
    blocks = max(1, -(-windows.count() // max_windows))
    names = [c for c in (keep or docs.columns) if c not in ADDED]
    current = docs.select(F.col(text_col).alias("_text"), F.lit(None).cast(T.DataType.fromDDL(HITS)).alias("_hits"), F.struct(*[docs[c] for c in names]).alias("_row"))
    row = current.schema["_row"]
    for k in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect()  # max_windows rows or so
        held = spark.sparkContext.broadcast(_Windows(rows))
        if k < blocks - 1:
            current = settle(current.mapInArrow(_scanner(held, False), current.schema), "hits")
    got = T.StructField("_got", T.DataType.fromDDL(f"struct<{','.join(f'{k}:{v}' for k, v in ADDED.items())}>"))
    found = current.mapInArrow(_scanner(held, True), T.StructType([got, row]))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in names], *[F.col("_got").getField(c).alias(c) for c in ADDED])


#: Columns that the search adds, and what it carries from one block of windows to the next.
ADDED = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "spans": "array<struct<first:bigint,end:bigint>>", "clean_text": "string"}
HITS = "array<struct<first:int,words:int,items:array<string>>>"


def _scanner(held, last: bool):
    hit_type = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("items", pa.list_(pa.string()))]))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch):
                texts, before, rows = part.column(0), part.column(1), part.column(2)
                hits, out = [], [[] for _ in kinds]
                for text, known in zip(utf8(texts), before.to_pylist()):
                    words = (text or b"").translate(CUT).split()
                    found = [(x["first"], x["words"], x["items"]) for x in known or ()]
                    found += held.value.hits(words, hashes.of(words))
                    if not last:
                        hits.append([{"first": i, "words": size, "items": items} for i, size, items in found])
                        continue
                    spans = _merged([x[:2] for x in found])
                    values = (
                        len(words), sum(b - a for a, b in spans), sorted({y for x in found for y in x[2]}),
                        [{"first": a, "end": b} for a, b in spans], _without(text, spans).decode() if spans else None,
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                if last:
                    got = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=list(ADDED))
                    yield pa.RecordBatch.from_arrays([got, rows], names=["_got", "_row"])
                else:
                    yield pa.RecordBatch.from_arrays([texts, pa.array(hits, hit_type), rows], names=["_text", "_hits", "_row"])

    return scan


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20):
    """True where hit words are one in ``share`` or more."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", share: int = 20, **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) all documents without the hit words.

    Same columns as ``docs``. ``options`` go to ``find_contamination``, which defines nulls, empty and repeated rows.
    """
    text_col = options.get("text_col", "text")
    found = find_contamination(docs.select("*", F.struct("*").alias("_all")), benchmark, **options)
    same = [F.col("_all").getField(c).alias(c) for c in docs.columns]
    if remove == "documents":
        return found.filter(~contaminated(share=share)).select(*same)
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    clean = F.coalesce("clean_text", F.col("_all").getField(text_col)).alias(text_col)
    return found.select(*[clean if c == text_col else kept for c, kept in zip(docs.columns, same)])
