"""Language identification by hyperdimensional profiles: letters, grams, texts and languages are long random vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.llm.common import pieces
from gridloom.session import settle

#: Letters in a gram, and components of a vector.
GRAM, WIDTH = 3, 1024
#: Languages at most: their prototypes, WIDTH numbers each, go to every task.
MAX_LANGUAGES = 2000
#: Gram vectors a task remembers at most, of WIDTH bytes each.
MOST_GRAMS = 40_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter; 32 for all that is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


@lru_cache(4096)
def letter_vector(letter: int) -> np.ndarray:
    """A fixed random vector of ones and minus ones for a letter (32: the gap between words)."""
    return np.random.Generator(np.random.Philox(key=letter)).integers(0, 2, WIDTH, dtype=np.int8) * np.int8(2) - np.int8(1)


def gram_vector(gram: int) -> np.ndarray:
    """The product of the letters' vectors, each permuted (rotated) by its distance from the end."""
    out = np.ones(WIDTH, np.int8)
    for j in range(GRAM):
        out *= np.roll(letter_vector(gram >> 21 * j & 0x1FFFFF), j)
    return out


def text_grams(text: str) -> np.ndarray:
    """The packed grams of a text: lower-case letters, one gap for whatever stands between, one at either end."""
    points = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = points == 32
    points = points[~(gap & np.append(False, gap[:-1]))].astype(np.int64)
    if len(points) < GRAM:
        return np.empty(0, np.int64)
    out = np.zeros(len(points) - GRAM + 1, np.int64)
    for j in range(GRAM):
        out <<= 21
        out |= points[j : j + len(out)]
    return out


class _Vectors:
    """Gram vectors made so far, in the order of their grams."""

    def __init__(self):
        self.grams, self.rows = np.empty(0, np.int64), np.empty((0, WIDTH), np.int8)

    def at(self, grams: np.ndarray) -> np.ndarray:
        """Row numbers of sorted distinct grams."""
        at = np.searchsorted(self.grams, grams)
        new = grams[(at == len(self.grams)) | (np.append(self.grams, -1)[at] != grams)]
        if len(new):
            if len(self.grams) + len(new) > MOST_GRAMS:
                self.__init__()
                new = grams
            self.grams, self.rows = np.append(self.grams, new), np.concatenate([self.rows, np.stack([gram_vector(int(g)) for g in new])])
            order = np.argsort(self.grams)
            self.grams, self.rows = self.grams[order], self.rows[order]
            at = np.searchsorted(self.grams, grams)
        return at

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the grams' vectors, each as often as it is met."""
        out = np.zeros(WIDTH)
        for a in range(0, len(grams), MOST_GRAMS // 2):
            at = self.at(grams[a : a + MOST_GRAMS // 2])
            out += counts[a : a + MOST_GRAMS // 2].astype(np.float32) @ self.rows[at].astype(np.float32)
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of unit length, less what all languages share. Each task bundles its texts by language; bundles are
    summed component by component. Rows without text or language are left out."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = _Vectors(), {}
        for batch in batches:
            for part in pieces(batch, 500):
                texts: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    texts.setdefault(lang, []).append(text_grams(text))
                for lang, of in texts.items():
                    sums[lang] = sums.get(lang, 0.0) + vectors.bundle(*np.unique(np.concatenate(of), return_counts=True))
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * WIDTH), pa.array(np.arange(WIDTH, dtype=np.int32)), pa.array(v)], names=["lang", "i", "x"])

    summed = settle(rows.mapInArrow(bundles, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")), "prototypes")
    langs = [r[0] for r in summed.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = {lang: np.zeros(WIDTH) for lang in langs}
    for lang, i, x in summed.collect():  # WIDTH numbers for each language
        found[lang][i] = x
    unit = {k: v / (np.linalg.norm(v) or 1.0) for k, v in found.items()}
    shared = sum(unit.values(), np.zeros(WIDTH)) / max(1, len(unit))
    return {k: (v - shared) / (np.linalg.norm(v - shared) or 1.0) for k, v in unit.items()} if len(unit) > 1 else unit


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: Column | str = "text", row: Column | None = None) -> DataFrame:
    """The columns of ``docs`` (or of the struct ``row``) with ``lang_pred`` and ``score``.

    A text's vector bundles its grams; its cosine with each language's prototype decides. ``score`` is the share of the
    best language in a soft maximum over the cosines. Documents aren't shuffled; the prototypes go to each task.

    Null text or text without a letter, and all texts where no language was learned: ``und`` with score 0. Ties: the first
    language by code point. Columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    names = list(prototypes)
    table = spark.sparkContext.broadcast(np.stack([prototypes[k] for k in names]).astype(np.float32) if names else None)
    rows = docs.select((F.struct("*") if row is None else row).alias("_row"), (F.col(text) if isinstance(text, str) else text).alias("_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors()
        for batch in batches:
            for part in pieces(batch, 500):
                langs, scores = [], []
                for t in part.column(1).to_pylist():
                    grams = text_grams(t) if t is not None and table.value is not None else np.empty(0, np.int64)
                    if not len(grams):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    v = vectors.bundle(*np.unique(grams, return_counts=True))
                    cosines = table.value @ (v / (np.linalg.norm(v) or 1.0))
                    best = int(np.argmax(cosines))
                    langs.append(names[best])
                    scores.append(float(round(1 / np.exp(SHARPNESS * (cosines - cosines[best])).sum(), 6)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["_row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["_row"], *T.StructType.fromDDL("lang_pred string, score double").fields])
    fields = [f.name for f in rows.schema["_row"].dataType.fields if f.name not in ("lang_pred", "score")]
    return rows.mapInArrow(predict, schema).select(*[F.col("_row").getField(c).alias(c) for c in fields], "lang_pred", "score")


#: Of the soft maximum over cosines.
SHARPNESS = 12.0
