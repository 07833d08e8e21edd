"""Corpus BLEU: clipped n-gram counts per document, merged into one score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.functions.text import strip

MAX_ORDER = 4

# Entities and rules of the 13a tokenisation, applied in this order.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]


def tokens(text: Column, tokenize: str = "13a") -> Column:
    """Tokens of a text: ``13a`` rules, or plain whitespace for ``none``."""
    t = F.coalesce(text, F.lit(""))
    if tokenize == "13a":
        for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES]:
            t = F.replace(t, F.lit(old), F.lit(new))
        t = F.concat(F.lit(" "), t, F.lit(" "))
        for pattern, put in RULES:
            t = F.regexp_replace(t, pattern, put)
    elif tokenize != "none":
        raise ValueError(f"unknown tokenisation {tokenize!r}")
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


# What the rules leave besides blanks at a punctuation mark; the first rule also pads blanks, which says nothing once words are split.
_MARKS = re.compile(r"[!-&(-+:-@/\[-`{-~]")
_POINTS = [(re.compile(pattern), put.replace("$", "\\")) for pattern, put in RULES[1:]]
# ``str.split`` also takes these for white space, ``tokens`` doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _words(tokenize: str) -> Callable[[str], list[str]]:
    """``tokens`` of one text, for a worker that goes on with the words: a text is shipped instead of a list."""
    if tokenize not in ("13a", "none"):
        raise ValueError(f"unknown tokenisation {tokenize!r}")

    def words(text: str) -> list[str]:
        if tokenize == "13a":
            for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES]:
                text = text.replace(old, new)
            text = _MARKS.sub(r" \g<0> ", f" {text} ")
            for pattern, put in _POINTS:
                text = pattern.sub(put, text)
        return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()

    return words


def _pair_counts(pred: list[str], gold: list[str]) -> list[int]:
    """Clipped matches and totals of orders 1..4, and both lengths. N-grams are numbered, so counts are exact."""
    ids: dict[str, int] = {}
    p, g = (np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in (pred, gold))
    code, split = np.concatenate([p, g]), len(p)
    correct, totals = [], []
    at_p, at_g = code[:split], code[split:]
    for n in range(1, MAX_ORDER + 1):
        if n > 1:  # the gram one shorter, renumbered, and the word behind it
            at_p, at_g = at_p[: max(0, len(p) - n + 1)], at_g[: max(0, len(g) - n + 1)]
            grams, number = np.unique(np.concatenate([at_p, at_g]), return_inverse=True)
            at_p, at_g = number[: len(at_p)] * len(ids) + p[n - 1 :], number[len(at_p) :] * len(ids) + g[n - 1 :]
        (own, n_own), (other, n_other) = (np.unique(x, return_counts=True) for x in (at_p, at_g))
        _, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
        correct.append(int(np.minimum(n_own[i], n_other[j]).sum()))
        totals.append(len(at_p))
    return [*correct, *totals, len(p), len(g)]


_SUMS = [*[f"correct_{n}" for n in range(1, MAX_ORDER + 1)], *[f"total_{n}" for n in range(1, MAX_ORDER + 1)], "pred_len", "gold_len"]


def _blank(pred: str) -> Column:
    return strip(F.coalesce(F.col(pred), F.lit(""))) == ""


def empty_counts(pairs: DataFrame, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``n_empty, n_pairs`` per group, as ``bleu_counts`` gives them, without counting words."""
    return pairs.groupBy(*by).agg(F.sum(_blank(pred).cast("long")).alias("n_empty"), F.count(F.lit(1)).alias("n_pairs"))


def bleu_counts(pairs: DataFrame, key: str, pred: str, gold: str, by: Sequence[str] = (), tokenize: str = "13a") -> DataFrame:
    """Sums that BLEU needs, per group: ``correct_n, total_n, pred_len, gold_len, n_empty, n_pairs``.

    A row is a pair, counted where it lies whatever its ``key``; only sums per group are shuffled.
    """
    words, text = _words(tokenize), lambda c: F.make_valid_utf8(F.coalesce(F.col(c), F.lit("")))
    rows = pairs.select(
        F.struct(F.lit(0).alias("_"), *by).alias("by"), text(pred).alias("p"), text(gold).alias("g"), _blank(pred).cast("long").alias("n_empty")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sums = [_pair_counts(words(p), words(g)) for p, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(3), *[pa.array([x[i] for x in sums], pa.int64()) for i in range(len(_SUMS))]], names=["by", "n_empty", *_SUMS]
                )

    long = [T.StructField(c, T.LongType()) for c in ("n_empty", *_SUMS)]
    counted = rows.mapInArrow(count, T.StructType([rows.schema["by"], *long]))
    flat = counted.select(*[F.col("by").getField(c).alias(c) for c in by], "n_empty", *_SUMS)
    return flat.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS], F.sum("n_empty").alias("n_empty"), F.count(F.lit(1)).alias("n_pairs"))


def corpus_bleu(
    pairs: DataFrame, key: str, pred: str, gold: str, by: Sequence[str] = (), tokenize: str = "13a"
) -> DataFrame:
    """BLEU 0..100 with exponential smoothing and the brevity penalty on corpus lengths."""
    counts = bleu_counts(pairs, key, pred, gold, by, tokenize)
    orders = range(1, MAX_ORDER + 1)
    # The k-th order without a match counts as 1 / (2^k * total).
    zeros_upto = {
        n: sum((F.when(F.col(f"correct_{m}") == 0, 1).otherwise(0) for m in range(1, n + 1)), F.lit(0)) for n in orders
    }
    for n in orders:
        total, correct = F.col(f"total_{n}"), F.col(f"correct_{n}")
        p = (
            F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0))
            .when(correct == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros_upto[n]) * total))
            .otherwise(F.lit(100.0) * correct / total)
        )
        counts = counts.withColumn(f"p{n}", p)
    bp = F.when(F.col("pred_len") >= F.col("gold_len"), F.lit(1.0)).when(
        F.col("pred_len") > 0, F.exp(F.lit(1.0) - F.col("gold_len") / F.col("pred_len"))
    ).otherwise(F.lit(0.0))
    any_match = F.greatest(*[F.coalesce(F.col(f"correct_{n}"), F.lit(0)) for n in orders]) > 0
    all_orders = F.least(*[F.col(f"p{n}") for n in orders]) > 0
    mean_log = sum((F.log(F.col(f"p{n}")) for n in orders), F.lit(0.0)) / MAX_ORDER
    score = F.when(any_match & all_orders, bp * F.exp(mean_log)).otherwise(F.lit(0.0))
    return counts.select(*by, score.alias("bleu"), bp.alias("bp"), *[f"p{n}" for n in orders], "n_empty", "n_pairs")
