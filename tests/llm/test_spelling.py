"""Near words and forms, against plain Python over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries, spelling
from tests.llm.fixtures import ascii_lower, documents, empty

FOLDER = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    """Pairs are met through the patterns they share, then checked."""
    by = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by[w[:k] + "*" + w[k + 1 :]].add(w)
            by[w[:k] + w[k + 1 :]].add(w)
        by[w].add(w)
    links = defaultdict(set)
    for held in by.values():
        for a in held:
            links[a].update(b for b in held if near(a, b))
    forms = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(links[w]), words[forms[w]] if forms[w] else None)
    return out


def counted(rows, drop_every=None, min_letters=6, min_count=5) -> dict[str, int]:
    held = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_letters:
                held[run] += 1
    return {w: n for w, n in held.items() if n >= min_count}


def random_words(rng, n=700, letters="abcé", low=5, high=11) -> dict[str, int]:
    """Few letters, so that many words share their counts; edits of earlier ones; ties of the counts."""
    words: dict[str, int] = {}
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        if words and rng.random() < 0.6:
            w = rng.choice(list(words))
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
        if w:
            words[w] = rng.choice([5, 5, 26, 130, 700, 4000])
    return words


def as_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("cell", [20, 100_000])
def test_forms(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    words = random_words(random.Random(cell))
    words |= {"x" * k: 5 + k for k in (300, 301, 302)} | {"日本語の単語": 9, "日本語の単誤": 60, "😀" * 6: 5, "😀" * 7: 25, "a": 5, "b": 125, "": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").withColumn("root", F.lit("clash"))
    assert as_rows(spelling.group_variants(df)) == grouped(words)


def test_many_cells(monkeypatch):
    """The coarse trees part the space: each vector has one cell, and a question reaches the cells of all near words."""
    monkeypatch.setattr(spelling, "CELL", 20)
    words = list(random_words(random.Random(2), 900, low=7, high=8))
    trees = spelling.coarse_trees(words, 1.0)
    for length in (7, 8):
        own = [w for w in words if len(w) == length]
        cells = [leaf.cell for leaf, _ in spelling.reached(trees[length], np.zeros((1, spelling.DIMS), np.float32), 999, 999)]
        assert len(set(cells)) == len(cells) > 3
        home = Counter(int(r) for leaf, rows in spelling.reached(trees[length], spelling.letter_counts(own), 0, 0) for r in rows)
        assert set(home.values()) == {1} and len(home) == len(own)


def test_boxes_prune(monkeypatch):
    """Leaves that no edit can reach are not compared."""
    monkeypatch.setattr(spelling, "LEAF", 8)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(3000)})
    cell = spelling.Cell(words, np.arange(len(words)))
    leaves = {id(leaf): len(leaf.points) for leaf, _ in spelling.reached(cell.tree, cell.counts, 99, 99)}
    met = sum(len(rows) * len(leaf.points) for leaf, rows in spelling.reached(cell.tree, cell.counts, 1, 1))
    assert sum(leaves.values()) == len(words) and met < 0.2 * len(words) ** 2
    i, j = cell.near(words, 0)
    assert {(words[a], words[b]) for a, b in zip(i, j)} == {(a, b) for a in words[:300] for b in words if near(a, b)} | {
        (words[a], words[b]) for a, b in zip(i, j) if a >= 300 and near(words[a], words[b])}


def test_long_chain(spark):
    """Roots beyond many forms."""
    words = {"a" * (6 + k): 5 ** (k + 1) for k in range(14)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert as_rows(spelling.group_variants(df)) == grouped(words)


def test_counts(spark):
    """Nulls, empty and long texts, repeated rows, null ids, clashing names."""
    docs = documents(spark, ["Straße ÉCOLE École école straße" * 3, None, "", "x" * 90_000, "letter " * 40 + "LETTER× ÷letter", "a b", "nałeszo nałeszo"] * 6)
    docs = docs.withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for drop in (None, 3):
        got = {r.word: r.n for r in spelling.count_words(docs, drop_every=drop).collect()}
        assert got == counted(rows, drop) and got
    assert spelling.group_variants(spelling.count_words(empty(spark))).collect() == []
    nulls = spark.createDataFrame([(None, 7), ("abcdef", None), ("abcdeg", 9)], "word string, n bigint")
    assert as_rows(spelling.group_variants(nulls)) == grouped({"abcdeg": 9})


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = as_rows(queries.QUERIES["op13_spelling"](spark, FOLDER))
    assert got == grouped(counted(rows, 199)) and len(got) > 100 and any(r[0] for r in got.values())
