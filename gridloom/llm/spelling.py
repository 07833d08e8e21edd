"""Spelling variants: words one edit apart, found by k-d trees over letter counts, and the form each word goes back to.

One inserted or deleted letter changes one count by one, one replaced letter two counts by one each, so near words lie
within an L1 distance of two, with at most one letter too many and one too few. A coarse tree, fitted on a bounded sample,
cuts the space of each word length into cells; every word is a point of one cell and a question to each cell whose box it
may reach in its own length, the next and the one before. Inside a cell a second tree with tight boxes leads to leaves; what
is left there is verified letter by letter. Only counts and the best neighbour leave a task, never pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.llm.common import TO_LOWER, utf8
from gridloom.session import cut_lineage, settle

#: Letter counts: a to z by themselves, all other letters folded into the rest (distances only shrink). Counts stop at MOST.
DIMS, MOST = 48, 127
#: Words on which the coarse trees are fitted, at most; words a cell should hold; and a leaf inside a cell.
SAMPLE, CELL, LEAF = 100_000, 20_000, 128
#: Words beyond this length have one cell a length.
LONG = 64
#: Letters that one step of the verification compares, about.
BLOCK = 1 << 22
#: Words a task counts before it hands them on.
HELD = 300_000


def count_words(
    docs: DataFrame, min_letters: int = 6, min_count: int = 5, letters: str = "A-Za-zÀ-ÿ", drop_every: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``word``, ``n``: maximal runs of ``letters`` of at least ``min_letters``, A-Z in lower case, met ``min_count`` times.

    ``drop_every``: a run whose crc32 of ``<id>:<run>`` it divides first loses the letter at that crc32 modulo its length
    (planted slips); a null id is empty there. Null and empty texts have no words; every row counts, repeated ones too;
    other columns are not read.
    """
    run = re.compile(f"[{letters}]{{{min_letters},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if not text:
                    continue
                words = run.findall(text.translate(TO_LOWER).decode())
                if drop_every:
                    seed = zlib.crc32(b"%s:" % (doc or "").encode())
                    met = Counter(words)
                    for word in [w for w in met if zlib.crc32(w.encode(), seed) % drop_every == 0]:
                        at = zlib.crc32(word.encode(), seed) % len(word)
                        n, cut = met.pop(word), word[:at] + word[at + 1 :]
                        if len(cut) >= min_letters:
                            held[cut] += n
                    held.update(met)
                else:
                    held.update(words)
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of ``DIMS`` counts for each word."""
    points = code_points(words).astype(np.int64)
    slots = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (DIMS - 26))
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(rows * DIMS + slots, minlength=len(words) * DIMS)
    return np.minimum(counts, MOST).reshape(-1, DIMS).astype(np.float32)


@dataclass
class Node:
    """A box of letter counts; either parted in two or a leaf with its points' numbers or its cell's number."""

    low: np.ndarray
    high: np.ndarray
    parts: tuple[Node, Node] | None = None
    points: np.ndarray | None = None
    cell: int = 0


def build(counts: np.ndarray, points: np.ndarray, leaf: int, box: tuple[np.ndarray, np.ndarray] | None = None) -> Node:
    """A k-d tree whose leaves hold ``leaf`` points, or more if they are all alike. Boxes are tight, or parts of ``box``."""
    own = counts[points]
    low, high = own.min(0), own.max(0)
    node = Node(*(box or (low, high)))
    if len(points) <= leaf or (low == high).all():
        node.points = points
        return node
    dim = int(np.argmax(np.where(high > low, own.var(0), -1)))
    cut = min(float(np.floor(np.median(own[:, dim]))), float(high[dim]) - 1)
    left = own[:, dim] <= cut
    boxes = (None, None)
    if box:
        upto, beyond = box[1].copy(), box[0].copy()
        upto[dim], beyond[dim] = cut, cut + 1
        boxes = ((box[0], upto), (beyond, box[1]))
    node.parts = build(counts, points[left], leaf, boxes[0]), build(counts, points[~left], leaf, boxes[1])
    return node


def reached(node: Node, counts: np.ndarray, more: int, fewer: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves, and the rows of ``counts`` that come into the leaf's box with ``more`` letters added and ``fewer`` removed."""
    todo = [(node, np.arange(len(counts)))]
    while todo:
        node, rows = todo.pop()
        own = counts[rows]
        near = (np.maximum(node.low - own, 0).sum(1) <= more) & (np.maximum(own - node.high, 0).sum(1) <= fewer)
        rows = rows[near]
        if not len(rows):
            continue
        if node.parts is None:
            yield node, rows
        else:
            todo.extend((part, rows) for part in node.parts)


def coarse_trees(sample: list[str], rate: float) -> dict[int, Node]:
    """For each length with more words than a cell should hold, the tree of its cells; ``rate``: the share that was sampled."""
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    trees = {}
    for length, words in by_length.items():
        leaf = max(16, int(CELL * rate))
        if length > LONG or len(words) <= leaf:
            continue
        whole = np.zeros(DIMS, np.float32), np.full(DIMS, MOST, np.float32)
        trees[length] = build(letter_counts(words), np.arange(len(words)), leaf, whole)
        leaves, todo = 0, [trees[length]]
        while todo:
            node = todo.pop()
            node.points, node.cell, leaves = None, leaves, leaves + (node.parts is None)
            todo.extend(node.parts or ())
    return trees


def routed(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """``cell``, ``kind``, ``word``, ``n``: each word as a point (null kind) and as a question to cells of words of its length
    (0), of one letter more (1) and of one fewer (-1)."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = np.array(batch.column(0).to_pylist(), object)
            lengths = np.array([len(w) for w in text], np.int64)
            n = batch.column(1).to_numpy()
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                counts = letter_counts(list(text[rows]))
                for kind, more, fewer in ((None, 0, 0), (0, 1, 1), (1, 1, 0), (-1, 0, 1)):
                    there = int(length) + (kind or 0)
                    tree = trees.get(there)
                    hits = [(leaf.cell, found) for leaf, found in reached(tree, counts, more, fewer)] if tree else [(0, np.arange(len(rows)))]
                    for cell, found in hits:
                        own = rows[found]
                        columns = [
                            pa.array(np.full(len(own), (there << 32) + cell)), pa.array([kind] * len(own), pa.int32()), pa.array(text[own], pa.string()), pa.array(n[own]),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["cell", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(route, "cell bigint, kind int, word string, n bigint")


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Of paired rows of code points, which differ by exactly one replaced letter, or by one that ``long`` has more."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    size = short.shape[1]
    if not size:
        return np.ones(len(short), bool)
    front, back = short != long[:, :size], (short != long[:, 1:])[:, ::-1]
    same = lambda x: np.where(x.any(1), x.argmax(1), size)
    return same(front) + same(back) >= size


class Cell:
    """The words of one cell, all of one length, and their tree."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = np.array(words, object), n
        self.counts, self.letters = letter_counts(words), code_points(words).reshape(len(words), -1)
        self.squares = (self.counts**2).sum(1)
        self.rank = np.empty(len(words), np.int64)
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        self.tree = build(self.counts, np.arange(len(words)), LEAF)

    def near(self, words: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words asked for and of near words of the cell, pair by pair."""
        counts, letters = letter_counts(words), code_points(words).reshape(len(words), -1)
        squares = (counts**2).sum(1)
        width = max(1, BLOCK // (letters.shape[1] + 1))
        asked, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for leaf, rows in reached(self.tree, counts, int(kind >= 0), int(kind <= 0)):
            step = max(1, BLOCK // len(leaf.points))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                distance = squares[part, None] + self.squares[leaf.points] - 2 * counts[part] @ self.counts[leaf.points].T
                i, j = np.nonzero(distance <= (1 if kind else 2))
                i, j = part[i], leaf.points[j]
                for k in range(0, len(i), width):
                    a, b = letters[i[k : k + width]], self.letters[j[k : k + width]]
                    same = one_edit(b, a) if kind < 0 else one_edit(a, b)
                    asked.append(i[k : k + width][same])
                    found.append(j[k : k + width][same])
        return np.concatenate(asked), np.concatenate(found)


def answered(cells: DataFrame) -> DataFrame:
    """For each question: ``word``, ``n``, ``n_near`` found in the cell, and the most frequent of them, ``near_n`` and ``near``."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, numbers, cell = None, [], [], None
        for batch in batches:
            places, kinds = batch.column(0).to_numpy(), batch.column(1).fill_null(-9).to_numpy()
            text, n = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1), len(places)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if places[start] != at:
                    at, words, numbers, cell = places[start], [], [], None
                if kinds[start] == -9:
                    words.extend(text[start:end])
                    numbers.append(n[start:end].copy())
                    continue
                own, kind = text[start:end], int(kinds[start])
                if words and cell is None:
                    cell = Cell(words, np.concatenate(numbers))
                i, j = cell.near(own, kind) if words else (np.empty(0, np.int64),) * 2
                order = np.lexsort((cell.rank[j], -cell.n[j], i)) if words else i
                i, j = i[order], j[order]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                n_near = np.bincount(i, minlength=len(own))
                best_n, best = np.zeros(len(own), np.int64), np.full(len(own), None, object)
                if len(first):
                    best_n[i[first]], best[i[first]] = cell.n[j[first]], cell.words[j[first]]
                out = np.flatnonzero(n_near > 0) if kind else np.arange(len(own))
                none = n_near[out] == 0
                columns = [
                    pa.array([own[k] for k in out], pa.string()), pa.array(n[start:end][out]), pa.array(n_near[out]),
                    pa.array(best_n[out], mask=none), pa.array(best[out], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_near", "near_n", "near"])

    return cells.mapInArrow(answer, "word string, n bigint, n_near bigint, near_n bigint, near string")


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``near_n``, ``near``: how many other words are one edit away, and the most frequent of
    them (ties: the smallest by code points). ``words``: distinct ``word`` and ``n``; settled, for it is read three times.

    No word is left out of the trees; the sample shapes the cells only. A task holds one cell's words at a time. Words that
    share all letter counts can't be parted, so many thousand anagrams of one length meet in one leaf.
    """
    total = words.count()
    rate = min(1.0, SAMPLE / max(1, total))
    few = words.filter((F.char_length("word") <= LONG) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(rate * 1_000_000)))
    cells = routed(words, coarse_trees([r.word for r in few.select("word").limit(2 * SAMPLE).collect()], rate))
    met = answered(cells.repartition("cell").sortWithinPartitions("cell", F.col("kind").asc_nulls_first()))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), F.col("near"))))
    grouped = met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
    return grouped.select("word", "n", "n_near", (-F.col("_best.col1")).alias("near_n"), F.col("_best.near").alias("near"))


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of distinct ``word``, ``n``: null words or counts don't count.

    A word's form is its most frequent near word if that is met at least ``ratio`` (2 or more) times as often; else null.
    Its root is reached by following forms; each step multiplies the count, so few rounds of doubling reach every root.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = settle(words.select("word", F.col("n").cast("long").alias("n")).dropna(), "words")
    close = near_words(words)
    good = F.col("near_n") >= ratio * F.col("n")
    forms = settle(close.select("word", "n", "n_near", F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "forms")
    ends = words.agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    steps = math.floor(math.log(max(1, ends.high) / max(1, ends.low), ratio)) + 1 if ends.high else 0
    links = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        links = cut_lineage(links.join(onward, "root", "left").select("word", F.coalesce("_on", "root").alias("root")))
        reach *= 2
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
