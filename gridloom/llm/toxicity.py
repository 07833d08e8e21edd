"""Toxicity by nearest labelled examples: exact cosine of TF-IDF vectors that hold every term of the examples, votes weighted by nearness."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.llm.common import mixed, pieces
from gridloom.session import settle

WORD, BLANK = re.compile(r"[^\W\d_]+"), re.compile(r"\s")
#: Hashes of words: the odd base of their letters' places, and what makes a beginning another term than the word it equals.
BASE, STEM = 0x9FB21C651E98DF25, np.uint64(0xD6E8FEB86659FD93)
#: Texts are hashed together up to so many letters; longer ones in parts.
LETTERS = 100_000
#: Word beginnings that are terms too, so that inflected forms meet.
STEMS = (4, 5, 6)
#: Labelled rows to learn from, at most (those with the smallest hash of the id).
MAX_EXAMPLES = 20_000
#: Neighbours that vote; similarity their votes are weighed against; documents searched at once.
NEIGHBOURS, PRIOR, BLOCK = 15, 0.5, 256
#: Blocks of examples that share terms, at most. A block's terms of more than this share of its examples, and of more than so
#: many, are multiplied as a dense matrix, the others by posting lists; as one product for queries with this share of them.
BLOCKS, COMMON, FEW, MANY = 8, 0.08, 8, 0.07
#: Texts whose terms are told at once; terms whose numbers of documents are a row.
ROWS, CHUNK = 200, 8192
#: Postings are kept in lines of so many.
LINE = 8
#: Single precision finds the candidates; what it may be off by, at most, for unit vectors of non-negative weights.
SLACK = 1e-4
#: Bins of the calibration.
BINS = 10


#: A term met so often in a text is a term of its own, as one hit says less than many.
OFTEN = (2, 4, 8)


def word_terms(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


class _Signs:
    """By code point: whether it is a letter of ``WORD``, and a random number; by place: powers of a base and of its inverse."""

    made: _Signs | None = None

    def __init__(self):
        every = "".join(map(chr, range(0x110000)))
        self.letter = np.zeros(len(every), bool)
        for m in WORD.finditer(every):
            self.letter[m.start() : m.end()] = True
        self.value = mixed(np.arange(1, len(every) + 1, dtype=np.uint64))
        self.up = self.down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, places: int) -> _Signs:
        """The worker's tables, with powers for so many places."""
        cls.made = cls.made or cls()
        if len(cls.made.up) < places:
            powers = lambda b: np.cumprod(np.append(np.uint64(1), np.full(places + places // 2, b, np.uint64)), dtype=np.uint64)
            cls.made.up, cls.made.down = powers(BASE), powers(pow(BASE, -1, 1 << 64))
        return cls.made


def hashed_words(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of a text, then their beginnings by ``STEMS``: length of the beginning (0: whole words), which words, where they
    begin and end in the text, and 64-bit hashes of the terms."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = _Signs.get(len(code) + 1)
    letter = np.zeros(len(code) + 2, np.int8)
    letter[1:-1] = signs.letter[code]
    turns = np.diff(letter)
    begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    upto = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(signs.value[code] * signs.up[: len(code)], out=upto[1:])
    first, back, which = upto[begin], signs.down[begin], np.arange(len(begin))
    yield 0, which, begin, end, mixed((upto[end] - first) * back)
    for n in STEMS:
        which = which[end[which] - begin[which] > n]
        a = begin[which]
        yield n, which, a, a + n, mixed(mixed((upto[a + n] - first[which]) * back[which]) ^ STEM)


def hashed_terms(texts: Sequence[str | None]) -> Iterator[tuple[str, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """All terms of some texts: the text they are in, which of ``texts`` that is, and as ``hashed_words`` where and what they are."""
    held, numbers, size = [], [], 0
    for number, text in [*enumerate(texts), (-1, None)]:
        for part in _parted(text.lower()) if text else ("",):
            held.append(part)
            numbers.append(number)
            size += len(part) + 1
            if size >= LETTERS or number < 0:
                starts = np.cumsum([0, *[len(x) + 1 for x in held[:-1]]])
                joined, of = "\n".join(held), np.array(numbers)
                for n, which, begin, end, hashes in hashed_words(joined):
                    if not n:
                        row = of[np.searchsorted(starts, begin, side="right") - 1]
                    yield joined, row[which], n, begin, end, hashes
                held, numbers, size = [], [], 0


def _parted(text: str) -> Iterator[str]:
    """A long text in parts that end before a blank."""
    at, least = 0, LETTERS
    while len(text) - at > least:
        blank = BLANK.search(text, at + least)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


def _counted(parts: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and terms as one number each (the row times 2 ** 32): where each row's terms begin (and the last ones end), the
    terms in ascending order, how often each is there."""
    key = np.concatenate([np.empty(0, np.int64), *parts])
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, counts = key[first], np.diff(first, append=len(key))
    return np.searchsorted(key, np.arange(rows + 1) << 32), (key & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)


def _hashed_names(names: pa.Array) -> np.ndarray:
    """Hashes of terms, or of those that terms like ``term*2`` are made of."""
    out = [np.empty(0, np.uint64)]
    for a in range(0, len(names), CHUNK):
        part = names.slice(a, CHUNK)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "\n")[0].as_py()
        *_, hashes = next(hashed_words(text))  # dashes, stars and digits are no letters
        out.append(np.where(pc.match_substring(part, "-"), mixed(hashes ^ STEM), hashes))
    return np.concatenate(out)


class Terms:
    """Known terms by number, found by their hashes."""

    def __init__(self, names: pa.Array):
        often = [np.flatnonzero(pc.ends_with(names, f"*{k}")) for k in OFTEN]
        base = np.delete(np.arange(len(names), dtype=np.int32), np.concatenate(often))
        keys = _hashed_names(names.take(pa.array(base)))
        self.mask = np.int64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
        self.keys, self.values = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        to = keys.astype(np.int64) & self.mask
        while len(keys):
            free = np.flatnonzero(self.values[to] < 0)
            self.keys[to[free]], self.values[to[free]] = keys[free], base[free]
            left = self.keys[to] != keys
            keys, base, to = keys[left], base[left], to[left] + 1 & self.mask
        self.often = np.full((len(OFTEN), len(names)), -1, np.int64)
        for numbers, some in zip(self.often, often):
            numbers[self.numbers(_hashed_names(names.take(pa.array(some))))] = some

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The terms' numbers, -1 for those that aren't known."""
        at = hashes.astype(np.int64) & self.mask
        out = self.values[at]
        left = np.flatnonzero((self.keys[at] != hashes) & (out >= 0))
        while len(left):  # the place is another's: the next one
            at[left] = at[left] + 1 & self.mask
            out[left] = self.values[at[left]]
            left = left[(self.keys[at[left]] != hashes[left]) & (out[left] >= 0)]
        return out

    def counted(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's terms begin (and the last ones end), their numbers in ascending order, how often each is met."""
        parts = []
        for _, row, _, _, _, hashes in hashed_terms(texts):
            numbers = self.numbers(hashes)
            known = np.flatnonzero(numbers >= 0)
            parts.append(row[known] << 32 | numbers[known])
        offsets, ids, counts = _counted(parts, len(texts))
        row, keys, met = np.repeat(np.arange(len(texts)) << 32, np.diff(offsets)), [], []
        for least, numbers in zip((1, *OFTEN), (np.arange(self.often.shape[1]), *self.often)):
            some = np.flatnonzero(counts >= least)
            to = numbers[ids[some]]
            some, to = some[to >= 0], to[to >= 0]
            keys.append(row[some] | to)
            met.append(counts[some])
        key, counts = np.concatenate(keys), np.concatenate(met)
        order = np.argsort(key, kind="stable")  # few ascending runs
        key = key[order]
        return np.searchsorted(key, np.arange(len(texts) + 1) << 32), (key & 0xFFFFFFFF).astype(np.int32), counts[order]


class Vocabulary:
    """Known terms; made ready for texts where they are first used, once in a worker."""

    def __init__(self, terms: pa.ChunkedArray):
        self.terms, self.ready = terms, None

    def of_texts(self) -> Terms:
        if self.ready is None:
            self.ready = Terms(pa.concat_arrays(self.terms.chunks).cast(pa.string()) if self.terms.num_chunks else pa.array([], pa.string()))
        return self.ready


def _spans(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the items of rows are, where each row begins among them, and how many it has."""
    a = offsets[rows]
    held = offsets[rows + 1] - a
    starts = np.cumsum(held) - held
    items = np.repeat(a - starts, held)
    items += np.arange(len(items))
    return items, starts, held


def _varints(offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ascending numbers and counts as bytes, seven bits each: the gap from the number before, the count, and so on.
    Also where each row begins (and the last one ends)."""
    v = np.empty(2 * len(ids), np.int64)
    v[::2], v[1::2] = np.diff(ids, prepend=0), counts
    starts = offsets[:-1][np.diff(offsets) > 0]
    v[2 * starts] = ids[starts]
    size = 1 + (v > 0x7F) + (v > 0x3FFF) + (v > 0x1FFFFF) + (v > 0xFFFFFFF)
    ends = np.append(0, np.cumsum(size))
    out = np.empty(ends[-1], np.uint8)
    out[ends[:-1]] = v & 0x7F | (size > 1) << 7
    for j in range(1, int(size.max(initial=1))):
        some = np.flatnonzero(size > j)
        out[ends[some] + j] = v[some] >> 7 * j & 0x7F | (size[some] > j + 1) << 7
    return out, ends[2 * offsets]


def _from_varints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_varints`` was given. Rows begin (and the last one ends) at the bytes ``offsets``."""
    ends = np.flatnonzero(data < 0x80) + 1
    starts = np.append(0, ends)[:-1]
    v = (data[starts] & 0x7F).astype(np.int64)
    size = ends - starts
    for j in range(1, int(size.max(initial=1))):
        some = np.flatnonzero(size > j)
        v[some] |= (data[starts[some] + j] & np.int64(0x7F)) << 7 * j
    offsets = np.searchsorted(ends, offsets, side="right") // 2
    upto = np.append(0, np.cumsum(v[::2]))
    return offsets, (upto[1:] - np.repeat(upto[offsets[:-1]], np.diff(offsets))).astype(np.int32), v[1::2].astype(np.int32)


def _joined(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets, *flat = zip((np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)), *parts)
    return np.append(0, np.cumsum(np.concatenate([np.diff(x) for x in offsets]))).astype(np.int64), *[np.concatenate(x) for x in flat]


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, numbers and counts of a column of rows that ``_varints`` made."""
    rows = column.cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _from_varints(data, offsets - offsets[0])


def digest(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ids.tobytes() + counts.tobytes())


class Index:
    """Labelled examples with all their terms. Equal vectors are one example with its numbers of labels. Bounded by the
    examples: about 15 bytes for each of their terms.

    ``weights``: of the terms, all positive. ``rows``: counts by term, label and name; or the same as flat arrays (``of``)."""

    def __init__(self, terms: Sequence[str], weights: np.ndarray, rows: list[tuple[dict[int, int], int, int]]):
        flat = [sorted(x[0].items()) for x in rows]
        ids, counts = (np.array([x[k] for row in flat for x in row], np.int32) for k in (0, 1))
        self._build(weights, np.append(0, np.cumsum([len(x) for x in flat])).astype(np.int64), ids, counts, [x[1] for x in rows], [x[2] for x in rows])
        self.levels = levels(sum((self.judged(range(a, min(a + BLOCK, self.n))) for a in range(0, self.n, BLOCK)), np.zeros((2, BINS))))

    @classmethod
    def of(cls, weights: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray, labels: Sequence[int], names: Sequence[int]) -> Index:
        """From flat arrays of terms and counts; not calibrated."""
        made = cls.__new__(cls)
        made._build(weights, offsets, ids, counts, labels, names)
        made.levels = None
        return made

    def _build(self, weights, offsets, ids, counts, labels, names) -> None:
        self.weights = np.asarray(weights, float)
        groups: dict[bytes, list] = {}
        self.plain = [0, 0]  # examples without any term: toxic, all
        for j, (a, z, label, name) in enumerate(zip(offsets[:-1], offsets[1:], labels, names)):
            if a == z:
                held = self.plain
            else:
                held = groups.setdefault(digest(ids[a:z], counts[a:z]), [0, 0, name, j])
                held[2] = min(held[2], name)
            held[0] += label
            held[1] += 1
        chosen = sorted(groups.items(), key=lambda g: (g[1][2], g[1][3]))
        self.numbers = {key: i for i, (key, _) in enumerate(chosen)}
        chosen = [g for _, g in chosen]
        self.n, self.names = len(chosen), [g[2] for g in chosen]
        self.toxic, self.total = (np.array([g[k] for g in chosen], float) for k in (0, 1))
        seen, toxic = self.total.sum() + self.plain[1], self.toxic.sum() + self.plain[0]
        self.base = (toxic + 0.5) / (seen + 2)
        at = [slice(offsets[g[3]], offsets[g[3] + 1]) for g in chosen]
        self.offsets = np.append(0, np.cumsum([x.stop - x.start for x in at])).astype(np.int64)
        self.ids = np.concatenate([ids[:0], *[ids[y] for y in at]]).astype(np.int32, copy=False)
        self.counts = np.concatenate([counts[:0], *[counts[y] for y in at]]).astype(np.min_scalar_type(int(counts.max(initial=0))))
        self.block, self.dense, self.skipped = self._blocks(), None, 0

    def __getstate__(self) -> dict:
        """Without what is made for the search, and small, as every worker gets it."""
        rows = []
        for a in range(0, self.n, ROWS):
            at = self.offsets[a : a + ROWS + 1]
            data, at = _varints(at - at[0], self.ids[at[0] : at[-1]], self.counts[at[0] : at[-1]])
            rows.append((pa.compress(data, "zstd", asbytes=True), at))
        names = ("weights", "plain", "numbers", "n", "names", "toxic", "total", "base", "block", "levels", "offsets")
        return {k: getattr(self, k) for k in names} | {"rows": rows, "kind": self.counts.dtype}

    def __setstate__(self, state: dict) -> None:
        rows, kind = state.pop("rows"), state.pop("kind")
        self.__dict__.update(state)
        self.ids, self.counts, upto = np.empty(self.offsets[-1], np.int32), np.empty(self.offsets[-1], kind), 0
        for data, at in rows:
            _, ids, counts = _from_varints(np.frombuffer(pa.decompress(data, int(at[-1]), "zstd"), np.uint8), at)
            self.ids[upto : upto + len(ids)], self.counts[upto : upto + len(ids)] = ids, counts
            upto += len(ids)
        self.dense, self.skipped = None, 0

    def _blocks(self) -> np.ndarray:
        """Examples that share terms in a block: some rounds of k-means over the most widespread terms. What is found doesn't
        depend on the blocks, only the time it takes."""
        blocks = max(1, min(BLOCKS, self.n // 32))
        found = np.zeros(self.n, np.int8)
        if blocks == 1:
            return found
        parts = [slice(self.offsets[a], self.offsets[min(a + ROWS, self.n)]) for a in range(0, self.n, ROWS)]
        held = sum((np.bincount(self.ids[x], minlength=len(self.weights)) for x in parts), np.zeros(len(self.weights), np.int64))
        column, top = np.full(len(self.weights), -1, np.int32), np.argsort(-held, kind="stable")[:256]
        column[top] = np.arange(len(top))
        rows = np.zeros((self.n, len(top)), np.float32)
        for x in parts:
            met = np.flatnonzero(column[self.ids[x]] >= 0) + x.start
            rows[np.searchsorted(self.offsets, met, side="right") - 1, column[self.ids[met]]] = self._raw(self.ids[met], self.counts[met])
        unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        rows = unit(rows)
        centres = rows[np.random.default_rng(0).choice(self.n, blocks, replace=False)]
        for _ in range(8):
            found = np.argmax(rows @ centres.T, 1).astype(np.int8)
            centres = unit(np.stack([rows[found == b].sum(0) for b in range(blocks)]))
        return found

    def _lists(self) -> None:
        """What is searched, made where the index is first searched: for each block the matrix of the terms that many of its
        examples hold, and posting lists of whatever is in no matrix. ``order``: the examples, block after block."""
        size = len(self.weights)
        self.order = np.argsort(self.block, kind="stable")
        self.cuts = np.append(0, np.cumsum(np.bincount(self.block, minlength=1)))
        self.column, self.dense, self.lengths, rare = [], [], np.empty(self.n), 0
        parts = [[(x, self.order[x : min(x + ROWS, z)]) for x in range(a, z, ROWS)] for a, z in zip(self.cuts[:-1], self.cuts[1:])]
        for block in parts:
            held = sum((np.bincount(self.ids[_spans(self.offsets, part)[0]], minlength=size) for _, part in block), np.zeros(size, np.int64))
            n = sum(len(part) for _, part in block)
            common = np.flatnonzero(held > max(COMMON * n, FEW))
            column = np.full(size, -1, np.int32)
            column[common] = np.arange(len(common))
            self.column.append(column)
            self.dense.append(np.zeros((len(common), n), np.float32))
            rare += int(held.sum() - held[common].sum())
        (ids, of, w), upto = (np.empty(rare, t) for t in (np.int32, np.int32, np.float32)), 0
        for block, column, dense, a in zip(parts, self.column, self.dense, self.cuts):
            for x, part in block:
                at, starts, held = _spans(self.offsets, part)
                terms = self.ids[at]
                weight = self._raw(terms, self.counts[at])
                self.lengths[part] = length = np.sqrt(np.add.reduceat(weight * weight, starts))
                weight = (weight / np.repeat(length, held)).astype(np.float32)
                row, c = np.repeat(np.arange(x, x + len(part), dtype=np.int32), held), column[terms]
                own, other = np.flatnonzero(c >= 0), np.flatnonzero(c < 0)
                dense[c[own], row[own] - a] = weight[own]
                to = slice(upto, upto + len(other))
                ids[to], of[to], w[to], upto = terms[other], row[other], weight[other], to.stop
        held = np.bincount(ids, minlength=size)
        upto, self.starts = np.append(0, np.cumsum(held)), np.append(0, np.cumsum(-(-held // LINE)))
        self.line_of, self.line_w = (np.zeros((self.starts[-1], LINE), t) for t in (np.int32, np.float32))  # where a line isn't full, the first example gets 0
        lo = 0
        while lo < size:
            hi = min(size, lo + 65_536, max(lo + 1, int(np.searchsorted(upto, upto[lo] + 1_000_000, side="right")) - 1))
            some = np.flatnonzero((ids >= lo) & (ids < hi))
            some = some[np.argsort((ids[some] - lo).astype(np.uint16), kind="stable")]  # 16 bits are sorted by counting
            to = np.arange(len(some)) + np.repeat(self.starts[lo:hi] * LINE - (upto[lo:hi] - upto[lo]), held[lo:hi])
            self.line_of.ravel()[to], self.line_w.ravel()[to] = of[some], w[some]
            lo = hi
        self.most = [math.sqrt(float(np.einsum("ij,ij->j", x, x).max())) if x.size else 0.0 for x in self.dense]
        self.seen = np.zeros(size, bool)
        self.full = np.zeros(size)
        self.room: dict[str, np.ndarray] = {}

    def _room(self, name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
        """An array that is kept for the next use: fresh memory costs several times the sums that it is taken for."""
        held, n = self.room.get(name), math.prod(shape)
        if held is None or len(held) < n:
            held = self.room[name] = np.empty(n + n // 2, kind)
        return held[:n].reshape(shape)

    def _raw(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts, dtype=float)) * self.weights[ids]

    def _unit(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = self._raw(ids, counts)
        length = math.sqrt((w * w).sum())
        return w / length if length else w

    @property
    def examples(self) -> list[tuple[tuple[int, int], ...]]:
        return [tuple(zip(self.ids[a:z].tolist(), self.counts[a:z].tolist())) for a, z in zip(self.offsets[:-1], self.offsets[1:])]

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        """Unit vector: (1 + log count) times the term's weight."""
        ids = np.fromiter(counts.keys(), np.int64, len(counts))
        return dict(zip(ids.tolist(), self._unit(ids, np.fromiter(counts.values(), np.int64, len(counts))).tolist()))

    def nearest(self, query: dict[int, float], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        ids = np.fromiter(query.keys(), np.int64, len(query))
        return self.search([(ids, np.fromiter(query.values(), float, len(query)))], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """The ``k`` examples of greatest positive cosine to each query (terms, unit weights), exactly; ties by example number.

        Every example that shares a term is summed in single precision: posting lists first, then block by block the terms of
        the matrix, as one product for the queries that hold many of them. For the others a block is left out where the largest
        sum in it so far and the length of the query's part can't reach the ``k`` best. All that may be among these are then
        summed again in double precision."""
        if self.dense is None:
            self._lists()
        return [x for at in range(0, len(queries), BLOCK) for x in self._search(queries[at : at + BLOCK], k)]

    def _search(self, part: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        sums = self._room("sums", (len(part), self.n), np.float32)
        sums[:] = 0
        for s, (ids, w) in zip(sums, part):
            at, _, held = _spans(self.starts, ids)
            of = self._room("of", (len(at), LINE), np.int64)
            of[:] = np.take(self.line_of, at, 0, out=self._room("lines", (len(at), LINE), np.int32), mode="clip")
            add = np.take(self.line_w, at, 0, out=self._room("add", (len(at), LINE), np.float32), mode="clip").ravel()
            add *= np.repeat(w.astype(np.float32), held * LINE)
            np.add.at(s, of.ravel(), add)
        ids, w = (np.concatenate([x[i] for x in part]) for i in (0, 1))
        of, w, few = np.repeat(np.arange(len(part)), [len(x[0]) for x in part]), w.astype(np.float32), []
        for b, (dense, column, a, z) in enumerate(zip(self.dense, self.column, self.cuts[:-1], self.cuts[1:])):
            c = column[ids]
            met = np.flatnonzero(c >= 0)
            if not len(met):
                continue
            many = np.bincount(of[met], minlength=len(part)) >= MANY * len(dense)
            own = many[of[met]]
            x, met = met[own], met[~own]
            if len(x):
                rows = np.flatnonzero(many)
                q = self._room("q", (len(rows), len(dense)), np.float32)
                q[:] = 0
                q[(np.cumsum(many) - 1)[of[x]], c[x]] = w[x]
                sums[rows, a:z] += np.matmul(q, dense, out=self._room("product", (len(rows), z - a), np.float32))
            if len(met):
                cut = np.flatnonzero(np.diff(of[met], prepend=-1))
                few += zip(of[met][cut].tolist(), [b] * len(cut), np.split(c[met], cut[1:]), np.split(w[met], cut[1:]))
        slack = [max(SLACK, 1.2e-7 * (len(x) + 8)) for x, _ in part]  # so many roundings of a sum
        least = {j: self._least(sums[j], k) - slack[j] for j in {x[0] for x in few}}
        for j, b, c, w in few:
            s, dense = sums[j, self.cuts[b] : self.cuts[b + 1]], self.dense[b]
            if s.max() + math.sqrt(float(w @ w)) * self.most[b] < least[j]:
                self.skipped += 1
            else:
                s += w @ np.take(dense, c, 0, out=self._room("taken", (len(c), len(s)), np.float32), mode="clip")
        return [self._best(s, ids, w, k, off) for s, (ids, w), off in zip(sums, part, slack)]

    def _best(self, sums: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int, slack: float) -> list[tuple[float, int]]:
        near = np.flatnonzero(sums >= max(self._least(sums, k) - slack, 1e-30))
        if len(near) > k:
            near = near[sums[near] >= np.partition(sums[near], len(near) - k)[len(near) - k] - slack]
        if not len(near):
            return []
        near = self.order[near]
        self.seen[ids], self.full[ids] = True, w * self.weights[ids]
        at = [slice(a, z) for a, z in zip(self.offsets[near].tolist(), self.offsets[near + 1].tolist())]
        terms, counts = (np.concatenate([x[y] for y in at]) for x in (self.ids, self.counts))
        shared = np.flatnonzero(self.seen[terms])
        starts = np.searchsorted(shared, np.cumsum([0, *[x.stop - x.start for x in at[:-1]]]))
        exact = np.add.reduceat((1 + np.log(counts[shared], dtype=float)) * self.full[terms[shared]], starts)
        exact = (exact / self.lengths[near]).round(12)
        self.seen[ids] = False
        best = np.lexsort((near, -exact))[:k]
        return list(zip(exact[best].tolist(), near[best].tolist()))

    @staticmethod
    def _least(sums: np.ndarray, k: int) -> float:
        """No more than the ``k``-th largest sum: the ``k``-th largest of the greatest of 16 each."""
        rest = len(sums) // 16
        if rest < k:
            return 0.0
        most = sums[: 16 * rest].reshape(16, rest).max(0)
        return float(np.partition(most, rest - k)[rest - k])

    def vote(self, near: list[tuple[float, int]]) -> float:
        """What the neighbours vote; without any, the examples that have no terms."""
        return self._share(near) if near else (self.plain[0] + PRIOR * self.base) / (self.plain[1] + PRIOR)

    def _share(self, near: list[tuple[float, int]], judged: tuple[int, int] | None = None) -> float:
        """Toxic share among the neighbours, weighted by similarity and drawn to the base rate by ``PRIOR``. Equal examples
        vote up to three times. ``judged``: an example and the label it has, which doesn't vote."""
        up, mass = PRIOR * self.base, PRIOR
        for s, i in near:
            toxic, total = self.toxic[i], self.total[i]
            if judged and i == judged[0]:
                toxic, total = toxic - judged[1], total - 1
            up += s * toxic / total * min(total, 3)
            mass += s * min(total, 3)
        return up / mass

    def around(self, numbers: Sequence[int]) -> list[list[tuple[float, int]]]:
        """The nearest of examples, one more than vote, as the example is among them."""
        spans = [slice(self.offsets[i], self.offsets[i + 1]) for i in numbers]
        return self.search([(self.ids[x], self._unit(self.ids[x], self.counts[x])) for x in spans], NEIGHBOURS + 1)

    def judged(self, numbers: Sequence[int], found: list[list[tuple[float, int]]] | None = None) -> np.ndarray:
        """Examples judged by all others: toxic and all labels for each bin of the votes. ``found``: as by ``around``."""
        sums, cuts = np.zeros((2, BINS)), np.linspace(0, 1, BINS + 1)[1:-1]
        for i, near in zip(numbers, self.around(numbers) if found is None else found):
            alone = self.total[i] == 1
            near = [x for x in near if not alone or x[1] != i][:NEIGHBOURS]
            for label, n in ((1, self.toxic[i]), (0, self.total[i] - self.toxic[i])):
                if n:
                    b = int(np.searchsorted(cuts, self._share(near, None if alone else (i, label)), side="right"))
                    sums[:, b] += label * n, n
        return sums

    def score(self, vote: float) -> float:
        """The calibrated vote: between the centres of bins, a straight line."""
        return float(np.interp(vote, (np.arange(BINS) + 0.5) / BINS, self.levels))


def levels(sums: np.ndarray) -> np.ndarray:
    """Calibration: the bins' toxic shares, smoothed and made to rise (pooling neighbours that don't)."""
    merged: list[list[float]] = []
    for u, a, c in zip(*sums, (np.arange(BINS) + 0.5) / BINS):
        merged.append([u + 2 * c, a + 2.0, 1])
        while len(merged) > 1 and merged[-2][0] / merged[-2][1] > merged[-1][0] / merged[-1][1]:
            last = merged.pop()
            merged[-1] = [x + y for x, y in zip(merged[-1], last)]
    return np.array([u / a for u, a, n in merged for _ in range(int(n))])


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's terms with the rows that hold them, by label; ``term*2`` and so on where a row holds them that often."""
    names, known, sums = [], {}, np.zeros((1 + len(OFTEN), 2, 0), np.int64)
    for batch in batches:
        for part in pieces(batch, ROWS):
            keys = []
            for text, row, n, begin, end, hashes in hashed_terms(part.column(0).to_pylist()):
                hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                before = len(known)
                numbers = np.fromiter((known.setdefault(h, len(known)) for h in hashes.tolist()), np.int64, len(hashes))
                first = first[numbers >= before]
                names += [text[a:z] + "-" * (n > 0) for a, z in zip(begin[first].tolist(), end[first].tolist())]
                keys.append(row << 32 | numbers[which])
            offsets, ids, counts = _counted(keys, part.num_rows)
            if len(names) > sums.shape[2]:
                sums = np.pad(sums, ((0, 0), (0, 0), (0, 2 * len(names) - sums.shape[2])))
            toxic = np.repeat(np.array([bool(x) for x in part.column(1).to_pylist()], bool), np.diff(offsets))
            for held, least in zip(sums, (1, *OFTEN)):
                held[0] += np.bincount(ids[toxic & (counts >= least)], minlength=sums.shape[2])
                held[1] += np.bincount(ids[counts >= least], minlength=sums.shape[2])
    for (toxic, rows), least in zip(sums, (1, *OFTEN)):
        some = np.flatnonzero(rows)
        told = pa.array([names[i] + f"*{least}" * (least > 1) for i in some.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([told, pa.array(toxic[some]), pa.array(rows[some])], names=["term", "toxic", "n"])


def vocabulary(examples: DataFrame) -> tuple[pa.ChunkedArray, np.ndarray]:
    """All terms of the examples, the most frequent first, and how much each tells: the square root of one plus the
    likelihood-ratio statistic of its presence and the label, in either direction. Equal texts count once."""
    examples = settle(examples.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "example-texts")
    n, toxic = examples.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    counts = examples.select("text", "toxic").mapInArrow(_label_counts, "term string, toxic bigint, n bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("n").alias("r"))
    held = counts.toArrow().sort_by([("r", "descending"), ("term", "ascending")])  # the terms of MAX_EXAMPLES texts
    a, r, t, m = held["a"].to_numpy().astype(float), held["r"].to_numpy().astype(float), float(toxic or 0), float(n)

    def part(seen: np.ndarray, row: np.ndarray, col: float) -> np.ndarray:
        safe = np.where(seen > 0, seen, 1.0)
        return np.where(seen > 0, seen * np.log(safe * m / np.where(seen > 0, row * col, m)), 0.0)

    g2 = 2 * (part(a, r, t) + part(r - a, r, m - t) + part(t - a, m - r, t) + part(m - r - t + a, m - r, m - t))
    return held["term"], np.sqrt(1 + np.maximum(g2, 0.0))


def _in_chunks(df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbers by term, a row for each ``CHUNK`` of them that are not all 0."""
    for at in range(0, len(df), CHUNK):
        if df[at : at + CHUNK].any():
            yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.array([df[at : at + CHUNK].tobytes()], pa.binary())], names=["chunk", "df"])


def _add_chunks(df: np.ndarray, rows: pa.RecordBatch | pa.Table) -> None:
    for k, held in zip(rows["chunk"].to_pylist(), rows["df"].to_pylist()):
        df[k * CHUNK : (k + 1) * CHUNK] += np.frombuffer(held, np.int64)


def rate(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, else all) with ``score`` (0 to 1), ``predicted`` and ``evidence``: the nearest
    examples with similarity and toxic share.

    Examples are the ``MAX_EXAMPLES`` rows of ``labels`` with the smallest hash of the id: a bounded sample, whose index goes
    to every task. All their terms (lower-case words and word beginnings, met once or often) make the vocabulary. All
    documents become sparse vectors over it, once; document frequencies are counted over all of them. A term weighs its
    inverse document frequency times how much it tells of the label (``vocabulary``), at least once: none is left out, and a
    copy of an example has the cosine 1 with it. Cosines to all examples are exact (``Index.search``); equal vectors are
    searched once in a task, those that equal an example for the calibration alone. Scores are calibrated on every example,
    judged by the others (the terms' weights are those of all examples).

    Null or empty text, or none of the terms: the share of toxic examples among those without terms. Without any labels
    the score is 0.25. Null ids and labels aren't learned from; an id labelled twice counts as toxic if either says so.
    Repeated rows get equal scores. Columns of the input named like the added ones are replaced.
    """
    spark = docs.sparkSession
    names = [c for c in (keep or docs.columns) if c not in ("score", "predicted", "evidence")]
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    sample = settle(marked.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(MAX_EXAMPLES), "labelled")
    examples = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    terms, tells = vocabulary(examples)
    known, size = spark.sparkContext.broadcast(Vocabulary(terms)), len(terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value.of_texts()
        for batch in batches:
            for part in pieces(batch, ROWS):
                data, at = _varints(*terms.counted(part.column(2).to_pylist()))
                packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], names=["row", "id", "terms"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for part in pieces(batch, ROWS):
                df += np.bincount(_unpacked(part.column(0))[1], minlength=size)
        yield from _in_chunks(df)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            _add_chunks(df, batch)
        yield from _in_chunks(df)

    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["id"], T.StructField("terms", T.BinaryType())])
    held = settle(rows.mapInArrow(vectors, schema), "vectors", "zstd")
    frequency = np.zeros(size, np.int64)
    chunks = held.select("terms").mapInArrow(frequencies, "chunk int, df binary").repartition("chunk").mapInArrow(added, "chunk int, df binary")
    _add_chunks(frequency, chunks.toArrow())  # a row for each CHUNK of terms
    weights = (np.log((1 + held.count()) / (1 + frequency)) + 1) * tells
    learned = held.select("id", "terms").join(F.broadcast(sample), "id").toArrow()  # MAX_EXAMPLES rows, and those that repeat their ids
    flat = _joined(_unpacked(x.slice(a, ROWS)) for x in learned["terms"].chunks for a in range(0, len(x), ROWS))
    made = Index.of(weights, *flat, learned["toxic"].to_pylist(), learned["id"].to_pylist())
    del learned, terms, flat
    index = spark.sparkContext.broadcast(made)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, BLOCK):
                found = index.value.around(part.column(0).to_pylist())
                kinds = [("similarity", 0, pa.float64()), ("near", 1, pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([[x[k] for x in near] for near in found], pa.list_(t)) for _, k, t in kinds]], names=["number", *[n for n, *_ in kinds]])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, made.n))
    found = spark.range(0, made.n, 1, tasks).mapInArrow(neighbours, "number long, similarity array<double>, near array<int>").toArrow()  # a row for each example
    around = [None] * made.n
    for i, s, near in zip(found["number"].to_pylist(), found["similarity"].to_pylist(), found["near"].to_pylist()):
        around[i] = list(zip(s, near))
    rising = levels(made.judged(range(made.n), around))
    close = np.zeros((len(around), NEIGHBOURS), [("s", float), ("i", np.int32)])  # 0: no neighbour
    for row, near in zip(close, around):
        row[: len(near)] = near[:NEIGHBOURS]
    close = spark.sparkContext.broadcast(close)
    del found, around, made

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = index.value, {}
        held.levels = rising
        kind = pa.list_(pa.struct([("id", pa.int64()), ("similarity", pa.float64()), ("toxic_share", pa.float64())]))
        for batch in batches:
            for part in pieces(batch, BLOCK):
                offsets, ids, counts = _unpacked(part.column(1))
                spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                keys = [digest(ids[a:z], counts[a:z]) for a, z in spans]
                if len(met) > 50_000:
                    met.clear()
                new = {key: (ids[a:z], counts[a:z]) for key, (a, z) in zip(keys, spans) if key not in met}
                near_to = {key: [(s, i) for s, i in close.value[held.numbers[key]].tolist() if s] for key in new if key in held.numbers}
                other = [key for key in new if key not in near_to]
                near_to.update(zip(other, held.search([(new[key][0], held._unit(*new[key])) for key in other])))
                for key, near in near_to.items():
                    vote = held.vote(near)
                    score = held.score(vote) if near else vote
                    met[key] = round(score, 6), [{"id": held.names[i], "similarity": s, "toxic_share": held.toxic[i] / held.total[i]} for s, i in near[:3]]
                found = [met[key] for key in keys]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], kind)], names=["row", "score", "evidence"])

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("score double, evidence array<struct<id:bigint,similarity:double,toxic_share:double>>").fields])
    judged = held.select("row", "terms").mapInArrow(judge, schema)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in names], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
