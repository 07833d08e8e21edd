"""SentencePiece encoding and decoding: exact merges by backtracking over longest matches.

The merge rule (join the adjacent pair whose concatenation has the highest score, leftmost first) never runs over a text.
The automaton gives the longest piece from each position; a piece is taken if, re-merged with the piece before it, both
stay as they are; else the next shorter piece that starts there is tried, and where none is left the position is marked as
failed and the piece before it gives way. The sequence whose neighbours all agree is the one the merges would make.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, types as T
from sentencepiece import sentencepiece_model_pb2

from gridloom.llm.common import pieces

#: What the library writes for a blank, and before the first word.
SPACE = "▁"
#: Letters behind which a text may be cut at a sign that no piece has behind a letter.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: Kinds of pieces, as the model file numbers them.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks that a worker remembers in each of two generations, merge results that it remembers, and the longest chunk.
MOST, MOST_PAIRS, LONGEST = 250_000, 500_000, 40


class Encoder:
    """Texts to the ids of a merge-type model with byte fallback and without normalisation; anything else is a ValueError."""

    def __init__(self, model: bytes):
        read = sentencepiece_model_pb2.ModelProto.FromString(model)
        form, by_kind = read.normalizer_spec, {kind: [i for i, p in enumerate(read.pieces) if p.type == kind] for kind in (NORMAL, UNKNOWN, CONTROL, BYTE)}
        if read.trainer_spec.model_type != 2 or len(by_kind[BYTE]) != 256 or sum(map(len, by_kind.values())) != len(read.pieces):
            raise ValueError("not a merge-type model with byte fallback and normal pieces alone")
        if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.escape_whitespaces or read.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalises its texts")
        self.prefix = SPACE if form.add_dummy_prefix else ""
        self.bytes = {int(read.pieces[i].piece[1:-1], 16): i for i in by_kind[BYTE]}
        self.ids = {read.pieces[i].piece: i for i in by_kind[NORMAL]}
        self.scores = {read.pieces[i].piece: read.pieces[i].score for i in by_kind[NORMAL]}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a letter that is no piece")
        #: Pieces that the merges can make, each with the next shorter one that starts it.
        made = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in made), None) for p in made}
        self.automaton = ahocorasick.Automaton()
        for p in made:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.width = max(map(len, made))
        # No merge crosses from one letter to the next unless a piece has the two side by side.
        side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        behind = {b for a, b in side if re.match(LETTERS, a)}
        signs = re.escape("".join(sorted({"\n", *(p for p in self.ids if len(p) == 1 and not re.match(LETTERS, p))} - behind - {SPACE})))
        crosses = any(b == SPACE != a for a, b in side)
        self.cut = re.compile("(?s).+" if crosses else f"{SPACE}*{LETTERS}+(?=[{signs}])|{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.letters = {p for p in self.ids if len(p) == 1}
        self.foreign = re.compile("([^" + re.escape("".join(sorted(self.letters))) + "]+)")
        self.agree: dict[tuple[str, str], bool] = {}
        self.met = Met(lambda chunk: array("i", self.chunk(chunk)).tobytes())
        #: Words behind one blank, which where nothing crosses to a blank are chunks of their own or a few.
        self.words = Met(lambda word: b"".join(map(self.met.__getitem__, self.cut.findall(SPACE + word))))
        self.by_words = bool(self.prefix) and not crosses

    def merge(self, text: str) -> list[str]:
        """The merge rule itself, for a piece or two."""
        parts, score, never = list(text), self.scores.get, float("-inf")
        worth = [score(a + b, never) for a, b in zip(parts, parts[1:])]
        while worth and (best := max(worth)) > never:
            at = worth.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del worth[at]
            if at:
                worth[at - 1] = score(parts[at - 1] + parts[at], never)
            if at < len(worth):
                worth[at] = score(parts[at] + parts[at + 1], never)
        return parts

    def agrees(self, pair: tuple[str, str]) -> bool:
        """Whether two adjacent pieces stay as they are when merged anew."""
        if len(self.agree) >= MOST_PAIRS:
            self.agree.clear()
        both = pair[0] + pair[1]
        known = self.agree[pair] = both not in self.shorter and tuple(self.merge(both)) == pair
        return known

    def run(self, text: str) -> list[str]:
        """The pieces of a text whose letters are all pieces."""
        size, shorter, agree, longest, width = len(text), self.shorter, self.agree, self.automaton.iter_long, self.width
        failed = bytearray(size // 8 + 1)  # a bit for each position
        taken: list[str] = []
        at, piece, before = 0, next(longest(text[:width]))[1], ""
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = True
                if before:
                    pair = (before, piece)
                    fits = agree.get(pair)
                    if fits is None:
                        fits = self.agrees(pair)
                if fits:
                    taken.append(piece)
                    if end == size:
                        return taken
                    at, before, piece = end, piece, next(longest(text[end : end + width]))[1]
                    continue
            piece = shorter[piece]
            while piece is None:  # nothing that starts here fits: the piece before gives way
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()  # never empty: the merges have a result
                at -= len(last)
                before, piece = taken[-1] if taken else "", shorter[last]

    def chunk(self, text: str) -> list[int]:
        """Ids of a part that no merge leaves; letters that are no piece become their bytes."""
        ids = self.ids.__getitem__
        if self.letters.issuperset(text):
            return list(map(ids, self.run(text)))
        out: list[int] = []
        for known in self.foreign.split(text):
            if known[:1] not in self.ids:
                out.extend(self.bytes[b] for b in known.encode())
            else:
                out.extend(map(ids, self.run(known)))
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as native 32-bit integers."""
        if not text:
            return b""
        if self.by_words and len(text) < 1 << 20 and text[0] != " " and "  " not in text and SPACE not in text:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        found = self.cut.finditer(self.prefix + text.replace(" ", SPACE))
        out = []
        while block := [part.group() for part in islice(found, 1 << 16)]:
            out.append(b"".join(map(self.met.__getitem__, block)))
        return b"".join(out)


class Met(dict):
    """The ids of what was met before, and what makes those of the new; the ``MOST`` met last stay, and as many before."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk)
            if len(chunk) > LONGEST:
                return ids
        if len(self) >= MOST:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(model)


@lru_cache(maxsize=2)
def _library(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``out``, the ids of ``text``: what the library's ``encode`` gives.

    ``model`` holds the bytes of a model file. No begin or end ids, no sampling; null and empty texts have no ids. A column
    named ``out`` is replaced; other columns, repeated rows and an empty table pass as they are. No shuffle; a task holds
    a few hundred texts at once. A long text without blanks costs memory in proportion to its length.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    extra = [] if text in kept else [text]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for part in pieces(batch, 256):
                found = [encoder.encode(value or "") for value in part.column(part.schema.get_field_index(text)).to_pylist()]
                offsets = np.cumsum([0, *map(len, found)]) // 4
                flat = np.frombuffer(b"".join(found), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), lists], names=[*kept, out])

    return docs.select(*kept, *extra).mapInArrow(ids, schema)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``out``, the text that the library's ``decode`` gives for ``ids``.

    Null and empty lists give an empty text; null ids inside a list are left out. A column named ``out`` is replaced."""
    kept = [c for c in (rows.columns if keep is None else keep) if c != out]
    extra = [] if ids in kept else [ids]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(model)
        for batch in batches:
            for part in pieces(batch, 256):
                lists = part.column(part.schema.get_field_index(ids))
                if lists.flatten().null_count:
                    found = [library.decode([i for i in value or () if i is not None]) for value in lists.to_pylist()]
                else:  # null lists have no values
                    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                    flat = lists.flatten().to_numpy(zero_copy_only=False)
                    found = [library.decode(own.tolist()) for own in np.split(flat, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(found, pa.string())], names=[*kept, out])

    return rows.select(*kept, *extra).mapInArrow(texts, schema)
