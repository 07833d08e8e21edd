"""Phrases and the graph they come from, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import phrases
from gridloom.session import settle
from tests.llm.fixtures import ascii_lower, documents, empty

#: A sketch that rules nothing out.
ALL = [b"\xff" * ((1 << phrases.SLOT_BITS) // 8)] * 2


def pieces_of(text):
    return [p for p in (re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or ""))) if p]


def counts_of(rows):
    """Per group: words, and runs of one to four words."""
    n, f = Counter(), defaultdict(Counter)
    for group, text in rows:
        group = "und" if group is None else group
        for p in pieces_of(text):
            n[group] += len(p)
            f[group].update(tuple(p[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(p) - k + 1))
    return n, f


def ranked(rows, min_count, top, cover=80):
    n, counts = counts_of(rows)
    out = set()
    for group, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        around = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        rated = []
        for p, a in candidates.items():
            if p in around and 100 * around[p] >= cover * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rated)[:top], 1):
            out.add((group, rank, p.decode(), -a, l, r, n[group], -score))
    return out


def as_rows(df):
    return {(r.grp, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def prose(seed, n=60):
    """Few words, a passage in many texts, runs of one word, white space of all kinds."""
    rng = random.Random(seed)
    words = "the of a river old stone bridge É é ß naïve x1 -- Über THE Of 日本".split()
    passage = "once upon a time there was a small house at the end of the long road to the sea"
    out = []
    for k in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  ", "!", "\x0b", "\x1c", " "]) for _ in range(rng.randint(0, 80)))
        out.append(text + (rng.choice(["\n", " ", "."]) + passage if k % 3 else "") + " ha" * (k % 9))
    return out


@pytest.mark.parametrize(("min_count", "top", "cover"), [(5, 2000, 80), (12, 7, 80), (3, 2000, 30)])
def test_collocations(spark, min_count, top, cover):
    docs = documents(spark, [*prose(1), None, "", " \t\n", "...", "word " * 20_000, "Word.word." * 300]).withColumn("grp", F.lit(1)).withColumn("n", F.lit("x"))
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = ranked(rows, min_count, top, cover)
    assert as_rows(phrases.collocations(docs, min_count, top, cover)) == want and len(want) > 5


def test_sketch_that_can_not_tell(spark, monkeypatch):
    """Two slots for all pairs: nothing is ruled out, the result is the same."""
    docs = documents(spark, prose(2))
    rows = [(r.lang, r.text) for r in docs.collect()]
    real = phrases.sketch
    monkeypatch.setattr(phrases, "sketch", lambda texts, least: (ALL, real(texts, least)[1]))
    assert as_rows(phrases.collocations(docs, 4)) == ranked(rows, 4, 2000)


def test_flows(spark):
    """Counts derived from the longest runs and the ends of pieces are the counts of all runs."""
    texts = documents(spark, prose(3)).select(F.coalesce("lang", F.lit("und")).alias("grp"), "text")
    _, f = counts_of([(r.grp, r.text) for r in texts.collect()])
    runs = settle(phrases.longest_runs(texts, ALL), "runs")
    for k, df in phrases.flows(runs).items():
        assert {(r.grp, r.gram): r.f for r in df.collect()} == {(g, " ".join(p)): n for g, c in f.items() for p, n in c.items() if len(p) == k}


def test_paths(spark):
    """A passage met often is one path; a branch and an end part it; edges and weights are kept."""
    passage = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [" ".join(passage)] * 6 + [" ".join([*passage[:6], "other", "way", "on"])] * 2 + [" ".join(passage[3:9])] * 3
    df = spark.createDataFrame([("en", t) for t in texts], "grp string, text string")
    flows = phrases.flows(settle(phrases.longest_runs(df, ALL), "runs"))
    inner = phrases.inner_nodes(flows[4], flows[3])
    paths = {" ".join(r.words): r.f for r in phrases.compact(flows[4], inner).collect()}
    assert paths == {
        "one two three four five six": 8, "four five six seven eight nine": 9, "seven eight nine ten eleven twelve": 6, "four five six other way on": 2,
    }
    repeats = spark.createDataFrame([("en", "ha " * 50)], "grp string, text string")
    flows = phrases.flows(settle(phrases.longest_runs(repeats, ALL), "runs"))
    assert [(r.words, r.f) for r in phrases.compact(flows[4], phrases.inner_nodes(flows[4], flows[3])).collect()] == [(["ha"] * 4, 47)]


def test_long_paths(spark):
    """More rounds of doubling than one."""
    words = [f"w{k}" for k in range(500)]
    df = spark.createDataFrame([("en", " ".join(words))] * 3 + [(None, " ".join(words[:100]))], "lang string, text string")
    df = df.select(F.coalesce("lang", F.lit("und")).alias("grp"), "text")
    flows = phrases.flows(settle(phrases.longest_runs(df, ALL), "runs"))
    got = {(r.grp, " ".join(r.words), r.f) for r in phrases.compact(flows[4], phrases.inner_nodes(flows[4], flows[3])).collect()}
    assert got == {("en", " ".join(words), 3), ("und", " ".join(words[:100]), 1)}


def test_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits."""
    big = 10**16
    candidates = spark.createDataFrame([("en", "a b", big)], "grp string, gram string, f bigint")
    counts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", 3 * big)], "grp string, gram string, f bigint")
    r = phrases.best_cut(candidates, counts).first()
    assert (r.l, r.r, r.score) == (big + 1, 3 * big, 2_000_000 * big // (4 * big + 1))


def test_blocks_end_with_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 10)
    rows = prose(4)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * (len(rows) // 2)), pa.array(rows)], names=["grp", "text"])
    got = defaultdict(list)
    for group, words, more in phrases.blocks(batch):
        for piece in np.split(np.array(words, object), np.flatnonzero(~more) + 1)[:-1]:
            got[group].append([w.decode() for w in piece])
    assert got == {"en": [p for t in rows[::2] for p in pieces_of(t)], "de": [p for t in rows[1::2] for p in pieces_of(t)]}


def test_empty(spark):
    assert phrases.collocations(empty(spark)).collect() == []
    assert phrases.collocations(documents(spark, [None, "", "few words"])).collect() == []
