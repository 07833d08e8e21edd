"""Small tables with the awkward cases: nulls, empty and long texts, copies, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    near = []
    for t in base[:12]:
        w = t.split()
        for k in range(3):
            x = list(w)
            for _ in range(max(1, len(w) // (10 + 20 * k))):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            near.append(" ".join(x))
    odd = [None, "", " \n\t ", "one", "One", "two words", "Ünïcode Straße ÀÉ", "日本語のテキストです", "a\x1cb \x0b c\r\nd", "<|endoftext|> it's 12 o'clock", " nbsp wide", "x" * 5000, " ".join(WORDS * 400)]
    return base + near + base[:5] + [t.upper() for t in base[5:8]] + odd


def documents(spark: SparkSession, of: list[str | None] | None = None, repeat: bool = True) -> DataFrame:
    """One row a text; ids aren't in the order of the rows. ``repeat``: also a row twice, an id twice, and a null id."""
    of = texts() if of is None else of
    rng = random.Random(5)
    ids = rng.sample(range(1, 10 * len(of) + 1), len(of))
    langs, sources = ["en", "de", None], ["a", "b", "é", None, "hot", "hot", "hot", "hot"]
    rows = [(i, t, langs[k % 3], sources[k % 8], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, of))]
    if repeat and rows:
        rows += [rows[0], (rows[1][0], "another text of the same id", "en", "a", None), (None, rows[2][1], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    """Between ASCII white space."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
