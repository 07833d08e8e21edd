"""Operators with one right answer, against plain Python on small tables, and against DuckDB."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import decontaminate, line_dedup, minhash, mixing, queries, syncmers, token_files, warc
from gridloom.session import scratch_path, settle
from tests.compare import compare, duck
from tests.llm.fixtures import ascii_lower, documents, empty, texts, words

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), duck(FOLDER), queries.ORACLES[name]) is None


# Lines


def kept_lines(rows, min_docs=3, min_chars=20):
    strip = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                held[strip(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if strip(x) not in gone or gone[strip(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_lines(spark):
    shared, other = "A line that many documents hold", "\tANOTHER line that some hold \r"
    of = [f"{shared}\nown {i}\n{other if i % 2 else ''}\n{shared.upper()}" for i in range(9)] + [shared, None, "", "\n\n", "short\nshort", "ÀÉ line with letters beyond ASCII"] * 3
    docs = documents(spark, of)
    got = line_dedup.drop_common_lines(docs.withColumns({"n_lines": F.lit("clash"), "row": F.lit(1), "id": F.lit(2), "h1": F.lit(3)}))
    assert {"row", "id", "h1", "source"} <= set(got.columns)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == kept_lines(rows)
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0


# Benchmark passages


def passages(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def found(rows, items, n=13):
    windows = defaultdict(set)
    for item, t in items:
        w = passages(t)
        for i in range(len(w) - min(n, len(w)) + 1):
            if w and item is not None:
                windows[tuple(w[i : i + min(n, len(w))])].add(str(item))
    out = []
    for i, t in rows:
        w, hit, of = passages(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    of |= x
        out.append((i, len(w), len(hit), tuple(sorted(of))))
    return Counter(out)


@pytest.mark.parametrize("most", [500_000, 7])
def test_passages(spark, most):
    of = texts()
    long = " ".join(words(of[-1])[5:40])
    items = [(1, long), (2, "Two, WORDS"), (3, None), (4, ""), (5, long.upper()), (None, "one"), (6, "日本語のテキストです"), (7, of[0])]
    docs, bench = documents(spark, of + [f"before {long}, after", f"<two--words> and {of[0]} x"]), spark.createDataFrame(items, "item_id bigint, text string")
    clash = docs.withColumns({"n_hit": F.lit("x"), "_text": F.lit(1), "words": F.lit(2)})
    got = decontaminate.find_contamination(clash, bench, max_windows=most).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == found([(r.doc_id, r.text) for r in docs.collect()], items)
    assert all(r.n_hit == sum(b - a for a, b in r.spans) for r in got)
    clean = decontaminate.decontaminate(clash, bench, remove="spans")
    assert clean.columns == clash.columns and clean.count() == clash.count()
    again = decontaminate.find_contamination(clean.filter("n_chars > 200"), bench).filter("n_hit > 0 and n_words > 60")
    assert again.count() <= 1  # words that the removal brought together
    whole = decontaminate.decontaminate(docs, bench)
    judged = {(i, n, h) for (i, n, h, _) in found([(r.doc_id, r.text) for r in whole.collect()], items)}
    assert whole.columns == docs.columns and all(not h or 20 * h < n for _, n, h in judged)
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_removed_span():
    assert decontaminate._without(b"keep, this -- drop me now; and this", [(2, 5)]) == b"keep, this -- ; and this"


# Near duplicates


def classes(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(ascii_lower(t or ""))
        k = min(n, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((up(i), up(j)))
                root[b] = a
    return {i: (len(sets[i]), up(i)) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    docs = documents(spark, texts(3), repeat=False)
    got = minhash.near_duplicates(docs.withColumn("id", F.lit("clash")), n=n).collect()
    want = classes([(r.doc_id, r.text) for r in docs.collect()], n, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.deduplicate(docs, n=n)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_chain_and_crowd(spark):
    """A chain whose ends differ, and a crowd around a middle that isn't its smallest id."""
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(base[3 * k :] + [f"x{i}" for i in range(3 * k)]) for k in range(12)]
    crowd = []
    for k in range(150):
        c = [f"c{i}" for i in range(120)]
        for j in range(9):
            c[(k * 7 + j * 13) % 120] = f"own{k}-{j}"
        crowd.append(" ".join(c))
    of = chain + crowd + [" ".join(f"c{i}" for i in range(120))]
    docs = documents(spark, of, repeat=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, n=2).collect()}
    assert got == classes([(r.doc_id, r.text) for r in docs.collect()], 2, 80)


def test_near_duplicates_odd_rows(spark):
    docs = documents(spark)
    got = minhash.near_duplicates(docs)
    assert got.count() == docs.count()
    assert [r.kept for r in got.filter("doc_id is null").collect()] == [True]
    kept = minhash.deduplicate(docs)
    assert kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    assert kept.filter("doc_id is null").count() == 1
    assert minhash.near_duplicates(empty(spark)).count() == 0 and minhash.deduplicate(empty(spark)).count() == 0


def test_fewest_matches():
    least = minhash.fewest_matches(80)
    assert len(least) == minhash.BANDS * minhash.ROWS // minhash.BATCH and all(a < b for a, b in zip(least, least[1:]))
    assert least[-1] < 0.8 * minhash.BANDS * minhash.ROWS


# Token files


def test_capitals_with_marks_keep_their_ids():
    """Letters of which only the lower-case one has a composed form with the mark."""
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    for pair in ("H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"):
        text = f"Some {pair}afiz and {pair} {pair.lower()} ABC \u00c9T\u00c9"
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(array("I", encoder.encode_pieces([text.encode()])[0])) == want


def test_new_pieces_are_encoded_together():
    """A call and a result of the library for each new piece would cost more than its merges."""
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER, most=500)
    odd = ["\u0130", "\u0130.", "a\u0130,", "\u0958,", "\u00e9t\u00e9!!", "don't.", "x\u0301.", "A<|endoftext|>B", "<|endoftext|", "|>", "\x0b", "1,2", "\u4e2d\u6587\u3002", "'s", "a\u0308***"]
    words = [f"{'abcdefghij'[i % 10]}{'\u00e9u'[i % 2]}{a}{b}{c}{end}" for i, (a, b, c) in enumerate((a, b, c) for a in "tnrs" for b in "aeiou" for c in "lmdkv") for end in ("", ".", "###", "9", "x1,")]
    texts = ["", "  ", *[" ".join(words[i::7] + odd[i:]) + "\t" * (i % 3) + "\n" for i in range(7)] * 2, " ".join(odd), odd[0]]
    asked, library = [], encoder.encode
    encoder.encode = lambda some: asked.append(len(some)) or library(some)
    got = [encoder.encode_pieces([t.encode() for t in part]) for part in (texts[:5], texts[5:], [], ["", " "])]
    want = [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in [*texts, "", " "]]
    assert [x for part in got for x in part] == want
    assert sum(asked) < 100 < len(words)


def test_settled_rows_reach_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = settle(rows.mapInArrow(sizes, "size bigint, n bigint"), "test-sizes").collect()
    assert sum(r.n for r in got) == 9000 and max(r.size for r in got) < 6 << 20


def test_token_files(spark):
    docs = documents(spark).withColumns({"part": F.lit("clash"), "tokens": F.lit(1), "at": F.lit(2)})
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(docs, path, TOKENIZER, 2, keep=["source"], drops_space=True, files=5)
    got = token_files.read_tokens(spark, path)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.tokens)) for r in rows) == want
    before = 0
    for r in rows:
        assert r.start == before and r.n_tokens == len(r.tokens)
        before += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    for r in token_files.with_crc(got).collect():
        pass
    crc = Counter((r.doc_id, r.ids_crc32) for r in token_files.with_crc(got).collect())
    assert crc == Counter((i, zlib.crc32(struct.pack(f"<{len(t)}I", *t))) for i, t in want.elements())
    whole = scratch_path(spark, "test-tokens")
    token_files.write_tokens(docs.limit(20), whole, TOKENIZER, 2, files=2)
    assert token_files.read_tokens(spark, whole).count() == 20
    file = pq.ParquetFile(sorted(__import__("glob").glob(f"{path}/*.parquet"))[0])
    column = file.metadata.row_group(0).column(0)
    assert column.has_column_index and column.has_offset_index
    none = scratch_path(spark, "test-tokens")
    token_files.write_tokens(empty(spark), none, TOKENIZER, 2)
    assert token_files.with_crc(token_files.read_tokens(spark, none)).count() == 0


# Archives


def test_archives(spark):
    long = "<html>" + "page " * 400 + "</html>"
    pages = [(i, f"http://x/{i} ä", long if i % 3 else long + str(i)) for i in range(40)] + [(100, None, None), (101, "u", ""), (102, "u", "é" * 600), (103, "u", "é" * 600), (104, "u", "s"), (105, "u", "s"), (None, "u", long)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("page", F.lit("clash")).repartition(3)
    path = scratch_path(spark, "test-archives")
    index = warc.write_archives(table, path, file_bytes=20_000)
    got = {r.page_id: r for r in warc.read_archives(spark, path, index).collect()}
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    assert len(got) == len(pages) - 1
    for i, url, h in pages:
        if i is None:
            continue
        data = (h or "").encode()
        revisit = len(data) >= 1000 and last[h] != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None)
        assert (r.payload is None) if revisit else (bytes(r.payload) == data)
    none = warc.write_archives(table.limit(0), scratch_path(spark, "test-archives"))
    assert none.count() == 0


def test_archive_frames(spark, tmp_path):
    """A leading skippable frame with the dictionary; any record is a frame that opens by itself at its offset."""
    import io

    import zstandard

    table = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 300) for i in range(50)], "page_id bigint, url string, html string").coalesce(1)
    index = warc.write_archives(table, str(tmp_path)).collect()
    data = (tmp_path / index[0].file).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE and size > 0
    r = index[17]
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompress(data[r.offset : r.offset + r.length])
    assert one.startswith(b"WARC/1.1\r\n") and f"<p>{r.page_id}</p>".encode() in one
    assert len(list(warc.records_of(io.BytesIO(data), "x"))) == 50


# Mixing


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "": 700, None: 300, "é": 0}
    table = spark.createDataFrame([("-" if k is None else "+" + k, k, v) for k, v in sizes.items()], "key string, source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(table, (5, 2, 1), 3).collect()}
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [k for k in order if k not in capped]
        level = (total - sum(capped.values())) / (sum(weight[k] for k in free) or 1)
        above = [k for k in free if weight[k] * level > 3 * sizes[k]]
        if not above:
            break
        capped |= {k: 3.0 * sizes[k] for k in above}
    want = {k: capped.get(k, weight[k] * level) for k in order}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_mix(spark):
    import math

    docs = documents(spark)
    clash = docs.withColumns({"size": F.lit("x"), "key": F.lit(1), "copies": F.lit(2), "h": F.lit(3)})
    got = mixing.mix(clash).collect()
    assert len(got) == docs.count()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= 3 and math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
        by[r.source].append(r)
    for rows in by.values():
        target, most = rows[0].target, max(r.size for r in rows)
        assert sum(r.size for r in rows) == rows[0].source_size
        assert abs(sum(r.size * r.rate for r in rows) - target) <= 1e-6 * target + 1e-9  # the dual meets its constraint
        assert abs(sum(r.size * r.copies for r in rows) - target) <= most
        tilt = {round(math.log(r.rate) / r.size, 9) for r in rows if r.size and 1e-12 < r.rate < 3}
        assert len(tilt) <= 1 or max(tilt) - min(tilt) < 1e-6  # exponential in the size
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in got)
    assert mixing.repeated(mixing.mix(docs), docs.columns).count() == sum(r.copies for r in got)
    assert mixing.mix(empty(spark)).count() == 0


# Fingerprints


def test_syncmers(spark):
    docs = documents(spark, repeat=False)
    rows = {r.doc_id: r for r in syncmers.with_anchors(docs.withColumn("i", F.lit(0)), "text", "anchors").collect()}
    for r in rows.values():
        n = len(words(r.text)) if r.text and r.text.isascii() else None
        at = [a.pos for a in r.anchors]
        assert at == sorted(at)
        if n is not None:
            assert len(at) == min(n, 1) if n < syncmers.K else len(at) >= 1
        if n and n >= 12:  # no k - s + 1 k-mers in a row without an anchor
            assert max(b - a for a, b in zip([-1, *at], [*at, n - syncmers.K + 1])) <= syncmers.K - syncmers.S + 2
    text = next(r.text for r in rows.values() if r.text and len(words(r.text)) > 80 and r.text.isascii())
    inner = " ".join(words(text)[20:70])
    both = syncmers.with_anchors(spark.createDataFrame([(text, inner)], "text string, inner string"), "text", "a")
    both = syncmers.with_anchors(both, "inner", "b").first()
    whole = {(a.pos, a.hash) for a in both.a}
    assert all((a.pos + 20, a.hash) in whole for a in both.b)  # chosen by their own words alone
    left = syncmers.with_anchors(spark.createDataFrame([(1, text)], "id int, text string"), "text", "anchors")
    right = syncmers.with_anchors(spark.createDataFrame([(2, f"other words first {inner}")], "id int, text string"), "text", "anchors")
    best = syncmers.matches(left, right, "id", "anchors").orderBy(F.desc("n")).first()
    assert best["shift"] == 3 - 20 and best["n"] >= len(both.b) - 1


def test_next_row(spark):
    docs = documents(spark, repeat=False)
    ids = sorted(r.doc_id for r in docs.collect())
    for blocks in (1, 3, 40):
        got = {r.doc_id: r.following for r in syncmers.with_next(docs.repartition(5), "doc_id", {"following": "doc_id"}, blocks=blocks).collect()}
        assert got == {a: b for a, b in zip(ids, [*ids[1:], ids[0]])}
    one = docs.limit(1)
    assert [r.f == r.doc_id for r in syncmers.with_next(one, "doc_id", {"f": "doc_id"}).collect()] == [True]
    assert syncmers.with_next(empty(spark), "doc_id", {"f": "doc_id"}).count() == 0
    assert syncmers.with_next(documents(spark), "doc_id", {"f": "doc_id"}).count() == documents(spark).count()


def test_fingerprint_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op7_fingerprints"](spark, FOLDER).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    by_text = defaultdict(set)
    for k, (i, t) in enumerate(docs):
        half, after = len(t) // 2, docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(got[i].fingerprint)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())
    long = [got[i] for i, t in docs if len(words(t)) > 60]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
