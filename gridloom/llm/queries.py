"""The operators over their whole tables, with the SQL each must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import decontaminate, language_id, line_dedup, minhash, mixing, phrases, pieces_bpe, quality, spelling, syncmers, token_files, toxicity, warc
from gridloom.llm.common import crc_mod
from gridloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labelled ones."""
    labels = table(spark, folder, "labels").filter(crc_mod("doc_id", 5) != 0)
    rated = toxicity.rate(table(spark, folder, "documents"), labels, keep=["doc_id"])
    return rated.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Source mixture: words per document, its source's words and target, and the words the mix takes."""
    mixed = mixing.mix(table(spark, folder, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files written and read back."""
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2, drops_space=True)
    return token_files.with_crc(token_files.read_tokens(spark, path))


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after the removal of common lines."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, common.k IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to archives and read back."""
    path = scratch_path(spark, "archives")
    index = warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, folder, "documents")
    prototypes = language_id.learn(docs.filter(crc_mod("doc_id", 4) != 2))
    found = language_id.identify(docs, prototypes, row=F.struct("doc_id"))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Syncmer fingerprints of documents and of their edited texts."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = syncmers.with_next(
        docs, "doc_id", {"next_text": "text", "next_anchors": "anchors"}, lambda df: syncmers.with_anchors(df, "text", "anchors")
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    edited = both.withColumn("n_chars", F.char_length("text")).withColumn("edited", edited).drop("text", "next_text")
    marked = syncmers.with_anchors(edited, "edited", "edited_anchors")
    return marked.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.fingerprint(F.col("anchors")).alias("fingerprint"), syncmers.fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


@query
def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents linked by 2-word shingle sets of similarity 0.8 or more."""
    return minhash.near_duplicates(table(spark, folder, "documents"), n=2, percent=80)


ORACLES["op8_minhash"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
k AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
copies AS (SELECT doc_id AS a, rep AS b FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) JOIN k USING (s)),
r AS (SELECT e.* FROM e JOIN (SELECT DISTINCT b FROM copies) ON doc_id = b),
near AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM r p JOIN r q ON p.x = q.x AND p.doc_id < q.doc_id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
edges AS (SELECT a, b FROM copies WHERE a <> b UNION SELECT b, a FROM copies WHERE a <> b UNION SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node),
roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN roots ON node = doc_id
"""


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in documents."""
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


ORACLES["op9_decontamination"] = """
WITH words_of AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
sized AS (SELECT kind, id, coalesce(w, []) AS w, len(coalesce(w, [])) AS n FROM words_of),
item_windows AS (
  SELECT id AS item_id, least(n, 13) AS size, array_to_string(w[i:i + least(n, 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, n - least(n, 13) + 2)) AS i FROM sized WHERE kind = 'b' AND n > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT id, w, size, unnest(range(1, n - size + 2)) AS i FROM sized, sizes WHERE kind = 'd' AND n >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS all_items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT s.id AS doc_id, s.n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= s.n AS contaminated
FROM sized s LEFT JOIN hit_words h ON h.doc_id = s.id LEFT JOIN items t ON t.doc_id = s.id WHERE s.kind = 'd'
"""


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, against its language's threshold."""
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), keep=["doc_id", "lang"])


@query
def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded to pieces and decoded again."""
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    ids = pieces_bpe.encode(table(spark, folder, "documents"), model, keep=["doc_id"])
    hashed = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    return pieces_bpe.decode(hashed, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of at least six letters met five times or more, near words, and the form each goes back to."""
    return spelling.group_variants(spelling.count_words(table(spark, folder, "documents"), drop_every=199), ratio=5)


@query
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first phrases of each language."""
    return phrases.collocations(table(spark, folder, "documents")).withColumnRenamed("grp", "lang")


ORACLES["op11_phrases"] = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS g, max(a) AS around
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, g) WHERE around IS NULL OR 100 * around < 80 * a),
cuts AS (SELECT lang, g, a, cut, array_to_string(ws[1:cut], ' ') AS lg, array_to_string(ws[cut + 1:k], ' ') AS rg FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
rated AS (
  SELECT cuts.lang, cuts.g, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = lg JOIN f y ON y.lang = cuts.lang AND y.g = rg),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM best JOIN sizes USING (lang) QUALIFY rank <= 2000
"""
