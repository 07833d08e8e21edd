"""WARC archives whose records are Zstandard frames of their own, with one dictionary per file in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridloom.llm.common import join_unique, pieces, utf8
from gridloom.session import settle

#: Fixed by the format: the skippable frame that holds a dictionary, and the magic numbers inside.
SKIPPABLE, FRAME_MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _dictionary(records: list[bytes], most: int, sampled: int) -> bytes:
    """A dictionary from evenly spaced records, ``sampled`` bytes of them at most; of few records, their own bytes."""
    step = max(1, -(-sum(map(len, records)) // sampled))
    chosen = [r[: 128 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(most, chosen).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b"".join(chosen)[-most:]


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _header(lines: list[tuple[str, str | None]], body: bytes) -> bytes:
    text = "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    return f"WARC/1.1\r\n{text}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _record(page: int, url: str | None, payload: bytes, keeper: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header alone."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = None if url is None else urllib.parse.quote(url, safe="%:/?#[]@!$&'()*+,;=-._~")
    lines = [
        ("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response"),
    ]
    if keeper is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{keeper}>")]
    return _header(lines, http if keeper is not None else http + payload)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000,
    date: str = "2000-01-01T00:00:00Z", file_bytes: int = 24 << 20, dictionary_bytes: int = 64 << 10, sampled_bytes: int = 4 << 20, level: int = 6,
) -> DataFrame:
    """Write a record for each page and return the index: id, ``file``, ``offset``, ``length`` (of the record's frame).

    Of pages with equal payloads (the html in UTF-8) of at least ``min_revisit`` bytes, that with the largest id is a
    response and the others are revisits that refer to it; shorter payloads are all responses. Payload digests are
    counted with map-side maxima; what a digest's keeper is comes to the pages by ``join_unique``.

    Each task gathers ``file_bytes`` of records, trains a dictionary of ``dictionary_bytes`` on evenly spaced ones, and
    writes it as a leading skippable frame, then each record as a frame of its own. File names are unique for each
    attempt, and the index names the files of the attempts that count: it is a table written by Spark. Files of lost
    attempts stay unnamed. ``path``: a folder of a file system that all executors reach.

    Null html: an empty payload. Null url: no target URI. Null ids: the row is left out, as a record needs a name. Rows
    that repeat an id and payload are responses both. Other columns aren't read. An empty table gives an empty index.
    """
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    sha = F.sha1("html")
    halves = [F.conv(F.substring(sha, a, 15), 16, 10).cast("long").alias(f"d{i}") for i, a in enumerate((1, 16))]
    keyed = rows.withColumns({f"d{i}": h for i, h in enumerate(halves)}).withColumn("d2", F.conv(F.substring(sha, 31, 10), 16, 10).cast("long"))
    long = F.octet_length("html") >= min_revisit
    keepers = settle(
        keyed.filter(long).groupBy("d0", "d1", "d2").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "keepers"
    )
    met = join_unique(keyed, keepers, ["d0", "d1", "d2"], "n", [F.col("page")])
    refers = F.when(long & (F.col("keeper") != F.col("page")), F.col("keeper"))
    todo = met.select("page", "url", "html", refers.alias("keeper"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)

        def flush(ids: list[int], records: list[bytes]) -> pa.RecordBatch:
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            dictionary = _dictionary(records, dictionary_bytes, sampled_bytes)
            packer = zstandard.ZstdCompressor(level=level, dict_data=_loaded(dictionary))
            frames = [packer.compress(r) for r in records]
            at, offsets = 8 + len(dictionary), []
            for f in frames:
                offsets.append(at)
                at += len(f)
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                for f in frames:
                    out.write(f)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(offsets, pa.int64()), pa.array(list(map(len, frames)), pa.int64())],
                names=["page", "file", "offset", "length"],
            )

        ids, records, size = [], [], 0
        for batch in batches:
            for part in pieces(batch, 200):
                for page, url, payload, keeper in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), part.column(3).to_pylist()):
                    record = _record(page, url, payload, keeper, date)
                    ids.append(page)
                    records.append(record)
                    size += len(record)
                    if size >= file_bytes:
                        yield flush(ids, records)
                        ids, records, size = [], [], 0
        if ids:
            yield flush(ids, records)

    index = settle(todo.mapInArrow(write, "page bigint, file string, offset bigint, length bigint"), "warc-index")
    return index.select(F.col("page").alias(id_col), "file", "offset", "length")


def records_of(data: io.BufferedIOBase, where: str) -> Iterator[dict]:
    """The records of one archive, frame by frame: ``headers`` (lower-case names) and ``body``."""
    magic, size = struct.unpack("<II", data.read(8))
    if magic != SKIPPABLE:
        raise ValueError(f"{where} has no leading dictionary frame")
    dictionary = data.read(size)
    if dictionary[:4] == FRAME_MAGIC:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unpacker, rest = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary)), b""
    while True:
        if not rest and not (rest := data.read(1 << 20)):
            return
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := data.read(1 << 20)):
                raise ValueError(f"{where} ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        length = int(headers["content-length"])
        if not first.startswith("WARC/") or body[length:] != b"\r\n\r\n":
            raise ValueError(f"{where} holds a broken record")
        yield {"headers": headers, "body": body[:length]}


def read_archives(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The records of the archives named by ``file``: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest`` (hex SHA-1),
    ``record_type``, ``refers_to``, ``payload`` (null for revisits). Archives are dealt over the tasks and streamed; each
    response's payload is checked against its digest."""
    names = files.select("file").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = [x.name for x in T.StructType.fromDDL(schema).fields]

    def number(urn: str | None) -> int | None:
        return None if urn is None else int(urn.strip("<>").rpartition(":")[2])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out: list[tuple] = []
                size = 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as data:
                    for record in records_of(data, name):
                        h, (http, _, payload) = record["headers"], record["body"].partition(b"\r\n\r\n")
                        length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        response = h["warc-type"] == "response"
                        if response and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: {h['warc-record-id']} differs from its digest")
                        out.append((number(h["warc-record-id"]), h.get("warc-target-uri"), length, digest, h["warc-type"], number(h.get("warc-refers-to")), payload if response else None))
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=columns)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=columns)

    return names.mapInArrow(read, schema)
