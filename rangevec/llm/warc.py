"""WARC archives over a chunked record table.

A payload travels as (record, chunk_no, data) rows of at most ``chunk_bytes``,
made by a native ``substring`` over the binary column. The writer compresses
each chunk into the record's own gzip member as it arrives and carries the
digest along, so it holds one chunk, not a record. The reader streams members
back the same way.

Which record of a group of equal payloads is the response is settled before
writing by an aggregate over digests (combined on the map side, so a payload
with a third of all rows is a few rows). Archives are written under names of
their own for each task attempt; a written manifest of committed attempts says
which of them count, so a lost executor leaves only files that nobody reads.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangevec.llm.common import short_batches, table
from rangevec.sources.scratch import materialize, scratch_path

CHUNK_BYTES = 64 << 10
FILE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def open_fs(path: str):
    """The file system and inner path of a URI or plain path."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def record_types(pages: DataFrame, min_bytes: int, id_col: str, url_col: str | None, payload_col: str) -> DataFrame:
    """Each row with payload, digest, record_type and refers_to."""
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("same", F.unhex(F.sha2("payload", 256)))
    groups = keyed.where(F.col("n_bytes") >= min_bytes).groupBy("same", "n_bytes").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").drop("n"), "payload-groups")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        keyed.withColumn("digest", F.sha1("payload"))
        .join(groups, ["same", "n_bytes"], "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .drop("same", "first_id")
    )


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk, in order within its record; a revisit, or an empty payload, is one empty chunk."""
    count = F.when(F.col("record_type") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes))).cast("int")
    rows = records.withColumn("n_chunks", count).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    data = F.when(F.col("record_type") == "response", F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.withColumn("data", data).drop("payload")


def _http(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def _head(row, date: str) -> bytes:
    own = "" if pd.isna(row.page_id) else str(int(row.page_id))
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row.record_type}",
        f"WARC-Record-ID: <{_ID}{own}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(row.url or 'urn:none', safe='%/:=&?~#+!$,;@()*[]')}",
        f"WARC-Payload-Digest: sha1:{row.digest}",
        f"WARC-Payload-Bytes: {row.n_bytes}",
    ]
    if row.record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{int(row.refers_to)}>", "Content-Length: 0"]
    else:
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(_http(row.n_bytes)) + row.n_bytes}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, level: int = 3) -> DataFrame:
    """Write chunk rows to ``.warc.gz`` files under ``path``; returns the written manifest (path, records, bytes)."""
    short_batches(chunks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_fs(path)
        store.create_dir(top, recursive=True)
        name = out = gz = digest = None
        records = written = 0

        def put(data: bytes) -> None:
            nonlocal written
            if data:
                out.write(data)
                written += len(data)

        for b in batches:
            for row in b.itertuples(index=False):
                if row.chunk_no == 0:
                    if out is not None and written >= file_bytes:
                        out.close()
                        yield pd.DataFrame({"path": [name], "records": [records], "bytes": [written]})
                        out, records, written = None, 0, 0
                    if out is None:
                        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{top}/{name.rpartition('/')[2]}", compression=None)
                    gz, digest = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    put(gz.compress(_head(row, date)))
                    if row.record_type == "response":
                        put(gz.compress(_http(row.n_bytes)))
                if row.record_type == "response":
                    digest.update(row.data)
                    put(gz.compress(row.data))
                if row.chunk_no == row.n_chunks - 1:
                    if row.record_type == "response" and digest.hexdigest() != row.digest:
                        raise ValueError(f"chunks of page {row.page_id} don't add up to its payload")
                    put(gz.compress(b"\r\n\r\n") + gz.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "records": [records], "bytes": [written]})

    return materialize(chunks.mapInPandas(run, "path string, records long, bytes long"), "warc-manifest")


def _records(stream) -> Iterator[tuple[dict, int]]:
    """Headers and block length of each record; the caller reads the block from ``stream`` before it goes on."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        yield head, int(head["content-length"])


def _payload(stream, length: int, http: bool, chunk_bytes: int) -> Iterator[bytes]:
    """The payload of a block in chunks, without its HTTP header."""
    while http and length > 0:
        line = stream.readline(length)
        length -= len(line)
        if line in (b"\r\n", b"\n", b""):
            break
    while length > 0:
        data = stream.read(min(length, chunk_bytes))
        if not data:
            raise ValueError("an archive ends within a record")
        length -= len(data)
        yield data


def _open(path: str):
    store, inner = open_fs(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=store.open_input_stream(inner, compression=None, buffer_size=1 << 20)), 1 << 20)


def _id_of(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(_ID)
    return int(text) if text else None


def _each_file(manifest: DataFrame) -> DataFrame:
    """One task for each archive; their number is bounded by the writer's tasks and file size."""
    return manifest.select("path").repartition(max(1, manifest.count()))


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives: page_id, chunk_no, data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                with _open(path) as stream:
                    for head, length in _records(stream):
                        one = _id_of(head.get("warc-record-id"))
                        for no, data in enumerate(_payload(stream, length, "http" in head.get("content-type", ""), chunk_bytes)):
                            yield pd.DataFrame({"page_id": pd.array([one], "Int64"), "chunk_no": [no], "data": [data]})

    return _each_file(manifest).mapInPandas(run, "page_id long, chunk_no long, data binary")


def read_records(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Of a response, size and digest are taken from the payload as it streams by,
    and a digest other than its header's stops the query; a revisit has its header's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})
        for b in batches:
            for path in b["path"]:
                rows = []
                with _open(path) as stream:
                    for head, length in _records(stream):
                        kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        n, digest = 0, hashlib.sha1()
                        for data in _payload(stream, length, "http" in head.get("content-type", ""), chunk_bytes):
                            n += len(data)
                            digest.update(data)
                        if kind == "revisit":
                            n = int(head["warc-payload-bytes"])
                        elif digest.hexdigest() != said:
                            raise ValueError(f"{path}: the payload of {head['warc-record-id']} differs from its digest")
                        rows.append((_id_of(head["warc-record-id"]), head["warc-target-uri"], n, said, kind, _id_of(head.get("warc-refers-to"))))
                        if len(rows) == 4096:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _each_file(manifest).mapInPandas(run, schema)


def write_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 1000, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Archive every row of ``pages``; returns the manifest.

    Null payloads count as empty. Of equal payloads of at least ``min_bytes``
    bytes the row with the largest id is the response and the others revisit
    it; smaller ones are responses. A null id revisits where its group has an
    id, else is a response. Repeated rows with the largest id are all
    responses. Other columns are not read. An empty table gives no archive.
    """
    records = record_types(pages, min_bytes, id_col, url_col, payload_col)
    return write_archives(chunk_table(records, chunk_bytes), path or scratch_path(pages.sparkSession, "warc"))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return read_records(write_pages(table(spark, sf_dir, "pages"))).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS best FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM q
"""
