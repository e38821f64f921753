"""WARC archives as chunk tables: payloads are written and read back in chunks, with digests that grow along."""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinetide.llm.common import shared_path, small_batches, staged

CHUNK = 1 << 16  # characters of a payload that are encoded at once, and bytes that are read at once
ARCHIVE = 64 << 20  # bytes on storage after which a task begins another archive
DATE = "2000-01-01T00:00:00Z"  # records of equal input are equal
LEAST_REVISIT = 0  # payload bytes from which a repeated payload is a revisit

CHUNKS = "page_id long, ordinal long, chunk int, bytes long, digest string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload_chunks(text: str) -> Iterator[tuple[int, bytes, str, bool]]:
    """(chunk number, bytes, digest of everything up to it, whether it is the last) of a payload; an empty one is one empty chunk."""
    running = hashlib.sha1()
    starts = range(0, len(text), CHUNK) or range(1)
    for number, at in enumerate(starts):
        data = text[at:at + CHUNK].encode("utf-8", "surrogatepass")
        running.update(data)
        yield number, data, base32(running.copy().digest()), at + CHUNK >= len(text)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of each page's payload, from its chunks."""
    for batch in batches:
        rows = []
        for text in batch.column("html").to_pylist():
            size, digest = 0, ""
            for _, data, digest, _ in payload_chunks(text or ""):
                size += len(data)
            rows.append((size, digest))
        sizes, digests = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["page_id", "row", "payload_bytes", "payload_digest"])


def record_types(sizes: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Add record_type and refers_to to (page_id, row, payload_bytes, payload_digest).

    The response of a payload is its largest page_id, null ids first; of repeated rows with that id, the one with the
    largest row number. A group is one aggregated row before it is joined, so one payload may have any number of pages.
    """
    key = ["payload_digest", "payload_bytes"]
    first = sizes.groupBy(*key).agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "row")).alias("m"), F.max("page_id").alias("refers_to"))
    joined = sizes.join(first, key)
    response = (F.col("row") == F.col("m.row")) | (F.col("payload_bytes") < least)
    return joined.select("page_id", "row", *reversed(key), F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("refers_to")).alias("refers_to"))


def _name(page: int | None, row: int) -> str:
    return f"urn:page:{'' if page is None else page}:{row}"


def _head(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", length)])
    return f"WARC/1.1\r\n{lines}\r\n".encode()


def _open(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def _write(folder: str):
    """Write each page's record to archives in the shared folder. Names are new on every attempt, and only the rows of the
    attempt that counts name its archives, so a lost task leaves nothing that is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, path = _open(folder)
        out, name, done = None, "", []
        for batch in batches:
            for page, row, url, html, size, digest, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "row", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"))):
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(name, compression=None)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                target = (url or "").translate({13: "%0D", 10: "%0A", 32: "%20"})
                fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_name(page, row)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if kind == "revisit":
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers is None else refers}>")]
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # each record is a gzip member of its own
                write = lambda data, packer=packer: out.write(packer.compress(data))  # noqa: E731, B023
                write(_head(fields, len(http) + (size if kind == "response" else 0)) + http)
                if kind == "response":
                    for _, data, _, _ in payload_chunks(html or ""):
                        write(data)
                write(b"\r\n\r\n")
                out.write(packer.flush())
                if out.tell() >= ARCHIVE:
                    done.append((name, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, out.tell()))
            out.close()
        if done:
            names, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["path", "bytes"])
    return run


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Chunk rows (record id, type, refers to, stated payload digest and size, chunk number, bytes, running digest, last) of an archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            fields[key.lower()] = value.strip()
        left, stated = int(fields["content-length"]), 0
        while left > 0:
            line = stream.readline()
            left -= len(line)
            if not line.strip():
                break
            key, _, value = line.decode().partition(":")
            stated = int(value) if key.lower() == "content-length" else stated
        running, number, got = hashlib.sha1(), 0, 0
        head = (fields["warc-record-id"].strip("<>"), fields["warc-type"], fields.get("warc-refers-to", "").strip("<>"), fields["warc-payload-digest"].partition(":")[2], stated)
        while True:
            data = stream.read(min(CHUNK, left))
            if left and not data:
                raise ValueError(f"archive ends inside {head[0]}")
            left, got = left - len(data), got + len(data)
            running.update(data)
            yield *head, number, data, base32(running.copy().digest()), left == 0
            number += 1
            if not left:
                break


CHUNK_SCHEMA = "page_id long, row long, record_type string, refers_to long, stated_digest string, stated_bytes long, chunk int, bytes long, digest string, last boolean"


def _read(folder: str, keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        number = lambda s: int(s) if s else None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * keep_bytes
        names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")] + ["data"] * keep_bytes
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with system.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), CHUNK) as stream:
                    for name, kind, refers, stated, size, chunk, data, digest, last in read_records(stream):
                        page, row = name.split(":")[2:]
                        rows.append((number(page), int(row), kind, number(refers.rpartition(":")[2]), stated, size, chunk, len(data), digest, last, *[data] * keep_bytes))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return run


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT) -> tuple[str, DataFrame]:
    """Write one record per row of pages (page_id, url, html); the folder and the table (path, bytes) of the archives."""
    spark = pages.sparkSession
    small_batches(spark)
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), "html"]
    pages = staged(pages.select(*columns).withColumn("row", F.monotonically_increasing_id()), "pages", compression="zstd")
    sizes = pages.select("page_id", "row", "html").mapInArrow(_digests, "page_id long, row long, payload_bytes long, payload_digest string")
    kinds = record_types(staged(sizes, "digests"), least).drop("page_id")
    folder = shared_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    # revisits are written without their payload
    records = pages.join(kinds, "row").withColumn("html", F.when(F.col("record_type") == "response", F.col("html")))
    return folder, staged(records.mapInArrow(_write(folder), "path string, bytes long"), "archives")


def read_archives(folder: str, archives: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """The chunk table of archives: one row per record and chunk, the digest of the payload up to each chunk, the bytes if asked for."""
    spread = archives.repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(_read(folder, keep_bytes), CHUNK_SCHEMA + ", data binary" * keep_bytes)


def archive_round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, chunks) of each row of pages, read back from the archives.

    Null html is an empty payload, null url an empty address, a null page_id stays null. Equal payloads have one response,
    the largest page_id (of repeated rows the last); the others revisit it and state the payload's size and digest. What a
    response's chunks add up to is checked against its headers, a difference raises an error. Other columns are not read; an
    empty table gives an empty one.
    """
    chunks = read_archives(*write_archives(pages, least))
    whole = F.when(F.col("record_type") == "revisit", F.col("stated_digest")).otherwise(F.max_by("digest", "chunk"))
    size = F.when(F.col("record_type") == "revisit", F.col("stated_bytes")).otherwise(F.sum("bytes"))
    found = chunks.groupBy("row", "page_id", "record_type", "refers_to", "stated_digest", "stated_bytes").agg(size.alias("payload_bytes"), whole.alias("payload_digest"), F.count("*").alias("chunks"))
    same = (F.col("payload_bytes") == F.col("stated_bytes")) & (F.col("payload_digest") == F.col("stated_digest"))
    checked = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("string"))
    return found.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", F.when(F.col("record_type") == "response", F.col("chunks")).otherwise(F.lit(0)).alias("chunks"))
