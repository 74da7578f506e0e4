"""WARC archives: write web pages as records, read them back with a splittable reader."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence.operators.scale import stored
from evidence.session import delete_on_exit, work_folder

# Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
WARC_VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads from this size on are written once, later ones refer to the first.
REVISIT_BYTES = 100
#: A new archive begins when one has grown to this size; a reading task takes this many bytes of an archive.
ARCHIVE_BYTES, SPLIT_BYTES = 64 << 20, 4 << 20
READ_BYTES = 1 << 18

RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, "
    "digest_ok boolean, archive string, offset long, length long"
)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def mark_revisits(pages: DataFrame, key: str, url: str, payload: str, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload binary, digest, refers_to): refers_to is the smallest page_id with the same payload, for others than it.

    One row per digest is aggregated (partially before the shuffle), and only digests of several rows are joined
    back, so a payload that a third of all pages share costs one row a task. A null payload is empty. Rows that
    repeat the smallest page_id are all responses; a null page_id is a response unless another row of its digest has an id.
    """
    data = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), data.alias("payload"),
        F.sha2(data, 256).alias("digest"),
    )
    firsts = stored(
        rows.where(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("_digest"), "first_id")
    )
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(firsts, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "digest", first.alias("refers_to")
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as one gzip member. A revisit keeps the HTTP header of the full payload but not its body."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {IDENTICAL}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head = WARC_VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of :func:`mark_revisits` below ``folder`` and return the table of archives (archive, bytes, records).

    Every task attempt writes files of names of its own; the table lists those of the attempts that Spark
    committed, so files of lost or repeated attempts are never read. ``folder`` must be reachable by
    all executors. No rows: no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        out, name, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = encode_record(**row)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (name, size, records)], None
        if out is not None:
            out.close()
            done.append((name, size, records))
        if done:
            names, sizes, counts = zip(*done)
            yield pa.RecordBatch.from_pydict({"archive": names, "bytes": sizes, "records": counts})

    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    return stored(marked.mapInArrow(run, "archive string, bytes long, records long"))


class Window:
    """Bytes of a file by position; only the part from the last position on is kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, start: int, least: int) -> bytes:
        """Bytes from ``start``; at least ``least`` unless the file ends before."""
        if start < self.at or start > self.at + len(self.data):
            self.at, self.data = start, b""
        if start > self.at:
            self.at, self.data = start, self.data[start - self.at :]
        while len(self.data) < least and self.at + len(self.data) < self.size:
            self.file.seek(self.at + len(self.data))
            more = self.file.read(max(READ_BYTES, least - len(self.data)))
            if not more:
                break
            self.data += more
        return self.data


def read_member(window: Window, start: int) -> tuple[bytes, int] | None:
    """The content and length of the gzip member at ``start``; None if it is not one whole WARC record.

    The start of the content is decoded first, which turns down nearly all chance hits at once; then the member
    is decoded to its checksum, and the file has to end or go on with another member.
    """
    unpacker = zlib.decompressobj(31)
    parts, at = [], start
    try:
        head = unpacker.decompress(window.get(start, 64)[:64], len(WARC_VERSION))
        if not WARC_VERSION.startswith(head[: len(WARC_VERSION)]):
            return None
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            chunk = window.get(at, 1)[:READ_BYTES]
            if not chunk:
                return None
            parts.append(unpacker.decompress(chunk))
            if len(parts) == 1 and not parts[0].startswith(WARC_VERSION[: len(parts[0])]):
                return None
            at += len(chunk)
    except zlib.error:
        return None
    end = at - len(unpacker.unused_data)
    following = window.get(end, len(GZIP_MAGIC))[: len(GZIP_MAGIC)]
    if following and following != GZIP_MAGIC[: len(following)]:
        return None
    return b"".join(parts), end - start


def parse_record(content: bytes) -> dict | None:
    """Fields of a record; None if its headers are not those of a response or revisit, or its length is wrong."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] != WARC_VERSION.decode():
        return None
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    kind, length = headers.get("warc-type"), headers.get("content-length", "")
    if kind not in ("response", "revisit") or not length.isdigit() or len(rest) != int(length) + 4:
        return None
    http, _, payload = rest[: int(length)].partition(b"\r\n\r\n")

    def number(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", headers.get(name, ""))
        return int(found[1]) if found else None

    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    url = headers.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    full = re.search(rb"(?im)^Content-Length: (\d+)", http)
    revisit = kind == "revisit"
    own = None if revisit else hashlib.sha256(payload).hexdigest()
    return {
        "page_id": number("warc-record-id"), "url": url, "record_type": kind, "refers_to": number("warc-refers-to"),
        "payload": None if revisit else payload,
        "payload_bytes": int(full[1]) if revisit and full else len(payload), "payload_digest": digest if revisit else own,
        "digest_ok": revisit or own == digest,
    }


def read_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(offset, length, record) of every record that starts in [start, end); its bytes may go on beyond."""
    window, at = Window(file, size), start
    while at < end:
        data = window.get(at, min(READ_BYTES, end - at) + len(GZIP_MAGIC) - 1)
        hit = data.find(GZIP_MAGIC)
        if hit < 0:
            at += max(1, len(data) - len(GZIP_MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        member = read_member(window, at)
        record = parse_record(member[0]) if member else None
        if record is None:
            at += 1
            continue
        yield at, member[1], record
        at += member[1]


def read_archives(archives: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives (archive, bytes) below ``folder``, one row each (columns of ``RECORD``).

    Archives are cut into byte ranges without regard to records. A task looks for the gzip magic in its range, takes a
    hit only if it decodes to a whole record, and owns the records that start inside; so each record is read once
    wherever the cuts fall. ``payload`` is null for revisits, whose size and digest come from their headers.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = archives.where("bytes > 0").select("archive", "bytes", F.explode(starts).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        for batch in batches:
            for name, size, start in zip(batch["archive"], batch["bytes"], batch["start"]):
                rows, held = [], 0
                with system.open_input_file(f"{base}/{name}") as file:
                    for offset, length, record in read_range(file, size, start, min(start + split_bytes, size)):
                        rows.append(record | {"archive": name, "offset": offset, "length": length})
                        held += len(record["payload"] or b"")
                        if held > READ_BYTES * 32:
                            yield as_frame(rows)
                            rows, held = [], 0
                yield as_frame(rows)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(parts, "archive", "start").mapInPandas(run, RECORD)


def as_frame(rows: list[dict]) -> pd.DataFrame:
    names = [part.split()[0] for part in RECORD.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def resolve_payloads(records: DataFrame) -> DataFrame:
    """The records with the payload of the response that a revisit refers to filled in."""
    responses = records.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(
        F.first("payload").alias("_payload")
    ).select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "_payload")
    match: Column = (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    joined = records.join(responses, match, "left")
    return joined.withColumn("payload", F.coalesce("payload", "_payload")).select(*records.columns)


def round_trip(spark: SparkSession, pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Write the pages to archives in the shared folder and read all records back."""
    folder = work_folder(spark, "warc")
    delete_on_exit(spark, folder)
    archives = write_archives(mark_revisits(pages, key, url, payload), folder)
    return read_archives(archives, folder)
