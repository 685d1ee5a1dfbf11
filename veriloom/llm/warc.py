"""WARC archives: writing, normalising whole-file gzip streams to one member a record, reading by offset index.

An archive that is one gzip stream can only be read from its start. The normaliser inflates such a stream once,
in blocks, writes every record again as a gzip member of its own and puts a sidecar beside the file with each
member's offset and length, from which single records are then read.

Each file is written under a name of its own attempt and renamed when whole, so a task that is lost and run
again leaves the same files. Records stream through in blocks: memory holds one block, not one record's archive.

Defined cases: null html is an empty payload; payloads under ``least`` bytes are always response records; where
rows repeat a page_id with the same payload, each row that holds the group's smallest page_id is a response and the
others revisit it; a null page_id comes after all others; an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build, filter_pages, probe
from .common import fresh_path, join_groups, materialize

BLOCK = 1 << 20
ARCHIVE_BYTES = 256 << 20
LEAST = 100


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to for every row.

    Groups of equal payloads are found on digests; only rows that a Bloom filter of the repeated digests lets through
    meet their group in a join, so the other payloads never shuffle.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"),
    )
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    narrow = rows.select("page_id", "digest", F.octet_length("payload").alias("bytes"))
    groups = materialize(
        narrow.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("size")).where("size > 1"),
        "payload-groups",
    )
    pages_n = filter_pages(groups.count())
    bitmaps = materialize(build(groups.select(F.xxhash64("digest").alias("h")), "h", pages_n), "payload-filter")
    probed = probe(rows.withColumn("h", F.xxhash64("digest")), "h", pages_n, bitmaps, "hit")
    alone = probed.where("not hit").select(*rows.columns, *[F.lit(None).cast("long").alias(c) for c in ("first", "size")])
    joined = alone.unionByName(join_groups(probed.where("hit").select(*rows.columns), groups, "digest", "size", pages.count()))
    again = F.col("size").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", F.lower(F.hex("digest")).alias("digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the digest and length of the payload but no body."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def split_records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Records of an uncompressed WARC stream: headers, and the raw bytes of the whole record in blocks.

    The bytes of a record must be used up before the next record is asked for.
    """
    held = bytearray()

    def more() -> bool:
        block = next(blocks, None)
        if block is None:
            return False
        held.extend(block)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        head = bytes(held[:end])
        fields = parse_head(head)
        left = end + 4 + int(fields["Content-Length"]) + 4

        def body(left=left) -> Iterator[bytes]:
            while left:
                if not held and not more():
                    raise ValueError("the archive ends inside a record")
                part = bytes(held[:left])
                del held[: len(part)]
                left -= len(part)
                yield part

        yield fields, body()


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip stream (of one member or many) in bounded blocks."""
    z = zlib.decompressobj(31)
    while raw := stream.read(BLOCK):
        while raw:
            yield z.decompress(raw, 4 * BLOCK)
            if z.eof:
                raw = z.unused_data
                z = zlib.decompressobj(31)
            else:
                raw = z.unconsumed_tail


class _WholeFile:
    """Writes to a name of this attempt; close() gives the file its final name."""

    def __init__(self, folder: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.final, self.name = f"{base}/{name}", name
        self.attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(base, recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.attempt, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.attempt, self.final)


def _uri(path: str) -> str:
    return path if "://" in path else (path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def write_monolithic(records: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Each task writes its records to archives that are one gzip stream each; gives (name, records)."""

    def write(batches):
        from pyspark import TaskContext

        out, pack, n, k, raw = None, None, 0, 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out, pack, n, raw = _WholeFile(folder, f"part-{part:06d}-{k:04d}.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"])
                out.write(pack.compress(data))
                n, raw = n + 1, raw + len(data)
                if raw >= most:
                    out.write(pack.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"name": [out.name], "records": [n]})
                    out, k = None, k + 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [out.name], "records": [n]})

    return records.mapInArrow(write, "name string, records long")


def normalise_archive(source: str, target: str, name: str, level: int = 6) -> int:
    """Rewrite one archive, each record as its own gzip member, with ``name``.idx beside it; gives the records."""
    fs, base = pafs.FileSystem.from_uri(source)
    out, index, n = _WholeFile(target, name), _WholeFile(target, f"{name}.idx"), 0
    with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
        for fields, body in split_records(inflate(stream)):
            start, pack = out.size, zlib.compressobj(level, zlib.DEFLATED, 31)
            for part in body:
                out.write(pack.compress(part))
            out.write(pack.flush())
            index.write((json.dumps({"id": fields.get("WARC-Record-ID"), "offset": start, "length": out.size - start}) + "\n").encode())
            n += 1
    out.close()
    index.close()
    return n


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Normalise the archives that ``manifest`` names, one at a time in each task; gives (name, records)."""

    def work(batches):
        for batch in batches:
            for name, records in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
                n = normalise_archive(source, target, name)
                if n != records:
                    raise ValueError(f"{name}: {records} records written, {n} found")
                yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]})

    return manifest.mapInArrow(work, "name string, records long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long, archive string"


def read_by_index(manifest: DataFrame, folder: str, rows: int = 2000) -> DataFrame:
    """One row a record, each read alone from its member by the sidecar's offset and length."""

    def work(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "length", "archive"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        fs, base = pafs.FileSystem.from_uri(folder)

        def packed(got):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                got = []
                with fs.open_input_stream(f"{base}/{name}.idx", compression=None, buffer_size=BLOCK) as index, fs.open_input_file(f"{base}/{name}") as archive:
                    lines, tail = b"", True
                    while tail:
                        tail = index.read(BLOCK)
                        lines += tail
                        *whole, lines = lines.split(b"\n") if tail else [*lines.split(b"\n"), b""]
                        for line in filter(None, whole):
                            at = json.loads(line)
                            archive.seek(at["offset"])
                            raw = zlib.decompress(archive.read(at["length"]), 31)
                            head, _, rest = raw.partition(b"\r\n\r\n")
                            fields = parse_head(head)
                            body = rest[: int(fields["Content-Length"])]
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                            if fields["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])):
                                raise ValueError(f"{name}: the payload at {at['offset']} differs from its digest")
                            page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                            got.append((page and int(page), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], refers and int(refers), at["offset"], at["length"], name))
                            if len(got) >= rows:
                                yield packed(got)
                                got = []
                if got:
                    yield packed(got)

    return manifest.mapInArrow(work, READ)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them and read every record back by its offset."""
    spark = pages.sparkSession
    folder = _uri(folder or fresh_path(spark, "warc"))
    mono, members = f"{folder}/monolithic", f"{folder}/members"
    written = materialize(write_monolithic(classify(pages), mono), "archives")
    tasks = max(1, min(written.count(), 10_000))
    normal = materialize(normalise(written.repartition(tasks, "name"), mono, members), "normalised")
    return read_by_index(normal.repartition(tasks, "name"), members)
