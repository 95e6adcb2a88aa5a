"""Deterministic sharded WARC writer and reader.

1. Payload digests are grouped; in a group of equal payloads the smallest page id is the
   response and the others become revisits without a body.
2. Cut points: page ids and payload sizes are sorted, sizes are summed up (running sums
   per partition plus prefix sums over partitions), and a shard begins at every full
   ``shard_bytes``. So the shards follow from the data alone, not from sampling.
3. A task writes whole shards in page order, one gzip member per record, and rolls to the
   next file once the compressed size is reached. Headers, digests and record ids are
   made anew from the row, dates are a parameter: equal input gives equal bytes.
4. A file is written under a name of the task attempt and then moved; the manifest lists
   the files of a complete run, and readers read nothing else. A repeated task writes
   the same bytes to the same name.

Cases: a null payload counts as empty; rows of equal id follow each other by digest, the
first of them answers for their payload; a null id comes first and its record has no
page number; a null url becomes the record's own id, line breaks in a url are escaped;
an empty table gives a manifest without files; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.common import blobs, file_system, materialize, qualified, write_manifest

LEAST_REVISIT_BYTES = 100
# Read at once; what follows a record in a piece is copied with it.
PIECE_BYTES = 1 << 16
# A row of the table of repeated digests takes some 150 bytes when broadcast.
BROADCAST_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcSpec:
    """Date of all records, compressed bytes after which a file is closed, and the
    payload bytes of a shard: a 256th of all, within the two bounds."""

    date: str = "2000-01-01T00:00:00Z"
    roll_bytes: int = 1 << 30
    least_shard_bytes: int = 1 << 18
    most_shard_bytes: int = 1 << 30


def http_head(payload_bytes: int) -> bytes:
    return (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()


def headed(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [*headers, ("Content-Length", len(block))]
    return (
        b"WARC/1.1\r\n"
        + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace")
        + b"\r\n" + block + b"\r\n\r\n"
    )


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page is None else page}:{digest[:16]}>"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, spec: WarcSpec) -> bytes:
    own = record_id(page, digest)
    target = own[1:-1] if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    block = http_head(len(payload)) + (b"" if revisit else payload)
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own),
        ("WARC-Date", spec.date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        headers.append(("X-Page-ID", page))
    if revisit:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", refers_to),
        ]
    return headed(headers, block)


def info_record(name: str, spec: WarcSpec) -> bytes:
    headers = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"),
        ("WARC-Date", spec.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
    ]
    return headed(headers, b"format: WARC File Format 1.1\r\n")


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ShardFiles:
    """The files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, spec: WarcSpec) -> None:
        self.system, self.path = file_system(folder)
        self.shard, self.spec = shard, spec
        self.mark = f".try-{TaskContext.get().taskAttemptId()}"
        self.done: list[tuple[int, str, int, int]] = []
        self.out = None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{len(self.done):04d}.warc.gz"
            self.out = self.system.open_output_stream(f"{self.path}/{self.name}{self.mark}", compression=None)
            self.records = self.size = 0
            self.put(info_record(self.name, self.spec))
        self.put(record)
        self.records += 1
        if self.size >= self.spec.roll_bytes:
            self.close()

    def put(self, record: bytes) -> None:
        self.size += self.out.write(member(record))

    def close(self) -> list[tuple[int, str, int, int]]:
        if self.out is not None:
            self.out.close()
            final = f"{self.path}/{self.name}"
            self.system.move(f"{final}{self.mark}", final)
            self.done.append((self.shard, self.name, self.records, self.size))
            self.out = None
        return self.done


def shard_starts(pages: DataFrame, id_col: str, payload: Column, spec: WarcSpec) -> list[int]:
    """The smallest page id of every shard but the first; one number per shard."""
    sizes = pages.select(F.col(id_col).cast("long").alias("page"), F.octet_length(payload).cast("long").alias("size"))
    ordered = materialize(
        sizes.where("page IS NOT NULL").repartitionByRange("page").select("*", F.spark_partition_id().alias("part")),
        "warc-sizes",
    )
    parts = ordered.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()
    total, bases = 0, []
    for p in parts:
        bases.append((p.part, total))
        total += p.size
    if not bases:
        return []
    shard_bytes = min(max(total // 256, spec.least_shard_bytes), spec.most_shard_bytes)
    before = F.sum("size").over(
        Window.partitionBy("part").orderBy("page").rangeBetween(Window.unboundedPreceding, -1)
    )
    base = pages.sparkSession.createDataFrame(bases, "part int, base bigint")
    starts = (
        ordered.withColumn("before", before)
        .join(F.broadcast(base), "part")  # one row per partition
        .groupBy(F.floor((F.col("base") + F.coalesce("before", F.lit(0))) / shard_bytes).alias("shard"))
        .agg(F.min("page").alias("page"))
    )
    return sorted(r.page for r in starts.collect())[1:]


def classified(pages: DataFrame, id_col: str, url_col: str, payload: Column) -> DataFrame:
    """(page, url, html, digest, refers_to) of every row."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.col(url_col).alias("url"),
        payload.alias("html"),
        F.sha2(payload, 256).alias("digest"),
    )
    large = F.octet_length("html") >= LEAST_REVISIT_BYTES
    groups = materialize(
        rows.where(large)
        .groupBy("digest")
        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first"),
        "warc-groups",
    )
    small = groups.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    groups = F.broadcast(groups) if small else groups
    # Which of several rows of the smallest id answers is settled where they meet.
    return rows.join(groups, "digest", "left")


def write_warc(
    pages: DataFrame,
    folder: str,
    spec: WarcSpec = WarcSpec(),
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> dict:
    """Write ``pages`` as WARC files and a manifest, which is returned as well."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    folder = qualified(pages.sparkSession, folder)
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    starts = np.array(shard_starts(pages, id_col, payload, spec), np.int64)

    @F.arrow_udf("int")
    def shard_of(page: pa.Array) -> pa.Array:
        least = page.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(starts, least, "right").astype(np.int32))

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last = None, (None, None)
        done: list[tuple[int, str, int, int]] = []
        for batch in source:
            columns = [batch.column(n).to_pylist() for n in ("shard", "page", "url", "digest", "first")]
            for shard, page, url, digest, first, html in zip(*columns, blobs(batch.column("html")), strict=True):
                if files is None or files.shard != shard:
                    done += files.close() if files else []
                    files = ShardFiles(folder, shard, spec)
                # The response of a group is the first row with its smallest id.
                again = first is not None and (page != first or last == (page, digest))
                files.add(page_record(page, url, html, digest, first if again else None, spec))
                last = (page, digest)
        done += files.close() if files else []
        names = ("shard", "name", "records", "bytes")
        columns = list(zip(*done, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    rows = classified(pages, id_col, url_col, payload).withColumn("shard", shard_of("page"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "page", "digest")
    files = dealt.mapInArrow(write, "shard int, name string, records bigint, bytes bigint").collect()
    manifest = {
        "format": "WARC/1.1",
        "files": sorted(({"name": f.name, "records": f.records, "bytes": f.bytes} for f in files), key=lambda f: f["name"]),
    }
    write_manifest(f"{folder}/manifest.json", manifest)
    return manifest


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records of a gzip stream, one after the other. A stream
    that ends inside a record is an error."""
    unpacker, parts = zlib.decompressobj(31), []
    piece = stream.read(PIECE_BYTES)
    while piece:
        parts.append(unpacker.decompress(piece))
        piece = unpacker.unused_data
        if unpacker.eof:
            head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
            lines = [x.partition(": ") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
            headers = {k: v for k, _, v in lines}
            size = int(headers["Content-Length"])
            if len(tail) < size:
                raise ValueError(f"incomplete block of {headers['WARC-Record-ID']}")
            yield headers, tail[:size]
            unpacker, parts = zlib.decompressobj(31), []
        piece = piece or stream.read(PIECE_BYTES)
    if parts:
        raise ValueError("the file ends inside a record")


def parsed(headers: dict[str, str], block: bytes) -> tuple | None:
    """(page_id, url, payload bytes, digest, type, refers_to, payload) of a page record."""
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged block of {headers['WARC-Record-ID']}")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
    return (
        None if page is None else int(page), headers["WARC-Target-URI"], size, digest, kind,
        None if refers is None else int(refers), payload if kind == "response" else None,
    )


READ_FIELDS = (
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()),
)
READ_SCHEMA = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, payload binary"
)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of all files of the manifest; digests are verified. A file that is
    missing, damaged, or has another size or number of records than the manifest says is
    an error."""
    folder = qualified(spark, folder)
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/manifest.json") as file:
        listing = [(f["name"], f["records"], f["bytes"]) for f in json.loads(file.read())["files"]]
    if not listing:
        return spark.createDataFrame([], READ_SCHEMA)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, (_, k) in zip(columns, READ_FIELDS, strict=True)],
            names=[n for n, _ in READ_FIELDS],
        )

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = file_system(folder)
        for batch in source:
            for name, n_records, n_bytes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if files.get_file_info(f"{where}/{name}").size != n_bytes:
                    raise ValueError(f"incomplete {name}: not the {n_bytes} bytes of the manifest")
                rows, size, seen = [], 0, 0
                with files.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        row = parsed(headers, block)
                        if row is None:
                            continue
                        seen += 1
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(block)
                        if size > 1 << 24:
                            yield batch_of(rows)
                            rows, size = [], 0
                if seen != n_records:
                    raise ValueError(f"incomplete {name}: {seen} of {n_records} records")
                if rows:
                    yield batch_of(rows)

    listed = spark.createDataFrame(listing, "name string, records bigint, bytes bigint")
    return listed.repartition(min(len(listing), 10_000)).mapInArrow(read, READ_SCHEMA)
