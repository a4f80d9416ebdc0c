"""WARC archives: deterministic sharded writing with revisits, and reading back."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, table

#: A shard's file is closed at the first record that takes it to this compressed size.
ROLL_BYTES = 64 << 20
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, temporary string, shard long, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; ids and dates come from the row, so that the same rows give the same bytes."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    number = "" if page_id is None else str(page_id)
    own = uuid.uuid5(NAMESPACE, f"{kind}\n{number}\n{target}\n{digest}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", number), ("X-Payload-Length", str(length)),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, target: str, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record for each row into gzip WARC shards under ``target`` (any store of pyarrow's file systems).

    Of rows with equal payloads of at least ``min_revisit_bytes`` the largest page id is the response and the others
    revisit it; of rows that share that largest id too, the first is the response. A null html is an empty payload; a
    null url is empty; null ids sort first and are a response only if no row with the payload has an id. Returns
    the manifest: file, shard, records, bytes, sha256. An empty table gives an empty manifest.

    Payload owners are found by a max with map-side combine over (digest, length), so copies meet only as sums. Each page
    crosses the network once, range-partitioned by id; its owner's id comes along as a small row just before it. A
    task writes only temporary names that hold its attempt; the driver renames what the successful attempts report,
    and writes the manifest last, so a lost executor leaves no half-written archive under a final name.
    """
    spark = pages.sparkSession
    root = target.rstrip("/")
    fs.FileSystem.from_uri(root)[0].create_dir(fs.FileSystem.from_uri(root)[1], recursive=True)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    keys = base.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    owners = keys.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    notes = keys.distinct().join(owners, ["digest", "size"]).select("page_id", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("html"), "digest", "owner")
    rows = base.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit("").alias("digest"), F.lit(None).cast("long").alias("owner"))
    dealt = notes.unionByName(rows).repartitionByRange(partitions(spark), "page_id").sortWithinPartitions("page_id", "kind", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(root)
        context = TaskContext.get()
        shard, attempt = context.partitionId(), f"{context.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        done: list[tuple] = []
        out, state = None, {}
        now: object = ()
        owner_of: dict[str, int | None] = {}
        answered: set[str] = set()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((state["file"], state["temporary"], shard, state["records"], state["bytes"], state["sha"].hexdigest()))
                out = None

        for batch in batches:
            for page_id, kind, url, text, digest, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page_id != now:
                    now, owner_of, answered = page_id, {}, set()
                if kind == 0:
                    owner_of[digest] = owner
                    continue
                payload = text.encode()
                raw = hashlib.sha1(payload)
                hexed = raw.hexdigest()
                refers = owner_of.get(hexed, page_id)
                first = hexed not in owner_of or refers == page_id and hexed not in answered
                answered.add(hexed)
                if out is None:
                    name = f"part-{shard:06d}-{len(done):05d}.warc.gz"
                    state = {"file": name, "temporary": f".{name}.{attempt}.tmp", "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                    out = store.open_output_stream(f"{place}/{state['temporary']}", compression=None)
                data = member(record("response" if first else "revisit", page_id, url, payload, base64.b32encode(raw.digest()).decode(), len(payload), None if first else refers))
                out.write(data)
                state["sha"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= roll_bytes:
                    close()
        close()
        columns = list(zip(*done, strict=True)) or [[] for _ in range(6)]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "temporary", "shard", "records", "bytes", "sha256"])

    # A row for each 64 MB; sorted here, as a sort in Spark would sample, and so write, the files once more.
    written = sorted(dealt.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.file)
    store, place = fs.FileSystem.from_uri(root)
    for row in written:
        store.move(f"{place}/{row.temporary}", f"{place}/{row.file}")
    for left in store.get_file_info(fs.FileSelector(place)):
        if left.base_name.startswith(".") and left.base_name.endswith(".tmp"):  # of attempts that were lost
            store.delete_file(left.path)
    listing = [{"file": r.file, "shard": r.shard, "records": r.records, "bytes": r.bytes, "sha256": r.sha256} for r in written]
    with store.open_output_stream(f"{place}/.manifest.tmp") as out:
        out.write("".join(json.dumps(x, sort_keys=True) + "\n" for x in listing).encode())
    store.move(f"{place}/.manifest.tmp", f"{place}/manifest.jsonl")
    return spark.createDataFrame([(r.file, r.shard, r.records, r.bytes, r.sha256) for r in written], "file string, shard long, records long, bytes long, sha256 string")


def _records(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unzip, held = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            held.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(held)
                unzip, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("the archive ends inside a record")


def read_archives(spark: SparkSession, target: str, payloads: bool = True) -> DataFrame:
    """Records of the archives that the manifest names, parsed from the files: page_id, url, record_type,
    payload_bytes and payload_digest (of the full payload), refers_to, payload (null for revisits, or if not asked for).

    Block and payload digests of responses are computed again and must agree with the headers.
    """
    root = target.rstrip("/")
    files = spark.read.schema("file string").json(f"{root}/manifest.jsonl").select("file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(root)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held: list[tuple] = []
                size = 0
                with store.open_input_stream(f"{place}/{file}", compression=None) as stream:
                    for data in _records(stream):
                        head, _, rest = data.partition(b"\r\n\r\n")
                        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        block = rest[: int(fields["Content-Length"])]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}" or fields["WARC-Type"] == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"{file}: a digest does not agree with its record")
                        number, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                        held.append((int(number) if number else None, fields["WARC-Target-URI"], fields["WARC-Type"], int(fields["X-Payload-Length"]), digest, int(refers) if refers else None, payload if payloads and fields["WARC-Type"] == "response" else None))
                        size += len(data)
                        if len(held) >= 4096 or size > 8 << 20:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    return files.repartition(partitions(spark), "file").mapInArrow(read, RECORDS)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``pages``, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    target = f"{Scratch(spark, 'warc').root}/archives"
    write_archives(table(spark, sf_dir, "pages"), target)
    return read_archives(spark, target, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
