"""Operator 5: a deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import commit_files, filesystem, finish_files, materialize, new_dir, partitions, quoted, slices

#: Payloads under this many bytes are always stored in full.
LEAST_REVISIT = 1000
ROLL_BYTES = 32 << 20
#: A fixed capture time keeps equal inputs byte-identical.
CAPTURED = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space of RFC 4122


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}')}>"


def safe(value: str) -> str:
    """A header value: controls and blanks are percent-encoded, so that no value can begin a new line."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit has headers only; its digest and length describe the full payload."""
    digest = hashlib.sha1(payload).hexdigest()
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {safe(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{b32}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(source, size: int = 1 << 20):
    """Uncompressed gzip members of a stream, one at a time."""
    data = b""
    unzip, parts = zlib.decompressobj(31), []
    while True:
        if not data:
            data = source.read(size)
            if not data:
                return
        parts.append(unzip.decompress(data))
        data = unzip.unused_data
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = zlib.decompressobj(31), []


def parse_record(raw: bytes) -> dict:
    """The record's fields, with digests checked against what is stored."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"][5:]:
        raise ValueError("a record's block differs from its digest")
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a record's payload differs from its digest")
    page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return {"page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": len(payload) if payload is not None else int(fields["WARC-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if refers is None else int(refers)}


MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_warc(pages: DataFrame, root: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", roll_bytes: int = ROLL_BYTES, least_revisit: int = LEAST_REVISIT) -> str:
    """Writes one record per row and returns the folder; manifest.json lists its files.

    Of rows with equal payloads of least_revisit bytes or more, those with the largest key are responses
    and the others revisits of it; shorter payloads are responses. Records are range-sorted by key (nulls
    first), digest, url and payload, so that a key with many rows is split; a file ends at roll_bytes of gzip members, and the
    files that successful tasks left under temporary names are committed by a manifest (common.commit_files). Null payloads count as
    empty, null urls have no target header, repeated rows give a record each, an empty table gives no file. Payloads are
    shuffled once: the few (key, digest, target) rows of revisits travel in the same sort.
    """
    spark = pages.sparkSession
    root = root or new_dir(spark, "warc")
    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    rows = pages.select(quoted(key).cast("long").alias("k"), quoted(url).cast("string").alias("u"), F.coalesce(quoted(payload), F.lit("")).cast("binary").alias("p"))
    large = rows.where(F.length("p") >= least_revisit).select("k", F.sha1("p").alias("d"))
    groups = large.groupBy("d").agg(F.max("k").alias("target"), F.count("*").alias("n")).where("n > 1")
    refers = materialize(large.join(groups, "d").where("target > k or (k is null and target is not null)").select("k", "d", "target").distinct(), "warc-refers")
    sort = ["k", "d", "is_page", "u", "p"]
    both = refers.select("k", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("u"), F.lit(None).cast("binary").alias("p"), "d", "target").unionByName(
        rows.select("k", F.lit(True).alias("is_page"), "u", "p", F.sha1("p").alias("d"), F.lit(None).cast("long").alias("target")))
    dealt = both.repartitionByRange(partitions(spark), "k", "d").sortWithinPartitions(*sort)

    def write(batches):
        from pyspark import TaskContext

        shard, (out, _) = TaskContext.get().partitionId(), filesystem(root)
        done, sink, seen, refers_to = [], None, None, None

        def end():
            sink.close()
            done.append({"shard": shard, "file": len(done), "path": path, "records": records, "bytes": size})

        for batch in batches:
            for part in slices(batch, "p"):
                for k, is_page, u, p, d, target in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if seen != (k, d):
                        seen, refers_to = (k, d), None
                    if not is_page:
                        refers_to = target
                        continue
                    data = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = data.compress(make_record(k, u, p, refers_to, refers_to is not None)) + data.flush()
                    if sink is None:
                        path, records, size = f"{base}/_temporary-{shard:05d}-{uuid.uuid4().hex}", 0, 0
                        sink = out.open_output_stream(path)
                    sink.write(raw)
                    records, size = records + 1, size + len(raw)
                    if size >= roll_bytes:
                        end()
                        sink = None
        if sink is not None:
            end()
        yield pa.RecordBatch.from_pylist(done, schema=MANIFEST)

    made = sorted(dealt.select("k", "is_page", "u", "p", "d", "target").mapInArrow(write, "shard int, file int, path string, records long, bytes long").collect(), key=lambda m: (m.shard, m.file))  # one row a file
    commit_files(spark, root, [{"temporary": m.path, "path": f"{base}/part-{m.shard:05d}-{m.file:05d}.warc.gz", "records": m.records, "bytes": m.bytes} for m in made])
    return root


READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records of a written folder: a task a file, a record at a time in memory; digests are checked."""
    finish_files(spark, root)
    fs, base = filesystem(root)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        listed = json.loads(f.read())
    files = spark.createDataFrame([(x["path"],) for x in listed], "path string").repartition(max(1, len(listed)))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        reader, _ = filesystem(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with reader.open_input_stream(path, compression=None) as source:
                    for raw in members(source):
                        held.append(parse_record(raw))
                        size += len(raw)
                        if size > 2 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.mapInArrow(read, READ)
