"""Operator 3: token ids in Simple-8b words.

A file holds blocks of ids. A 64-bit word has a selector in its upper four bits and as many equally
wide ids as fit in the other sixty; a wider value goes to the block's escape table and its word holds
the place there, so that words never need their neighbours to be decoded. The footer has every block's
byte offset, first id and size, and the documents' ids and lengths, coded alike.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.bpe import encoder
from brightfield.llm.common import commit_files, filesystem, new_dir, partitions, quoted, slices

#: (values in a word, bits each) of selectors 1 to 14; selector 0 is an escape. Fixed values of the coding.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([1] + [n for n, _ in PACKINGS] + [0], dtype=np.int64)
MAGIC = b"S8TOKEN1"
BLOCK_IDS = 1 << 16
ROLL_IDS = 1 << 25
#: Bytes of text that are encoded at once: new words of more texts share the steps of the merge.
ENCODE_BYTES = 1 << 22


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit values; each word takes as many values as fit."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    wide = values >> np.uint64(60) != 0
    narrow = values.astype(np.uint32) if int(values.max()) < 1 << 32 else values
    choice = np.zeros(n, dtype=np.uint8)  # escape, unless a packing fits
    at = np.arange(n, dtype=np.int32)
    for k in range(len(PACKINGS), 0, -1):
        count, bits = PACKINGS[k - 1]
        over = narrow > narrow.dtype.type((1 << bits) - 1) if bits < 8 * narrow.itemsize else None
        if over is None or not over.any():
            choice[:] = k
            continue
        # place of the next value that is too wide; the end of the block counts as zeros
        ahead = np.where(over, at, np.int32(n + 64))
        ahead = np.minimum.accumulate(ahead[::-1])[::-1]
        fits = ahead - at >= count
        if not fits.any():
            break
        choice[fits] = k
    steps = COUNTS[choice].tolist()
    starts, i = [], 0
    push = starts.append
    while i < n:
        push(i)
        i += steps[i]
    starts = np.array(starts, dtype=np.int64)
    kinds = choice[starts]
    words = np.zeros(len(starts), dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(64, np.uint64)])
    for k in np.unique(kinds).tolist():
        rows = kinds == k
        if k == 0:
            words[rows] = np.arange(int(rows.sum()), dtype=np.uint64)
            continue
        count, bits = PACKINGS[k - 1]
        each = np.arange(count)
        got = padded[starts[rows][:, None] + each] << (each * bits).astype(np.uint64)
        words[rows] = np.bitwise_or.reduce(got, axis=1) | np.uint64(k << 60)
    return words, values[wide]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n values of the words."""
    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[kinds]
    ends = np.cumsum(counts)
    out = np.zeros((int(ends[-1]) if len(ends) else 0) + 64, dtype=np.uint64)
    starts = ends - counts
    for k in np.unique(kinds).tolist():
        rows = kinds == k
        payload = words[rows] & np.uint64((1 << 60) - 1)
        if k == 0:
            out[starts[rows]] = escapes[payload.astype(np.int64)]
            continue
        count, bits = PACKINGS[k - 1]
        each = np.arange(count)
        out[starts[rows][:, None] + each] = (payload[:, None] >> (each * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    return out[:n]


def _section(values: np.ndarray) -> bytes:
    words, escapes = pack(values)
    return struct.pack("<QII", len(values), len(words), len(escapes)) + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def _read_section(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    n, words, escapes = struct.unpack_from("<QII", data, at)
    at += 16
    w = np.frombuffer(data, "<u8", words, at)
    e = np.frombuffer(data, "<u8", escapes, at + 8 * words)
    return unpack(w, e, n), at + 8 * (words + escapes)


class TokenFileWriter:
    """Writes one file; ids arrive document by document."""

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        sink.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets: list[int] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if all_ else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, end, BLOCK_IDS):
            data = _section(ids[i : min(i + BLOCK_IDS, end)])
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.held, self.n_held = ([ids[end:]], len(ids) - end) if end < len(ids) else ([], 0)

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([k is None for k in self.keys], dtype=np.uint64)
        keys = np.array([k or 0 for k in self.keys], dtype=np.int64)
        steps = np.diff(keys, prepend=np.int64(0))
        zigzag = ((steps << 1) ^ (steps >> 63)).view(np.uint64)
        footer = b"".join(map(_section, (np.array(self.offsets, dtype=np.uint64), nulls, zigzag, np.array(self.lengths, dtype=np.uint64))))
        self.sink.write(footer)
        self.sink.write(struct.pack("<QQ", self.at, len(footer)) + MAGIC)
        self.sink.close()


def read_token_file(source):
    """Yields (key, ids) of each document in the file's order, one block in memory at a time."""
    size = source.size()
    source.seek(size - 24)
    at, length = struct.unpack("<QQ", source.read(24)[:16])
    source.seek(at)
    data = source.read(length)
    offsets, p = _read_section(data)
    nulls, p = _read_section(data, p)
    zigzag, p = _read_section(data, p)
    lengths, _ = _read_section(data, p)
    keys = np.cumsum((zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).astype(np.int64))
    ends = [*offsets.astype(np.int64).tolist()[1:], at]
    block, held, have = 0, [], 0
    for key, null, n in zip(keys.tolist(), nulls.tolist(), lengths.astype(np.int64).tolist(), strict=True):
        while have < n:
            source.seek(int(offsets[block]))
            got, _ = _read_section(source.read(ends[block] - int(offsets[block])))
            held.append(got.astype(np.uint32))
            have += len(got)
            block += 1
        ids = np.concatenate(held) if len(held) != 1 else held[0]
        yield None if null else key, ids[:n]
        held, have = [ids[n:]], have - n


@dataclass
class TokenFiles:
    """Committed files in order: path, first id, number of ids and of documents."""

    root: str
    files: list[tuple[str, int, int, int]]


MANIFEST = "shard int, file int, path string, n_ids long, n_docs long"


def write_token_files(df: DataFrame, vocabulary: str, root: str, key: str = "doc_id", text: str = "text", end_id: int = 2, roll_ids: int = ROLL_IDS) -> TokenFiles:
    """Encodes every whole text, appends end_id and writes the ids in ascending order of the key.

    Rows are range-sorted by (key, text), nulls first, so that equal inputs give equal files; a file
    ends once it has roll_ids ids. Tasks write under temporary names; the files of those tasks that
    succeeded are committed by a manifest (common.commit_files). A key with many rows is split by how their texts begin. Null texts count as empty; repeated keys
    are kept as documents of their own; an empty table gives no file.
    """
    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    rows = df.select(quoted(key).cast("long").alias("__key"), quoted(text).alias("__text"))
    rows = rows.repartitionByRange(partitions(df.sparkSession), F.col("__key"), F.substring("__text", 1, 32)).sortWithinPartitions("__key", "__text")

    def write(batches):
        from pyspark import TaskContext

        bpe, shard = encoder(vocabulary), TaskContext.get().partitionId()
        out, _ = filesystem(root)
        tail = np.array([end_id], dtype="<u4").tobytes()
        writer, done = None, []

        def end():
            writer.close()
            done.append((shard, len(done), path, writer.n_ids, len(writer.keys)))

        for batch in batches:
            for part in slices(batch, "__text", ENCODE_BYTES):
                for k, ids in zip(part.column(0).to_pylist(), bpe.encode(part.column(1).to_pylist()), strict=True):
                    if writer is None:
                        path = f"{base}/_temporary-{shard:05d}-{uuid.uuid4().hex}"
                        writer = TokenFileWriter(out.open_output_stream(path))
                    writer.add(k, np.frombuffer(ids + tail, dtype="<u4"))
                    if writer.n_ids >= roll_ids:
                        end()
                        writer = None
        if writer is not None:
            end()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "path", "n_ids", "n_docs"), d, strict=True)) for d in done], schema=pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    files, listed, first = [], [], 0
    for m in sorted(rows.mapInArrow(write, MANIFEST).collect(), key=lambda m: (m.shard, m.file)):  # one row a file
        final = f"{base}/tokens-{m.shard:05d}-{m.file:05d}.s8b"
        listed.append({"temporary": m.path, "path": final, "first_id": first, "n_ids": m.n_ids, "n_docs": m.n_docs})
        files.append((final, first, m.n_ids, m.n_docs))
        first += m.n_ids
    commit_files(df.sparkSession, root, listed)
    return TokenFiles(root, files)


READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("token_ids", T.BinaryType())])


def read_token_files(spark: SparkSession, made: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it) and token_ids (little-endian unsigned 32-bit) from the files; a task a file."""
    root = made.root
    listed = spark.createDataFrame([(p, f) for p, f, _, _ in made.files], "path string, first long")

    def read(batches):
        fs, _ = filesystem(root)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, starts, ids, held = [], [], [], 0
                with fs.open_input_file(path) as source:
                    for k, x in read_token_file(source):
                        keys.append(k)
                        starts.append(start)
                        ids.append(x.astype("<u4").tobytes())
                        start += len(x)
                        held += len(x)
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=READ.names)
                            keys, starts, ids, held = [], [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=READ.names)

    return listed.repartition(max(1, len(made.files))).mapInArrow(read, READ)


def crc32(df: DataFrame) -> DataFrame:
    """n_tokens and the unsigned crc32 of each document's ids."""
    return df.select("doc_id", "start", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32"))


def token_files(df: DataFrame, vocabulary: str, root: str | None = None, **options) -> TokenFiles:
    """write_token_files into `root`, by default a new folder of the shared one."""
    return write_token_files(df, vocabulary, root or new_dir(df.sparkSession, "tokens"), **options)
