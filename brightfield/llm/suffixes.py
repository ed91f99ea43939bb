"""Operator 1: suffix-array deduplication of bytes by distributed prefix doubling on sampled positions.

Sorting a position-rank pair for every byte would shuffle many times the input, so the rounds run on
sampled positions (sampling.py) and lengthen what is compared until a position is unique or past the
threshold: 32-byte grams first (unique grams stand for no repeat), then the whole region of windows around
the gram (regions that occur twice are decided), then blocks of 16 windows, whose common 185 bytes must
occur twice and whose union decides them all, and last the 200-byte windows of the blocks still open. Each
round groups (rank, name) pairs, and only what it leaves open enters the next. All steps are exact but for
64-bit hashes of one polynomial: strings with equal hashes count as equal, and bytes are not compared again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import condensed, materialize, quoted, slices
from brightfield.llm.sampling import BATCH, BYTE_CODE, PRIME, covered, mix, passes, pieces, signed, sketch, text_bytes

LENGTH = 200
GRAM = 32

#: Windows in a block, by their distance to the gram.
BLOCK = 16

ANCHORS = "doc long, row long, gram long, region long, at long, lo long, n int"
BLOCKS = "gram long, region long, blocks array<struct<key:long,whole:long,low:int,high:int>>"
WINDOWS = "key long, whole long, low int, names array<long>"


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, row (a hash of key and text, alike for repeated rows) and text."""
    t = F.coalesce(quoted(text), F.lit(""))
    return df.select(quoted(key).cast("long").alias("doc"), F.xxhash64(quoted(key).cast("long"), t).alias("row"), t.alias("text"))


def _anchors(batch: pa.RecordBatch, length: int, gram: int):
    raw, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    yield from pieces(BYTE_CODE[raw], offsets, length, gram)


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Byte spans [start, end) whose every byte lies in a `length`-byte string that starts anywhere else too, as doc, row, start, end.

    Spans of one text may overlap. Texts shorter than `length`, empty and null ones have none; repeated rows
    match each other and share their spans by `row`.
    """
    rows = _rows(df, key, text)

    def grams(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                for found, _ in _anchors(part, length, gram):
                    yield pa.RecordBatch.from_arrays([signed(found.gram)], names=["gram"])

    repeated = sketch(rows.select("text").mapInArrow(grams, "gram long").groupBy("gram").count().where("count > 1"), "gram")

    def anchors(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                for found, add in _anchors(part, length, gram):
                    f = found.keep(passes(repeated, found.gram))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(f.text)), part.column(1).take(pa.array(f.text)), signed(f.gram), signed(f.region), pa.array(f.local(f.at) + add[f.text]), pa.array(f.local(f.lo) + add[f.text]), pa.array((f.hi - f.lo + 1).astype(np.int32))], names=["doc", "row", "gram", "region", "at", "lo", "n"])

    sampled = materialize(rows.mapInArrow(anchors, ANCHORS), "suffix-anchors")
    regions = materialize(sampled.groupBy("gram", "region").agg(F.count("*").alias("count")), "suffix-regions")
    open_ = materialize(_open(regions, ["gram"]), "suffix-open")
    wanted = sketch(open_, "gram")

    def blocks(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                for found, _ in _anchors(part, length, gram):
                    f = found.keep(passes(wanted, found.gram))
                    key, whole, low, high, cuts = _blocks(f, length)
                    struct = pa.StructArray.from_arrays([signed(key), signed(whole), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["key", "whole", "low", "high"])
                    yield pa.RecordBatch.from_arrays([signed(f.gram), signed(f.region), pa.ListArray.from_arrays(pa.array(cuts), struct)], names=["gram", "region", "blocks"])

    named = rows.select("text").mapInArrow(blocks, BLOCKS).groupBy("gram", "region").agg(F.first("blocks").alias("blocks"))
    block = materialize(named.join(open_, ["gram", "region"]).select("gram", "region", "count", F.explode("blocks").alias("b")).select("gram", "region", "count", "b.*"), "suffix-blocks")
    wholes = materialize(block.groupBy("key", "whole").agg(F.sum("count").alias("count")), "suffix-wholes")
    left = materialize(_open(wholes, ["key"]), "suffix-left")
    last = sketch(left, "key")

    def windows(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                for found, _ in _anchors(part, length, gram):
                    f = found.keep(passes(wanted, found.gram))
                    key, whole, low, high, cuts = _blocks(f, length)
                    go = passes(last, key)
                    at = np.repeat(f.at, np.diff(cuts))[go]
                    key, whole, low, n = key[go], whole[go], low[go], (high - low + 1)[go]
                    ends = np.cumsum(n)
                    distance = np.repeat(low - ends + n, n) + np.arange(int(n.sum()))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), signed(f.hashed.of(np.repeat(at, n) - distance, length)))
                    yield pa.RecordBatch.from_arrays([signed(key), signed(whole), pa.array(low, pa.int32()), lists], names=["key", "whole", "low", "names"])

    single = rows.select("text").mapInArrow(windows, WINDOWS).groupBy("key", "whole").agg(F.first("low").alias("low"), F.first("names").alias("names"))
    single = single.join(left, ["key", "whole"]).select("key", "whole", "count", "low", F.posexplode("names").alias("j", "name"))
    single = materialize(single.select("key", "whole", "count", (F.col("low") + F.col("j")).alias("d"), "name"), "suffix-windows")
    twice = single.groupBy("key", "d", "name").agg(F.sum("count").alias("total")).where("total > 1").select("key", "d", "name")
    hits = single.where("count = 1").join(twice, ["key", "d", "name"]).groupBy("key", "whole").agg(F.collect_list("d").alias("ds"))

    once = block.where("count = 1").select("gram", "region", "key", "whole", "low", "high")
    by_block = once.join(wholes.where("count > 1"), ["key", "whole"]).select("gram", "region", F.struct("low", "high").alias("d"))
    by_window = once.join(hits, ["key", "whole"]).select("gram", "region", F.explode("ds").alias("d")).select("gram", "region", F.struct(F.col("d").alias("low"), F.col("d").alias("high")).alias("d"))
    partly = by_block.unionByName(by_window).groupBy("gram", "region").agg(F.collect_list("d").alias("ds"))
    partly = materialize(partly, "suffix-partly")  # a table of its own, so that Spark can split a hot region in the join below
    entire = sampled.join(regions.where("count > 1").select("gram", "region"), ["gram", "region"]).select("doc", "row", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))
    pieces_ = sampled.join(partly, ["gram", "region"]).select("doc", "row", "at", F.explode("ds").alias("d")).select("doc", "row", (F.col("at") - F.col("d.high")).alias("start"), (F.col("at") - F.col("d.low") + length).alias("end"))
    return entire.unionByName(pieces_)


def _open(ranked: DataFrame, rank: list[str]) -> DataFrame:
    """Rows whose rank holds several names, one of them seen once: the next, longer names decide those."""
    groups = ranked.groupBy(*rank).agg(F.count("*").alias("m"), F.min("count").alias("least")).where("m > 1 and least = 1").select(*rank)
    return ranked.join(groups, rank)


def _blocks(f, length: int):
    """Blocks of up to BLOCK windows of each anchor: key (gram, block and the bytes that all its windows share), name of the whole, least and largest distance to the gram; and the cuts between anchors."""
    low, high = f.at - f.hi, f.at - f.lo
    first = low // BLOCK
    n = high // BLOCK - first + 1
    ends = np.cumsum(n)
    each = np.repeat(np.arange(len(n)), n)
    b = np.repeat(first - ends + n, n) + np.arange(int(n.sum()))
    at, low, high = f.at[each], np.maximum(low[each], b * BLOCK), np.minimum(high[each], b * BLOCK + BLOCK - 1)
    shared = f.hashed.of(at - b * BLOCK, length - BLOCK + 1)
    key = mix(f.gram[each] + b.astype(np.uint64) * np.uint64(PRIME)) ^ shared
    whole = mix(f.hashed.of(at - high, length + high - low) + (low * length + high).astype(np.uint64))
    return mix(key), whole, low, high, np.concatenate([[0], ends]).astype(np.int32)


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: the key as doc_id, n_bytes, spans (maximal removed runs of bytes) and kept (the remaining bytes).

    Every byte covered by a `length`-byte string that also starts anywhere else is removed, judged on the
    input. Null texts count as empty; null keys, repeated rows and keys are documents like others; other
    columns are left out. Texts without spans are passed by a sketch and are not shuffled.
    """
    rows = _rows(df, key, text)
    # maximal runs of a text meet in one row; texts bound their number
    grouped = condensed(lambda: repeated_spans(df, key, text, length).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans")
    touched = sketch(grouped, "row")

    def hit(batch):
        return passes(touched, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))

    def cut(batches):
        # doc, text, spans
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, runs, kept = [], [], []
                for t, spans_ in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = t.encode()
                    found = covered([(s["start"], s["end"]) for s in spans_ or ()])
                    sizes.append(len(raw))
                    runs.append([{"start": s, "end": e} for s, e in found])
                    ends = [0, *(e for _, e in found)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in found), len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=OUT.names)

    def clean(batches):
        for batch in batches:
            rest = batch.filter(pa.array(~hit(batch)))
            none = pa.nulls(rest.num_rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield from cut([pa.RecordBatch.from_arrays([rest.column(0), rest.column(2), none], names=["doc", "text", "spans"])])

    def others(batches):
        for batch in batches:
            yield batch.filter(pa.array(hit(batch)))

    # each branch runs one Python stage at a time
    left = rows.mapInArrow(others, "doc long, row long, text string").alias("r").join(grouped.alias("s"), F.expr("r.row = s.row and r.doc <=> s.doc"), "left").select("r.doc", "r.text", "s.spans")
    return rows.mapInArrow(clean, OUT).unionByName(left.mapInArrow(cut, OUT))
