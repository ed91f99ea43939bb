"""Operator 7: substring deduplication of words over a compacted de Bruijn graph.

Nodes are the sampled word k-mers of sampling.py with their regions, edges lead to the next one of the
same text. Nodes that always follow one another are compacted: a node is joined with the one before it,
and where each is the other's only neighbour they belong to one path. A path occurs in the same
documents all along, so it is decided as a whole from its smallest document; spans come from the
coordinates of its sources. Where nodes with one k-mer differ around it, their 50-word windows are
compared one by one, by the 64-bit names of window and k-mer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import condensed, materialize, slices
from brightfield.llm.sampling import BATCH, PRIME, covered, mix, passes, pieces, signed, sketch, text_bytes, word_units
from brightfield.llm.suffixes import _rows

LENGTH = 50
GRAM = 12

NODES = "doc long, row long, gram long, node long, before long, after long, lo long, n int"
WINDOWS = "node long, names array<long>"


def _anchors(batch: pa.RecordBatch, length: int, gram: int):
    codes, _, _, offsets = word_units(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
    yield from pieces(codes, offsets, length, gram)


def _node(found) -> np.ndarray:
    return mix(found.gram * np.uint64(PRIME) + found.region) | np.uint64(1)  # never 0, which stands for a text's end


def earlier_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Word spans [start, end) covered by `length`-word windows that also start in a document with a smaller key, as doc, row, start, end.

    A null key is smaller than any other; rows with equal keys are not earlier than one another. Spans of one
    text may overlap; shorter, empty and null texts have none.
    """
    rows = _rows(df, key, text)
    order = F.coalesce("doc", F.lit(-(2**63)))

    def grams(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                for found, _ in _anchors(part, length, gram):
                    yield pa.RecordBatch.from_arrays([signed(found.gram)], names=["gram"])

    repeated = sketch(rows.select("text").mapInArrow(grams, "gram long").groupBy("gram").count().where("count > 1"), "gram")

    def nodes(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                for found, add in _anchors(part, length, gram):
                    f = found.keep(passes(repeated, found.gram))
                    node = _node(f)
                    same = f.text[1:] == f.text[:-1]
                    before, after = np.zeros(len(node), np.uint64), np.zeros(len(node), np.uint64)
                    before[1:][same] = node[:-1][same]
                    after[:-1][same] = node[1:][same]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(f.text)), part.column(1).take(pa.array(f.text)), signed(f.gram), signed(node), signed(before), signed(after), pa.array(f.local(f.lo) + add[f.text]), pa.array((f.hi - f.lo + 1).astype(np.int32))], names=["doc", "row", "gram", "node", "before", "after", "lo", "n"])

    sampled = materialize(rows.mapInArrow(nodes, NODES), "debruijn-nodes")
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(0))
    graph = sampled.groupBy("node").agg(F.first("gram").alias("gram"), only("before").alias("before"), only("after").alias("after"), F.min(order).alias("lowest"), F.max(order).alias("highest"))
    graph = materialize(graph, "debruijn-graph")
    ahead = graph.where("after <> 0").select(F.col("node").alias("before"), F.col("after").alias("node"), F.lit(True).alias("inner"))
    flags = graph.where("highest > lowest").join(ahead, ["before", "node"], "left").select("node", "lowest", F.coalesce("inner", F.lit(False)).alias("inner"))
    flags = materialize(flags, "debruijn-flags")  # a table of its own, so that Spark can split a hot node in the join below
    # paths: within a text a new one begins at every node that is not the only successor of its only predecessor
    by = W.partitionBy("doc", "row").orderBy("lo")
    runs = sampled.join(flags, "node").withColumn("path", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(by))
    paths = runs.groupBy("doc", "row", "path").agg(F.min("lo").alias("start"), (F.max(F.col("lo") + F.col("n")) - 1 + length).alias("end"), F.min("lowest").alias("lowest"), F.sum("n").alias("windows"))
    later = paths.where(order > F.col("lowest"))
    # a path whose windows do not follow one another without a gap is not one span
    whole = later.where(F.col("end") - F.col("start") == F.col("windows") - 1 + length).select("doc", "row", "start", "end")
    loose = runs.join(later.where(F.col("end") - F.col("start") != F.col("windows") - 1 + length).select(F.col("doc").alias("d"), F.col("row").alias("r"), F.col("path").alias("p")), F.expr("doc <=> d and row = r and path = p")).select("doc", "row", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))
    # k-mers whose nodes differ: windows of a node that also lie in one with a smaller document
    mixed = graph.groupBy("gram").agg(F.min("lowest").alias("least"), F.max("lowest").alias("most")).where("least < most").select("gram")
    open_ = materialize(graph.join(mixed, "gram").select("node", "gram", "lowest"), "debruijn-open")
    wanted = sketch(open_, "node")

    def windows(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                for found, _ in _anchors(part, length, gram):
                    f = found.keep(passes(wanted, _node(found)))
                    n = f.hi - f.lo + 1
                    ends = np.cumsum(n)
                    at = np.repeat(f.lo - ends + n, n) + np.arange(int(n.sum()))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), signed(found.hashed.of(at, length)))
                    yield pa.RecordBatch.from_arrays([signed(_node(f)), lists], names=["node", "names"])

    named = rows.select("text").mapInArrow(windows, WINDOWS).groupBy("node").agg(F.first("names").alias("names"))
    each = materialize(named.join(open_, "node").select("node", "gram", "lowest", F.posexplode("names").alias("j", "name")), "debruijn-windows")
    least = each.groupBy("gram", "name").agg(F.min("lowest").alias("least"), F.max("lowest").alias("most")).where("least < most").select("gram", "name", "least")
    found = each.join(least, ["gram", "name"]).where("least < lowest").groupBy("node").agg(F.sort_array(F.collect_list("j")).alias("js"))
    found = materialize(found, "debruijn-hits")
    single = sampled.join(found, "node").select("doc", "row", "lo", F.explode("js").alias("j")).select("doc", "row", (F.col("lo") + F.col("j")).alias("start"), (F.col("lo") + F.col("j") + length).alias("end"))
    return whole.unionByName(loose).unionByName(single)


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType())])


def remove_earlier(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: the key as doc_id, n_words, spans (maximal removed runs of words) and kept (the other words, joined by a blank).

    Words are what ASCII white space separates, unchanged. Null texts have no words; other columns are left
    out; repeated rows get equal results. Texts without spans are passed by a sketch and are not shuffled.
    """
    rows = _rows(df, key, text)
    grouped = condensed(lambda: earlier_spans(df, key, text, length).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "debruijn-spans")
    touched = sketch(grouped, "row")

    def hit(batch):
        return passes(touched, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))

    def cut(batches):
        # doc, text, spans
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, runs, kept = [], [], []
                for t, spans_ in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = t.encode().split()  # bytes.split() knows ASCII white space alone
                    found = covered([(s["start"], s["end"]) for s in spans_ or ()])
                    sizes.append(len(words))
                    runs.append([{"start": s, "end": e} for s, e in found])
                    for s, e in reversed(found):
                        del words[s:e]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], names=OUT.names)

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
