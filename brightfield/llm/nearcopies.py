"""Operator 6: near-duplicate classes by ProbMinHash on weighted word shingles.

A shingle that occurs w times sends arrivals of a Poisson process with rate w to random registers; a
register keeps the shingle of its earliest arrival, and a shingle stops once its next arrival is later
than every register's. Two texts agree in a register with the probability Jaccard similarity of their
shingle counts. Bands of registers give buckets; pairs from buckets are verified with the exact
similarity. Within a bucket, members are compared with pivots: first with the member that shares most with
others, then, in turns with sixteen times as many pivots each, only across components that are not yet linked.
In crowded buckets a bound (`Bound`) rules out the pairs that share common shingles alone and too few of them,
and pairs with a rare shingle in common are listed by it, so that a large group of texts that resemble their source, but not
one another, takes no comparison of all its pairs. What is compared is what shares a bucket, is not linked and
may still be similar, and no link is lost.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import discard, fresh, map_rows, materialize, quoted, slices
from brightfield.llm.sampling import BATCH, SKETCH_BITS, Hashed, mix, passes, signed, sketch, text_bytes, word_units
from brightfield.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: 24 bands of 4 registers miss a pair of similarity 0.8 with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Pairs are dropped on their registers alone where a similar pair would agree in so few with this probability at most.
MISS = 1e-6
#: In open buckets with more members, pairs are held against the bound before they are made; it decides no link.
CROWD = 16
#: Shingles of so many crowded texts at most are rare.
RARE = 8
#: Pivots of a bucket in its first turn, and the factor by which they grow from turn to turn.
PIVOTS, PIVOT_GROWTH = 128, 16


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct word shingles of a batch, by text and hash. A text with fewer words is one shingle."""
    codes, _, _, offsets = word_units(*text_bytes(column))
    hashed = Hashed(codes)
    n = np.diff(offsets)
    many = np.maximum(n - size + 1, np.minimum(n, 1))
    ends = np.cumsum(many)
    text = np.repeat(np.arange(len(n)), many)
    at = np.repeat(offsets[:-1] - ends + many, many) + np.arange(int(many.sum()))
    h = hashed.of(at, np.minimum(n, size)[text]) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """ProbMinHash registers (n_texts, m): the element of each register's earliest arrival, 0 for texts without elements."""
    best = np.full(n_texts * m, np.inf)
    holds = np.zeros(n_texts * m, dtype=np.uint64)
    arrival = np.zeros(len(element))
    rate = weight.astype(np.float64)
    step = 0
    while len(element):
        step += 1
        r = mix(element + np.uint64(step * 0x632BE59BD9B4E019 % (1 << 64)))
        arrival = arrival - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate
        slot = text * m + ((mix(r) >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, slot, arrival)
        won = best[slot] == arrival
        holds[slot[won]] = element[won]
        latest = best.reshape(n_texts, m).max(axis=1)
        go = arrival < latest[text]
        text, element, rate, arrival = text[go], element[go], rate[go], arrival[go]
    return holds.reshape(n_texts, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One bucket key per text and band."""
    n = len(registers)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    parts = registers.reshape(n, bands, rows)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def probability_jaccard(hx: np.ndarray, wx: np.ndarray, hy: np.ndarray, wy: np.ndarray) -> float:
    """sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i), with one sort of the ratios x_j / y_j."""
    _, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(ix):
        return 0.0
    x = np.concatenate([wx[ix], np.delete(wx, ix), np.zeros(len(hy) - len(iy))]).astype(np.float64)
    y = np.concatenate([wy[iy], np.zeros(len(hx) - len(ix)), np.delete(wy, iy)]).astype(np.float64)
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    below_y = np.concatenate([[0.0], np.cumsum(y[order])])
    above_x = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    shared = ratio[: len(ix)]
    at = np.searchsorted(sorted_ratio, shared, side="left")
    return float((x[: len(ix)] / (above_x[at] + shared * below_y[at])).sum())


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, tid (a 64-bit hash of the text, which stands for it) and text."""
    t = F.coalesce(quoted(text), F.lit(""))
    return df.select(quoted(key).cast("long").alias("doc"), F.xxhash64(t).alias("tid"), t.alias("text"))


def least_agreement(registers: int, similarity: float, miss: float = MISS) -> int:
    """The largest number of registers in which a pair of the given similarity falls short with a probability of at most `miss`."""
    under, c = 0.0, 0
    while c < registers:
        under += math.comb(registers, c) * similarity**c * (1 - similarity) ** (registers - c)
        if under > miss:
            break
        c += 1
    return c


def _agreeing(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose registers, a byte of each, agree often enough for the similarity."""
    joined = pairs.join(marks.select(F.col("tid").alias("a"), F.col("mark").alias("x")), "a").join(marks.select(F.col("tid").alias("b"), F.col("mark").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (text_bytes(batch.column(i))[0].reshape(batch.num_rows, -1) for i in (2, 3))
            good = (x == y).sum(axis=1) >= least_agreement(x.shape[1], similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return joined.mapInArrow(check, "a long, b long")


def _shingled(rows: DataFrame, tids: DataFrame, size: int) -> DataFrame:
    """(tid, h, n): distinct shingles and counts of the texts in tids; rows that repeat a text repeat it.

    A sketch spares most others the shingles; those that it lets pass wrongly, a share of all texts that grows with tids, are dropped by a join.
    With more tids than a sketch tells apart, texts are joined instead.
    """
    if tids.count() > 1 << (SKETCH_BITS - 4):
        rows = rows.join(tids, "tid", "left_semi")
    wanted = sketch(tids, "tid")

    def shingle(batches):
        for batch in batches:
            hit = passes(wanted, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            batch = batch.filter(pa.array(hit))
            for part in slices(batch, "text", BATCH):
                text, h, n = shingles(part.column(1), size)
                cuts = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(cuts, signed(h)), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32)))], names=["tid", "h", "n"])

    return rows.select("tid", "text").mapInArrow(shingle, "tid long, h array<long>, n array<int>").join(tids, "tid", "left_semi")


def _verify(rows: DataFrame, pairs: DataFrame, marks: DataFrame, size: int, similarity: float) -> DataFrame:
    """The (a, b) of pairs whose texts are similar enough; only texts of pairs whose registers agree are shingled and shuffled."""
    pairs = materialize(_agreeing(pairs, marks, similarity), "near-agreeing", compact=True)
    tids = pairs.select(F.col("a").alias("tid")).unionByName(pairs.select(F.col("b").alias("tid"))).distinct()
    made = _shingled(rows, tids, size).groupBy("tid").agg(F.first(F.struct("h", "n")).alias("s"))
    made = materialize(made, "near-shingles", 500)
    joined = pairs.join(made.select(F.col("tid").alias("a"), F.col("s").alias("x")), "a").join(made.select(F.col("tid").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x.h", "x.n", F.col("y.h").alias("g"), F.col("y.n").alias("k"))

    def check(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            lists = [batch.column(i) for i in range(2, 6)]
            good = []
            for r in range(batch.num_rows):
                hx, wx, hy, wy = (c[r].values.to_numpy(zero_copy_only=False) for c in lists)
                good.append(probability_jaccard(hx, wx, hy, wy) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = materialize(joined.mapInArrow(check, "a long, b long"), "near-links", 200, True)
    discard(pairs, made)
    return found


def most_similar(s: Column, c: Column, d: Column, n: Column, s2: Column, c2: Column, d2: Column, n2: Column) -> Column:
    """The bound: the largest probability Jaccard similarity of two texts that have no shingles in common but those that each may share.

    Of a text, s is the share of its weight that it may share, d the number of distinct shingles in that, c the largest
    count of one shingle and n its weight. A shared shingle i adds at most 1 / (1/x_i + (1 - t)/y_i) in normalised weights, where t is
    the other's shared weight; that is concave and homogeneous, so the sum is largest with all in one shingle: 1 / (1/s + 1/t - 1).
    What is shared has no more distinct shingles than the other's d, each counted c times at most.
    """
    left, right = F.least(s, c * d2 / n), F.least(s2, c2 * d / n2)
    return F.when((left > 0) & (right > 0), 1 / (1 / left + 1 / right - 1)).otherwise(0.0)


def _crowded(rows: DataFrame, tids: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(tid, s, c, d, n) for most_similar, with what may be shared restricted to shingles of more than RARE of the texts; and the pairs (a, b) with a rarer one in common.

    Hash collisions only add to what is common.
    """
    made = _shingled(rows, tids, size).groupBy("tid").agg(F.first(F.struct("h", "n")).alias("s")).select("tid", "s.*")
    made = materialize(made, "near-crowd", 500)
    each = made.select("tid", F.explode(F.arrays_zip("h", "n")).alias("e")).select("tid", "e.h", "e.n")
    common = each.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1")
    shared = materialize(each.join(common, "h"), "near-common", compact=True)  # a table of its own: shingles of one text are most, and gone
    bounds = shared.where(F.col("texts") > RARE).groupBy("tid").agg(F.sum("n").alias("f"), F.count("*").alias("d"))
    whole = made.select("tid", F.array_max("n").alias("c"), F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v).alias("w"))
    bounds = whole.join(bounds, "tid", "left").select(F.col("tid").alias("t"), (F.coalesce("f", F.lit(0)) / F.col("w")).alias("s"), F.col("c").cast("double").alias("c"), F.coalesce("d", F.lit(0)).cast("double").alias("d"), F.col("w").cast("double").alias("w"))
    bounds = materialize(bounds, "near-bounds", compact=True)
    few = shared.where(F.col("texts") <= RARE).groupBy("h").agg(F.sort_array(F.collect_set("tid")).alias("t"))
    pairs = few.select(F.explode(F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, RARE), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.*").distinct()
    pairs = materialize(pairs, "near-rare", compact=True)
    discard(made, shared)
    return bounds, pairs


def _merge(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, component) after further links: only the components that they touch are worked on."""
    named = parts.select(F.col("node").alias("end"), "component")
    ends = links.join(named.select(F.col("end").alias("a"), F.col("component").alias("ca")), "a", "left").join(named.select(F.col("end").alias("b"), F.col("component").alias("cb")), "b", "left")
    moved = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = parts.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    made = materialize(old.unionByName(moved.join(parts, "node", "left_anti")), "near-parts", compact=True)
    discard(parts)
    return made


def links(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows_a_band: int = ROWS) -> DataFrame:
    """(node, component) of the distinct texts (their 64-bit hashes) that have a near copy, by verified links."""
    rows = _texts(df, key, text)

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                t, h, n = shingles(part.column(1), size)
                some = np.zeros(part.num_rows, dtype=bool)
                some[t] = True
                registers = signatures(t, h, n, part.num_rows, bands * rows_a_band)[some]
                keys = band_keys(registers, bands, rows_a_band)
                cuts = pa.array((np.arange(len(keys) + 1) * bands).astype(np.int32))
                marks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bands * rows_a_band), len(keys), [None, pa.py_buffer((registers & np.uint64(255)).astype(np.uint8).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(some)), marks, pa.ListArray.from_arrays(cuts, signed(keys.reshape(-1)))], names=["tid", "mark", "keys"])

    signed_ = rows.select("tid", "text").mapInArrow(sign, "tid long, mark binary, keys array<long>")
    signed_ = materialize(signed_.groupBy("tid").agg(F.first(F.struct("mark", "keys")).alias("s")).select("tid", "s.*"), "near-signatures")
    spread = signed_.select("tid", F.explode("keys").alias("bucket"))
    sizes = spread.groupBy("bucket").count().where("count > 1")
    crowded = sketch(sizes, "bucket")

    def crowd(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(crowded, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))

    # members of buckets with company, and by text how much company it has in all: the middle of a group has most
    found = spread.mapInArrow(crowd, "tid long, bucket long")
    found = materialize(found.join(found.groupBy("bucket").count().where("count > 1"), "bucket"), "near-buckets", compact=True)
    score = found.groupBy("tid").agg(F.sum("count").alias("score"))
    members = materialize(found.join(score, "tid").select("bucket", "tid", "score"), "near-members", compact=True)
    marks = materialize(signed_.select("tid", "mark").join(score, "tid", "left_semi"), "near-marks", compact=True)
    discard(found, signed_)
    rank = F.struct(F.col("score"), (-F.col("tid")).alias("t"))
    pivots = members.groupBy("bucket").agg(F.max_by("tid", rank).alias("pivot"), F.max("score").alias("pivot_score"))
    # first each text with the best of its pivots
    first = members.join(pivots, "bucket").where("tid <> pivot").groupBy("tid").agg(F.max_by("pivot", F.struct("pivot_score", (-F.col("pivot")).alias("t"))).alias("pivot"))
    compared = materialize(first.select(F.least("tid", "pivot").alias("a"), F.greatest("tid", "pivot").alias("b")).distinct(), "near-pairs", compact=True)
    seen = [compared]
    edges = _verify(rows, compared, marks, size, similarity)
    parts = materialize(connected_components(edges), "near-parts", compact=True)
    discard(edges)
    turn = 0
    while True:
        # buckets that still hold several components
        placed = members.join(parts, members.tid == parts.node, "left").select("bucket", "tid", "score", F.coalesce("component", "tid").alias("component"))
        open_ = placed.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("members"), F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")).where("parts > 1").drop("parts")
        left = materialize(placed.join(open_, "bucket"), "near-left", compact=True)
        if left.isEmpty():
            discard(left, members, marks, *seen)
            return parts
        crowds = left.where(F.col("members") > CROWD).select("tid").distinct()
        if crowds.isEmpty():
            bounds = rare = None
            known = left.select("bucket", "tid", "score", "component", "main", F.lit(False).alias("crowd"), *(F.lit(None).cast("double").alias(k) for k in "scdw"))
        else:
            bounds, rare = _crowded(rows, crowds, size)
            known = left.join(bounds, left.tid == bounds.t, "left").withColumn("crowd", F.col("members") > CROWD).drop("t", "members")
            # a text leaves whose bound is under the similarity even with the bucket's shortest text, all of which it may share
            shortest = known.where("crowd").groupBy("bucket").agg(F.min(F.col("w") / F.col("c")).alias("shortest"))
            reach = F.col("d") * (1 / similarity + 1 - 1 / F.col("s"))
            known = known.join(shortest, "bucket", "left").where(~F.col("crowd") | F.when(F.col("s") >= similarity - 1e-9, reach >= F.col("shortest") - 1e-9).otherwise(False)).drop("shortest")
        alone = known = materialize(known, "near-known", compact=True)
        # a pair is made in the first bucket that both are in, and not in each
        lists = known.groupBy("tid").agg(F.collect_list("bucket").alias("buckets"))
        known = materialize(known.join(lists, "tid"), "near-listed", compact=True)
        group = F.pmod(F.xxhash64("tid", F.lit(turn)), F.lit(PIVOTS * PIVOT_GROWTH**turn))
        chosen = known.where("component <> main").groupBy("bucket", group.alias("g")).agg(F.max_by(F.struct(F.col("tid").alias("pivot"), F.col("component").alias("with"), F.col("buckets").alias("others"), *(F.col(k).alias(f"{k}2") for k in "scdw")), rank).alias("p")).select("bucket", "p.*")
        chosen = materialize(chosen, "near-pivots", compact=True)
        may = ~F.col("crowd") | (most_similar(*map(F.col, ("s", "c", "d", "w", "s2", "c2", "d2", "w2"))) >= similarity - 1e-9)
        ends = (F.least("tid", "pivot").alias("a"), F.greatest("tid", "pivot").alias("b"))
        once = F.col("bucket") == F.array_min(F.array_intersect("buckets", "others"))
        pairs = known.join(chosen, "bucket").where((F.col("component") != F.col("with")) & may & once).select(*ends)
        if rare is not None:
            # those that share a rare shingle, whatever their bucket, unless they are linked
            place = left.select("tid", "component").distinct()
            pairs = pairs.unionByName(rare.join(place.select(F.col("tid").alias("a"), F.col("component").alias("ca")), "a").join(place.select(F.col("tid").alias("b"), F.col("component").alias("cb")), "b").where("ca <> cb").select("a", "b"))
        pairs = materialize(pairs.distinct().join(compared, ["a", "b"], "left_anti"), "near-pairs", compact=True)
        edges = _verify(rows, pairs, marks, size, similarity)
        if not edges.isEmpty():
            parts = _merge(parts, edges)
        superseded = [t for t in (members, left, bounds, rare, alone, known, chosen, edges) if t is not None]
        members = materialize(known.join(chosen.select("bucket", F.col("pivot").alias("tid")), ["bucket", "tid"], "left_anti").select("bucket", "tid", "score"), "near-members", compact=True)
        discard(*superseded)
        seen.append(pairs)
        compared = functools.reduce(DataFrame.unionByName, seen)
        turn += 1


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(tid, part, class_id, texts, rows): for each distinct text its class, the smallest key there, the distinct texts and the rows in the class."""
    rows = _texts(df, key, text).select("doc", "tid")
    parts = links(df, key, text, **options)
    each = materialize(rows.groupBy("tid").agg(F.min("doc").alias("least"), F.count("*").alias("rows")), "near-texts", compact=True)
    placed = each.join(parts, each.tid == parts.node, "left").select("tid", "least", "rows", F.col("component"))
    whole = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("texts"), F.sum("rows").alias("all"))
    linked = placed.where("component is not null").join(whole, "component").select("tid", F.col("component").alias("part"), "class_id", "texts", F.col("all").alias("rows"))
    alone = placed.where("component is null").select("tid", F.col("tid").alias("part"), F.col("least").alias("class_id"), F.lit(1).cast("long").alias("texts"), "rows")
    return linked.unionByName(alone)


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: key, class_id (the smallest key of its class), class_texts and class_rows.

    Equal texts are one class; texts are linked at a probability Jaccard similarity of 0.8 or more of their
    5-word shingle counts, and classes are the components of links. Texts without words are only equal to
    themselves, null counts as empty. Null keys are never smallest (a class of them alone has a null class_id).
    """
    made = classes(df, key, text, **options)
    rows = _texts(df, key, text).select("doc", "tid")
    return rows.join(made, "tid").select(F.col("doc").alias(key), "class_id", F.col("texts").alias("class_texts"), F.col("rows").alias("class_rows"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class: that with the class's smallest key. Rows without near or equal copies are passed by a sketch, unshuffled.

    Rows that share the smallest key of a class: the least text hash, then the least hash of the whole row,
    decides, so that reruns keep the same row. A class of null keys keeps one of its rows. Null texts count as
    empty. Columns of any name pass through; an empty table stays empty.
    """
    names = df.columns
    tid, hit, part, least, whole = fresh(df, "tid", "touched", "part", "class", "row_hash")
    made = classes(df, key, text, **options)
    crowd = materialize(made.where("rows > 1").select(F.col("tid").alias(tid), F.col("part").alias(part), F.col("class_id").alias(least)), "near-crowd")
    touched = sketch(crowd, tid)

    def mark(batches):
        for batch in batches:
            found = passes(touched, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.append_column(hit, pa.array(found))

    with_tid = df.select(*(quoted(c) for c in names), F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias(tid))
    marked = map_rows(with_tid, mark, [*with_tid.schema.fields, T.StructField(hit, T.BooleanType())])
    clean = marked.where(~F.col(hit)).select(*(quoted(c) for c in names))
    others = marked.where(hit).join(crowd, tid, "left")
    alone = others.where(F.col(part).isNull()).select(*(quoted(c) for c in names))
    held = others.where(F.col(part).isNotNull() & quoted(key).eqNullSafe(F.col(least)))
    hashed = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = held.withColumn(whole, F.xxhash64(*hashed)).groupBy(part).agg(F.min_by(F.struct(*(quoted(c) for c in names)), F.struct(tid, whole)).alias("row")).select("row.*")
    return clean.unionByName(alone).unionByName(first)
