"""Operator 9: benchmark decontamination by q-gram lemma filtering.

A passage of m characters with at most e edits keeps all but q * e of any set of its q-grams, on
diagonals (place in the text minus place in the passage) at most e apart. The benchmark's q-grams are a Spark
table that the texts' q-grams are joined with; shared ones are counted in overlapping bands of
2 * (e + 1) diagonals, a band that reaches the bound is a region, and a banded alignment of the passage
against it verifies that the edits stay within the budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import condensed, fresh, map_rows, materialize, quoted, slices
from brightfield.llm.sampling import PIECE, Hashed, passes, signed, sketch

Q = 12
#: Edits allowed as a share of the passage's characters.
EDITS = 0.05
#: Of a passage, q-grams that stand at more places of the benchmark are left uncounted where enough rarer ones remain; the bound is lower by as many.
COMMON = 64
#: So many q-grams more than the edits can destroy are counted at least, if the passage has them.
SPARE = 8
#: Neighbouring places of a text among which a region must have its share of the benchmark's q-grams.
NEAR = 32
#: The benchmark's q-grams are broadcast to the join up to so many rows (about 30 MB); beyond, Spark shuffles both sides.
BROADCAST_ROWS = 1 << 20

BLANK = 32
#: Stands between texts; no normalised character.
END = 0

_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Lower-case letter or digit, or else a blank, by code point; beyond the basic plane a character stands for itself."""
    if not _TABLE:
        chars = [chr(c) for c in range(0x10000)]
        _TABLE.append(np.array([ord(c.lower()[0]) if c.isalnum() else BLANK for c in chars], dtype=np.uint32))
    return _TABLE[0]


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, place of the END before each and after the last): lower case, each run of characters that are no letters or digits one blank."""
    raw = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))]) if texts else np.zeros(1, np.int64)
    table = _table()
    made = np.where(raw < len(table), table[np.minimum(raw, len(table) - 1)], raw)
    made[ends] = END
    keep = np.ones(len(made), dtype=bool)
    keep[1:] = (made[1:] != BLANK) | (made[:-1] != BLANK)
    return made[keep], (np.cumsum(keep) - 1)[ends]


def normal(text: str | None) -> np.ndarray:
    """One text's normalised characters without blanks around them."""
    made = normalise([text or ""])[0][1:-1]
    some = np.flatnonzero(made != BLANK)
    return made[some[0] : some[-1] + 1] if len(some) else made[:0]


def budget(m: int, share: float = EDITS, q: int = Q) -> int:
    """Edits allowed in a passage of m characters; less where the lemma's bound would not be positive."""
    e = int(m * share)
    while e and m - q + 1 - q * e < 1:
        e -= 1
    return e


def banded_distance(passage: np.ndarray, window: np.ndarray, shift: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the passage's best place in the window, if it needs at most `most` edits.

    The first character may fall anywhere in the band of `most` + 1 diagonals around `shift`. Rows are
    computed for the band alone; insertions within a row are a running minimum.
    """
    m, n = len(passage), len(window)
    reach = 2 * (most + 1)
    width = 2 * reach + 1
    cols = np.arange(width)
    big = 1 << 20
    # cell (i, b): i characters of the passage against the window up to i + shift - reach + b
    row = np.where((shift - reach + cols >= 0) & (shift - reach + cols <= n), 0, big)
    origin = shift - reach + cols
    for i in range(1, m + 1):
        at = i + shift - reach + cols
        real = (at >= 1) & (at <= n)
        same = np.zeros(width, dtype=bool)
        same[real] = window[at[real] - 1] == passage[i - 1]
        swap = row + ~same
        skip = np.append(row[1:] + 1, big)
        skip_origin = np.append(origin[1:], 0)
        best = np.where(swap <= skip, swap, skip)
        came = np.where(swap <= skip, origin, skip_origin)
        best = np.where((at >= 0) & (at <= n), best, big)
        # taking window characters without one of the passage: cost rises by one a step to the right
        run = best - cols
        least = np.minimum.accumulate(run)
        place = np.maximum.accumulate(np.where(run == least, cols, 0))
        row, origin = np.minimum(least + cols, big), came[place]
        if row.min() > most:
            return None
    b = int(row.argmin())
    return (int(row[b]), int(origin[b]), int(m + shift - reach + b)) if row[b] <= most else None


def places(raw: np.ndarray, passage: np.ndarray, most: int, bands: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the passage in one normalised text, the best one of each overlapping group, from bands (half, number) that reached the bound."""
    m, w = len(passage), most + 1
    found = set()
    for half, band in bands:
        lowest = band * 2 * w - half * w
        # an unedited passage needs no alignment
        same = next((d for d in range(max(lowest, 0), min(lowest + 2 * w, len(raw) - m + 1)) if np.array_equal(raw[d : d + m], passage)), None)
        if same is not None:
            found.add((same, same + m, 0))
            continue
        start = max(0, lowest - 2 * w)
        if got := banded_distance(passage, raw[start : start + m + 6 * w], lowest + w - start, most):
            found.add((start + got[1], start + got[2], got[0]))
    out: list[tuple[int, int, int]] = []
    for f in sorted(found, key=lambda f: (f[0], f[2], f[1])):
        if out and f[0] < out[-1][1]:
            if f[2] < out[-1][2]:
                out[-1] = f
        else:
            out.append(f)
    return out


def passages(benchmark: DataFrame, passage: str = "text", q: int = Q, share: float = EDITS) -> DataFrame:
    """Distinct normalised passages: pid (a hash), p, m characters, most edits, grams (place, gram) of their q-grams; one of fewer than q characters has one gram, itself between blanks."""
    columns = "p string, m int, most int, grams array<struct<place:int,gram:long>>"

    def grams(batches):
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                made = normal(t)
                if len(made):
                    whole = made if len(made) >= q else np.concatenate([[BLANK], made, [BLANK]])
                    each = Hashed(whole.astype(np.uint64)).grams(min(q, len(whole)) if len(made) >= q else len(whole)).view(np.int64)
                    rows.append({"p": made.tobytes().decode("utf-32-le", "surrogatepass"), "m": len(made), "most": budget(len(made), share, q), "grams": [{"place": i, "gram": g} for i, g in enumerate(each.tolist())]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("p", pa.string()), ("m", pa.int32()), ("most", pa.int32()), ("grams", pa.list_(pa.struct([("place", pa.int32()), ("gram", pa.int64())])))]))

    made = benchmark.select(quoted(passage).alias("t")).distinct().mapInArrow(grams, columns)
    return materialize(made.withColumn("pid", F.xxhash64("p")).groupBy("pid").agg(F.first(F.struct("p", "m", "most", "grams")).alias("s")).select("pid", "s.*"), "leak-passages", 500)


def _counted(known: DataFrame, q: int) -> DataFrame:
    """(gram, pid, place, most, bound, tiles): the q-grams of each passage that are counted, and how many of them a region must hold at least."""
    each = known.where(F.col("m") >= q).select("pid", "m", "most", F.explode("grams").alias("g")).select("pid", "m", "most", "g.*")
    common = each.groupBy("gram").agg(F.count("*").alias("n"))
    by = W.partitionBy("pid")
    ranked = each.join(common, "gram").withColumn("nth", F.row_number().over(by.orderBy("n", "place")))
    chosen = ranked.where((F.col("n") <= COMMON) | (F.col("nth") <= F.col("most") * q + SPARE))
    bound = (F.count("*").over(by) - F.col("most") * q).cast("int")
    tiles = F.ceil((F.col("m") + F.col("most") - q + 1) / NEAR).cast("int")
    long = chosen.select("gram", "pid", "place", "most", bound.alias("bound"), tiles.alias("tiles"))
    short = known.where(F.col("m") < q).select(F.col("grams")[0]["gram"].alias("gram"), "pid", F.lit(0).alias("place"), F.lit(0).alias("most"), F.lit(0).alias("bound"), F.lit(1).alias("tiles"))
    return materialize(long.unionByName(short), "leak-grams")


def _scan(bitmap: np.ndarray, least: int | None, lengths: list[int], q: int):
    """Kernel that gives (tid, at, gram) of a text's q-grams that the bitmap lets pass and of which `least` stand within NEAR places; and once each the short passages' whole grams."""

    def dense(ok: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(NEAR, np.int64), np.cumsum(ok), np.full(NEAR - 1, ok.sum())])
        good = np.concatenate([[0], np.cumsum(sums[NEAR:] - sums[:-NEAR] >= least)])  # windows by their last place
        return ok & (good[NEAR:] - good[:-NEAR] > 0)

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, ends = normalise(part.column(1).to_pylist())
                places_, grams = [], []
                for lo in range(0, len(raw), PIECE):
                    first = max(0, lo - NEAR)
                    piece = raw[first : lo + PIECE + NEAR + q]
                    if least is not None and len(piece) >= q:
                        made = Hashed(piece.astype(np.uint64)).grams(q)
                        at = np.flatnonzero(dense(passes(bitmap, made)))
                        at = at[(at + first >= lo) & (at + first < lo + PIECE)]
                        places_.append(at + first)
                        grams.append(made[at])
                    for n in lengths:
                        made = Hashed(np.where(piece == END, BLANK, piece).astype(np.uint64)).grams(n + 2)
                        at = np.flatnonzero(passes(bitmap, made))
                        _, once = np.unique(np.stack([np.searchsorted(ends, at + first, side="right").astype(np.uint64), made[at]]), axis=1, return_index=True) if len(at) else (None, at)
                        places_.append(at[once] + first + 1)
                        grams.append(made[at[once]])
                at = np.concatenate(places_) if places_ else np.zeros(0, np.int64)
                text = np.clip(np.searchsorted(ends, at, side="right") - 1, 0, max(len(ends) - 2, 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array((at - ends[text] - 1).astype(np.int64)), signed(np.concatenate(grams) if grams else np.zeros(0, np.uint64))], names=["tid", "at", "gram"])

    return scan


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", passage: str = "text", q: int = Q, share: float = EDITS) -> tuple[DataFrame, DataFrame]:
    """Found regions (tid, pid, start, end, edits, m) by distinct text, a 64-bit hash, and the passages."""
    spark = df.sparkSession
    rows = df.select(F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias("tid"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    known = passages(benchmark, passage, q, share)
    counted = _counted(known, q)
    # in any region of `tiles` runs of NEAR places, one holds at least so many of the counted q-grams
    n, least = counted.agg(F.count("*"), F.min(F.when(F.col("bound") > 0, F.ceil(F.col("bound") / F.col("tiles"))))).first()
    lengths = sorted(r.m for r in known.where(F.col("m") < q).select("m").distinct().collect())  # q - 1 values at most
    found = "tid long, pid long, start long, end long, edits int, m int"
    if not n:
        return spark.createDataFrame([], found), known
    hits = rows.mapInArrow(_scan(sketch(counted, "gram"), None if least is None else int(least), lengths, q), "tid long, at long, gram long")
    side = counted.drop("tiles")
    hits = hits.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, "gram")
    width = F.col("most") + 1
    band = lambda half: F.struct(F.lit(half).alias("half"), F.floor((F.col("at") - F.col("place") + half * width) / (2 * width)).alias("band"))
    # a short passage's gram is the passage
    bands = F.when(F.col("bound") > 0, F.array(band(0), band(1))).otherwise(F.array(F.struct(F.lit(0).alias("half"), F.lit(0).cast("long").alias("band"))))
    votes = hits.select("tid", "pid", "bound", "at", F.explode(bands).alias("b")).groupBy("tid", "pid", "bound", "b").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    regions = votes.where("n >= bound").groupBy("tid", "pid").agg(F.collect_list("b").alias("bands"), F.min("at").alias("at"))
    regions = materialize(regions, "leak-regions")
    touched = sketch(regions, "tid")

    def others(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(touched, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    texts = rows.mapInArrow(others, "tid long, text string").groupBy("tid").agg(F.first("text").alias("text"))
    pairs = regions.join(known.select("pid", "p", "most", "m"), "pid").join(texts, "tid").select("tid", "pid", "p", "most", "m", "bands", "at", "text")

    def verify(batches):
        last, raw = None, None
        schema = pa.schema([("tid", pa.int64()), ("pid", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("m", pa.int32())])
        for batch in batches:
            made = []
            ids = batch.column(0).to_pylist()
            for i, (pid, p, most, m, bands, at) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True)):
                if last != ids[i]:  # the join leaves the passages of one text together
                    last, raw = ids[i], normalise([batch.column(7)[i].as_py()])[0][1:-1]
                chars = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
                if m < q:
                    made += [(ids[i], pid, at, at + m, 0, m)] if np.array_equal(raw[at : at + m], chars) else []
                else:
                    made += [(ids[i], pid, *f, m) for f in places(raw, chars, most, [(b["half"], b["band"]) for b in bands])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], f.type) for k, f in enumerate(schema)], schema=schema)

    return materialize(pairs.mapInArrow(verify, found), "leaks", 100), known


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text", q: int = Q, share: float = EDITS) -> DataFrame:
    """Rows (key, row, item, start, end, edits): where a document holds a benchmark passage with at most `share` of its characters edited.

    Places are characters of the normalised text (lower case, runs of non-word characters one blank). A passage
    of fewer than q normalised characters is found word for word, at its first place. Passages without a letter or digit,
    null and empty texts find nothing; repeated passages and rows each report; a null key is reported as null. An empty
    table on either side finds nothing; columns of any name may stand beside.
    """
    found, known = leaks(df, benchmark, text, passage, q, share)
    t = quoted(text)
    rows = df.select(quoted(key).cast("long").alias("doc"), F.xxhash64(quoted(key).cast("long"), t).alias("row"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("tid"))
    items = _named(benchmark, item, passage, known)
    return rows.join(found.drop("m"), "tid").join(items, "pid").select(F.col("doc").alias(key), "row", F.col("item").alias(item), "start", "end", "edits")


def _named(benchmark: DataFrame, item: str, passage: str, known: DataFrame) -> DataFrame:
    """(item, pid) of each benchmark row with a passage."""

    def run(batches):
        for batch in batches:
            made = [normal(t) for t in batch.column(1).to_pylist()]
            some = pa.array([len(m) > 0 for m in made], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes().decode("utf-32-le", "surrogatepass") for m in made], pa.string())], names=["item", "p"]).filter(some)

    rows = benchmark.select(quoted(item).cast("long").alias("item"), quoted(passage).alias("t")).mapInArrow(run, "item long, p string")
    return materialize(rows.select("item", F.xxhash64("p").alias("pid")), "leak-items")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", passage: str = "text", q: int = Q, share: float = EDITS, short: bool = False) -> DataFrame:
    """The rows of df that hold no passage of the benchmark, with their columns; rows without one are passed by a sketch, unshuffled.

    A passage of fewer than q characters ("yes") says nothing about where a text comes from and only counts with
    `short`. Null and empty texts stay; repeated rows share their fate; columns of any name pass through.
    """
    names = df.columns
    tid, hit = fresh(df, "tid", "touched")
    gone = condensed(lambda: leaks(df, benchmark, text, passage, q, share)[0].where(F.lit(short) | (F.col("m") >= q)).select(F.col("tid").alias(tid)).distinct(), "leak-texts")
    touched = sketch(gone, tid)

    def mark(batches):
        for batch in batches:
            yield batch.append_column(hit, pa.array(passes(touched, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))))

    with_tid = df.select(*(quoted(c) for c in names), F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias(tid))
    marked = map_rows(with_tid, mark, [*with_tid.schema.fields, T.StructField(hit, T.BooleanType())])
    clean = marked.where(~F.col(hit)).select(*(quoted(c) for c in names))
    return clean.unionByName(marked.where(hit).join(gone, tid, "left_anti").select(*(quoted(c) for c in names)))
