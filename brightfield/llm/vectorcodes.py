"""Vector code compression: integer product quantisation whose assignments look into memoised grid cells."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import discard, materialize, quoted
from brightfield.llm.neighbours import usable

#: Cells that a task remembers for a part before it starts anew; a forgotten cell is made again.
MEMO_CELLS = 1 << 15
#: Distances that are evaluated at once.
PAIRS = 1 << 16


class Cells:
    """Nearest entries of one part's codebook, exact, ties to the lower index.

    A part falls into a cell of a grid of `width`. Over the cell's box an entry has a least and a largest squared distance; entries whose
    least exceeds another's largest can be nearest to no part of the cell. The others are remembered for the cell, and parts are held
    against those alone.
    """

    def __init__(self, book: np.ndarray, width: int):
        self.book, self.width, self.memo = book, width, {}

    def open_entries(self, cells: np.ndarray) -> np.ndarray:
        """cells x entries: whether the entry can be nearest to a part in the cell."""
        least, most = (np.zeros((len(cells), len(self.book)), dtype=np.int64) for _ in range(2))
        for i in range(cells.shape[1]):
            rows, back = np.unique(cells[:, i], return_inverse=True)
            lo = rows[:, None] * self.width
            below, above = lo - self.book[None, :, i], self.book[None, :, i] - (lo + self.width - 1)
            least += (np.maximum(np.maximum(below, above), 0) ** 2)[back]
            most += (np.maximum(-below, -above) ** 2)[back]  # the farther end of the box
        return least <= most.min(axis=1, keepdims=True)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part."""
        cells, back = np.unique(parts // self.width, axis=0, return_inverse=True)
        back = back.ravel()
        names = [c.tobytes() for c in cells]
        new = [i for i, c in enumerate(names) if c not in self.memo]
        if len(self.memo) + len(new) > MEMO_CELLS:
            self.memo, new = {}, list(range(len(names)))
        for a in range(0, len(new), 256):
            some = new[a : a + 256]
            for i, row in zip(some, self.open_entries(cells[some]), strict=True):
                self.memo[names[i]] = np.flatnonzero(row)
        lists = [self.memo[c] for c in names]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat, starts = np.concatenate(lists), np.cumsum(sizes) - sizes
        index, error = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        cost = np.cumsum(sizes[back])
        a = 0
        while a < len(parts):
            b = max(a + 1, int(np.searchsorted(cost, PAIRS + (cost[a - 1] if a else 0), side="right")))
            n = sizes[back[a:b]]
            heads = np.cumsum(n) - n
            row = np.repeat(np.arange(b - a), n)
            entry = flat[np.arange(n.sum()) - np.repeat(heads, n) + np.repeat(starts[back[a:b]], n)]
            far = ((parts[a:b][row] - self.book[entry]) ** 2).sum(axis=1)
            best = np.minimum.reduceat(far, heads)
            hits = np.flatnonzero(far == best[row])
            _, first = np.unique(row[hits], return_index=True)  # entries of a cell ascend, so the first hit has the lower index
            index[a:b], error[a:b] = entry[hits[first]], best
            a = b
        return index, error


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x.astype(np.int64), parts, axis=1)


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, width: int = 96) -> tuple[DataFrame, list[np.ndarray]]:
    """(the rows kept with `code` and `error`, the codebooks of the parts).

    Component x counts as floor(scale * x); vectors are cut into equal consecutive parts. A codebook starts as the parts of the rows with the
    smallest keys (`entries` of them at most, fewer if there are fewer rows); rows with one key stand in the order of their vectors, rows
    without a key last. Each round assigns every part of every row to its nearest entry, squared distance, ties to the lower index, and
    replaces entries by the floors of their parts' means; unused entries stay. Each task passes on one sum an entry, so that a round
    shuffles as much as codebooks are large. Arithmetic is in integers, so that nothing depends on the order of rows.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, and so are vectors of another length than
    that of the first row of the codebook. A length that parts do not divide, or components that 64-bit distances cannot hold, raise an error.
    Repeated rows are kept; other columns stay, unless they are named `code` or `error`, which the results replace.
    """
    whole, order = "whole", "order"
    kept = [c for c in vectors.columns if c.lower() not in ("code", "error")]
    at = [f"c{i}" for i in range(len(kept))]  # names of any kind pass through tasks under plain ones
    rows = vectors.select(*(quoted(c).alias(n) for c, n in zip(kept, at, strict=True)))
    name, vec = at[[c.lower() for c in kept].index(key.lower())], at[[c.lower() for c in kept].index(vector.lower())]
    rows = rows.where(usable(F.col(vec), zeros=True)).withColumn(whole, F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))
    table = materialize(rows, "vectors", 4000)
    first = table.orderBy(F.col(name).asc_nulls_last(), vec).limit(entries).select(F.size(whole).alias(order), whole).collect()
    fields = [table.schema[n] for n in at] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    if not first:
        empty = table.select(*(F.col(n).alias(c) for n, c in zip(at, kept, strict=True)), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, [np.empty((0, 0), dtype=np.int64)] * parts
    dim = first[0][order]
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    same = table.where(F.size(whole) == dim)
    books = _parts(np.array([r[whole] for r in first if r[order] == dim], dtype=np.int64), parts)
    limit = int((2**62 / dim) ** 0.5 / 2)
    over = same.where(F.exists(whole, lambda x: F.abs(x) > limit)).limit(1).count()
    if over:
        raise ValueError(f"components beyond {limit} have squared distances that 64 bits cannot hold")
    d = dim // parts
    sums = ", ".join(f"s{i} long" for i in range(d))

    def totals(books):
        def run(batches):
            cells = [Cells(b, width) for b in books]
            n = np.zeros((parts, len(books[0])), dtype=np.int64)
            s = np.zeros((parts, len(books[0]), d), dtype=np.int64)
            for batch in batches:
                for p, x in enumerate(_parts(_integers(batch.column(0)), parts)):
                    index, _ = cells[p].nearest(x)
                    np.add.at(s[p], index, x)
                    n[p] += np.bincount(index, minlength=len(n[p]))
            p, e = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *(pa.array(s[p, e, i]) for i in range(d))], names=["part", "entry", "n", *(f"s{i}" for i in range(d))])

        return run

    for _ in range(rounds):
        made = same.select(whole).mapInArrow(totals(books), f"part int, entry int, n long, {sums}").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(d)))
        books = [b.copy() for b in books]
        for r in made.collect():  # as many rows as codebooks have entries
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(d)]

    def assign(batches):
        cells = [Cells(b, width) for b in books]
        for batch in batches:
            found = [c.nearest(x) for c, x in zip(cells, _parts(_integers(batch.column(len(at))), parts), strict=True)]
            codes = np.stack([i for i, _ in found], axis=1)
            digits = pa.array(["".join(f"{i:02x}" for i in row) for row in codes.tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(at)], digits, pa.array(sum(e for _, e in found))], names=[*at, "code", "error"])

    coded = same.mapInArrow(assign, T.StructType(fields))
    out = materialize(coded.select(*(F.col(n).alias(c) for n, c in zip(at, kept, strict=True)), "code", "error"), "codes", 4000)
    discard(table)
    return out, books


def _integers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded_vectors(vectors: DataFrame, label: str = "label", **how) -> DataFrame:
    """vector_codes with `label_error`, the error summed over rows of equal labels (nulls together), and `codebooks_sha256`."""
    coded, books = vector_codes(vectors, **how)
    by = coded.groupBy(quoted(label).alias("l")).agg(F.sum("error").alias("label_error"))
    # labels can be few or many: their sums are joined, and Spark splits a label that holds many rows
    joined = coded.join(by, quoted(label).eqNullSafe(F.col("l")), "left").drop("l")
    return joined.withColumn("codebooks_sha256", F.lit(books_digest(books)))

