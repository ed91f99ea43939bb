"""Sampled positions for exact searches of repeated windows.

A window of L units (bytes or words) is represented by its minimizer: the leftmost of its k-unit grams
with the smallest hash. Equal windows choose the same gram at the same place, so a window can only repeat
where its gram does, and only the sampled grams (about two in L - k) are shuffled. The windows that share
a minimizer follow one another; the units they cover are its region. Everything is numpy on batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.llm.common import arrow_rows

PRIME = 0x9E3779B97F4A7C15
#: Units of a text that are hashed at once; longer texts are cut into pieces whose windows do not overlap.
PIECE = 1 << 21
#: Bytes of text in a batch: every byte takes part in some twenty 64-bit arrays.
BATCH = 1 << 19
#: log2 of the most bits in a sketch: 16 MB. A sketch has 16 bits for each that is set, up to this.
SKETCH_BITS = 27
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x9, 0xE)]] = True

_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse modulo 2^64, at least n of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", PRIME), ("down", pow(PRIME, -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


class Hashed:
    """Units of concatenated texts with prefix sums, from which any run of units gets its hash in one step."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start, length) -> np.ndarray:
        """Hashes of the runs [start, start + length)."""
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, len + 1 offsets) of an Arrow string or binary column; null counts as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: (hash, first byte, end byte) of each and the offsets of texts in words."""
    blank = np.ones(len(raw) + 2, dtype=bool)
    blank[1:-1] = BLANK[raw]
    new_text = np.zeros(len(raw) + 1, dtype=bool)
    new_text[offsets] = True
    inside = ~blank[1:]  # by byte; the last is past the end
    starts = np.flatnonzero(inside & (blank[:-1] | new_text))
    ends = np.flatnonzero(~blank[:-1] & (blank[1:] | new_text))
    codes = Hashed(BYTE_CODE[raw]).of(starts, ends - starts) if len(starts) else np.zeros(0, np.uint64)
    return codes, starts, ends, np.searchsorted(starts, offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Anchors:
    """The sampled positions of a batch: arrays text, lo, hi (window starts within the text), gram and region hash."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.length, self.base = length, offsets
        self.hashed = Hashed(codes)
        n = len(codes) - length + 1
        if n <= 0:
            self.text = self.lo = self.hi = self.at = np.zeros(0, np.int64)
            self.gram = self.region = np.zeros(0, np.uint64)
            return
        grams = self.hashed.grams(gram)
        place = np.uint64((1 << 24) - 1)
        low = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        at = (low & place).astype(np.int64)
        # windows that reach over a text's end stand for nothing
        step = np.zeros(n + 1, dtype=np.int32)
        np.add.at(step, np.minimum(np.maximum(offsets[1:] - length + 1, offsets[:-1]), n), 1)
        np.add.at(step, np.minimum(offsets[1:], n), -1)
        at[np.cumsum(step[:-1]) > 0] = -1
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        real = at[first] >= 0
        lo, hi = first[real], last[real]
        self.at = at[lo]
        self.gram = grams[self.at]
        # the region's hash also tells where the gram lies in it
        self.region = mix(self.hashed.of(lo, hi - lo + length) + (self.at - lo).astype(np.uint64) * np.uint64(PRIME))
        self.text = np.searchsorted(offsets, lo, side="right") - 1
        self.lo, self.hi = lo, hi

    def keep(self, mask: np.ndarray) -> Anchors:
        for name in ("text", "lo", "hi", "at", "gram", "region"):
            setattr(self, name, getattr(self, name)[mask])
        return self

    def local(self, x: np.ndarray) -> np.ndarray:
        return x - self.base[self.text]


def pieces(codes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[Anchors, np.ndarray]]:
    """Anchors of a batch and what to add to its texts' positions; texts beyond PIECE units come in pieces that share length - 1 units."""
    if offsets[-1] - offsets[0] <= 2 * PIECE:
        yield Anchors(codes, offsets, length, gram), np.zeros(len(offsets) - 1, np.int64)
        return
    for i in range(len(offsets) - 1):
        for at in range(offsets[i], max(offsets[i] + 1, offsets[i + 1] - length + 1), PIECE):
            part = codes[at : min(at + PIECE + length - 1, offsets[i + 1])]
            bounds = np.zeros(len(offsets), np.int64)
            bounds[i + 1 :] = len(part)
            yield Anchors(part, bounds, length, gram), np.full(len(offsets) - 1, at - offsets[i], np.int64)


def sketch(df: DataFrame, column: str, bits: int = SKETCH_BITS) -> np.ndarray:
    """A bitmap of up to 2^bits bits with those set that the column's low bits name: a filter that passes every value of the column, and some others.

    Spark builds it with a grouped bit_or, so that the driver receives 2^(bits - 6) rows at most, whatever
    the input's size, and the bitmap is folded until one bit in 16 is set. Results never depend on it, since what
    passes wrongly fails the exact joins that follow; some 8 million values fill it to a sixteenth, and beyond that
    more rows reach those joins.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    with arrow_rows(df.sparkSession, 1000):
        rows = df.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    where, words = rows.column("w").to_numpy(), rows.column("b").to_numpy()
    size = 1 << 10
    while size < 1 << (bits - 6) and size * 4 < len(where):
        size *= 2
    made = np.zeros(size, dtype=np.int64)
    np.bitwise_or.at(made, where & (size - 1), words)
    return made.view(np.uint64)


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
