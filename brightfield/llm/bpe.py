"""Operator 2: BPE encoding and decoding with a contiguous rank array.

A word is held as a row of part ids with the merge rank of every adjacent pair beside it. Until no
pair has a rank, the leftmost minimum is found, the boundary behind it is deleted and the ranks of
the two neighbouring pairs are looked up again. Distinct words of equal length form one matrix, so
that a step of the loop serves thousands of words. Words repeat, so each task keeps a table of those
it has seen; the table is emptied when full, which changes no result.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from itertools import chain, filterfalse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brightfield.llm.common import map_texts

#: Words of up to this many bytes are merged in matrices, longer ones with a heap.
SHORT = 48
#: Words that a worker process remembers, at about 200 bytes each.
REMEMBERED = 250_000
NO_RANK = np.int32(2**31 - 1)

_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The encoder of a vocabulary file, loaded once a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}-\\U{chars[j]:08x}")
        i = j + 1
    return "".join(out)


#: White space of the split pattern (the Unicode property), a fixed value.
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Texts whose characters all lie below this are split with small character classes, which is ten times faster.
LATIN = 0x370


def _piece_pattern(below: int) -> re.Pattern:
    """The vocabulary's split pattern for characters below a bound. Its first branches begin with characters of their own, so their order is free."""
    letters, numbers = [], []
    for c in range(below):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            letters.append(c)
        elif kind == "N":
            numbers.append(c)
    letter, number, space = _ranges(letters), _ranges(numbers), _ranges([c for c in SPACES if c < below])
    return re.compile(f"[{letter}]+|[{number}]|'(?:s|t|re|ve|m|ll|d)|[^{space}{letter}{number}]+")


def byte_chars() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: visible Latin-1 stays, the rest follows from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(seen))}
    return [chr(rest.get(b, b)) for b in range(256)]


class WordBpe:
    """A byte-level BPE whose words end in a suffix, lower-cased, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        ids = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.tokens = [ids.get(i, "") for i in range(max(ids) + 1)]
        self.pattern, self.latin_pattern = _piece_pattern(sys.maxunicode + 1), _piece_pattern(LATIN)
        self.beyond_latin = re.compile(f"[^\\0-{chr(LATIN - 1)}]")
        self.known: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.known.update({t: np.array([i], dtype="<u4").tobytes() for t, i in self.specials.items()})

    def pieces(self, text: str) -> list[str]:
        """Words of the split pattern in order; special tokens stand for themselves."""
        if "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for part in self.split_specials.split(text):
            if part in self.specials:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()  # no final sigma
            if self.beyond_latin.search(text):
                return self.pattern.findall(text)
        return self.latin_pattern.findall(text.lower())

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NO_RANK where there is none."""
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges rows of equal length; returns (row numbers, ids) of rows that ended together."""
        rows, done = np.arange(len(parts)), []
        ranks = self.lookup(parts[:, :-1], parts[:, 1:])
        while True:
            n, width = parts.shape
            if width == 1:
                done.append((rows, parts))
                return done
            at = ranks.argmin(1)
            best = ranks[np.arange(n), at]
            open_ = best < NO_RANK
            if not open_.all():
                done.append((rows[~open_], parts[~open_]))
                rows, parts, ranks, at, best = rows[open_], parts[open_], ranks[open_], at[open_], best[open_]
                n = len(rows)
                if not n:
                    return done
            each = np.arange(n)
            parts[each, at] = self.merged[best]
            stay = np.ones((n, width), dtype=bool)
            stay[each, at + 1] = False
            parts = parts[stay].reshape(n, width - 1)
            stay = np.ones((n, width - 1), dtype=bool)
            stay[each, at] = False
            ranks = ranks[stay].reshape(n, width - 2)
            left = at > 0
            ranks[each[left], at[left] - 1] = self.lookup(parts[each[left], at[left] - 1], parts[each[left], at[left]])
            right = at < width - 2
            ranks[each[right], at[right]] = self.lookup(parts[each[right], at[right]], parts[each[right], at[right] + 1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, with a heap of pairs and linked parts."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        ahead, behind = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            ahead[i] = ahead[j]
            if ahead[j] >= 0:
                behind[ahead[j]] = i
            for p, q in ((behind[i], i), (i, ahead[i])):
                if p >= 0 and q >= 0 and (r := self.rank_of.get(ids[p] << 16 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words and remembers their ids as little-endian bytes."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        order = lengths.argsort(kind="stable")
        sizes, starts = np.unique(lengths[order], return_index=True)
        for length, rows in zip(sizes.tolist(), np.split(order, starts[1:]), strict=True):
            group = [words[i] for i in rows.tolist()]
            data = [raws[i] for i in rows.tolist()]
            if length > SHORT:
                self.known.update((w, self.merge_long(raw).astype("<u4").tobytes()) for w, raw in zip(group, data, strict=True))
                continue
            raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(group), length)
            parts = self.first[raw]
            parts[:, -1] = self.last[raw[:, -1]]
            for ended, ids in self.merge_rows(parts):
                each = np.ascontiguousarray(ids, dtype="<u4").view(f"V{4 * ids.shape[1]}").ravel().tolist()
                self.known.update(zip(map(group.__getitem__, ended.tolist()), each, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers (null: none)."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self._reset()
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(split)))
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a blank: the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds token_ids (binary, little-endian unsigned 32-bit ids), n_tokens and decoded (the ids decoded again).

    Every whole text is encoded; null and empty texts have no ids and decode to "". Repeated rows are
    encoded alike, other columns pass through and one named like an output is replaced. Rows are
    independent: no shuffle, memory is bounded by a batch of texts and one text's ids.
    """

    def kernel():
        bpe = encoder(vocabulary)

        def apply(texts):
            ids = bpe.encode(texts)
            return [ids, [len(x) // 4 for x in ids], [bpe.decode(x) for x in ids]]

        return apply

    out = T.StructType([T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return map_texts(df, text, kernel, out, keep)
