"""BPE encoding and decoding with a contiguous rank array per word.

A word is a row of parts (its bytes at first) with the merge rank of every adjacent pair beside it. The least
rank is found by a scan, its boundary is deleted, and the two neighbouring ranks are looked up anew, until no pair has a
rank. For the short words of real text a scan of a few numbers beats any queue; words over ``LONG`` parts, where
scans would grow with the square, keep the same ranks in a heap.

The vocabulary file is a parameter; Spark ships it to the executors (its size is fixed). Words repeat, so each worker
remembers what it has merged, up to ``REMEMBERED`` words. One Arrow pass, no shuffle.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import rows_of, slices

LONG = 128
REMEMBERED = 100_000
LONGEST_REMEMBERED = 48
NO_RANK = 1 << 60


def byte_characters() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in table)
    return [table[b] for b in range(256)] if len(table) == 256 else [
        c for _, c in sorted((table | {b: chr(256 + k) for k, b in enumerate(rest)}).items())]


# Letters, numbers and lower-case mappings that Unicode 16.0, which the tokenizers library follows, has besides
# those of 15.1, which the interpreter has (first and last code point; capital and its small letter, these as of 17.0).
NEW = {
    "L": ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
          (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
          (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
          (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
          (0x1E5F1, 0x1E5FA)),
}
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)} \
    | {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def members(kind: str) -> frozenset[int]:
    """Code points of the general categories that begin with ``kind`` (L or N), in Unicode 16.0."""
    old = (c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind)
    return frozenset(old).union(*(range(a, b + 1) for a, b in NEW[kind]))


def class_of(points: set[int] | frozenset[int]) -> str:
    """Inside of a character class of the code points."""
    edges = sorted(c for c in points if c - 1 not in points), sorted(c for c in points if c + 1 not in points)
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(*edges, strict=True))


def disputed() -> frozenset[int]:
    """Code points that ``regex``, which follows another version, classes differently, and the new capitals."""
    import regex

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = set(NEW_LOWER)
    for kind in "LN":
        found |= set(map(ord, regex.findall(rf"\p{{{kind}}}", everything))) ^ members(kind)
    return frozenset(found)


class Vocabulary:
    """A tokenizer file of the kind: byte-level BPE with word ends, NFC, one space for white space, lower case."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        end = model["end_of_word_suffix"]
        self.tokens = [""] * (max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        chars = byte_characters()
        self.inner = [ids[c] for c in chars]
        self.last = [ids[c + end] for c in chars]
        self.size = len(self.tokens)
        self.ranks, self.made = {}, []  # rank of a pair, and what the merge of a rank makes
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            self.ranks[ids[a] * self.size + ids[b]] = rank
            self.made.append(ids[a + b])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the white space of the file's own regex library: control characters 28 to 31 do not count
        space = r"[\t-\r\x20\x85\xa0  -     　]"
        pattern = pattern.replace(r"[^\s", "[^" + space[1:-1])
        self.common = regex.compile(pattern).findall
        self.rare = frozenset(map(chr, disputed()))
        self.exact = regex.compile(pattern.replace(r"\p{L}", class_of(members("L"))).replace(r"\p{N}", class_of(members("N")))).findall
        self.spaces = regex.compile(f"{space}{{2,}}|(?! ){space}")  # a blank by itself stays as it is
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Words of a normalised text; the slower pattern of fixed ranges only where the two could differ."""
        if text.isascii() or self.rare.isdisjoint(text):
            return self.common(text)
        return self.exact(text.translate(NEW_LOWER))

    def rank(self, a: int, b: int) -> int:
        return self.ranks.get(a * self.size + b, NO_RANK)

    def merge(self, parts: list[int]) -> list[int]:
        """Merge by the rank array; of equal ranks the leftmost goes first."""
        if len(parts) > LONG:
            return self.merge_long(parts)
        rank, size = self.ranks.get, self.size
        ranks = [rank(a * size + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = made = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] * size + made, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(made * size + parts[i + 1], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges with the ranks in a heap; entries whose pair has changed are skipped."""
        n = len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(self.rank(parts[i], parts[i + 1]), i, parts[i], parts[i + 1]) for i in range(n - 1)]
        heap = [h for h in heap if h[0] < NO_RANK]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = self.made[least]
            gone[j], after[i] = True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := self.rank(parts[x], parts[after[x]])) < NO_RANK:
                    heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return [p for p, g in zip(parts, gone) if not g]

    def word_ids(self, word: str) -> bytes:
        raw = word.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        merged = self.merge(parts)
        return struct.pack(f"<{len(merged)}I", *merged)

    def normalized(self, text: str) -> str:
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()  # capital sigma by itself: no rule for ends of words

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._encode(text)
        return b"".join(
            np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._encode(p)
            for k, p in enumerate(self.specials.split(text)))

    def _encode(self, text: str) -> bytes:
        words = self.words(self.normalized(text))
        known = self.known
        out = list(map(known.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = words[k]
            ids = known.get(w)  # it may have come since
            if ids is None:
                ids = self.word_ids(w)
                if len(w) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            out[k] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so tokens are joined by single spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_vocabularies: dict[str, Vocabulary] = {}


def shipped(name: str) -> Vocabulary:
    """The worker's vocabulary, read once."""
    path = SparkFiles.get(name)
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
           decode: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (packed little-endian uint32) of every row; ``decoded`` if asked for.

    A null text counts as empty and has no ids. Null ids, repeated rows and ties are kept as they are, an empty table
    gives an empty one, and other columns are left out.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped(name)
        for batch in slices(batches):
            ids = [v.encode(t) if t else b"" for (t,) in rows_of(batch, "text")]
            columns = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([v.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded"][: len(columns)])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)
