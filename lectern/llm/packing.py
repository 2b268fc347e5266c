"""Packing by Karmarkar-Karp multiway differencing.

Each task tokenises its documents and packs them group by group, without a shuffle. A document's full windows are
sequences of their own; the rests of a group are dealt to m windows by largest differencing: every rest starts as a partial
partition, and the two partial partitions of largest imbalance are merged, the fuller windows of one with the emptier ones
of the other, until one is left. m starts at the group's tokens over the capacity and rises whenever a window exceeds it.
Rests of more than a third of a window are cut into equal parts, since few large pieces can't make equal windows.

A group is bounded by its tokens, so memory is too, whatever the size of a task's input; its last group is smaller.
Groups follow the order in which a task reads its rows, which a run of the same task again repeats.

Defined results: a null or empty text has only the closing id; repeated rows are packed each for itself and null keys
pass through; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tokenizer_file

TOKENIZER, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 2
#: Windows of a group: more balance better and take longer (their square).
GROUP_WINDOWS = 256
#: A rest is cut into parts of a window over so many at most.
PARTS = 3
#: A task forgets its words beyond so many, and words longer than so many characters at once.
MEMO_WORDS, MEMO_CHARS = 800_000, 64


# -- tokens ------------------------------------------------------------------------------------------------------------


@cache
def _tokenizer(name: str, folder: str | None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name, folder))


@cache
def _file(name: str, folder: str | None) -> dict:
    with open(tokenizer_file(name, folder), encoding="utf-8") as f:
        return json.load(f)


def _pretokens(name: str, folder: str | None) -> str:
    """The pattern of what the tokenizer's file merges separately."""
    return _file(name, folder)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


def _specials(name: str, folder: str | None) -> list[str]:
    """The strings that the library takes as one id wherever a text holds them."""
    return [t["content"] for t in _file(name, folder)["added_tokens"]]


def _printable() -> dict[int, int]:
    """Byte-level vocabularies write a byte that isn't printable as the next free character from 256 on."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + k for k, b in enumerate(odd)}


class _Memo(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class Tokens:
    """Ids of texts for the tokenizer file, which never joins over blanks or line ends: words that come again are looked up.

    New words of printable Latin-1 are split here and merged by the library's model; all others go through the whole library, as
    do texts that hold a special string such as <|endoftext|>, which thus is its own id, as in the library's plain call.
    """

    def __init__(self, name: str = TOKENIZER, folder: str | None = None):
        self.library = _tokenizer(name, folder)
        self.model, self.chars = self.library.model, _printable()
        self.split = regex.compile(_pretokens(name, folder)).findall
        self.specials = _specials(name, folder)
        self.words, self.parts = _Memo(self._word, MEMO_WORDS), _Memo(self._part, MEMO_WORDS)

    def _word(self, word: str) -> bytes:
        if len(word) > MEMO_CHARS or not word.isprintable() or not (word.isascii() or max(word) < "\u0100"):
            return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.parts[p] for p in self.split(word.lower())])

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.chars)
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


# -- differencing ------------------------------------------------------------------------------------------------------


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Places of the sizes in each of m windows, by largest differencing."""
    left, right = [], []  # of a merged node, by its number less len(sizes)
    heap: list[tuple] = []
    for k, s in enumerate(sizes):
        heap.append((-s if m > 1 else 0, k, np.array([s], np.int64), np.array([k], np.int64)))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, sums2, nodes2 = heapq.heappop(heap)
        over = len(sums) + len(sums2) - m
        if over <= 0:  # each has a window of its own
            sums, nodes = np.concatenate([sums, sums2]), np.concatenate([nodes, nodes2])
        else:
            a, b = len(sums) - over, len(sums2) - over
            made = np.arange(over) + len(sizes) + len(left)
            left += nodes[a:].tolist()
            right += nodes2[b:][::-1].tolist()
            sums = np.concatenate([sums[:a], sums2[:b], sums[a:] + sums2[b:][::-1]])
            nodes = np.concatenate([nodes[:a], nodes2[:b], made])
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        if len(sums) == m:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, nodes))
        order += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        own, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < len(sizes):
                own.append(x)
            else:
                stack += (right[x - len(sizes)], left[x - len(sizes)])
        out.append(own)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within the capacity, as few as differencing manages."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece exceeds the capacity")
    total = sum(sizes)
    m = -(-total // capacity)
    while True:
        found = differencing(sizes, m)
        most = max(sum(sizes[k] for k in w) for w in found)
        if most <= capacity:
            return found
        # the mean that would have let the fullest window fit, halfway
        excess = most - total / m
        m = max(m + 1, min(int(np.ceil(total / max(1.0, capacity - excess / 2))), 2 * m))


# -- documents ---------------------------------------------------------------------------------------------------------

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Packer:
    def __init__(self, part: int, capacity: int, group: int):
        self.sequence, self.capacity, self.group = part << 33, capacity, group
        self.rests: list[tuple] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        n, cap, rows = len(ids) // 4, self.capacity, []
        full = n // cap
        for k in range(full):
            rows.append((doc_id, k * cap, cap, ids[k * cap * 4 : (k + 1) * cap * 4], n, self.sequence, 0))
            self.sequence += 1
        start, rest = full * cap, n - full * cap
        parts = -(-rest // max(1, cap // PARTS))
        for k in range(parts):
            a, b = start + rest * k // parts, start + rest * (k + 1) // parts
            if b > a:
                self.rests.append((doc_id, a, b - a, ids[a * 4 : b * 4], n))
                self.held += b - a
        return rows + (self.flush() if self.held >= self.group * cap else [])

    def flush(self) -> list[tuple]:
        rows = []
        for window in windows([r[2] for r in self.rests], self.capacity):
            at = 0
            for k in window:
                rows.append((*self.rests[k], self.sequence, at))
                at += self.rests[k][2]
            self.sequence += 1
        self.rests, self.held = [], 0
        return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, text: str = "text", key: str = "doc_id", name: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """A row for each piece of a document: its ids (binary, 4 bytes each), its sequence and its place there."""
    small_batches(docs.sparkSession)
    names, kinds = [x.split()[0] for x in PIECES.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, end = Tokens(name, folder), _Packer(TaskContext.get().partitionId(), capacity, group_windows), np.array([END_ID], "<u4").tobytes()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for doc_id, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rows := packer.add(doc_id, tokens.encode(words) + end):
                    yield batch(rows)
        yield batch(packer.flush())

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
