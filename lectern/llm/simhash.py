"""SimHash near-dedup with anchor points of a covering code.

A fingerprint has 64 bits. Bits 0-22 and 23-45 are each covered by the binary Golay code [23,12], which is perfect: each
word lies within 3 bits of exactly one codeword. Their product is the covering code: 2^24 anchors, radius 3 + 3; the other
18 bits are free. Two fingerprints that differ in t bits at most differ in i bits of the first block and j of the second,
i + j <= t, so one's anchor (u, v) lies within 3 + i and 3 + j of the other. Every fingerprint is therefore sent to all
anchors within (3 + i, 3 + j) for i + j <= t (61 on average for t = 2), marked where it is at home, and each anchor compares
those at home with all that came. No link is lost, and no other pair is formed.

Equal fingerprints are one node before anything is replicated, so a group of exact copies costs one row. An anchor at
which many near copies meet looks up each one's 2081 neighbours instead of comparing all pairs, so its work is linear.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; repeated rows keep one
output row each; a null doc_id never is a component's id unless nothing else is in it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table
from .components import components

BITS, SEED = 64, 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle: A-Z lower-cased, words split at ASCII white space; repeats stay."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """Bit k is 1 if over half of the hashes have it; zero without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].astype("<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


@cache
def _golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each 23-bit word: its syndrome's coset; of each coset, the error patterns of weight 3, 4 or 5 at most, by weight."""
    gen = 0b101011100011

    def syndromes(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (gen << (bit - 11)), x)
        return x

    by_bit = syndromes(1 << np.arange(23, dtype=np.int64))
    low, high = np.zeros(4096, np.int64), np.zeros(2048, np.int64)
    for k in range(12):
        low ^= np.where(np.arange(4096) >> k & 1, by_bit[k], 0)
    for k in range(11):
        high ^= np.where(np.arange(2048) >> k & 1, by_bit[12 + k], 0)
    errors: list[list[list[int]]] = [[[], [], []] for _ in range(2048)]
    for weight in range(6):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            s = 0
            for b in bits:
                s ^= int(by_bit[b])
            errors[s][max(0, weight - 3)].append(word)
    return np.concatenate([low, high]), [[np.array(x, np.int64) for x in e] for e in errors]  # type: ignore[return-value]


def anchors(fp: int, t: int) -> tuple[int, np.ndarray]:
    """The home anchor, and all anchors within radius plus t; an anchor is its two codewords, 23 bits each."""
    if t > 2:
        raise ValueError("the error tables reach to two bits beyond the radius")
    syn, errors = _golay()
    x, y = fp & 0x7FFFFF, fp >> 23 & 0x7FFFFF
    ex, ey = (errors[int(syn[w & 4095] ^ syn[4096 + (w >> 12)])] for w in (x, y))
    out = []
    for i in range(t + 1):
        for j in range(t + 1 - i):
            out.append(((x ^ ex[i])[:, None] << 23 | (y ^ ey[j])[None, :]).ravel())
    return int((x ^ int(ex[0][0])) << 23 | (y ^ int(ey[0][0]))), np.concatenate(out)


def _near(home: np.ndarray, there: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in home, index in there) within t bits; there is sorted. In blocks, never all pairs at once."""
    flips = [0, *(1 << i for i in range(BITS))] + ([(1 << i) | (1 << j) for i, j in combinations(range(BITS), 2)] if t > 1 else [])
    if len(there) <= 8 * len(flips):
        step = max(1, (1 << 20) // len(there))
        for at in range(0, len(home), step):
            yield (lambda i, j: (i + at, j))(*np.nonzero(np.bitwise_count(home[at : at + step, None] ^ there[None, :]) <= t))
        return
    for f in flips if t else [0]:
        want = home ^ np.uint64(f)
        at = np.minimum(np.searchsorted(there, want), len(there) - 1)
        i = np.nonzero(there[at] == want)[0]
        yield i, at[i]


def _forest(home: np.ndarray, there: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Links enough to join what is linked at one anchor: at most one fewer than there are fingerprints."""
    there = np.unique(there)
    if len(there) < 2:
        return []
    parent = list(range(len(there)))
    at = np.searchsorted(there, home)

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    for i, j in _near(home, there, t):
        for a, b in zip(at[i].tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(there[a]), int(there[b])))
    return links


def _batch(cols: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp (the 64 bits as a signed long) of each row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(shingle_hashes(x, words)) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, t: int = 2) -> DataFrame:
    """distinct: fp (long, no repeats). x, y: fingerprints, enough links to connect all within t bits of one another."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 2000):
                keys, who, home = [], [], []
                for fp in fps[at : at + 2000].tolist():
                    h, every = anchors(fp, t)
                    keys.append(every)
                    who.append(np.full(len(every), fp, np.uint64))
                    home.append(every == h)
                if keys:
                    yield _batch([np.concatenate(keys), np.concatenate(who).view(np.int64), np.concatenate(home)], [pa.int64(), pa.int64(), pa.bool_()], ["anchor", "fp", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; one anchor is held at a time."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found: list[tuple[int, int]] = []

        def work(a: np.ndarray, fp: np.ndarray, home: np.ndarray) -> None:
            cuts = np.flatnonzero(np.diff(a)) + 1
            bounds = np.concatenate([[0], cuts, [len(a)]])
            homes = np.add.reduceat(home.astype(np.int64), bounds[:-1])
            for k in np.flatnonzero((np.diff(bounds) > 1) & (homes > 0)).tolist():
                part = slice(bounds[k], bounds[k + 1])
                found.extend(_forest(fp[part][home[part]], fp[part], t))

        def flush() -> pa.RecordBatch:
            xy = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            found.clear()
            return _batch([xy[:, 0], xy[:, 1]], [pa.int64(), pa.int64()], ["x", "y"])

        for b in batches:
            a, fp, home = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)
            if not len(a):
                continue
            last = int(np.searchsorted(a, a[-1]))  # from here on the batch's last anchor, which may go on
            if held and (last > 0 or held[-1][0][-1] != a[0]):
                own = int(np.searchsorted(a, held[-1][0][-1], "right")) if held[-1][0][-1] == a[0] else 0
                held.append((a[:own], fp[:own], home[:own]))
                work(*(np.concatenate([h[i] for h in held]) for i in range(3)))
                held = []
                a, fp, home, last = a[own:], fp[own:], home[own:], last - own
            if last > 0:
                work(a[:last], fp[:last], home[:last])
            held.append((a[last:], fp[last:], home[last:]))
            if len(found) > 5000:
                yield flush()
        if held:
            work(*(np.concatenate([h[i] for h in held]) for i in range(3)))
        yield flush()

    sent = distinct.select("fp").mapInArrow(send, "anchor long, fp long, home boolean")
    return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "x long, y long").distinct()


def classes(prints: DataFrame, t: int = 2) -> DataFrame:
    """prints: doc_id, fp. fp, component_id: of each distinct fingerprint, the smallest doc_id that links reach from it."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, t).select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, words: int = 3, t: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of each row."""
    prints = materialise(fingerprints(docs, words), "prints")
    own = classes(prints, t)
    # A fingerprint of many copies is one row of `own`; its copies are spread over salts.
    salts = 32
    left = prints.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    right = own.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["fp", "s"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
