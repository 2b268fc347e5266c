"""SimHash near-dedup at a similarity of five-word shingles, for the pipeline.

Each distinct text gets the SimHash of all its shingles, and fingerprints that differ by WITHIN bits at most meet at the
anchors of the covering code in ``simhash``, which loses none. Texts whose fingerprints are joined there are compared by
the Jaccard similarity of their whole shingle sets, as 32-bit hashes; links that hold join texts to groups.

At a similarity of 0.8 these fingerprints differ by up to 14 of 64 bits (median 10), out of reach for a covering code with
few anchors. So each text also gets several views: the SimHash of a min-wise sample of its shingles. Two texts of
similarity s share a given view's fingerprint with probability s^PER_VIEW or more, and so at least one of VIEWS with 0.9998
at s = 0.8. Texts that share one are compared likewise, in ROUNDS: where all that meet are in one group by now, no
comparison could add to it.

Equal texts are one node from the start. An anchor (texts joined by the code, or a view's fingerprint) of more than BLOCK
texts or BYTES of hashes is first split into blocks of about that size, each with the same LEADERS or so, which joins a
group of near copies at little cost. Where an anchor's texts are after all rounds still in several groups, every pair of
its half blocks is compared too, so all its pairs are. No pairs are emitted but links of a forest, at most one fewer than
a task's texts.

Defined results: null counts as empty, and all wordless texts that are equal are copies of one another; a text of fewer
than five words is one shingle; rows that repeat doc_id and text are copies, of which the first by their other columns stays;
of a group the least doc_id stays, null last;
an empty table stays empty; all columns pass through, and helper columns are prefixed with ``__n_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .components import components
from .simhash import links as code_links
from .simhash import shingle_hashes, simhash

WORDS, SIMILARITY = 5, 0.8
WITHIN = 2
VIEWS, PER_VIEW = 16, 4
#: The first anchor and the number of anchors of each round; anchor 0 is the covering code's, the others are views.
ROUNDS = ((0, 1), (1, 4), (5, VIEWS - 4))
SALTS = 32
BLOCK, BYTES, LEADERS = 2000, 8 << 20, 32
_MIX = np.random.default_rng(3).integers(1, 1 << 63, (VIEWS * PER_VIEW, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def describe(text: str | None, words: int = WORDS) -> tuple[list[int], bytes]:
    """The fingerprints of a text and of its views (as signed longs), and its shingles (ascending 32-bit hashes)."""
    h = shingle_hashes(text, words)
    if not len(h):
        return [0] * (1 + VIEWS), b""
    whole = simhash(h)
    h = np.unique((h >> np.uint64(32)).astype(np.uint32))
    wide = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide ^= wide >> np.uint64(29)
    least = np.full((len(_MIX), 1), np.iinfo(np.uint64).max)
    for at in range(0, len(wide), 1 << 14):
        mixed = wide[None, at : at + (1 << 14)] * _MIX
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(0xD6E8FEB86659FD93)).min(1, keepdims=True))
    views = [simhash(v) for v in least.reshape(VIEWS, PER_VIEW)]
    return np.array([whole, *views], np.uint64).view(np.int64).tolist(), h.astype("<u4").tobytes()


def similar(sets: list[np.ndarray], at_least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of a forest over the sets of hashes, by similarity."""
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    m = len(order)
    if m < 2:
        return []
    sizes = np.array([len(sets[i]) for i in order])
    vocabulary, local = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # sizes ascend, and a set is similar to none that is larger by more than the threshold
    last = np.searchsorted(at_least * sizes, sizes, "right")
    flag = np.zeros(len(vocabulary), bool)
    label, links = np.arange(m), []
    for i in range(m - 1):
        a, b = i + 1, int(last[i])
        if a >= b or (label[a:b] == label[i]).all():
            continue
        own = local[starts[i] : ends[i]]
        flag[own] = True
        both = np.add.reduceat(flag[local[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], dtype=np.int64)
        flag[own] = False
        for j in (a + np.flatnonzero((both >= at_least * (sizes[i] + sizes[a:b] - both)) & (label[a:b] != label[i]))).tolist():
            if label[j] != label[i]:
                links.append((order[i], order[j]))
                label[label == label[j]] = label[i]
    return links


_ROWS = "doc_id long, key binary, views array<long>, hashes binary"


def _described(docs: DataFrame, text: str, words: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [describe(x, words) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.binary())], names=["doc_id", "key", "views", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(text), F.col(text).cast("string").alias("text")).mapInArrow(run, _ROWS)


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).alias("key")


def _compare(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterator[pa.RecordBatch]:
    """Rows (group in three columns, key, hashes) sorted by group; one group is held at a time."""
    now, held, links = None, {}, []

    def close() -> None:
        if len(held) > 1:
            keys = list(held)
            links.extend((keys[i], keys[j]) for i, j in similar([np.frombuffer(held[k], "<u4") for k in keys], at_least))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"])
        links.clear()
        return out

    for batch in batches:
        groups = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        for group, key, hashes in zip(groups, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if group != now:
                close()
                now, held = group, {}
                if len(links) > 5000:
                    yield flush()
            held[key] = hashes
    close()
    yield flush()


def _coded(rows: DataFrame) -> DataFrame:
    """key, least, size, views of each distinct text; first of the views is what the covering code joins its fingerprint to."""
    prints = rows.where(F.length("hashes") > 0).select(F.col("views")[0].alias("fp")).distinct()
    codes = components(code_links(prints, WITHIN).select(F.col("x").alias("a"), F.col("y").alias("b")))
    one = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("views").alias("views"), F.first(F.length("hashes")).alias("size"))
    # many texts may share a fingerprint; they are spread over salts
    left = one.withColumn("node", F.col("views")[0]).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    right = codes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.array(F.coalesce("root", "node"))
    return left.join(right, ["node", "salt"], "left").select("key", "least", "size", F.concat(own, F.slice("views", 2, VIEWS)).alias("views"))


def keep_one(docs: DataFrame, text: str = "text", words: int = WORDS, at_least: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each group of near copies."""
    rows = materialise(_described(docs, text, words), "near-rows")
    texts = materialise(_coded(rows), "near-texts")
    roots = texts.select(F.col("key").alias("node"), F.col("key").alias("root")).limit(0)
    where = F.xxhash64("key", "view")

    def seen(first: int, n: int, *more: Column) -> DataFrame:
        own = texts.where("size > 0").join(roots, F.col("key") == F.col("node"), "left") if more else texts.where("size > 0")
        return own.select("key", "least", "size", *more, F.posexplode(F.slice("views", first + 1, n)).alias("at", "fp")).withColumn("view", F.col("at") + first).drop("at")

    # only texts that meet another one are compared, so only their hashes are dealt out in each round
    often = materialise(seen(0, 1 + VIEWS).groupBy("view", "fp").count().where("count > 1").select("view", "fp"), "near-often")
    meets = seen(0, 1 + VIEWS).join(often, ["view", "fp"]).select("key", "least").distinct()
    sets = materialise(rows.join(meets, (meets.key == rows.key) & meets.least.eqNullSafe(rows.doc_id), "left_semi").select("key", "hashes"), "near-sets")

    def apart(seen: DataFrame) -> DataFrame:
        """The anchors whose texts are in several groups."""
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BYTES), F.lit(1)).cast("int")
        often = seen.groupBy("view", "fp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
        return materialise(often.select("view", "fp", "n", F.least(blocks, F.col("n")).cast("int").alias("blocks")), "near-apart")

    def compared(at: Column, met: DataFrame) -> DataFrame:
        """roots, with the links that hold among the texts dealt to a block."""
        dealt = met.select("view", "fp", "key", F.explode(at).alias("block"))
        sorted_ = dealt.join(sets, "key").select("view", "fp", "block", "key", "hashes").repartition("view", "fp", "block").sortWithinPartitions("view", "fp", "block")
        links = materialise(sorted_.mapInArrow(lambda batches: _compare(batches, at_least), "a binary, b binary"), "near-links")
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))

    group = F.xxhash64(F.coalesce("root", "key")).alias("group")
    leads = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("key"), F.col("n")) < F.least(F.lit(LEADERS), F.col("n") / F.col("blocks") / 4))
    large = []
    for first, n in ROUNDS:
        met = apart(seen(first, n, group))
        large.append(met.where("blocks > 1").select("view", "fp"))
        dealt = F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(where, F.col("blocks")).cast("int")))
        roots = compared(dealt, seen(first, n).join(met, ["view", "fp"]))
    split = reduce(DataFrame.unionByName, large)
    if not split.isEmpty():
        every = min(x for x, _ in ROUNDS), sum(n for _, n in ROUNDS)
        met = apart(seen(*every, group).join(split, ["view", "fp"]))
        halves = F.col("blocks").cast("long") * 2
        own = F.pmod(where, halves)
        others = F.filter(F.sequence(F.lit(0).cast("long"), halves - 1), lambda x: x != own)
        roots = compared(F.transform(others, lambda x: F.least(x, own) * halves + F.greatest(x, own)), seen(*every).join(met, ["view", "fp"]))
    placed = texts.select("key", "least").join(roots, texts.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("nil"), "least", "key")).alias("first")
    stay = materialise(placed.groupBy("root").agg(first).select(F.col("first.least").alias("__n_least"), F.col("first.key").alias("__n_key")), "near-kept")
    keyed = docs.withColumn("__n_own", _key(text))
    out = keyed.join(stay, (F.col("__n_own") == F.col("__n_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__n_least")), "left_semi")
    if not rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        # the same row whatever the order of reading: columns that can't be sorted are compared as JSON
        others = [F.to_json(F.struct(*[c for c in docs.columns if c != text]))] if len(docs.columns) > 1 else [F.lit(0)]
        first = Window.partitionBy("doc_id", "__n_own").orderBy(*others)
        out = out.withColumn("__n_first", F.row_number().over(first)).where("__n_first = 1").drop("__n_first")
    return out.drop("__n_own")
