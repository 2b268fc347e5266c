"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is cut by medians along two-means directions into lists of equal size; their means are the centroids, and
a graph of near centroids is searched in memory. Every vector is posted to its nearest list and, if it lies near a border,
to further lists whose centroids are about as near. A query first reads the lists whose centroids are within a ratio of the
nearest one's distance. Its k-th distance then tells how far its neighbours may lie: it also reads every list whose region
begins within a share of that distance (the region of a list is cut off by the plane midway between its centroid and the
query's nearest one). So an easy query reads few lists and a hard one many; no number of lists is a limit. Ratio and share are
calibrated on the sample. Lists of any length are worked on in blocks of vectors against blocks of queries.

Distances are Euclidean, computed from differences in double precision on the original vectors. Queries that find fewer
than k others are searched again over all lists.

The number of lists follows the vectors up to MAX_LISTS, which is what centroids in memory allow; beyond, lists grow.

Defined results: a vector that is null, zero, of another length than most, or holding null or non-finite components takes
no part, nor does a row without vec_id; rows with the query's vec_id aren't candidates; a repeated vec_id counts once, by
its nearest vector, and as a query by its least; ties go to the smaller vec_id; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

#: The sample that lists are fitted on, vectors a list should have, and lists at most (beyond, lists grow).
SAMPLE, LIST_SIZE, MAX_LISTS = 32_768, 200, 8192
#: Border vectors: lists at most, and how much further than the nearest their centroids may be.
REPLICAS, NEAR = 4, 1.03
#: The ratio is the least with which CALIBRATE queries of the sample find this share of their neighbours in the sample.
RECALL, CALIBRATE = 0.97, 512
#: The share of the k-th distance is the least with which they find this share of their neighbours.
WIDE_RECALL = 0.995
NEIGHBOURS, VECTOR_BLOCK, QUERY_BLOCK = 24, 4096, 1024


@dataclass
class Lists:
    """Centroids, a graph over them, and the nodes at which a search begins."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def search(self, x: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances to centroids, infinite where the search found no reason to look.

        Beginning at the entries, every node within ratio of the nearest so far, or among the ``least`` nearest so far, is
        opened, until none is closed.
        """
        n, k = len(x), len(self.centroids)
        dist = np.full((n, k), np.inf)
        opened = np.zeros((n, k), bool)
        norms, own = np.square(self.centroids).sum(1), np.square(x).sum(1)

        def look(rows: np.ndarray, nodes: np.ndarray) -> None:
            for at in range(0, len(rows), 1 << 15):
                r, c = rows[at : at + (1 << 15)], nodes[at : at + (1 << 15)]
                d = own[r] + norms[c] - 2 * np.einsum("ij,ij->i", x[r], self.centroids[c])
                dist[r, c] = np.sqrt(np.maximum(d, 0))

        look(np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n))
        while True:
            near = dist.min(1) * ratio
            if least > 1:
                near = np.maximum(near, np.partition(dist, min(least, k) - 1, axis=1)[:, min(least, k) - 1])
            rows, nodes = np.nonzero((dist <= near[:, None]) & ~opened & np.isfinite(dist))
            if not len(rows):
                return dist
            opened[rows, nodes] = True
            seen = np.zeros((n, k), bool)
            seen[np.repeat(rows, self.graph.shape[1]), self.graph[nodes].ravel()] = True
            look(*np.nonzero(seen & np.isinf(dist)))

    def post(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, list): the nearest list and those of border vectors."""
        dist = self.search(x, 1.0, 2 * REPLICAS)
        near = np.argsort(dist, 1, kind="stable")[:, :REPLICAS]
        d = np.take_along_axis(dist, near, 1)
        taken = np.zeros(near.shape, bool)
        taken[:, 0] = True
        for j in range(1, near.shape[1]):
            ok = (d[:, j] <= NEAR * d[:, 0]) & np.isfinite(d[:, j])
            taken[:, j] = ok
        rows, cols = np.nonzero(taken)
        return rows, near[rows, cols]

    def probe(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, list): the lists that queries read."""
        if np.isinf(ratio):
            return np.repeat(np.arange(len(x)), len(self.centroids)), np.tile(np.arange(len(self.centroids)), len(x))
        dist = self.search(x, ratio, 2)
        return np.nonzero(np.isfinite(dist) & (dist <= ratio * dist.min(1)[:, None]))


    def begins(self, x: np.ndarray) -> np.ndarray:
        """Of each query and list, how far the list's region lies: nothing that is nearest to its centroid is nearer than that."""
        norms = np.square(self.centroids).sum(1)
        square = np.square(x).sum(1)[:, None] + norms[None, :] - 2 * x @ self.centroids.T
        own = square.argmin(1)
        apart = np.sqrt(np.maximum(norms[own][:, None] + norms[None, :] - 2 * self.centroids[own] @ self.centroids.T, 1e-24))
        return np.maximum(0, square - square[np.arange(len(x)), own][:, None]) / (2 * apart)

    def widen(self, x: np.ndarray, far: np.ndarray, ratio: float, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, list): lists that queries with k-th distances ``far`` read beside those of ``probe``."""
        more = self.begins(x) <= share * far[:, None]
        more[self.probe(x, ratio)] = False
        return np.nonzero(more)


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of each row whether it lies on the upper side of the median along the line between two means."""
    a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
    for _ in range(6):
        side = np.square(x - a).sum(1) > np.square(x - b).sum(1)
        if side.all() or not side.any():
            break
        a, b = x[~side].mean(0), x[side].mean(0)
    by = np.argsort((x - x.mean(0)) @ (b - a), kind="stable")
    out = np.zeros(len(x), bool)
    out[by[len(x) // 2 :]] = True
    return out


def train(sample: np.ndarray, lists: int, seed: int = 11) -> Lists:
    """Balanced lists of a sample: it is halved, the largest part first, until there are enough parts."""
    rng = np.random.default_rng(seed)
    parts = [sample]
    while len(parts) < min(lists, len(sample)):
        k = max(range(len(parts)), key=lambda i: len(parts[i]))
        x = parts.pop(k)
        up = _halves(x, rng)
        parts += [x[~up], x[up]]
    centroids = np.array([p.mean(0) for p in parts])
    k = len(centroids)
    near = np.empty((k, min(NEIGHBOURS, k)), np.int64)
    norms = np.square(centroids).sum(1)
    for at in range(0, k, 512):
        d = norms[None, :] - 2 * centroids[at : at + 512] @ centroids.T
        near[at : at + 512] = np.argsort(d, 1, kind="stable")[:, : near.shape[1]]
    # links go both ways along a ring through all nodes, so that every node is reached
    ring = np.stack([np.roll(np.arange(k), 1), np.roll(np.arange(k), -1)], 1)
    return Lists(centroids, np.concatenate([near, ring], 1), np.unique(rng.integers(0, k, min(k, 32))))


def calibrate(lists: Lists, sample: np.ndarray, k: int) -> tuple[float, float]:
    """The ratio of distances within which queries of the sample find RECALL of their k nearest in the sample, and the share
    of their k-th distance within which they find WIDE_RECALL.

    Neighbours in the sample lie further apart than in all rows, so it errs on the side of more lists.
    """
    if len(sample) < 2:
        return 1.0, 1.0
    queries = sample[:: max(1, len(sample) // CALIBRATE)]
    norms, k = np.square(sample).sum(1), min(k + 1, len(sample))
    near = np.empty((len(queries), k), np.int64)
    for at in range(0, len(queries), 64):
        near[at : at + 64] = np.argpartition(norms[None, :] - 2 * queries[at : at + 64] @ sample.T, k - 1, axis=1)[:, :k]
    flat = near.ravel()
    who, where = (np.concatenate(x) for x in zip(*((p[0] + at, p[1]) for at in range(0, len(flat), 256) for p in [lists.post(sample[flat[at : at + 256]])]), strict=True))
    d = np.sqrt(np.maximum(0, np.square(queries).sum(1)[:, None] + np.square(lists.centroids).sum(1)[None, :] - 2 * queries @ lists.centroids.T))
    need = np.full(len(flat), np.inf)
    np.minimum.at(need, who, d[who // k, where] / np.maximum(d.min(1), 1e-12)[who // k])
    far = np.sqrt(np.square(sample[near] - queries[:, None, :]).sum(2)).max(1)
    reach = np.full(len(flat), np.inf)
    np.minimum.at(reach, who, lists.begins(queries)[who // k, where] / np.maximum(far, 1e-12)[who // k])
    return tuple(float(q * (1 + 1e-9)) for q in (max(1.0, np.quantile(need, RECALL, method="higher")), np.quantile(reach, WIDE_RECALL, method="higher")))


# -- tables ------------------------------------------------------------------------------------------------------------


def _taking_part(rows: DataFrame, key: str, vector: str) -> DataFrame:
    picked = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    return picked.where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _spread(where: Column, counts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.greatest(F.element_at(counts, where + 1), F.lit(1)) - 1))


def _counts(df: DataFrame, k: int, block: int) -> list[int]:
    """Blocks of each list: k numbers, whatever the data."""
    out = [1] * k
    for r in df.groupBy("list").count().collect():
        out[r[0]] = -(-r[1] // block)
    return out


def nearest(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", ratio: float | None = None, share: float | None = None, list_size: int = LIST_SIZE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (is_query: a condition on vec_id).

    ratio, share: in place of the calibrated ones; an infinite ratio reads all lists, a negative share adds none.
    """
    spark = rows.sparkSession
    small_batches(spark)
    fine = _taking_part(rows, key, vector)
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    none = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], none)
    dim, n = sizes[0]
    fine = fine.where(F.size("v") == dim)
    picked = fine.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow()
    sample = picked.column(1).combine_chunks()
    x = _matrix(sample, dim)
    lists = train(x, max(1, min(MAX_LISTS, round(n / list_size), -(-len(sample) // 4))))
    if ratio is None or share is None:
        own_ratio, own_share = calibrate(lists, x[np.sort(np.unique(picked.column(0).to_numpy(), return_index=True)[1])], k)
        ratio, share = own_ratio if ratio is None else ratio, own_share if share is None else share
    sent, kk = spark.sparkContext.broadcast(lists), len(lists.centroids)

    def place(how: str, ratio: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    x = _matrix(part.column(1), dim)
                    who, where = index.post(x) if how == "post" else index.probe(x, ratio) if how == "probe" else index.widen(x, part.column(2).to_numpy(), ratio, share)
                    for s in range(0, len(who), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(where[s : s + 4096], pa.int32()), part.column(0).take(pa.array(who[s : s + 4096])), part.column(1).take(pa.array(who[s : s + 4096]))], names=["list", "vec_id", "v"])

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted, queries first. The best of each query are kept over the groups of a task."""
        best: dict[int, list[tuple[float, int]]] = {}
        key, queries, vectors = None, [], []

        def flush() -> pa.RecordBatch:
            flat = [(q, v, s) for q, found in best.items() for s, v in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        def close() -> None:
            if queries and vectors:
                _scan_block(np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries]), np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors]), k, best)

        for b in batches:
            group = [b.column(i).to_numpy() for i in range(3)]
            kind, ids, x = b.column(3).to_numpy(), b.column(4).to_numpy(), _matrix(b.column(5), dim)
            cuts = [0, *(np.flatnonzero(np.any([np.diff(g) != 0 for g in group], axis=0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(int(g[lo]) for g in group)
                if now != key:
                    close()
                    key, queries, vectors = now, [], []
                    if len(best) > 20_000:
                        yield flush()
                q = kind[lo:hi] == 0
                if q.any():
                    queries.append((ids[lo:hi][q], x[lo:hi][q]))
                if not q.all() and queries:
                    vectors.append((ids[lo:hi][~q], x[lo:hi][~q]))
        close()
        yield flush()

    posted = materialise(fine.mapInArrow(place("post", 1.0), "list int, vec_id long, v array<double>"), "postings")
    v_blocks = _counts(posted, kk, VECTOR_BLOCK)
    asked = materialise(fine.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")

    def run(queries: DataFrame, ratio: float, how: str = "probe", before: DataFrame | None = None) -> DataFrame:
        """The k best of each query in the lists it reads, and of those found before."""
        probes = materialise(queries.mapInArrow(place(how, ratio), "list int, vec_id long, v array<double>"), "probes")
        q_blocks = _counts(probes, kk, QUERY_BLOCK)
        vb, qb = (F.lit(np.array(x, np.int32)) for x in (v_blocks, q_blocks))
        own = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("list") + 1)).cast("int")
        left = probes.select("list", _spread(F.col("list"), vb).alias("vb"), own(qb).alias("qb"), F.lit(0).alias("kind"), "vec_id", "v")
        right = posted.select("list", own(vb).alias("vb"), _spread(F.col("list"), qb).alias("qb"), F.lit(1).alias("kind"), "vec_id", "v")
        dealt = left.unionByName(right).repartition("list", "vb", "qb").sortWithinPartitions("list", "vb", "qb", "kind")
        found = dealt.mapInArrow(scan, "query_id long, vec_id long, score double")
        if before is not None:
            found = found.unionByName(before.select("query_id", "vec_id", "score"))
        first = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return materialise(first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")

    found = run(asked, ratio)
    if share >= 0 and not np.isinf(ratio):
        far = found.groupBy("query_id").agg(F.max("score").alias("far"))
        reach = asked.join(far, asked.vec_id == far.query_id).select("vec_id", "v", "far")
        found = run(reach, ratio, "widen", found)
    enough = min(k, n - 1)
    got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= enough)
    short = asked.join(got, asked.vec_id == got.query_id, "left_anti")
    if enough and not short.isEmpty():
        short = materialise(short, "short")
        found = found.join(short, found.query_id == short.vec_id, "left_anti").unionByName(run(short, float("inf")))
    return found


def _scan_block(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, best: dict[int, list[tuple[float, int]]]) -> None:
    """Take the block's nearest into best: products pick candidates, differences in double precision decide."""
    v_norm = np.square(v).sum(1)
    by_id = np.argsort(v_ids, kind="stable")
    first = np.unique(v_ids[by_id], return_index=True)[1]
    for at in range(0, len(q), 128):
        ids, x = q_ids[at : at + 128], q[at : at + 128]
        norm = np.square(x).sum(1)
        rough = norm[:, None] + v_norm[None, :] - 2 * (x @ v.T)
        rough[v_ids[None, :] == ids[:, None]] = np.inf
        slack = 1e-9 * (norm[:, None] + v_norm.max())
        # a vec_id counts once, by its nearest row
        once = rough if len(first) == len(v_ids) else np.minimum.reduceat(rough[:, by_id], first, axis=1)
        limit = np.partition(once, k - 1, axis=1)[:, k - 1] if once.shape[1] > k else np.full(len(x), np.inf)
        held = np.array([best[i][k - 1][0] ** 2 if len(best.get(i, ())) >= k else np.inf for i in ids.tolist()])
        rows, cols = np.nonzero((rough <= np.minimum(limit, held)[:, None] + slack) & np.isfinite(rough))
        for a in range(0, len(rows), 1 << 14):
            r, c = rows[a : a + (1 << 14)], cols[a : a + (1 << 14)]
            score = np.sqrt(np.square(x[r] - v[c]).sum(1))
            for i in np.unique(r).tolist():
                own = r == i
                merged: dict[int, float] = {}
                for s, w in [*best.get(int(ids[i]), ()), *zip(score[own].tolist(), v_ids[c[own]].tolist(), strict=True)]:
                    if s < merged.get(w, np.inf):
                        merged[w] = s
                best[int(ids[i])] = sorted((s, w) for w, s in merged.items())[:k]


def op9_balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose vec_id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
