"""Exact cosine search, and pairs of near vectors in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Documents that are embedded together.
EMBED_ROWS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    bad = x.isNull() | y.isNull() | (F.size(x) != F.size(y)) | (norm == 0)
    return F.when(bad, F.lit(0.0)).otherwise(dot(x, y) / norm)


def top(vectors: DataFrame, query: list[float], k: int, fetch: int | None = None, key: str = "seq", vector: str = "embedding", where: Column | None = None, residual: Column | None = None) -> DataFrame:
    """id, rank, vector_score: ``where`` holds before the fetch, ``residual`` after it, then k rows are kept."""
    rows = vectors if where is None else vectors.where(where)
    score = F.greatest(F.lit(0.0), cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    best = rows.withColumn("vector_score", score).orderBy(F.desc("vector_score"), key).limit(fetch or k)
    if residual is not None:
        best = best.where(residual)
    rank = F.row_number().over(Window.orderBy(F.desc("vector_score"), key))
    return best.orderBy(F.desc("vector_score"), key).limit(k).select(F.col(key).alias("id"), rank.alias("rank"), "vector_score")


#: Bounds of near pairs: blocks while each holds at most so many bytes of vectors, bytes of a strip of products.
BLOCKS, BLOCK_BYTES, STRIP_BYTES = 16, 16 << 20, 32 << 20


def blocks_for(n: int, d: int, width: int) -> int:
    """Blocks of n vectors of d components of so many bytes: a number that doesn't grow with n while a block fits."""
    return max(1, min(BLOCKS, -(-n // 256)), -(-n * d * width // BLOCK_BYTES))


def first_near(vectors: DataFrame, threshold: float, key: str = "seq", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """left, right, similarity: of each row the first earlier one whose cosine reaches the threshold.

    Vectors that are null, empty, zero or hold nulls are near nothing; vectors of different lengths aren't near one another.
    Every vector is compared with every other, as the definition asks; blocks of vectors meet in pairs, so a task holds two
    blocks, and only each block pair's first partner of a row leaves it. A vector is sent once for each block, as it is stored;
    their number is BLOCKS until a block would hold more than BLOCK_BYTES, so what is sent grows with the rows, not their square.
    """
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    stored = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{stored}>").alias("v"))
    rows = rows.where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).withColumn("d", F.size("v"))
    sizes = {r.d: -(-r.n // block) if block else blocks_for(r.n, r.d, 4 if stored == "float" else 8) for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    if not sizes:
        return rows.select(F.col("id").alias("left"), F.col("id").alias("right"), F.lit(0.0).alias("similarity"))
    blocks = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("d"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    others = F.sequence(F.lit(0), blocks - 1)
    meeting = rows.select("id", "v", "d", "b", F.explode(others).alias("o")).select("id", "v", "d", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def compare(key_: tuple, table: pa.Table) -> pa.Table:
        width, p, q = (x.as_py() for x in key_)
        ids, own = table.column("id").to_numpy(), table.column("b").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        by = np.argsort(ids, kind="stable")
        ids, own, x = ids[by], own[by], x[by]
        step, out = max(1, STRIP_BYTES // (8 * max(1, len(ids)))), []
        for at in range(0, len(ids), step):
            earlier = np.searchsorted(ids, ids[min(at + step, len(ids)) - 1])  # later ones are nobody's first partner
            sims = x[at : at + step] @ x[:earlier].T
            hit = (sims >= threshold) & (ids[None, :earlier] < ids[at : at + step, None])
            if p != q:
                hit &= own[None, :earlier] != own[at : at + step, None]
            some = np.flatnonzero(hit.any(1))
            first = hit[some].argmax(1) if earlier else some
            out += [(ids[first], ids[at + some], sims[some, first])] if len(some) else []
        left, right, near = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.zeros(0))
        return pa.table({"left": left, "right": right, "similarity": near})

    found = meeting.groupBy("d", "p", "q").applyInArrow(compare, "left long, right long, similarity double")
    first = found.groupBy("right").agg(F.min(F.struct("left", "similarity")).alias("f"))
    return first.select(F.col("f.left").alias("left"), "right", F.col("f.similarity").alias("similarity"))


def hashed_embeddings(docs: DataFrame, dimension: int = 256, text: str = "text") -> DataFrame:
    """docs with ``embedding``: a deterministic, offline embedding (signed hashing of words, unit length).

    A task's Python holds one document's words beside an Arrow batch of all documents' words as plain texts.
    """
    from ..functions.text import tokenize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            for at in range(0, b.num_rows, EMBED_ROWS):
                part = b.slice(at, EMBED_ROWS)
                out = np.zeros((part.num_rows, dimension), np.float32)
                for v, words in zip(out, part.column(part.num_columns - 1), strict=True):
                    for w in words.as_py().split(" ") if len(words.as_py()) else ():
                        h = zlib.crc32(w.encode())
                        v[h % dimension] += 1 if h >> 31 else -1
                    n = np.linalg.norm(v)
                    v /= n if n else 1
                offsets = pa.array(np.arange(0, out.size + 1, dimension, dtype=np.int32))
                made = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], schema=pa.schema([*[f for f in b.schema][:-1], pa.field("embedding", pa.list_(pa.float32()))]))

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return docs.withColumn("__tokens", F.array_join(tokenize(F.col(text)), " ")).mapInArrow(run, schema)
