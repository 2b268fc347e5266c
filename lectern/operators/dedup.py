"""Duplicate papers: by DOI, by title and year, and by nearness of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import vector

THRESHOLD, SIGNATURE_CHARS, BODY_NEEDED = 0.92, 3000, 40


def _with_first(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """left, right: each later row of a key beside its first; the first is found by a combined minimum, not a sort."""
    first = rows.groupBy(key).agg(F.min("seq").alias("left"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(first, key).where("seq > left").select("left", F.col("seq").alias("right"), F.lit(1.0).alias("similarity"), F.lit(reason).alias("reason"))


def by_doi(papers: DataFrame) -> DataFrame:
    return _with_first(papers.select("seq", T.plain_key(F.col("doi")).alias("k")).where("k <> ''"), "k", "doi")


def by_title_year(papers: DataFrame) -> DataFrame:
    """Papers without a DOI that share title and year (a missing year is a year of its own)."""
    plain = papers.where(T.plain_key(F.col("doi")) == "").select("seq", T.plain_key(F.col("title")).alias("t"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("y"))
    return _with_first(plain.where("t <> ''").select("seq", F.struct("t", "y").alias("k")), "k", "title_year")


def semantic(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return vector.first_near(vectors, threshold).withColumn("reason", F.lit("semantic"))


def unique_pairs(*found: DataFrame) -> DataFrame:
    """Each (left, right) once; of several reasons the one that comes first in the list."""
    rows = None
    for k, df in enumerate(found):
        df = df.withColumn("o", F.lit(k))
        rows = df if rows is None else rows.unionByName(df)
    best = rows.groupBy("left", "right").agg(F.min(F.struct("o", "similarity", "reason")).alias("b"))
    return best.select("left", "right", "b.similarity", "b.reason")


def signature(doi: Column, title: Column, abstract: Column, body: Column, chars: int = SIGNATURE_CHARS) -> Column:
    """The text whose embedding stands for a paper; the body joins in if nothing else says much."""
    parts = F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in (doi, title, abstract)]), lambda x: x != "")
    rich = F.exists(parts, lambda x: F.length(x) > BODY_NEEDED)
    alone = F.concat_ws("\n", parts)
    more = F.concat_ws("\n", F.concat(parts, F.array(F.substring(F.coalesce(body, F.lit("")), 1, chars))))
    return F.substring(F.when(rich, alone).otherwise(more), 1, chars)


def without_duplicates(papers: DataFrame, pairs: DataFrame) -> DataFrame:
    return papers.join(pairs.select(F.col("right").alias("seq")), "seq", "left_anti")
