"""Chunks with overlap, as array expressions: a document is one row's arrays, so no window needs a shuffle.

A sentence ends at . ! ? or a line end before white space. Units are stated: ``by_tokens`` fills chunks with whole sentences
up to a number of tokens, ``by_sentences`` and ``by_words`` are windows of a fixed number of sentences or words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SENTENCES, SENTENCE_OVERLAP, TOKENS, TOKEN_OVERLAP = 8, 2, 1200, 180


def sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def _windows(units: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    if step < 1:
        raise ValueError("the overlap must be smaller than the size")
    n = F.size(units)
    last = F.greatest(F.ceil((n - overlap) / F.lit(step)).cast("int"), F.lit(1)) - 1
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(units, i * step + 1, F.lit(size)), " ")))


def _filled(units: Column, size: int, overlap: int) -> Column:
    """Chunks of whole units, each as full as it goes; units longer than a chunk are cut before.

    A fold over the units holds the open chunk's units with their tokens. Where the next one doesn't fit, the chunk is closed
    and goes on with as many of its last units as the overlap holds and the next one leaves room for.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    none = F.array().cast("array<struct<t:string,n:int>>")

    def tail(held: Column, more: Column) -> Column:
        room = F.least(F.lit(overlap), F.lit(size) - more)
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("go"))

        def take(a: Column, u: Column) -> Column:
            fits = a["go"] & (a["n"] + u["n"] <= room)
            return F.struct((a["n"] + F.when(fits, u["n"]).otherwise(0)).alias("n"), (a["k"] + F.when(fits, 1).otherwise(0)).alias("k"), fits.alias("go"))

        return F.aggregate(F.reverse(held), start, take)

    def text(held: Column) -> Column:
        return F.array_join(F.transform(held, lambda u: u["t"]), " ")

    def step(acc: Column, u: Column) -> Column:
        def closed(back: Column) -> Column:
            kept = F.slice(acc["held"], F.size(acc["held"]) - back["k"] + 1, back["k"])
            return F.struct(F.array_append(acc["done"], text(acc["held"])).alias("done"), F.array_append(kept, u).alias("held"), (back["n"] + u["n"]).alias("n"))

        longer = F.struct(acc["done"].alias("done"), F.array_append(acc["held"], u).alias("held"), (acc["n"] + u["n"]).alias("n"))
        return F.when(acc["n"] + u["n"] <= size, longer).otherwise(T.let(tail(acc["held"], u["n"]), closed))

    sized = F.flatten(F.transform(units, lambda s: T.let(words(s), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size)), lambda i: T.let(F.slice(w, i + 1, F.lit(size)), lambda p: F.struct(F.array_join(p, " ").alias("t"), F.size(p).alias("n")))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("held"), F.lit(0).alias("n"))
    return F.aggregate(sized, start, step, lambda a: F.when(F.size(a["held"]) > 0, F.array_append(a["done"], text(a["held"]))).otherwise(a["done"]))


def _exploded(docs: DataFrame, windows: Column, text: str) -> DataFrame:
    cut = docs.withColumn("__w", windows)
    others = [c for c in docs.columns if c != text]  # a whole text beside each of its chunks would be square in its length
    out = cut.select(*others, F.size("__w").alias("chunk_count"), F.posexplode("__w").alias("chunk_index", "chunk_text"))
    return out.withColumn("chunk_id", T.chunk_id(F.col("source_path"), F.col("chunk_index"), F.col("chunk_text")))


def by_sentences(docs: DataFrame, size: int = SENTENCES, overlap: int = SENTENCE_OVERLAP, text: str = "text") -> DataFrame:
    """docs (with source_path, without the text) and their chunks: chunk_id, chunk_index, chunk_count, chunk_text."""
    return _exploded(docs, T.let(sentences(F.col(text)), lambda u: _windows(u, size, overlap)), text)


def by_words(docs: DataFrame, size: int = TOKENS, overlap: int = TOKEN_OVERLAP, text: str = "text") -> DataFrame:
    return _exploded(docs, T.let(words(F.col(text)), lambda u: _windows(u, size, overlap)), text)


def by_tokens(docs: DataFrame, size: int = TOKENS, overlap: int = TOKEN_OVERLAP, text: str = "text") -> DataFrame:
    """Whole sentences up to ``size`` tokens a chunk, the last ones repeated up to ``overlap``. A token is a run of visible characters."""
    return _exploded(docs, T.let(sentences(F.col(text)), lambda u: _filled(u, size, overlap)), text)
