"""Filters, summaries, details, deletion, refresh and export over the table of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import titles

SEPARATOR = "\n\n---\n\n"
LATE = 1_000_000_000


def pushed(year: int | None = None, file_name: str | None = None) -> Column | None:
    """The part of a filter that may hold before a top-k; 0 and '' are no filter."""
    found = [F.col(c) == v for c, v in (("year", year), ("file_name", file_name)) if v]
    return found[0] & found[1] if len(found) == 2 else found[0] if found else None


def matches(author: str | None = None, year: int | None = None, tag: str | None = None, file_name: str | None = None) -> Column:
    """The whole filter: equality on year and file name, containment in the joined authors and tags."""
    out = F.lit(True)
    if year is not None:
        out = out & F.coalesce(F.col("year") == year, F.lit(False))
    if file_name:
        out = out & F.coalesce(F.col("file_name") == file_name, F.lit(False))
    if author:
        out = out & T.contains_ci(T.join_list(F.col("authors")), author)
    if tag:
        out = out & T.contains_ci(T.join_list(F.col("tags")), tag)
    return out


def selected(selector: str) -> Column:
    """Containment in path, file name, title or DOI; a blank selector matches nothing."""
    needle = selector.strip()
    if not needle:
        return F.lit(False)
    out = F.lit(False)
    for c in ("source_path", "file_name", "title", "doi"):
        out = out | T.contains_ci(F.col(c), needle)
    return out


def paper_key() -> Column:
    return F.coalesce(T.blank(F.col("source_path")), T.blank(F.col("file_name")), F.col("chunk_id"))


def first_filled(c: str, seq: str = "seq") -> Column:
    """The first value, by seq, that is neither null, '' nor an empty list."""
    kind = F.typeof(F.col(c))
    value = F.when(kind.startswith("array") & (F.col(c).cast("string") == "[]"), F.lit(None)).when(F.col(c).cast("string") == "", F.lit(None)).otherwise(F.col(c))
    return F.min_by(value, F.when(value.isNotNull(), F.col(seq)))


META = ("source_path", "file_name", "title", "authors", "year", "doi")


def papers(chunks: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per paper: merged metadata, the best title, the number of chunks, its first seq."""
    merged = chunks.withColumn("paper", paper_key()).groupBy("paper").agg(F.count(F.lit(1)).alias("chunk_count"), F.min("seq").alias("first_seq"), *[first_filled(c).alias(c) for c in dict.fromkeys((*META, *extra))])
    return merged.withColumn("title", titles.best([F.col("title")], F.col("file_name")))


def newest_first() -> list[Column]:
    """Year as text, then title, both descending; papers without a year come last."""
    return [F.desc(F.coalesce(F.col("year").cast("string"), F.lit(""))), F.desc(F.coalesce(T.blank(F.col("title")), F.col("file_name"))), F.col("first_seq")]


def summary(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """The papers, newest first, with the library's totals beside each shown row."""
    rows = papers(chunks)
    totals = rows.agg(F.count(F.lit(1)).alias("paper_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("library_chunks"))
    shown = rows.orderBy(*newest_first())
    return (shown if limit is None else shown.limit(limit)).crossJoin(F.broadcast(totals))  # one row


def details(chunks: DataFrame, selector: str, limit: int | None = 10) -> DataFrame:
    """Selected papers with their chunk ids in order."""
    rows = papers(chunks).where(selected(selector)).orderBy(*newest_first())
    rows = rows if limit is None else rows.limit(limit)
    ids = chunks.withColumn("paper", paper_key()).join(rows.select("paper"), "paper").groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))).alias("l"))
    return rows.join(ids.select("paper", F.col("l.chunk_id").alias("chunk_ids")), "paper")


def metadata_search(chunks: DataFrame, limit: int = 20, group: bool = False, **filters) -> DataFrame:
    """Rows that match, with score 1, in order; grouped: the papers of the least chunk_index first."""
    rows = chunks.where(matches(**filters)).withColumn("score", F.lit(1.0))
    if not group:
        return rows.orderBy("seq").limit(limit)
    order = F.struct(F.coalesce(F.col("chunk_index"), F.lit(LATE)).alias("i"), F.col("seq").alias("s"))
    keyed = rows.withColumn("paper", F.coalesce("source_path", "chunk_id")).withColumn("o", order)
    grouped = keyed.groupBy("paper").agg(F.min("o").alias("best"), F.count(F.lit(1)).cast("int").alias("pool_chunk_count"), F.array_sort(F.collect_list(F.struct("o", "chunk_id"))).alias("l"))
    firsts = grouped.orderBy("best").limit(limit)
    others = F.slice(F.col("l.chunk_id"), F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))
    head = firsts.select("paper", "best", "pool_chunk_count", others.alias("other_chunk_ids"))
    return keyed.join(head, (keyed["paper"] == head["paper"]) & (keyed["o"] == head["best"])).drop(head["paper"]).orderBy("best").drop("o", "best", "paper")


def export_sections(chunks: DataFrame, ids: list[str]) -> DataFrame:
    """pos, section of the listed chunks in the list's order; unknown ids are left out, repeated ones repeat."""
    spark = chunks.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, chunk_id string")
    doi = F.when(T.blank(F.col("doi")).isNotNull(), F.concat(F.lit("- doi: "), F.col("doi")))
    title = F.coalesce(T.blank(F.col("title")), T.blank(F.col("file_name")), F.col("chunk_id"))
    head = F.concat_ws("\n", F.concat(F.lit("## "), title), F.concat(F.lit("- chunk_id: "), F.col("chunk_id")), doi)
    return chunks.join(F.broadcast(wanted), "chunk_id").select("pos", F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("section"))  # the caller's list


def export_context(chunks: DataFrame, ids: list[str]) -> str:
    return SEPARATOR.join(r.section for r in export_sections(chunks, ids).orderBy("pos").collect())


def deleted(chunks: DataFrame, selector: str, limit: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """What stays of the chunks, and the papers that go."""
    gone = details(chunks, selector, limit)
    return chunks.withColumn("__p", paper_key()).join(gone.select(F.col("paper").alias("__p")), "__p", "left_anti").drop("__p"), gone


def refreshed(chunks: DataFrame, metadata: DataFrame, columns: tuple[str, ...], prune: bool = False) -> DataFrame:
    """Filled values of metadata (by source_path) overwrite those of the chunks; prune also clears what it has empty."""
    new = metadata.select("source_path", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__known"))
    joined = chunks.join(new, "source_path", "left")
    out = {}
    for c in columns:
        filled = F.when(F.col(f"__{c}").cast("string").isin("", "[]"), None).otherwise(F.col(f"__{c}"))
        out[c] = F.when(F.col("__known"), filled).otherwise(F.col(c)) if prune else F.coalesce(filled, F.col(c))
    return joined.withColumns(out).select(*chunks.columns)
