"""Which files an index run works on: discovery, markers, change detection, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_roots(*listings: DataFrame) -> DataFrame:
    """path, root_path, tags, root_ord of all roots; a path that several have belongs to the first."""
    rows = None
    for k, df in enumerate(listings):
        df = df.withColumn("root_ord", F.lit(k))
        rows = df if rows is None else rows.unionByName(df)
    first = Window.partitionBy("path").orderBy("root_ord")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def ancestors(path: str = "path"):
    """All directories above a path, nearest last."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def without_marked(files: DataFrame, markers: DataFrame) -> DataFrame:
    """files (path) that lie under no directory (dir) of markers: an equi-join on each ancestor instead of prefixes."""
    hit = files.select("path", F.explode(ancestors()).alias("dir")).join(markers.select("dir").distinct(), "dir", "left_semi")
    return files.join(hit.select("path").distinct(), "path", "left_anti")


def marker_hits(files: DataFrame, markers: DataFrame) -> DataFrame:
    """dir of each marker above any file, once."""
    return files.select(F.explode(ancestors()).alias("dir")).distinct().join(markers.select("dir").distinct(), "dir")


def targets(files: DataFrame, manifest: DataFrame, force: bool = False, only_new: bool = False, max_files: int | None = None) -> DataFrame:
    """files with reason: new, changed, forced, known, same_stat, same_content or over_limit.

    files: path, seq, size, mtime, digest (null where the file isn't read yet). Known files are settled by size and time; the
    digest is compared only where these differ.
    """
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("mtime").alias("m_mtime"), F.col("digest").alias("m_digest"), F.lit(True).alias("known"))
    j = files.join(m, "path", "left")
    known = F.coalesce("known", F.lit(False))
    reason = F.when(F.lit(only_new) & known, "known").when(~known, "new").when(F.lit(force), "forced").when((F.col("size") == F.col("m_size")) & (F.col("mtime") == F.col("m_mtime")), "same_stat").when(F.col("digest") == F.col("m_digest"), "same_content").otherwise("changed")
    out = j.withColumn("reason", reason).select(*files.columns, "reason")
    if max_files is None:
        return out
    work = F.col("reason").isin("new", "changed", "forced")
    first = out.where(work).orderBy("seq").limit(max_files).select("path", F.lit(True).alias("in"))
    return out.join(first, "path", "left").withColumn("reason", F.when(work & F.col("in").isNull(), "over_limit").otherwise(F.col("reason"))).drop("in")


def plan(rows: DataFrame) -> DataFrame:
    """root_path, files: work by root, in order of first file."""
    work = rows.where(F.col("reason").isin("new", "changed", "forced"))
    return work.groupBy("root_path").agg(F.count(F.lit(1)).alias("files"), F.min("seq").alias("first_seq"))


def counters(rows: DataFrame) -> DataFrame:
    work = F.col("reason").isin("new", "changed", "forced")
    return rows.agg(F.count_if(work).alias("indexed"), F.count_if(~work).alias("skipped"))


def manifest_after(manifest: DataFrame, indexed: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """The manifest with indexed files' entries replaced; files skipped for equal content get their new size and time."""
    columns = ["path", "digest", "size", "mtime", "chunk_count"]
    stat = skipped.where(F.col("reason") == "same_content").select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime")) if skipped is not None else None
    old = manifest.join(indexed.select("path"), "path", "left_anti")
    if stat is not None:
        old = old.join(stat, "path", "left").withColumns({"size": F.coalesce("n_size", "size"), "mtime": F.coalesce("n_mtime", "mtime")})
    return old.select(*columns).unionByName(indexed.select(*columns))
