"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host if more than ``max_ratio`` of the host's pages hold it, and at least ``min_pages`` of them
(two: a line of one page is no repetition, and without this a host of one page would lose all). Boilerplate lines go. With
``spare_whole`` (off unless asked for) a page that consists of nothing else keeps its text: it is a copy, which near-dedup
deals with, and not content with boilerplate around it. Hosts are a column, or ``host_of`` a column of URLs.

Defined results: a null text stays null and counts as a page; a null host is a host of its own; blank lines (white space
only) are never boilerplate; a line that a page repeats counts once for that page; a page of boilerplate only becomes an empty
text; repeated rows are pages of their own; an empty table gives an empty result; extra columns pass through, and columns
named like the helper columns don't clash, since all helpers are prefixed with ``__ld_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

MAX_RATIO, MIN_PAGES = 0.1, 2
SPACE = " \t\n\u000b\f\r"
#: The boilerplate table is broadcast only if it holds at most so many hashes (8 bytes each).
BROADCAST_HASHES = 100_000
#: Else each host's list goes to so many tasks, so that a host with a third of all pages isn't one task's work.
SALTS = 64


def _key(line):
    return F.xxhash64(line)


def _blank(line):
    return F.btrim(line, F.lit(SPACE)) == ""


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port and a leading "www."; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def boilerplate(docs: DataFrame, host: str | Column = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line hash, pages with the line, pages of the host: the lines over the ratio.

    Each page emits each distinct line's hash once; both sums are combined on the map side, so a line or host that a
    third of all rows share reaches a reducer as one row per task.
    """
    lines = docs.select(
        _column(host).alias("__ld_host"),
        F.explode(
            F.array_union(
                F.array(F.lit(None).cast("long")),  # the page itself
                F.transform(F.filter(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), "\n")), lambda x: ~_blank(x)), _key),
            )
        ).alias("__ld_line"),
    )
    counts = lines.groupBy("__ld_host", "__ld_line").agg(F.count(F.lit(1)).alias("__ld_n"))
    totals = counts.where(F.col("__ld_line").isNull()).select(F.col("__ld_host").alias("__ld_h"), F.col("__ld_n").alias("__ld_total"))
    often = counts.where(F.col("__ld_line").isNotNull() & (F.col("__ld_n") >= min_pages))
    return often.join(totals, F.col("__ld_host").eqNullSafe(F.col("__ld_h"))).where(F.col("__ld_n") > F.lit(max_ratio) * F.col("__ld_total")).drop("__ld_h")


def _column(host: str | Column) -> Column:
    return F.col(host) if isinstance(host, str) else host


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, spare_whole: bool = False, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """docs with boilerplate lines taken out of ``text``, and ``__ld_dropped``, the number of lines that went."""
    found = materialise(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    n = found.count()
    per_host = found.groupBy("__ld_host").agg(F.collect_list("__ld_line").alias("__ld_bad"))  # at most lines a page / ratio
    if n <= broadcast_hashes:
        joined = docs.join(F.broadcast(per_host), _column(host).eqNullSafe(F.col("__ld_host")), "left")
    else:
        salted = per_host.withColumn("__ld_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = docs.withColumn("__ld_salt", F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, _column(host).eqNullSafe(F.col("__ld_host")) & (F.col("__ld_salt") == F.col("__ld_s")), "left").drop("__ld_salt", "__ld_s")
    lines = F.split(F.col(text), "\n")
    hits = F.array_intersect(F.transform(lines, _key), F.col("__ld_bad"))
    cut = joined.withColumn("__ld_hits", F.when(F.col("__ld_bad").isNotNull() & F.col(text).isNotNull(), hits))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__ld_hits"), _key(x)))
    cut = cut.withColumn("__ld_kept", F.when(F.size("__ld_hits") > 0, kept))
    cuts = F.col("__ld_kept").isNotNull()
    if spare_whole:
        cuts = cuts & F.exists("__ld_kept", lambda x: ~_blank(x))
    new = F.when(cuts, F.array_join("__ld_kept", "\n")).otherwise(F.col(text))
    gone = F.when(cuts, F.size(lines) - F.size("__ld_kept")).otherwise(F.lit(0)).cast("long")
    return cut.withColumn("__ld_dropped", gone).withColumn(text, new).drop("__ld_host", "__ld_bad", "__ld_hits", "__ld_kept")


def op7_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, source as host: doc_id, lines dropped, characters kept, SHA-256 of the text that stays."""
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select(
        "doc_id",
        F.col("__ld_dropped").alias("lines_dropped"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


_BLANK_SQL = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''"
#: Rows with the text after line dedup; {docs} stands for the input relation.
DEDUP_SQL = f"""
ld_rows AS (SELECT row_number() OVER () AS ld_rn, * FROM {{docs}}),
ld_lines AS (SELECT ld_rn, source, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM ld_rows),
ld_total AS (SELECT source, count(*) AS total FROM ld_rows GROUP BY source),
ld_count AS (SELECT source, line, count(*) AS n FROM ld_lines WHERE NOT {_BLANK_SQL.format("line")} GROUP BY source, line),
ld_bad AS (SELECT c.source, c.line FROM ld_count c JOIN ld_total t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > {MAX_RATIO} * t.total),
ld_all AS (SELECT ld_rn, source, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ld_rows WHERE text IS NOT NULL),
ld_cut AS (SELECT a.ld_rn, count(b.line) AS gone,
  coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (WHERE b.line IS NULL), '') AS kept
  FROM ld_all a LEFT JOIN ld_bad b ON a.source IS NOT DISTINCT FROM b.source AND a.line = b.line GROUP BY a.ld_rn),
ld_out AS (SELECT r.* EXCLUDE (ld_rn, text), CASE WHEN c.gone > 0 THEN c.kept ELSE r.text END AS text, coalesce(c.gone, 0) AS lines_dropped
  FROM ld_rows r LEFT JOIN ld_cut c ON r.ld_rn = c.ld_rn)"""

OP7_SQL = f"""WITH {DEDUP_SQL.format(docs="documents")}
SELECT doc_id, lines_dropped::BIGINT AS lines_dropped, length(coalesce(text, ''))::BIGINT AS n_chars_kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM ld_out"""
