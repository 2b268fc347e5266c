"""The library's tables made from the star of test tables, in Spark and in SQL alike.

Four documents are the chunks of one paper; identifiers, years, authors and references come from arithmetic on doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_TEXT = "the shanin er restion the"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = F.floor(F.col("doc_id") / 4)
    mod = lambda n: F.pmod(p, F.lit(n))
    path = F.concat(F.lit("/papers/p"), p.cast("string"), F.lit(".pdf"))
    index = F.pmod("doc_id", F.lit(4)).cast("int")
    return d.select(
        F.substring(F.sha2(F.concat(path, F.lit(":"), index.cast("string"), F.lit(":"), F.col("text")), 256), 1, 24).alias("chunk_id"),
        F.col("doc_id").alias("seq"), "text", path.alias("source_path"), F.concat(F.lit("p"), p.cast("string"), F.lit(".pdf")).alias("file_name"), index.alias("chunk_index"),
        F.when(index > 0, F.concat(F.lit("A Study of Topic "), mod(97).cast("string"))).alias("title"),
        F.when(mod(3) == 0, F.concat(F.lit("10.5555/"), mod(200).cast("string"))).alias("doi"),
        F.when(mod(10) != 0, (2000 + mod(25)).cast("int")).alias("year"),
        F.array(F.concat(F.lit("Author "), mod(7).cast("string")), F.concat(F.lit("Writer, "), mod(11).cast("string"))).alias("authors"),
        F.array(F.col("source"), F.col("lang")).alias("tags"),
    )


CHUNKS_SQL = """docs AS (SELECT *, doc_id // 4 AS p, (doc_id % 4)::INT AS i FROM documents),
chunks AS (SELECT substr(sha256('/papers/p' || p || '.pdf:' || i || ':' || text), 1, 24) AS chunk_id, doc_id AS seq, text,
  '/papers/p' || p || '.pdf' AS source_path, 'p' || p || '.pdf' AS file_name, i AS chunk_index,
  CASE WHEN i > 0 THEN 'A Study of Topic ' || (p % 97) END AS title,
  CASE WHEN p % 3 = 0 THEN '10.5555/' || (p % 200) END AS doi,
  CASE WHEN p % 10 <> 0 THEN (2000 + p % 25)::INT END AS year,
  ['Author ' || (p % 7), 'Writer, ' || (p % 11)] AS authors, [source, lang] AS tags FROM docs)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper per document, with references into and out of the library."""
    d = table(spark, sf_dir, "documents")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    rows = d.crossJoin(F.broadcast(n))  # one row
    return rows.select(
        i.alias("seq"), F.concat(F.lit("/papers/"), s(i), F.lit(".pdf")).alias("source_path"), F.concat(s(i), F.lit(".pdf")).alias("file_name"),
        F.concat(F.lit("Title "), s(F.pmod(i, F.lit(301)))).alias("title"),
        F.when(F.pmod(i, F.lit(4)) != 0, F.concat(F.lit("10.5555/"), s(F.pmod(i * 5, F.col("n"))))).alias("doi"),
        F.when(F.pmod(i, F.lit(3)) == 0, F.concat(F.lit("https://openalex.example/W"), s(i))).alias("openalex_id"),
        F.when(F.pmod(i, F.lit(10)) != 0, (2000 + F.pmod(i, F.lit(25))).cast("int")).alias("year"),
        F.pmod(i, F.lit(50)).cast("int").alias("cited_by_count"),
        F.array(F.concat(F.lit("https://doi.org/10.5555/"), s(F.pmod(i * 7 + 3, F.col("n")))), F.concat(F.lit("10.5555/"), s(F.pmod(i * 13 + 5, 2 * F.col("n")))), F.lit("doi:")).alias("referenced_dois"),
        F.array(F.concat(F.lit("https://openalex.example/W"), s(F.pmod(i * 11 + 1, F.col("n")))), F.concat(F.lit("https://openalex.example/W"), s(i))).alias("referenced_work_ids"),
    )


PAPERS_SQL = """total AS (SELECT count(*) AS n FROM documents),
papers AS (SELECT doc_id AS seq, '/papers/' || doc_id || '.pdf' AS source_path, doc_id || '.pdf' AS file_name, 'Title ' || (doc_id % 301) AS title,
  CASE WHEN doc_id % 4 <> 0 THEN '10.5555/' || ((doc_id * 5) % n) END AS doi,
  CASE WHEN doc_id % 3 = 0 THEN 'https://openalex.example/W' || doc_id END AS openalex_id,
  CASE WHEN doc_id % 10 <> 0 THEN (2000 + doc_id % 25)::INT END AS year, (doc_id % 50)::INT AS cited_by_count,
  ['10.5555/' || ((doc_id * 7 + 3) % n), '10.5555/' || ((doc_id * 13 + 5) % (2 * n))] AS rd,
  ['https://openalex.example/W' || ((doc_id * 11 + 1) % n), 'https://openalex.example/W' || doc_id] AS rw FROM documents, total),
placed AS (SELECT *, coalesce('doi:' || doi, openalex_id, 'path:' || source_path) AS id FROM papers),
refs AS (SELECT seq, id AS source, 0 AS kind, unnest(rd) AS ref FROM placed UNION ALL SELECT seq, id, 1, unnest(rw) FROM placed),
known AS (SELECT kind, ref, arg_max(id, seq) AS node, max(seq) AS seq FROM (SELECT 0 AS kind, doi AS ref, id, seq FROM placed WHERE doi IS NOT NULL
  UNION ALL SELECT 1, openalex_id, id, seq FROM placed WHERE openalex_id IS NOT NULL) GROUP BY kind, ref),
edges AS (SELECT DISTINCT source, coalesce(node, CASE WHEN kind = 0 THEN 'doi:' || ref ELSE ref END) AS target, node IS NOT NULL AS inside
  FROM refs LEFT JOIN known USING (kind, ref) WHERE source <> coalesce(node, CASE WHEN kind = 0 THEN 'doi:' || ref ELSE ref END))"""
