"""Queries that go through whole runs: files in a scratch folder, answers from a function in place of the services."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runs
from ..config import Enrichment, Root, Settings
from ..service import Library
from ..session import scratch
from ..sources import files
from .catalog import query
from .corpus import table


def _library(spark: SparkSession, **more) -> Library:
    return Library(spark, Settings(data_dir=scratch(spark, "library"), metadata_enrichment=Enrichment(requests_per_second=1e6, timing="manual"), **more))


@query("""SELECT provider, query_value, CASE WHEN c % 4 = 0 THEN 'new ' || c ELSE 'old ' || c END AS payload FROM (SELECT 'p' || (c_custkey % 3) AS provider, c_custkey::VARCHAR AS query_value, c_custkey AS c FROM customer) WHERE c % 2 = 0 AND c % 5 <> 0""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to the cache of answers, the second over part of the first, and a lookup by provider, kind and value."""
    lib, i = _library(spark), F.col("c_custkey")
    keys = table(spark, sf_dir, "customer").select(i, F.concat(F.lit("p"), F.pmod(i, F.lit(3)).cast("string")).alias("provider"), F.lit("doi").alias("query_type"), i.cast("string").alias("query_value"))
    for n, word in ((2, "old "), (4, "new ")):
        runs.cache_put(lib, keys.where(F.pmod(i, F.lit(n)) == 0).withColumn("payload", F.concat(F.lit(word), i.cast("string"))))
    return runs.cached(lib, keys.where(F.pmod(i, F.lit(5)) != 0).drop("c_custkey")).select("provider", "query_value", "payload")


def _answers(method: str, url: str, parameters: dict, body: dict | None) -> tuple[int, str]:
    """The first service knows every third title and errs on every third; the second knows those, and is down for some others."""
    title = parameters.get("query.bibliographic") or parameters.get("search") or ""
    found = re.search(r" number (\d+)$", title)
    k = int(found[1]) if found else 0
    if "openalex" in url:
        if k % 6 == 5:
            raise TimeoutError("late")
        return 200, json.dumps({"results": [{"doi": f"https://doi.org/10.9/{k}", "id": f"W{k}", "display_name": title.upper()}] if k % 3 == 1 else []})
    named = title if k % 3 == 0 else "Quite Another Work"
    return 200, json.dumps({"message": {"items": [{"DOI": f"10.7/{k}", "title": [named], "issued": {"date-parts": [[1990 + k % 30]]}}] if k % 3 < 2 else []}})


@query("""SELECT '/parts/' || p_partkey || '.pdf' AS source_path, CASE p_partkey % 3 WHEN 0 THEN '10.7/' || p_partkey ELSE '10.9/' || p_partkey END AS doi, CASE p_partkey % 3 WHEN 0 THEN 'crossref' ELSE 'openalex' END AS metadata_source,
CASE WHEN p_partkey % 3 = 0 THEN 1990 + p_partkey % 30 END::INT AS year, (SELECT count(*) FROM part WHERE p_partkey % 6 = 5)::BIGINT AS failed, (SELECT count(*) FROM part WHERE p_partkey % 6 = 2)::BIGINT AS skipped FROM part WHERE p_partkey % 3 < 2""")
def enrich_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as papers, looked up at two services in turn; what was accepted, read back from the metadata file, and the counters."""
    lib, i = _library(spark), F.col("p_partkey")
    name = F.concat(i.cast("string"), F.lit(".pdf"))
    papers = table(spark, sf_dir, "part").select(i.alias("seq"), F.concat(F.lit("/parts/"), name).alias("source_path"), name.alias("file_name"), F.lit("").alias("text"), F.concat("p_name", F.lit(" number "), i.cast("string")).alias("title"))
    done = runs.enrich_papers(lib, papers, _answers)
    said = files.metadata_json(spark, lib.settings.indexing.metadata_path)
    value = lambda c, t="string": F.try_variant_get("value", f"$.{c}", t).alias(c)
    return said.select(F.col("meta_key").alias("source_path"), value("doi"), value("metadata_source"), value("year", "int"), F.lit(done["failed"]).cast("long").alias("failed"), F.lit(done["skipped"]).cast("long").alias("skipped"))


def _read(content: bytes) -> tuple[str, int]:
    text = content.decode()
    if text.startswith("broken"):
        raise OSError("no pages")
    return text, 1


@query("""SELECT run, indexed, skipped, chunks FROM (SELECT 1 AS run, count(*) FILTER (WHERE n_nationkey % 5 <> 0)::BIGINT AS indexed, count(*) FILTER (WHERE n_nationkey % 5 = 0)::BIGINT AS skipped, count(*) FILTER (WHERE n_nationkey % 5 <> 0)::BIGINT AS chunks FROM nation
UNION ALL SELECT 2, 0, count(*), 0 FROM nation UNION ALL SELECT 3, count(*) FILTER (WHERE n_nationkey % 5 <> 0), count(*) FILTER (WHERE n_nationkey % 5 = 0), count(*) FILTER (WHERE n_nationkey % 5 <> 0) FROM nation
UNION ALL SELECT 4, 2, count(*) - 2, 2 FROM nation)""")
def index_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation, some of them broken: a first run, one that finds nothing new, a forced one, and one of two files."""
    folder = scratch(spark, "papers")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        files.write_lines(spark, f"{folder}/{r.n_nationkey:02d}.pdf", ["broken" if r.n_nationkey % 5 == 0 else f"The history of {r.n_name} and its people"])
    lib = _library(spark, papers=[Root(folder)])
    done = [runs.index(lib, reader=_read, **how) for how in ({}, {}, {"force": True})]
    lib.chunks.delete(F.lit(True))
    runs.manifest(lib).delete(F.substring("path", -5, 1).cast("int").isin(1, 2) & (F.substring("path", -6, 1) == "0"))
    files.clear_failures(spark, lib.settings.indexing.failed_path, spark.createDataFrame([], "path string"))
    done.append(runs.index(lib, reader=_read))
    return spark.createDataFrame([(k, d["indexed"], d["skipped"], d["chunks"]) for k, d in enumerate(done, 1)], "run int, indexed long, skipped long, chunks long")
