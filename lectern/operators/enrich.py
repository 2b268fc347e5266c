"""Bibliographic enrichment: parsed answers of services, a gate, merges and outcomes."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions import titles

YEAR_SLACK, MIN_SIMILARITY, DOI_CHARS = 2, 0.6, 4000
#: The fields that enrichment writes.
FIELDS = ("doi", "title", "authors", "year", "container_title", "publisher", "url", "openalex_id", "abstract", "referenced_dois", "referenced_work_ids", "related_work_ids", "cited_by_count", "metadata_source", "metadata_enriched_at")

_DATE = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
CROSSREF = (
    "DOI STRING, title ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING>>, `published-print` " + _DATE + ", `published-online` " + _DATE
    + ", published " + _DATE + ", issued " + _DATE + ", `container-title` ARRAY<STRING>, publisher STRING, URL STRING, score DOUBLE, reference ARRAY<STRUCT<DOI: STRING>>"
)
OPENALEX = (
    "id STRING, doi STRING, display_name STRING, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, publication_year INT, "
    "primary_location STRUCT<source: STRUCT<display_name: STRING>>, abstract_inverted_index MAP<STRING, ARRAY<INT>>, referenced_works ARRAY<STRING>, "
    "related_works ARRAY<STRING>, cited_by_count INT, publisher STRING, relevance_score DOUBLE"
)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _first(c: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), 0), F.lit(""))


def _strings(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def parse_crossref(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with ``work``; null without a DOI or for text that isn't JSON."""
    m = rows.withColumn("m", F.from_json(payload, CROSSREF))
    year = F.coalesce(*[F.get(F.get(F.col("m")[k]["date-parts"], 0), 0) for k in ("published-print", "published-online", "published", "issued")])
    names = F.filter(F.transform("m.author", lambda a: F.trim(F.concat_ws(" ", T.blank(_text(a["given"])), T.blank(_text(a["family"]))))), lambda x: x != "")
    refs = F.array_sort(F.array_distinct(F.filter(F.transform("m.reference", lambda r: T.doi_bare(r["DOI"])), lambda x: x != "")))
    none = F.array().cast("array<string>")
    work = F.struct(
        F.lit("crossref").alias("source"), _text(F.col("m.DOI")).alias("doi"), _first(F.col("m.title")).alias("title"), F.coalesce(names, none).alias("authors"), year.alias("year"),
        _first(F.col("m.container-title")).alias("container_title"), _text(F.col("m.publisher")).alias("publisher"), _text(F.col("m.URL")).alias("url"), F.col("m.score").alias("score"),
        F.lit("").alias("openalex_id"), F.lit("").alias("abstract"), none.alias("referenced_work_ids"), F.coalesce(refs, none).alias("referenced_dois"), none.alias("related_work_ids"), F.lit(None).cast("int").alias("cited_by_count"),
    )
    return m.withColumn("work", F.when(_text(F.col("m.DOI")) != "", work)).drop("m")


def abstract_of(index: Column) -> Column:
    """The text of an inverted index of words and positions."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " "), F.lit(""))


def parse_openalex(rows: DataFrame, payload: str = "payload") -> DataFrame:
    m = rows.withColumn("m", F.from_json(payload, OPENALEX))
    names = F.filter(F.transform("m.authorships", lambda a: _text(a["author"]["display_name"])), lambda x: x != "")
    none = F.array().cast("array<string>")
    work = F.struct(
        F.lit("openalex").alias("source"), T.doi_bare(F.col("m.doi")).alias("doi"), _text(F.col("m.display_name")).alias("title"), F.coalesce(names, none).alias("authors"), F.col("m.publication_year").alias("year"),
        _text(F.col("m.primary_location.source.display_name")).alias("container_title"), _text(F.col("m.publisher")).alias("publisher"), F.coalesce(T.blank(_text(F.col("m.doi"))), _text(F.col("m.id"))).alias("url"), F.col("m.relevance_score").alias("score"),
        _text(F.col("m.id")).alias("openalex_id"), abstract_of(F.col("m.abstract_inverted_index")).alias("abstract"), _strings(F.col("m.referenced_works")).alias("referenced_work_ids"), none.alias("referenced_dois"), _strings(F.col("m.related_works")).alias("related_work_ids"), F.col("m.cited_by_count").alias("cited_by_count"),
    )
    return m.withColumn("work", F.when(T.doi_bare(F.col("m.doi")) != "", work)).drop("m")


# -- the gate ----------------------------------------------------------------------------------------------------------


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    """The better of the character sequences' ratio and the words' overlap. The ratio needs Python; it runs only on candidates."""
    x, y = titles.compare_form(a), titles.compare_form(b)
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(F.greatest(_sequence_ratio(x, y), titles.token_jaccard(x, y)))


def year_fits(found: Column, expected: Column) -> Column:
    return F.coalesce(F.abs(found - expected) <= YEAR_SLACK, F.lit(True))


def accepted(trusted: Column, similarity: Column, found_year: Column, expected_year: Column, least: float = MIN_SIMILARITY) -> Column:
    """Trusted DOIs pass; all others need a like title and, where both are known, a near year."""
    return F.coalesce(trusted, F.lit(False)) | (F.coalesce(similarity >= least, F.lit(False)) & year_fits(found_year, expected_year))


def doi_choice(doi: Column, url: Column, external_url: Column, text: Column, trust_existing: bool = True) -> tuple[Column, Column]:
    """(trusted, speculative) DOI: stored ones are trusted unless they are to be verified; the text is searched only without one."""
    existing = F.coalesce(T.blank(T.doi_bare(doi)), *[T.blank(T.doi_bare(T.extract_doi(c))) for c in (url, external_url)])
    nothing = F.lit(None).cast("string")
    if not trust_existing:
        return nothing, existing
    mined = T.blank(T.doi_bare(T.extract_doi(F.substring(F.coalesce(text, F.lit("")), 1, DOI_CHARS))))
    return existing, F.when(existing.isNull(), mined)


# -- merges and outcomes -----------------------------------------------------------------------------------------------


def _filled(c: Column, array: bool) -> Column:
    return F.when(F.size(c) > 0, c) if array else F.when(c.cast("string") != "", c)


_LISTS = ("authors", "referenced_dois", "referenced_work_ids", "related_work_ids")


def merged(rows: DataFrame, force: bool = False, at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """rows (metadata columns and work) with the work merged in: it fills gaps, or overwrites with force; titles must be trusted."""
    out = {}
    for c in FIELDS[:-2]:
        old, new = _filled(F.col(c), c in _LISTS), _filled(F.col("work")[c], c in _LISTS)
        if c == "title":
            old, new = F.when(titles.trusted(old), old), F.when(titles.trusted(new), new)
        both = F.coalesce(new, old) if force else F.coalesce(old, new)
        if c == "title":
            both = F.coalesce(both, T.blank(titles.from_file_name(F.col("file_name"))))
        out[c] = F.when(F.col("work").isNull(), F.col(c)).otherwise(both)
    out["metadata_source"] = F.when(F.col("work").isNull(), F.col("metadata_source")).otherwise(F.col("work.source"))
    out["metadata_enriched_at"] = F.when(F.col("work").isNull(), F.col("metadata_enriched_at")).otherwise(F.lit(at))
    return rows.withColumns(out)


def cleared(rows: DataFrame) -> DataFrame:
    """rows without what enrichment wrote."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in FIELDS if c in rows.columns})


def outcome(has_doi: Column, accepted_: Column, failed: Column, force: bool = False, reverify: bool = False) -> Column:
    """skipped, updated, cleared, failed or unmatched of each target."""
    done = has_doi if not (force or reverify) else F.lit(False)
    gone = F.lit("cleared") if reverify else F.lit("skipped")
    return F.when(done, "skipped").when(accepted_, "updated").when(failed, "failed").when(has_doi, gone).otherwise("skipped")


def abstracts(papers: DataFrame) -> DataFrame:
    """A chunk for each paper that has an abstract: its id depends on the path only, so a new abstract replaces the old one."""
    head = F.coalesce(T.blank(F.trim("title")), T.blank(F.trim("file_name")))
    kept = [c for c in ("seq", "source_path", "file_name", "title", "doi", "year", "authors", "tags", *FIELDS[4:]) if c in papers.columns]
    return papers.where(T.blank(F.trim("abstract")).isNotNull()).select(T.abstract_id(F.col("source_path")).alias("chunk_id"), F.concat_ws("\n\n", head, F.trim("abstract")).alias("text"), F.lit("abstract").alias("chunk_type"), *kept)
