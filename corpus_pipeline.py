"""A corpus of documents from raw texts to packed token sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); run() writes each one's rows as Parquet in the shared folder and reads
them again as the next one's documents. n_chars follows the text wherever a stage changes it.

Defined results: null texts count as empty, pass all filters and are packed as a closing id; of them, as of all documents that
are equal or nearly so, the one of the least doc_id stays; rows that repeat a doc_id with other texts are documents of their
own; null lang, source or n_chars pass through, a null source being a host; an empty table passes through all stages as one;
columns beyond the five of ``documents`` are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup, near_copies, packing, pii, toxicity
from lectern.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; the model is fitted on labelled ones of the input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("__tox_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many of a source's documents share go; every document stays.

    A document of such lines only keeps them: it is a copy of others, and the next stage keeps one of these.
    """
    return _documents(line_dedup.drop_boilerplate(docs.select(*COLUMNS), spare_whole=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_copies.keep_one(docs.select(*COLUMNS))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds."""
    return _documents(pii.redact(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, in sequences of at most 4096."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, fingerprints and tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
