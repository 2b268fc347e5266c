"""Citation graph and a paper's citation view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def node_id(doi: Column, openalex_id: Column, path: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), T.blank(T.doi_key(doi))), T.blank(F.trim(openalex_id)), F.concat(F.lit("path:"), path))


def _placed(papers: DataFrame) -> DataFrame:
    return papers.withColumn("id", node_id(F.col("doi"), F.col("openalex_id"), F.col("source_path")))


def _targets(papers: DataFrame) -> DataFrame:
    """seq, source, kind, ref: one row per reference, DOIs first."""
    placed = _placed(papers)
    dois = placed.select("seq", F.col("id").alias("source"), F.lit(0).alias("kind"), F.explode(F.transform("referenced_dois", T.doi_key)).alias("ref"))
    works = placed.select("seq", F.col("id").alias("source"), F.lit(1).alias("kind"), F.explode(F.transform("referenced_work_ids", lambda x: F.trim(x))).alias("ref"))
    return dois.unionByName(works).where("ref <> ''")


def _known(papers: DataFrame) -> DataFrame:
    """kind, ref, node: of papers that share a key, the last one."""
    placed = _placed(papers)
    dois = placed.select(F.lit(0).alias("kind"), T.doi_key(F.col("doi")).alias("ref"), "id", "seq")
    works = placed.select(F.lit(1).alias("kind"), F.trim(F.coalesce("openalex_id", F.lit(""))).alias("ref"), "id", "seq")
    return dois.unionByName(works).where("ref <> ''").groupBy("kind", "ref").agg(F.max_by("id", "seq").alias("node"))


def edges(papers: DataFrame, external: bool = True) -> DataFrame:
    """source, target: distinct references without self references; external works are nodes of their own unless left out."""
    named = _targets(papers).join(_known(papers), ["kind", "ref"], "left")
    outside = F.when(F.col("kind") == 0, F.concat(F.lit("doi:"), F.col("ref"))).otherwise(F.col("ref"))
    target = F.coalesce("node", outside) if external else F.col("node")
    return named.select("source", target.alias("target")).where("target is not null and source <> target").distinct()


def nodes(papers: DataFrame, external: bool = True) -> DataFrame:
    """id, title, indexed; a node's payload is that of its last paper."""
    own = _placed(papers).groupBy("id").agg(F.max_by(F.struct("source_path", "title", "doi", "openalex_id", "year", "cited_by_count"), "seq").alias("p"), F.min("seq").alias("first_seq"))
    inside = own.select("id", "p.*", F.lit(True).alias("indexed"), "first_seq")
    if not external:
        return inside
    outside = edges(papers).select(F.col("target").alias("id")).distinct().join(inside.select("id"), "id", "left_anti")
    return inside.unionByName(outside.withColumn("indexed", F.lit(False)), allowMissingColumns=True)


def mermaid_id(c: Column) -> Column:
    clean = F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")
    return F.when(clean.rlike(r"^\p{N}"), F.concat(F.lit("n_"), clean)).otherwise(clean)


def mermaid_label(title: Column, doi: Column, openalex_id: Column, node: Column) -> Column:
    """Title, DOI, end of the work's id, or the node's; backslashes and quotes are escaped, line ends become blanks.

    A work outside of the library is known by the one reference to it, which its node's id holds.
    """
    outside = F.when(node.startswith("doi:"), F.substring(node, 5, 1 << 30)).when(~node.startswith("path:"), F.substring_index(node, "/", -1))
    label = F.coalesce(*[T.blank(F.trim(c)) for c in (title, T.doi_key(doi))], F.substring_index(T.blank(F.trim(openalex_id)), "/", -1), outside, node)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", " ")):
        label = F.replace(label, F.lit(a), F.lit(b))
    return label


def mermaid(papers: DataFrame, external: bool = True) -> DataFrame:
    """ord, line: nodes, then arrows, each by name."""
    n = nodes(papers, external).select(F.lit(0).alias("part"), F.col("id").alias("k"), F.lit("").alias("k2"), F.concat(F.lit("  "), mermaid_id(F.col("id")), F.lit('["'), mermaid_label(F.col("title"), F.col("doi"), F.col("openalex_id"), F.col("id")), F.lit('"]')).alias("line"))
    e = edges(papers, external).select(F.lit(1).alias("part"), F.col("source").alias("k"), F.col("target").alias("k2"), F.concat(F.lit("  "), mermaid_id(F.col("source")), F.lit(" --> "), mermaid_id(F.col("target"))).alias("line"))
    return n.unionByName(e)


# -- the view of one paper ---------------------------------------------------------------------------------------------


def outgoing_local(papers: DataFrame, seq: int) -> DataFrame:
    """Papers of the library that the paper refers to, each once: DOI matches first, then by reference."""
    refs = _targets(papers.where(F.col("seq") == seq)).drop("source", "seq")
    keys = papers.select(F.lit(0).alias("kind"), T.doi_key(F.col("doi")).alias("ref"), "seq").unionByName(papers.select(F.lit(1).alias("kind"), F.trim(F.coalesce("openalex_id", F.lit(""))).alias("ref"), "seq"))
    hit = keys.where("ref <> ''").groupBy("kind", "ref").agg(F.max("seq").alias("seq")).join(refs.distinct(), ["kind", "ref"]).where(F.col("seq") != seq)
    first = hit.groupBy("seq").agg(F.min(F.struct("kind", "ref")).alias("o"))
    return first.join(papers, "seq").withColumn("position", F.row_number().over(Window.orderBy("o"))).drop("o")


def outgoing_external(papers: DataFrame, seq: int) -> DataFrame:
    """References that no paper of the library answers."""
    return _targets(papers.where(F.col("seq") == seq)).select("kind", "ref").distinct().join(_known(papers), ["kind", "ref"], "left_anti")


def _citing(papers: DataFrame, seq: int) -> DataFrame:
    own = papers.where(F.col("seq") == seq)
    keys = own.select(F.lit(0).alias("kind"), T.doi_key(F.col("doi")).alias("ref")).unionByName(own.select(F.lit(1).alias("kind"), F.trim(F.coalesce("openalex_id", F.lit(""))).alias("ref"))).where("ref <> ''")
    return _targets(papers).join(F.broadcast(keys), ["kind", "ref"], "left_semi").select("seq").distinct().where(F.col("seq") != seq)  # two rows


def incoming(papers: DataFrame, seq: int, limit: int = 50) -> DataFrame:
    """Papers that refer to the paper by DOI or work id, newest first."""
    citing = _citing(papers, seq)
    order = [F.desc(F.coalesce(F.col("year").cast("string"), F.lit(""))), F.desc(F.coalesce("title", F.lit(""))), F.col("seq")]
    return papers.join(citing, "seq").orderBy(*order).limit(limit)


def view(papers: DataFrame, seq: int, external_sample: int = 20, incoming_limit: int = 50) -> dict:
    """The citation view as plain values."""
    own = papers.where(F.col("seq") == seq).select("file_name", "title", "doi", "year", "openalex_id", "cited_by_count").first()
    shape = lambda df: [r.asDict() for r in df.select("file_name", "title", "doi", "year").collect()]
    local = outgoing_local(papers, seq).orderBy("position")
    outside = outgoing_external(papers, seq)
    citing = _citing(papers, seq)
    rows = shape(local)
    return {
        "paper": own.asDict() if own else None,
        "outgoing": {"local": rows, "local_count": len(rows), "external_count": outside.count(), "external_sample": [r.ref for r in outside.orderBy("kind", "ref").limit(external_sample).collect()]},
        "incoming": shape(incoming(papers, seq, incoming_limit)),
        "incoming_count": citing.count(),
    }
