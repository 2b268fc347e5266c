"""The library as an object: search, inspection, citations and maintenance over snapshot tables.

Searches are read-only. The lexical index is written once per version of the chunks and used until that changes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import text as T
from .operators import chunking, citations, dedup, enrich, fusion, lexical, library, vector
from .session import scratch
from .sources.files import add_line, write_lines
from .sources.snapshots import SnapshotTable

#: A paper's chunks are numbered within so many bits of seq.
CHUNK_BITS = 24


class Library:
    """embed: (rows, text column) -> rows with ``embedding``; judge: (rows with text, query) -> rows with ``rerank_score``."""

    def __init__(self, spark: SparkSession, settings: Settings, embed: Callable[[DataFrame, str], DataFrame] | None = None, judge: Callable[[DataFrame, str], DataFrame] | None = None):
        self.spark, self.settings, self.judge = spark, settings, judge
        self.chunks = SnapshotTable(spark, settings.table("chunks"), within="source_path")
        self.embed = embed or (lambda rows, text: vector.hashed_embeddings(rows, settings.embedding.dimension, text))
        self._index: tuple[int, lexical.LexicalIndex] | None = None

    # -- writing -------------------------------------------------------------------------------------------------------

    def add_papers(self, papers: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """papers: seq, source_path, file_name, text and metadata. Earlier chunks of the same papers (and of ``gone``'s), abstracts
        too, are replaced. Returns the new chunks."""
        cut = chunking.by_tokens(papers, self.settings.indexing.chunk_size, self.settings.indexing.chunk_overlap)
        rows = cut.withColumnRenamed("chunk_text", "text").withColumn("seq", F.shiftleft("seq", CHUNK_BITS) + F.col("chunk_index"))
        path = scratch(self.spark, "chunks")
        self.embed(rows, "text").write.mode("overwrite").parquet(path)  # a service is asked once
        new = self.spark.read.parquet(path)
        self.chunks.merge(new, on="source_path", gone=(papers if gone is None else gone).select("source_path"))
        return new

    def add_abstracts(self, papers: DataFrame) -> None:
        """A chunk for each paper's abstract, in place of an earlier one; its seq is the paper's last."""
        made = enrich.abstracts(papers).withColumn("seq", F.shiftleft("seq", CHUNK_BITS) + F.lit((1 << CHUNK_BITS) - 1))
        path = scratch(self.spark, "abstracts")
        self.embed(made, "text").write.mode("overwrite").parquet(path)
        self.chunks.merge(self.spark.read.parquet(path))

    def delete(self, selector: str, limit: int | None = 10) -> list[dict]:
        """The papers that went; their files are no longer known either, so the next run may index them again."""
        kept, gone = library.deleted(self._rows(), selector, limit)
        rows = [r.asDict() for r in gone.select("paper", "title", "chunk_count", "source_path").collect()]
        if rows:
            paths = self.spark.createDataFrame([(r["source_path"],) for r in rows], "source_path string")
            self.chunks.merge(self._rows().limit(0), on="source_path", gone=paths)
            known = SnapshotTable(self.spark, self.settings.table("manifest"), key="path")
            if known.version():
                known.delete_ids([r["source_path"] for r in rows])
        return [{k: r[k] for k in ("paper", "title", "chunk_count")} for r in rows]

    def refresh(self, metadata: DataFrame, columns: tuple[str, ...], prune: bool = False) -> int:
        """Correct metadata without touching texts or embeddings; only the buckets of the named papers are written."""
        own = self._rows()
        own = own.withColumns({c: F.lit(None).cast(metadata.schema[c].dataType) for c in columns if c not in own.columns})
        own = own.join(metadata.select("source_path"), "source_path", "left_semi")
        return self.chunks.merge(library.refreshed(own, metadata, columns, prune), on="source_path")

    # -- searching -----------------------------------------------------------------------------------------------------

    def _rows(self) -> DataFrame:
        rows = self.chunks.read()
        if rows is None:
            raise LookupError("nothing is indexed yet")
        return rows

    def embed_query(self, query: str) -> list[float]:
        return self.embed(self.spark.range(1).select(F.lit(query).alias("text")), "text").first().embedding

    def lexical_index(self) -> lexical.LexicalIndex:
        version = self.chunks.version()
        if self._index is None or self._index[0] != version:
            self._index = (version, lexical.write(self._rows(), self.settings.table(f"lexical/v={version}")))
        return self._index[1]

    def search(self, query: str, top_k: int | None = None, group_by_paper: bool = False, max_text_chars: int | None = None, **filters) -> list[dict]:
        r, rows = self.settings.retrieval, self._rows()
        k = top_k or r.default_top_k
        where = library.pushed(filters.get("year"), filters.get("file_name"))
        near = vector.top(rows, self.embed_query(query), r.vector_top_k, max(r.vector_top_k, 3 * r.default_top_k), where=where, residual=library.matches(**filters))
        words = lexical.top(self.lexical_index(), query, r.bm25_top_k, rows, condition=library.matches(**filters))
        fused = fusion.fuse(near, words, r.fusion, r.rrf_k, (r.vector_weight, r.bm25_weight))
        ids = [x.id for x in fused.select("id").collect()]  # two short lists
        texts = rows.where(F.col("seq").isin(ids)).drop("embedding")
        ranked = texts.join(F.broadcast(fused), texts.seq == fused.id).drop("id")
        if self.settings.reranker.enabled and self.judge is not None:
            ranked = self._judged(ranked, query)
        ranked = fusion.group_by_paper(ranked, k) if group_by_paper else ranked.orderBy("rank").limit(k)
        self._note("search", query=query, top_k=k)
        return self._shown(ranked.orderBy("rank"), max_text_chars)

    def _judged(self, ranked: DataFrame, query: str) -> DataFrame:
        """ranked by the judging model; as it is if the model can't be asked at all."""
        most = self.settings.reranker.top_k
        try:
            found = self.judge(ranked.where(F.col("rank") <= most), query).select("seq", "rerank_score").collect()  # top_k rows
        except Exception:  # noqa: BLE001  a search without its reranker is better than none
            return ranked
        scores = F.create_map(*[F.lit(x) for r in found for x in (r.seq, r.rerank_score)])
        return fusion.rerank(ranked, F.element_at(scores, F.col("seq")), most) if found else ranked

    def search_by_metadata(self, limit: int = 20, group_by_paper: bool = False, max_text_chars: int | None = None, **filters) -> list[dict]:
        self._note("search_by_metadata", limit=limit)
        return self._shown(library.metadata_search(self._rows(), limit, group_by_paper, **filters), max_text_chars)

    def _shown(self, rows: DataFrame, most: int | None) -> list[dict]:
        out = rows.withColumn("text", T.truncated(F.col("text"), most)).drop("source_path", "embedding")
        return [r.asDict(recursive=True) for r in out.collect()]

    def _note(self, event: str, **payload) -> None:
        row = {"timestamp": datetime.now(timezone.utc).isoformat(), "event": event, "payload": json.dumps(payload)}
        add_line(self.spark, self.settings.stats_path, json.dumps(row))

    # -- looking -------------------------------------------------------------------------------------------------------

    def get_chunk(self, chunk_id: str) -> dict | None:
        row = self.chunks.get(chunk_id)
        return {k: v for k, v in row.items() if k not in ("source_path", "embedding")} if row else None

    def export_context(self, chunk_ids: list[str]) -> str:
        self._note("export_context", ids=len(chunk_ids))
        return library.export_context(self._rows(), chunk_ids)

    def list_papers(self, limit: int | None = 10) -> list[dict]:
        return [r.asDict() for r in library.summary(self._rows(), limit).drop("source_path", "paper").collect()]

    def show_paper(self, selector: str, limit: int = 10, all_chunks: bool = False) -> list[dict]:
        out = []
        for r in library.details(self._rows(), selector, limit).drop("source_path", "paper").collect():
            d = r.asDict()
            ids = d.pop("chunk_ids")
            out.append(d | {"chunk_ids": ids if all_chunks else ids[:5], "hidden_chunks": 0 if all_chunks else max(0, len(ids) - 5)})
        return out

    def has_paper(self, source_path: str) -> bool:
        return not self._rows().where(F.col("source_path") == source_path).limit(1).isEmpty()

    def citations_of(self, selector: str, external_sample: int = 20, incoming_limit: int = 50) -> dict | None:
        rows = library.papers(self._rows(), ("openalex_id", "referenced_dois", "referenced_work_ids", "cited_by_count")).withColumn("seq", F.col("first_seq"))
        hit = rows.where(library.selected(selector)).orderBy("seq").limit(1).select("seq").first()
        return citations.view(rows, hit.seq, external_sample, incoming_limit) if hit else None

    def duplicates(self) -> DataFrame:
        rows = library.papers(self._rows()).withColumn("seq", F.col("first_seq"))
        found = [dedup.by_doi(rows), dedup.by_title_year(rows)]
        if self.settings.dedup.semantic_enabled:
            found.append(dedup.semantic(self._rows().where("chunk_index = 0"), self.settings.dedup.similarity_threshold))
        return dedup.unique_pairs(*found)

    def citation_graph(self) -> dict:
        """Writes nodes and edges as JSON and the graph as Mermaid text, line by line."""
        rows = library.papers(self._rows(), ("openalex_id", "referenced_dois", "referenced_work_ids", "cited_by_count")).withColumn("seq", F.col("first_seq"))
        g = self.settings.citation_graph
        citations.nodes(rows, g.include_external_nodes).write.mode("overwrite").json(f"{g.path}/nodes")
        citations.edges(rows, g.include_external_nodes).write.mode("overwrite").json(f"{g.path}/edges")
        lines = citations.mermaid(rows, g.include_external_nodes).orderBy("part", "k", "k2")
        n = write_lines(self.spark, g.mermaid_path, chain(["```mermaid", "graph TD"], (r.line for r in lines.toLocalIterator()), ["```"])) - 3
        edges = self.spark.read.schema("source string, target string").json(f"{g.path}/edges").count()
        return {"nodes": n - edges, "edges": edges, "path": g.path, "mermaid_path": g.mermaid_path}

    def info(self) -> dict:
        s = self.settings
        return {"name": s.service.name, "transport": s.service.transport, "embedding_model": s.embedding.model, "fusion": s.retrieval.fusion, "reranker": s.reranker.model if s.reranker.enabled else None, "chunks": self.chunks.count()}


TOOLS = ("search", "search_by_metadata", "get_chunk", "export_context", "list_papers", "show_paper", "citations_of", "info")


def call(lib: Library, request: dict) -> dict:
    """Answer one request {"tool", "arguments"}; only the reading tools can be called."""
    if request.get("tool") not in TOOLS:
        return {"error": f"unknown tool: {request.get('tool')}"}
    try:
        return {"result": getattr(lib, request["tool"])(**request.get("arguments", {}))}
    except (TypeError, LookupError, ValueError) as e:
        return {"error": str(e)}
