"""Settings as dataclasses, read from JSON; every path hangs below data_dir unless it is named.

Names and defaults of the settings that users carry over (sizes, overlaps, thresholds, rates, the fields of a paper root) are
fixed values. Older forms are accepted: one path or object for ``papers``, ``pdf_dir`` or ``path`` for a root, ``provider`` for
``providers``. What is out of range or unknown is refused with the setting's name.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


def _need(fits: bool, name: str, what: str) -> None:
    if not fits:
        raise ValueError(f"{name} must be {what}")


@dataclass
class Root:
    root_path: str | list[str] = "./papers"
    skip_marker_file: str = ""
    tags: list[str] = field(default_factory=list)

    def paths(self) -> list[str]:
        return [self.root_path] if isinstance(self.root_path, str) else list(self.root_path)


@dataclass
class Indexing:
    chunk_size: int = 1200
    chunk_overlap: int = 180
    metadata_path: str = ""
    failed_path: str = ""
    assume_yes: bool = False
    max_files: int | None = None

    def __post_init__(self) -> None:
        _need(0 <= self.chunk_overlap < self.chunk_size, "indexing.chunk_overlap", "smaller than chunk_size and not negative")
        _need(self.max_files is None or self.max_files >= 0, "indexing.max_files", "not negative")


@dataclass
class Enrichment:
    enabled: bool = True
    providers: list[str] = field(default_factory=lambda: ["crossref", "openalex"])
    timing: str = "per_file"
    base_url: str = "https://api.crossref.org"
    openalex_base_url: str = "https://api.openalex.org"
    user_agent: str = "lectern/0.1"
    mailto: str = ""
    openalex_email: str = ""
    timeout_seconds: float = 20
    requests_per_second: float = 1.0
    proxy: str = ""
    min_title_score: float = 3.0
    min_openalex_score: float = 0.5
    min_title_similarity: float = 0.6
    max_query_chars: int = 300

    def __post_init__(self) -> None:
        self.providers = list(dict.fromkeys([self.providers] if isinstance(self.providers, str) else self.providers or ["crossref", "openalex"]))
        _need(set(self.providers) <= {"crossref", "openalex"}, "metadata_enrichment.providers", "crossref or openalex")
        _need(self.timing in ("per_file", "after_index", "manual"), "metadata_enrichment.timing", "per_file, after_index or manual")
        _need(self.requests_per_second > 0, "metadata_enrichment.requests_per_second", "above 0")
        _need(0 <= self.min_title_similarity <= 1, "metadata_enrichment.min_title_similarity", "from 0 to 1")
        _need(self.min_title_score >= 0 and self.min_openalex_score >= 0, "metadata_enrichment.min_title_score and min_openalex_score", "not negative")
        _need(self.max_query_chars > 0, "metadata_enrichment.max_query_chars", "above 0")


@dataclass
class Retrieval:
    vector_top_k: int = 12
    bm25_top_k: int = 12
    default_top_k: int = 8
    fusion: str = "rrf"
    rrf_k: int = 60
    vector_weight: float = 0.65
    bm25_weight: float = 0.35

    def __post_init__(self) -> None:
        _need(self.fusion in ("rrf", "linear"), "retrieval.fusion", "rrf or linear")


@dataclass
class Reranker:
    enabled: bool = False
    model: str = ""
    base_url: str = "http://127.0.0.1:11434"
    instruction: str = "Given a web search query, retrieve relevant passages that answer the query."
    top_k: int = 20
    concurrency: int = 4
    timeout_seconds: float = 60.0
    top_logprobs: int = 10

    def __post_init__(self) -> None:
        _need(min(self.top_k, self.concurrency, self.top_logprobs) >= 1, "reranker.top_k, concurrency and top_logprobs", "at least 1")


@dataclass
class Embedding:
    provider: str = "hashing"
    model: str = "hashing"
    dimension: int = 256
    base_url: str = "http://127.0.0.1:11434"
    api_key_env: str = "OPENAI_API_KEY"
    timeout_seconds: float = 120.0

    def __post_init__(self) -> None:
        _need(self.provider in ("hashing", "ollama", "openai"), "embedding.provider", "hashing, ollama or openai")


@dataclass
class Dedup:
    enabled: bool = False
    semantic_enabled: bool = True
    action: str = "report"
    similarity_threshold: float = 0.92
    signature_chars: int = 3000
    max_files: int | None = None
    report_path: str = ""

    def __post_init__(self) -> None:
        _need(self.action in ("report", "skip"), "dedup.action", "report or skip")
        _need(0 <= self.similarity_threshold <= 1, "dedup.similarity_threshold", "from 0 to 1")
        _need(self.signature_chars > 0 and (self.max_files is None or self.max_files >= 0), "dedup.signature_chars and max_files", "above 0 and not negative")


@dataclass
class CitationGraph:
    include_external_nodes: bool = True
    path: str = ""
    mermaid_path: str = ""


@dataclass
class Display:
    timezone: str = "local"
    datetime_format: str = ""


@dataclass
class Service:
    name: str = "lectern"
    transport: str = "stdio"
    host: str = "127.0.0.1"
    port: int = 8765

    def __post_init__(self) -> None:
        _need(self.transport in ("stdio", "http"), "service.transport", "stdio or http")

    @property
    def endpoint(self) -> str | None:
        return f"http://{self.host}:{self.port}/" if self.transport == "http" else None


@dataclass
class Settings:
    data_dir: str = "./lectern_data"
    papers: list[Root] = field(default_factory=lambda: [Root()])
    indexing: Indexing = field(default_factory=Indexing)
    metadata_enrichment: Enrichment = field(default_factory=Enrichment)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    reranker: Reranker = field(default_factory=Reranker)
    dedup: Dedup = field(default_factory=Dedup)
    citation_graph: CitationGraph = field(default_factory=CitationGraph)
    display: Display = field(default_factory=Display)
    service: Service = field(default_factory=Service)

    def __post_init__(self) -> None:
        d = self.data_dir.rstrip("/")
        self.indexing.metadata_path = self.indexing.metadata_path or f"{d}/paper_metadata.json"
        self.indexing.failed_path = self.indexing.failed_path or f"{d}/logs/index_failed"
        self.dedup.report_path = self.dedup.report_path or f"{d}/logs/duplicate_papers.json"
        self.citation_graph.path = self.citation_graph.path or f"{d}/citation_graph/graph"
        self.citation_graph.mermaid_path = self.citation_graph.mermaid_path or f"{d}/citation_graph/graph.md"

    def table(self, name: str) -> str:
        return f"{self.data_dir.rstrip('/')}/tables/{name}"

    @property
    def stats_path(self) -> str:
        return f"{self.data_dir.rstrip('/')}/logs/retrieval_stats"


def _papers(value: Any) -> list[dict]:
    """Older forms of the paper roots: a path, or an object of them."""
    if isinstance(value, str):
        return [{"root_path": value}]
    if isinstance(value, dict):
        shared = {k: value[k] for k in ("skip_marker_file", "tags") if k in value}
        value = value.get("roots") or [{"root_path": value[k], **shared} for k in ("pdf_dir", "zetro_database_dir") if value.get(k)] or [{}]
    return [{("root_path" if k in ("pdf_dir", "path") else k): v for k, v in r.items()} for r in value]


def _migrated(kind: type, value: dict) -> dict:
    if kind is Settings and "papers" in value:
        return {**value, "papers": _papers(value["papers"])}
    if kind is Enrichment and "provider" in value:
        first = value["provider"]
        rest = {k: v for k, v in value.items() if k != "provider"}
        return rest if "providers" in value else {**rest, "providers": [first, *(p for p in ("crossref", "openalex") if p != first)]}
    return value


def _build(kind: type, value: Any) -> Any:
    if not is_dataclass(kind):
        return value
    value = _migrated(kind, value)
    known = {f.name: f for f in fields(kind)}
    unknown = set(value) - set(known)
    if unknown:
        raise ValueError(f"unknown settings in {kind.__name__}: {sorted(unknown)}")
    types = {"indexing": Indexing, "metadata_enrichment": Enrichment, "embedding": Embedding, "retrieval": Retrieval, "reranker": Reranker, "dedup": Dedup, "citation_graph": CitationGraph, "display": Display, "service": Service}
    made = {k: _build(types[k], v) if k in types and kind is Settings else [_build(Root, r) for r in v] if k == "papers" else v for k, v in value.items()}
    return kind(**made)


def load(path: str | None = None) -> Settings:
    """Settings of a file; without one, the defaults."""
    if path is None:
        return Settings()
    with open(path, encoding="utf-8") as f:
        return _build(Settings, json.load(f))


def write_default(path: str) -> None:
    if os.path.exists(path):
        raise FileExistsError(path)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(Settings()), f, indent=2, ensure_ascii=False)
        f.write("\n")
