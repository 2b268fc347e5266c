"""Bibliographic, embedding and judging services as DataFrames over a transport that is passed in.

A transport is a function (method, url, parameters, JSON body) -> (status, text); ``http`` is one over the network, tests pass
their own. Requests go out by mapInArrow from ``lanes`` tasks, each of which keeps its share of the request rate.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Transport = Callable[[str, str, dict, dict | None], tuple[int, str]]


def http(timeout: float = 20.0, headers: dict | None = None, proxy: str = "") -> Transport:
    def send(method: str, url: str, parameters: dict, body: dict | None) -> tuple[int, str]:
        full = url + ("?" + urllib.parse.urlencode(parameters) if parameters else "")
        data = json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(full, data=data, method=method, headers={"Content-Type": "application/json", **(headers or {})})
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({"http": proxy, "https": proxy} if proxy else None))
        try:
            with opener.open(request, timeout=timeout) as answer:
                return answer.status, answer.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(errors="replace")

    return send


class Pace:
    """Waits so that no more than ``rate`` requests go out a second."""

    def __init__(self, rate: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.due, self.now, self.sleep = 1.0 / rate, 0.0, now, sleep

    def wait(self) -> None:
        late = self.due - self.now()
        if late > 0:
            self.sleep(late)
        self.due = self.now() + self.gap


# -- bibliographic services --------------------------------------------------------------------------------------------


def _crossref(send: Transport, s, kind: str, value: str) -> str | None:
    common = {"mailto": s.mailto} if s.mailto else {}
    base = s.base_url.rstrip("/")
    if kind == "doi":
        status, text = send("GET", f"{base}/works/{urllib.parse.quote(value, safe='')}", common, None)
        if status == 404:
            return None
    else:
        status, text = send("GET", f"{base}/works", {"query.bibliographic": value[: s.max_query_chars], "rows": 1, **common}, None)
    if status >= 400:
        raise OSError(f"status {status}")
    found = json.loads(text).get("message")
    if kind != "doi" and isinstance(found, dict):
        items = found.get("items")
        found = items[0] if isinstance(items, list) and items else None
        score = found.get("score") if isinstance(found, dict) else None
        if isinstance(score, (int, float)) and score < s.min_title_score:
            return None
    return json.dumps(found) if isinstance(found, dict) else None


def _openalex(send: Transport, s, kind: str, value: str) -> str | None:
    common = {"mailto": s.openalex_email or s.mailto} if s.openalex_email or s.mailto else {}
    asked = {"filter": f"doi:{value}"} if kind == "doi" else {"search": value[: s.max_query_chars]}
    status, text = send("GET", s.openalex_base_url.rstrip("/") + "/works", {**asked, "per-page": 1, **common}, None)
    if status >= 400:
        raise OSError(f"status {status}")
    results = json.loads(text).get("results")
    found = results[0] if isinstance(results, list) and results else None
    score = found.get("relevance_score") if isinstance(found, dict) else None
    if kind != "doi" and isinstance(score, (int, float)) and score < s.min_openalex_score:
        return None
    return json.dumps(found) if isinstance(found, dict) else None


SERVICES = {"crossref": _crossref, "openalex": _openalex}


def lookup(queries: DataFrame, provider: str, send: Transport, settings, lanes: int = 1) -> DataFrame:
    """queries: query_type ('doi' or 'title'), query_value. The same with payload (JSON, null: no match) and error, each once."""
    ask, rate = SERVICES[provider], settings.requests_per_second / lanes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(rate)
        for b in batches:
            out = []
            for kind, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pace.wait()
                try:
                    out.append((ask(send, settings, kind, value), None))
                except Exception as e:  # noqa: BLE001  whatever the transport raises belongs to its request
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([o[k] for o in out], pa.string()) for k in (0, 1))], names=["query_type", "query_value", "payload", "error"])

    once = queries.select("query_type", "query_value").where("query_value <> ''").distinct().repartition(lanes)
    return once.mapInArrow(run, "query_type string, query_value string, payload string, error string")


# -- embeddings and judgements -----------------------------------------------------------------------------------------


def embedder(send: Transport, settings, lanes: int = 1, batch: int = 32) -> Callable[[DataFrame, str], DataFrame]:
    """A function (rows, text column) -> rows with ``embedding``: both services' wire formats, ``batch`` texts a request."""

    def ask(texts: list[str]) -> list[list[float]]:
        if settings.provider == "openai":
            status, text = send("POST", settings.base_url.rstrip("/") + "/embeddings", {}, {"model": settings.model, "input": texts})
            pick = lambda d: [x["embedding"] for x in sorted(d["data"], key=lambda x: x.get("index", 0))]
        else:
            status, text = send("POST", settings.base_url.rstrip("/") + "/api/embed", {}, {"model": settings.model, "input": texts})
            pick = lambda d: d["embeddings"]
        if status >= 400:
            raise OSError(f"status {status}")
        found = pick(json.loads(text))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} embeddings for {len(texts)} texts")
        return found

    def embed(rows: DataFrame, text: str = "text") -> DataFrame:
        schema = StructType([*rows.drop("embedding").schema.fields, *StructType.fromDDL("embedding array<float>").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, at = b.column(b.num_columns - 1).to_pylist(), b.slice(0)
                found = [v for k in range(0, len(own), batch) for v in ask([t or "" for t in own[k : k + batch]])]
                yield pa.RecordBatch.from_arrays([*at.columns[:-1], pa.array(found, pa.list_(pa.float32()))], schema=pa.schema([*list(b.schema)[:-1], pa.field("embedding", pa.list_(pa.float32()))]))

        sent = rows.drop("embedding").withColumn("__text", F.col(text))
        return (sent.repartition(lanes) if lanes > 1 else sent).mapInArrow(run, schema)

    return embed


def judge(send: Transport, settings) -> Callable[[DataFrame, str], DataFrame]:
    """A function (rows with text, query) -> rows with rerank_score. A pair whose request fails scores 0."""
    from ..operators import fusion

    def score(rows: DataFrame, query: str) -> DataFrame:
        asked = rows.withColumn("__prompt", fusion.prompt(settings.instruction, F.lit(query), F.col("text")))
        schema = StructType([*rows.schema.fields, *StructType.fromDDL("__top array<struct<token:string,logprob:double>>, __answer string, __failed boolean").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for prompt in b.column(b.num_columns - 1).to_pylist():
                    body = {"model": settings.model, "prompt": prompt, "raw": True, "stream": False, "logprobs": True, "top_logprobs": settings.top_logprobs, "options": {"num_predict": 1, "temperature": 0}}
                    try:
                        status, text = send("POST", settings.base_url.rstrip("/") + "/api/generate", {}, body)
                        if status >= 400:
                            raise OSError(f"status {status}")
                        found = json.loads(text)
                        first = (found.get("logprobs") or [{}])[0]
                        top = [{"token": str(t.get("token") or ""), "logprob": float(t["logprob"]) if isinstance(t.get("logprob"), (int, float)) else None} for t in first.get("top_logprobs") or []]
                        out.append((top, found.get("response"), False))
                    except Exception:  # noqa: BLE001  one pair degrades, the others go on
                        out.append((None, None, True))
                kinds = (pa.list_(pa.struct([("token", pa.string()), ("logprob", pa.float64())])), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], names=[*b.schema.names[:-1], "__top", "__answer", "__failed"])

        found = asked.mapInArrow(run, schema)
        return found.withColumn("rerank_score", F.when(F.col("__failed"), 0.0).otherwise(fusion.judge_score(F.col("__top"), F.col("__answer")))).drop("__top", "__answer", "__failed")

    return score
