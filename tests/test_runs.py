"""Runs over files with readers and transports of their own: counters, manifest, failures, cache, reports."""

import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lectern import cli, config, runs, service
from lectern.sources import files, pdf, providers
from lectern.sources.snapshots import Conflict, SnapshotTable


def reader(content):
    """A file of test text: its first line may ask for a failure."""
    text = content.decode()
    if text.startswith("BROKEN"):
        raise OSError("no pages")
    return text, 1, {"title": text.split("\n")[0], "author": "Ann Author"}


@pytest.fixture
def lib(spark, tmp_path):
    root = tmp_path / "papers"
    for name, text in {"a.pdf": "Apples and pears in spring\nabout apples", "sub/b.PDF": "Plums of the late summer\nabout plums", "sub/c.pdf": "BROKEN", "skip/d.pdf": "Marked paper text here", "e.pdf": " \n", "n.txt": "no paper"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "skip/.skip-index").write_text("")
    s = config.Settings(data_dir=str(tmp_path / "data"), papers=[config.Root([str(root), str(tmp_path / "missing")], ".skip-index", ["t"])])
    return service.Library(spark, s)


def test_index_run(lib, spark, tmp_path):
    root, run = tmp_path / "papers", lambda **k: runs.index(lib, reader=reader, **k)
    plans, dirs = [], []
    assert run(confirm_plan=lambda p: plans.append(p), confirm_markers=lambda d: dirs.append(d) or True)["indexed"] == 0
    assert [(p["root_path"], p["files"]) for p in plans[0]] == [(str(root), 4)] and dirs == [[str(root / "skip")]]
    assert run() == {"indexed": 2, "skipped": 2, "chunks": 2, "duplicates": 0, "enriched": 0, "failed_metadata": 0}
    log = lib.settings.indexing.failed_path
    assert [r.file for r in files.failures(spark, log).collect()] == [str(root / "sub/c.pdf")]
    rows = {r.file_name: r for r in lib.chunks.read().collect()}
    assert rows["a.pdf"].title == "Apples and pears in spring" and rows["a.pdf"].tags == ["t"] and rows["a.pdf"].authors == ["Ann Author"]
    assert run()["indexed"] == 0 and run(only_new=True)["indexed"] == 0  # the broken and the empty file are tried again
    (root / "a.pdf").write_text("Apples and pears in autumn\nmore")
    (root / "sub/c.pdf").write_text("Cherries at last\ntext")
    assert run(retry_failed=True)["indexed"] == 1 and files.failures(spark, log).count() == 0
    assert run(max_files=1)["indexed"] == 1 and lib.chunks.count() == 3
    assert {r.title for r in lib.chunks.read().collect()} == {"Apples and pears in autumn", "Plums of the late summer", "Cherries at last"}
    assert run(file=str(root / "sub/b.PDF"), force=True)["indexed"] == 1 and run(force=True)["indexed"] == 3 and lib.chunks.count() == 3
    seqs = [r.seq for r in lib.chunks.read().collect()]
    assert len(set(seqs)) == 3 and len({r.seq for r in runs.manifest(lib).read().collect()}) == 3
    assert [r["paper"] for r in lib.delete("Cherries")] == [str(root / "sub/c.pdf")] and run()["indexed"] == 1
    with pytest.raises(FileNotFoundError):
        run(file=str(root / "none.pdf"))
    with pytest.raises(ValueError):
        run(file=str(root / "n.txt"))
    lib.settings.papers = [config.Root(str(tmp_path / "missing"))]
    with pytest.raises(FileNotFoundError):
        run()


def test_refresh_run(lib, tmp_path):
    assert runs.refresh(lib) == {"papers": 0, "chunks": 0, "skipped": 0}
    runs.index(lib, reader=reader)
    (tmp_path / "data").mkdir(exist_ok=True)
    (tmp_path / "data/paper_metadata.json").write_text(json.dumps({"a.pdf": {"title": "A New Title", "year": 1999, "authors": "X Y, Z"}, "b.PDF": {"title": "Not Mine", "source_path": "/else/b.PDF"}}))
    assert runs.refresh(lib) == {"papers": 1, "chunks": 1, "skipped": 1}
    row = lib.get_chunk(lib.show_paper("a.pdf")[0]["chunk_ids"][0])
    assert (row["title"], row["year"], row["authors"]) == ("A New Title", 1999, ["X Y", "Z"])


def test_dedupe_run(lib, tmp_path):
    root = tmp_path / "papers"
    (root / "copy.pdf").write_text((root / "a.pdf").read_text())
    (root / "doi.pdf").write_text("Quite another paper\nx")
    (tmp_path / "data").mkdir(exist_ok=True)
    (tmp_path / "data/paper_metadata.json").write_text(json.dumps({"doi.pdf": {"doi": "10.1/x"}, "sub/none.pdf": {"doi": "10.1/x"}, "b.PDF": {"doi": "10.1/X"}}))
    done = runs.dedupe(lib, reader=reader)
    pairs = {(json.loads(x)["source_path"].split("/")[-1], json.loads(x)["duplicate_path"].split("/")[-1], json.loads(x)["reason"]) for f in (tmp_path / "data/logs/duplicate_papers.json/pairs").glob("*.json") for x in f.read_text().splitlines()}
    assert ("a.pdf", "copy.pdf", "semantic") in pairs and ("doi.pdf", "b.PDF", "doi") in pairs and done["checked"] == 6 and done["pairs"] == len(pairs)
    assert runs.dedupe(lib, file=str(root / "copy.pdf"), reader=reader)["pairs"] == 1 and runs.dedupe(lib, max_files=1, reader=reader)["pairs"] == 0
    lib.settings.dedup.enabled, lib.settings.dedup.action = True, "skip"
    run = runs.index(lib, reader=reader)
    assert run["duplicates"] == 2 and run["indexed"] == 2 and {r.file_name for r in lib.chunks.read().collect()} == {"a.pdf", "doi.pdf"}


# -- enrichment --------------------------------------------------------------------------------------------------------

CROSSREF = {"DOI": "10.1/apples", "title": ["Apples and Pears in Spring"], "author": [{"given": "Ada", "family": "B"}], "issued": {"date-parts": [[2019]]}, "score": 50.0, "publisher": "P"}
OPENALEX = {"doi": "https://doi.org/10.2/plums", "id": "https://openalex.org/W2", "display_name": "Plums of the late summer", "publication_year": 2020, "abstract_inverted_index": {"All": [0], "plums": [1]}, "relevance_score": 9.0}


class Service:
    """Answers by title; counts what was asked (in the tasks' own processes, so by a file)."""

    def __init__(self, log):
        self.log = str(log)

    def __call__(self, method, url, parameters, body):
        with open(self.log, "a") as f:
            f.write(json.dumps([url, parameters]) + "\n")
        asked = parameters.get("query.bibliographic") or parameters.get("search") or ""
        if "broken" in asked.lower():
            raise TimeoutError("late")
        if "openalex" in url:
            hit = "plums" in asked.lower() or "10.2/plums" in parameters.get("filter", "")
            return 200, json.dumps({"results": [OPENALEX] if hit else []})
        if "/works/" in url:
            return (200, json.dumps({"message": CROSSREF})) if url.endswith("10.1%2Fapples") else (404, "")
        item = CROSSREF if "apples" in asked.lower() else {"DOI": "10.9/other", "title": ["Something else entirely"], "score": 99.0}
        return 200, json.dumps({"message": {"items": [item]}})

    def asked(self):
        try:
            return [json.loads(x) for x in open(self.log)]
        except FileNotFoundError:
            return []


def test_enrichment_run(lib, tmp_path):
    lib.settings.metadata_enrichment.requests_per_second = 1000.0
    (tmp_path / "papers/f.pdf").write_text("Broken services are no match\nx")
    send = Service(tmp_path / "asked")
    lib.settings.metadata_enrichment.timing = "manual"
    assert runs.index(lib, reader=reader, transport=send)["enriched"] == 0 and send.asked() == []
    done = runs.enrich_files(lib, send, reader=reader)
    assert done == {"checked": 4, "updated": 2, "cleared": 0, "skipped": 1, "failed": 1}  # the empty file has no title to ask for
    said = json.loads((tmp_path / "data/paper_metadata.json").read_text())
    a, b = said[str(tmp_path / "papers/a.pdf")], said[str(tmp_path / "papers/sub/b.PDF")]
    assert (a["doi"], a["year"], a["authors"], a["metadata_source"]) == ("10.1/apples", 2019, ["Ada B"], "crossref")
    assert (b["doi"], b["openalex_id"], b["abstract"], b["metadata_source"]) == ("10.2/plums", "https://openalex.org/W2", "All plums", "openalex")
    rows = lib.chunks.read()
    assert rows.where("chunk_type = 'abstract'").select("text").collect() == [("Plums of the late summer\n\nAll plums",)]
    assert {r.doi for r in rows.collect()} == {"10.1/apples", "10.2/plums", None} and rows.select("seq").distinct().count() == rows.count()
    assert "10.1/apples" in runs.cache_get(lib, "crossref", "title", "apples and pears in spring") and runs.cache_get(lib, "crossref", "doi", "10.1/apples") is None
    n = len(send.asked())
    assert runs.enrich_files(lib, send, reader=reader, max_files=1) == {"checked": 1, "updated": 0, "cleared": 0, "skipped": 1, "failed": 0} and len(send.asked()) == n
    # checked again: a stored DOI whose work has another title goes; the cache answers for the right one
    said[str(tmp_path / "papers/a.pdf")] |= {"doi": "10.9/wrong", "title": "Wrong"}
    said[str(tmp_path / "papers/e.pdf")] = {"doi": "10.9/gone", "title": "Gone", "note": "kept?"}
    (tmp_path / "papers/e.pdf").write_text("Nobody knows this paper at all\nx")
    (tmp_path / "data/paper_metadata.json").write_text(json.dumps(said))
    done = runs.enrich_files(lib, send, reader=reader, reverify=True)
    assert (done["updated"], done["cleared"], done["failed"]) == (2, 1, 1)
    said = json.loads((tmp_path / "data/paper_metadata.json").read_text())
    assert said[str(tmp_path / "papers/a.pdf")]["doi"] == "10.1/apples" and "doi" not in said[str(tmp_path / "papers/e.pdf")]
    with pytest.raises(LookupError):
        runs.enrich_files(lib, send, file=str(tmp_path / "papers/sub/c.pdf"), reader=reader)


def test_enrichment_in_index(lib, tmp_path):
    lib.settings.metadata_enrichment.requests_per_second = 1000.0
    done = runs.index(lib, reader=reader, transport=Service(tmp_path / "asked"))
    assert (done["indexed"], done["enriched"], done["failed_metadata"]) == (2, 2, 0)


def test_lookup(spark, tmp_path):
    send, s = Service(tmp_path / "asked"), config.Enrichment(requests_per_second=1000.0, mailto="me@x.org", min_title_score=60.0)
    asked = spark.createDataFrame([("doi", "10.1/apples"), ("doi", "10.1/none"), ("title", "apples"), ("title", "apples"), ("title", "broken"), ("title", "")], "query_type string, query_value string")
    got = {(r.query_type, r.query_value): (r.payload is not None, r.error) for r in providers.lookup(asked, "crossref", send, s).collect()}
    assert got == {("doi", "10.1/apples"): (True, None), ("doi", "10.1/none"): (False, None), ("title", "apples"): (False, None), ("title", "broken"): (False, "TimeoutError: late")}
    assert all(p.get("mailto") == "me@x.org" for _, p in send.asked()) and len(send.asked()) == 4
    waits = []
    clock = iter([0.0, 0.0, 0.1, 0.5, 2.0, 2.0])
    pace = providers.Pace(2.0, lambda: next(clock), waits.append)
    for _ in range(3):
        pace.wait()
    assert waits == [pytest.approx(0.4)]


def test_embedder_and_judge(spark):
    def send(method, url, parameters, body):
        if url.endswith("/api/embed"):
            return 200, json.dumps({"embeddings": [[float(len(t)), 1.0] for t in body["input"]]})
        if url.endswith("/embeddings"):
            return 200, json.dumps({"data": [{"index": k, "embedding": [float(len(t))]} for k, t in reversed(list(enumerate(body["input"])))]})
        if "bad" in body["prompt"]:
            return 500, ""
        return 200, json.dumps({"response": "no", "logprobs": [{"top_logprobs": [{"token": "Yes", "logprob": -0.1}, {"token": "no", "logprob": -2.0}]}] if "good" in body["prompt"] else []})

    rows = spark.createDataFrame([(1, "a"), (2, "bcd"), (3, None)], "seq long, text string")
    for provider, want in (("ollama", [[1.0, 1.0], [3.0, 1.0], [0.0, 1.0]]), ("openai", [[1.0], [3.0], [0.0]])):
        got = providers.embedder(send, config.Embedding(provider=provider, model="m"), batch=2)(rows, "text").orderBy("seq").collect()
        assert [list(r.embedding) for r in got] == want and got[1].text == "bcd"
    score = providers.judge(send, config.Reranker(model="m"))
    got = {r.text: round(r.rerank_score, 4) for r in score(spark.createDataFrame([(1, "good"), (2, "bad"), (3, "plain")], "seq long, text string"), "query").collect()}
    assert got == {"good": 0.8699, "bad": 0.0, "plain": 0.0}


def test_reranked_search(lib, spark):
    runs.index(lib, reader=reader)
    lib.settings.reranker.enabled = True
    lib.judge = lambda rows, query: rows.withColumn("rerank_score", F.when(F.col("text").contains("plums"), 0.9).otherwise(0.1))
    assert [r["file_name"] for r in lib.search("apples")] == ["b.PDF", "a.pdf"]
    lib.judge = lambda rows, query: 1 / 0
    assert lib.search("apples", 1)[0]["file_name"] == "a.pdf"


# -- tables, PDF files, settings, server -------------------------------------------------------------------------------


def test_snapshot_writers(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), buckets=8)
    row = lambda *ids, v="x": spark.createDataFrame([(i, v) for i in ids], "chunk_id string, text string")
    t.upsert(row(*"abcdefghijklmnop"))
    kept = t._current(1)
    assert t.upsert(row("a", v="y")) == 2
    assert sum(t._current(2)[b] != w for b, w in kept.items()) == 1  # one bucket was written
    before = t.version()
    t.upsert(row("b", v="z"))
    with pytest.raises(Conflict):
        t._write(row("c", v="lost"), before, t._current(before), list(range(8)))
    assert t.count() == 16 and {r.chunk_id: r.text for r in t.read().collect()}["b"] == "z"
    for k in range(4):
        t.upsert(row("a", v=str(k)))
    names = {f.name for f in (tmp_path / "t").iterdir()}
    used = {w for n in t._numbers() for w in t._current(n).values()}
    assert len(t._numbers()) == 2 and {n for n in names if n.startswith("w-")} == used
    t.upsert(spark.createDataFrame([("q", "new", 5)], "chunk_id string, text string, more int"))
    assert t.get("q")["more"] == 5 and t.count() == 17
    t.delete(F.lit(True))
    assert t.count() == 0 and t.read().columns[0] == "chunk_id" and t.upsert(row("z")) and t.count() == 1


def test_pdf_reader():
    import zlib

    stream = b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ T* (caf\\351) ' ET"
    packed = zlib.compress(b"BT (second page) Tj ET")
    body = b"%PDF-1.4\n1 0 obj <</Type /Pages>> endobj\n2 0 obj <</Type /Page>> endobj\n3 0 obj <</Type/Page>> endobj\n4 0 obj <</Length 1>>\nstream\n" + stream + b"\nendstream endobj\n5 0 obj <</Filter /FlateDecode>>\nstream\n" + packed + b"\nendstream\n6 0 obj <</Title (A Title) /Author (Ann)>> endobj"
    text, pages, info = pdf.read(body)
    assert text == "[Page 1]\nHello (PDF)\nworld\ncafé\n\n[Page 2]\nsecond page" and pages == 2 and info == {"title": "A Title", "author": "Ann"}
    for bad in (b"text", b"%PDF-1.4 /Encrypt"):
        with pytest.raises(ValueError):
            pdf.read(bad)


@pytest.mark.parametrize("value", [{"retrieval": {"fusion": "best"}}, {"indexing": {"chunk_overlap": 1200}}, {"metadata_enrichment": {"requests_per_second": 0}}, {"metadata_enrichment": {"min_title_similarity": 1.5}}, {"metadata_enrichment": {"providers": ["x"]}}, {"dedup": {"action": "drop"}}, {"service": {"transport": "smoke"}}, {"reranker": {"top_k": 0}}, {"embedding": {"provider": "x"}}])
def test_settings_refused(value, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(value))
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"))


def test_settings_migrated(tmp_path):
    def load(value):
        (tmp_path / "c.json").write_text(json.dumps(value))
        return config.load(str(tmp_path / "c.json"))

    assert load({"papers": "/p"}).papers[0].paths() == ["/p"]
    assert [(r.root_path, r.tags) for r in load({"papers": {"pdf_dir": "/a", "zetro_database_dir": "/b", "tags": ["x"]}}).papers] == [("/a", ["x"]), ("/b", ["x"])]
    assert load({"papers": [{"pdf_dir": "/c"}, {"path": "/d"}]}).papers[1].paths() == ["/d"] and load({"papers": {"roots": [{"root_path": "/r"}]}}).papers[0].paths() == ["/r"]
    assert load({"metadata_enrichment": {"provider": "openalex"}}).metadata_enrichment.providers == ["openalex", "crossref"]
    assert load({"metadata_enrichment": {"providers": "openalex"}}).metadata_enrichment.providers == ["openalex"]
    d = config.Settings()
    assert (d.metadata_enrichment.min_title_similarity, d.dedup.enabled, d.dedup.semantic_enabled, d.indexing.chunk_size) == (0.6, False, True, 1200)


def test_display():
    assert cli.shown_time("2026-06-28T10:00:00Z", "Asia/Shanghai", "%Y-%m-%d %H:%M:%S %Z") == "2026-06-28 18:00:00 CST"
    assert cli.shown_time("2026-06-28T10:00:00", "UTC") == "2026-06-28 10:00:00+00:00" and cli.shown_time("soon") == "soon" and cli.shown_time(None) == ""
    shown = cli.detail({"title": "A", "chunk_ids": ["c0", "c1"], "hidden_chunks": 2, "metadata_enriched_at": "2026-06-28T10:00:00Z", "doi": None}, config.Display("UTC", "%Y"))
    assert shown == "title: A\nchunk_ids:\n  c0\n  c1\n  ... 2 more hidden\nmetadata_enriched_at: 2026"


def test_served(lib):
    runs.index(lib, reader=reader)
    with ThreadingHTTPServer(("127.0.0.1", 0), cli.handler(lib)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        ask = lambda body: json.loads(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/", body.encode()), timeout=60).read())
        assert ask('{"tool": "info"}')["result"]["chunks"] == 2 and "error" in ask('{"tool": "drop"}')
        with pytest.raises(urllib.error.HTTPError):
            ask("{")
        server.shutdown()


def test_command_line(lib, tmp_path, capsys, monkeypatch):
    path = tmp_path / "config.json"
    s = lib.settings
    path.write_text(json.dumps({"data_dir": s.data_dir, "papers": [{"root_path": s.papers[0].root_path, "skip_marker_file": ".skip-index"}], "metadata_enrichment": {"requests_per_second": 1000}}))
    run = lambda *a: (cli.main([*a, "--config", str(path)], Service(tmp_path / "asked")), capsys.readouterr().out)
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert json.loads(run("index", "--reader", "tests.test_runs:reader")[1])["indexed"] == 0
    assert json.loads(run("index", "--yes", "--reader", "tests.test_runs:reader", "--max-files", "9")[1])["enriched"] == 2
    assert "10.1/apples" in run("show-paper", "a.pdf")[1] and run("show-paper", "nothing")[0] == 1
    assert json.loads(run("index", "--update-metadata-only")[1])["papers"] == 2
    assert json.loads(run("enrich-metadata", "--yes", "--reader", "tests.test_runs:reader")[1])["skipped"] >= 2
    assert json.loads(run("dedupe-papers", "--reader", "tests.test_runs:reader")[1])["checked"] == 4
    assert json.loads(run("build-citation-graph")[1])["nodes"] == 2 and "Apples" in run("search", "apples", "--top-k", "1")[1]
    assert run("delete-paper", "a.pdf")[0] == 1 and len(json.loads(run("delete-paper", "a.pdf", "--yes")[1])) == 1 and len(json.loads(run("list-papers")[1])) == 1
