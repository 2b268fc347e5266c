"""Functions, sources, tables and the service on small rows."""

import json
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern import cli, config, service
from lectern.functions import text as T
from lectern.functions import titles
from lectern.operators import chunking, citations, dedup, enrich, fusion, indexing, library, vector
from lectern.sources import files
from lectern.sources.snapshots import SnapshotTable
from lectern.streaming import ingest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("text, tokens", [("Größe 深度学习 v1.2 foo_bar-baz", ["größe", "深", "度", "学", "习", "v1", "2", "foo_bar", "baz"]), ("", []), (None, [])])
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokenize(F.lit(text).cast("string"))) == tokens


def test_dois(spark):
    assert one(spark, T.extract_doi(F.lit("DOI: 10.1145/3368089.3409702."))) == "10.1145/3368089.3409702"
    assert one(spark, T.doi_bare(F.lit(" http://dx.doi.org/10.1/Ab). "))) == "10.1/Ab"
    assert one(spark, T.doi_key(F.lit("https://doi.org/DOI:10.1/Ab"))) == "10.1/ab"
    assert one(spark, T.extract_doi(F.lit("none"))) is None


@pytest.mark.parametrize("title, good", [("A Useful Paper", True), ("ab", False), ("x" * 261, False), ("see www.spam.com now", False), ("best SEO tricks", False), ("a %%% *** ###", False), ("深度学习", True), ("12345", False), (None, False)])
def test_trusted_title(spark, title, good):
    assert one(spark, titles.trusted(F.lit(title).cast("string"))) is good


def test_file_names(spark):
    p = one(spark, titles.file_name_parts(F.lit("A et al. - 2019 - T - sub.pdf")))
    assert (p.title, p.year) == ("T - sub", 2019)
    p = one(spark, titles.file_name_parts(F.lit("A - n.d. - T.pdf")))
    assert (p.title, p.year) == ("", None)
    assert one(spark, titles.from_file_name(F.lit("/x/my_good-paper.v2.pdf"))) == "my good paper.v2"
    assert one(spark, titles.pick_line(F.lit("[Page 1]\nAbstract\nIntroduction:\nA Title That Is Long Enough\nmore"), F.lit("f.pdf"))) == "A Title That Is Long Enough"
    assert one(spark, titles.infer(F.lit("Metadata Title"), F.lit("Another line of text"), F.lit("f.pdf"))) == "Metadata Title"


def test_times(spark):
    assert one(spark, T.shown_time(F.lit("2026-06-28T10:00:00Z"), "Asia/Shanghai")) == "2026-06-28 18:00:00"
    assert one(spark, T.shown_time(F.lit("2026-06-28T10:00:00"))) == "2026-06-28 10:00:00"


def test_cosine(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vector.cosine(a(1, 0), a(1, 0))) == 1.0
    assert one(spark, vector.cosine(a(1, 0), a(0, 1))) == 0.0
    assert one(spark, vector.cosine(a(1, 0), a(1))) == one(spark, vector.cosine(a(0, 0), a(1, 0))) == 0.0


def test_title_similarity(spark):
    a, b = "Attention is all you need", "Attention Is All You Need: a study"
    x, y = "attention is all you need", "attention is all you need a study"
    assert abs(one(spark, enrich.title_similarity(F.lit(a), F.lit(b))) - max(SequenceMatcher(None, x, y).ratio(), 5 / 7)) < 1e-12
    assert one(spark, enrich.title_similarity(F.lit(""), F.lit(b))) == 0


def test_parsers(spark):
    crossref = {"DOI": "10.1/x", "title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2020, 1]]}, "reference": [{"DOI": "doi:10.2/z"}, {"DOI": "10.2/a"}, {"key": "k"}]}
    openalex = {"doi": "https://doi.org/10.3/y", "id": "W1", "display_name": "U", "authorships": [{"author": {"display_name": "D"}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "referenced_works": ["W2"], "cited_by_count": 4}
    df = spark.createDataFrame([(1, json.dumps(crossref)), (2, "{}"), (3, "no json")], "k int, payload string")
    w = {r.k: r.work for r in enrich.parse_crossref(df).collect()}
    assert w[2] is None and w[3] is None
    assert (w[1].doi, w[1].title, w[1].authors, w[1].year, w[1].referenced_dois) == ("10.1/x", "T", ["A B", "C"], 2020, ["10.2/a", "10.2/z"])
    w = enrich.parse_openalex(spark.createDataFrame([(1, json.dumps(openalex))], "k int, payload string")).first().work
    assert (w.doi, w.abstract, w.referenced_work_ids, w.cited_by_count, w.authors) == ("10.3/y", "a b a", ["W2"], 4, ["D"])


def test_duplicates_are_stars(spark):
    rows = spark.createDataFrame([(1, "10.1/A", "X", 2000), (2, "10.1/a ", "X", 2000), (3, "10.1/a", "X", 2000), (4, None, "X", 2000), (5, None, " x", 2000), (6, "", "X", None)], "seq long, doi string, title string, year int")
    pairs = lambda df: sorted((r.left, r.right) for r in df.collect())
    assert pairs(dedup.by_doi(rows)) == [(1, 2), (1, 3)] and pairs(dedup.by_title_year(rows)) == [(4, 5)]
    both = dedup.unique_pairs(dedup.by_doi(rows), dedup.by_doi(rows).withColumn("reason", F.lit("semantic")))
    assert {r.reason for r in both.collect()} == {"doi"} and both.count() == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "seq long, embedding array<double>")
    assert pairs(dedup.semantic(v, 0.9)) == [(1, 2)]


def test_graph(spark):
    rows = spark.createDataFrame([(1, "/a.pdf", "A", "10.1000/a", ["10.1000/b", "10.1000/external", "10.1000/a"]), (2, "/b.pdf", "B", "10.1000/b", None)], "seq long, source_path string, title string, doi string, referenced_dois array<string>")
    rows = rows.withColumns({"openalex_id": F.lit(None).cast("string"), "referenced_work_ids": F.array().cast("array<string>"), "year": F.lit(2000), "cited_by_count": F.lit(1), "file_name": F.lit("f")})
    assert citations.nodes(rows).count() == 3 and citations.edges(rows).count() == 2 and citations.edges(rows, False).count() == 1
    v = citations.view(rows, 1)
    assert v["outgoing"]["local_count"] == 1 and v["outgoing"]["external_sample"] == ["10.1000/external"] and v["incoming_count"] == 0
    assert citations.view(rows, 2)["incoming_count"] == 1


def test_groups_of_papers(spark):
    rows = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "c", "p"), (4, "d", None)], "rank int, chunk_id string, source_path string")
    got = [(r["rank"], r.chunk_id, r.pool_chunk_count, r.other_chunk_ids) for r in fusion.group_by_paper(rows, 3).orderBy("rank").collect()]
    assert got == [(1, "a", 2, ["c"]), (2, "b", 1, []), (3, "d", 1, [])]


def test_indexing(spark):
    f = spark.createDataFrame([("/r/a/1.pdf", 1, 5, 1, "x"), ("/r/a/2.pdf", 2, 5, 2, "y"), ("/r/b/3.pdf", 3, 5, 1, "z")], "path string, seq long, size long, mtime long, digest string").withColumn("root_path", F.lit("/r"))
    m = spark.createDataFrame([("/r/a/1.pdf", 5, 1, "wrong", 1), ("/r/a/2.pdf", 5, 1, "y", 1)], "path string, size long, mtime long, digest string, chunk_count int")
    why = lambda **k: [r.reason for r in indexing.targets(f, m, **k).orderBy("seq").collect()]
    assert why() == ["same_stat", "same_content", "new"] and why(force=True) == ["forced", "forced", "new"] and why(only_new=True, force=True) == ["known", "known", "new"]
    assert why(force=True, max_files=2) == ["forced", "forced", "over_limit"]
    hits = spark.createDataFrame([("/r/a",)], "dir string")
    assert [r.path for r in indexing.without_marked(f, hits).collect()] == ["/r/b/3.pdf"] and indexing.marker_hits(f, hits).count() == 1


def test_files(spark, tmp_path):
    for name in ("a/x.pdf", "a/y.PDF", "b/z.pdf", "b/.skip", "b/no.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-1.4\n")
    got = files.listing(spark, str(tmp_path), ("t",), content=True)
    assert got.count() == 3 and got.select("digest").distinct().count() == 1
    assert [r.dir for r in files.markers(spark, str(tmp_path), ".skip").collect()] == [str(tmp_path / "b")] == files.marked_parents(spark, str(tmp_path / "b/z.pdf"), [str(tmp_path)], ".skip")
    out = files.extract(got, lambda c: (files.paged(["one", " ", "two"]), 3) if c else (1 / 0, 0)).collect()
    assert {r.text for r in out} == {"[Page 1]\none\n\n[Page 3]\ntwo"}
    assert files.extract(got, lambda c: 1 / 0).where("error like 'ZeroDivisionError%'").count() == 3
    with pytest.raises(ValueError):
        files.one_file(spark, "x.txt")
    (tmp_path / "m.json").write_text(json.dumps({"x.pdf": {"title": "X"}, "z.pdf": {"title": "Z", "source_path": "/other/z.pdf"}}))
    found = {r.path.split("/")[-1]: r.t for r in files.resolve_metadata(got, files.metadata_json(spark, str(tmp_path / "m.json"))).select("path", F.try_variant_get("value", "$.title", "string").alias("t")).collect()}
    assert found == {"x.pdf": "X", "y.PDF": None, "z.pdf": None}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.metadata_json(spark, str(tmp_path / "l.json"))


def test_failures(spark, tmp_path):
    log = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([("t", "/a.pdf", "E", "x")], files.FAILURE), log)
    files.append_log(spark.createDataFrame([("t", "/b.pdf", "E", "x")], files.FAILURE), log)
    assert sorted(r.file for r in files.failures(spark, log).collect()) == ["/a.pdf", "/b.pdf"]
    assert files.without_failure(spark.read.text(log), "/a.pdf").count() == 1


def test_chunks(spark):
    d = spark.createDataFrame([(" ".join(f"w{k}" for k in range(25)), "/p"), ("", "/q"), (None, "/r"), ("a b", "/s")], "text string, source_path string")
    got = chunking.by_words(d, 10, 3).where("source_path = '/p'").orderBy("chunk_index").collect()
    assert [len(r.chunk_text.split()) for r in got] == [10, 10, 10, 4] and got[1].chunk_text.split()[0] == "w7" and got[0].chunk_count == 4
    assert chunking.by_words(d, 10, 3).where("source_path <> '/p'").count() == 1
    with pytest.raises(ValueError):
        chunking.by_words(d, 3, 3)


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.count() == 0
    t.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "chunk_id string, seq int, text string"))
    assert t.upsert(spark.createDataFrame([("b", 2, "z")], "chunk_id string, seq int, text string")) == 2
    assert t.get("b")["text"] == "z" and t.get("q") is None and [r.seq for r in t.page(offset=1).collect()] == [2]
    t.delete_ids(["a"])
    assert t.count() == 1 and t.delete_ids([]) == 3


def test_streaming(spark, tmp_path):
    schema = "chunk_id string, seq int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(str(tmp_path / "in"), mode="append")
    t = SnapshotTable(spark, str(tmp_path / "t"))
    for want in (2, 3):
        ingest.ingest(spark, str(tmp_path / "in"), schema, t, str(tmp_path / "ck")).awaitTermination()
        assert t.count() == want
        spark.createDataFrame([("c", 3)], schema).write.parquet(str(tmp_path / "in"), mode="append")


def test_service(spark, tmp_path):
    s = config.Settings(data_dir=str(tmp_path))
    lib = service.Library(spark, s)
    with pytest.raises(LookupError):
        lib.list_papers()
    rows = [(k, f"/p/{k}.pdf", f"{k}.pdf", f"the paper {k} is about {w} and more", f"Paper about {w}", f"10.1/{k}", 2000 + k, ["Ann"], ["x"], None, [f"10.1/{k + 1}"], None, k) for k, w in enumerate(["apples", "pears", "plums", "apples"])]
    papers = spark.createDataFrame(rows, "seq long, source_path string, file_name string, text string, title string, doi string, year int, authors array<string>, tags array<string>, openalex_id string, referenced_dois array<string>, referenced_work_ids array<string>, cited_by_count int")
    lib.add_papers(papers)
    lib.add_papers(papers)
    found = lib.search("pears", 2)
    assert found[0]["title"] == "Paper about pears" and "source_path" not in found[0]
    assert all(r["year"] == 2003 for r in lib.search("apples", year=2003)) and lib.search("apples", author="nobody") == []
    assert len(lib.search("apples", 2, group_by_paper=True, max_text_chars=9)) == 2
    assert [p["title"] for p in lib.list_papers(1)] == ["Paper about apples"] and lib.list_papers(1)[0]["paper_count"] == 4
    chunk = lib.show_paper("pears")[0]["chunk_ids"][0]
    assert lib.get_chunk(chunk)["year"] == 2001 and lib.export_context([chunk, "?"]).startswith("## Paper about pears")
    assert lib.citations_of("plums")["incoming_count"] == 1 and lib.citations_of("nothing") is None
    graph = lib.citation_graph()
    text = open(graph["mermaid_path"]).read().split("\n")
    assert text[:2] == ["```mermaid", "graph TD"] and (graph["nodes"], graph["edges"]) == (5, 4) and len(text) == 2 + 5 + 4 + 2
    assert {(r.left, r.right) for r in lib.duplicates().where("reason <> 'semantic'").collect()} == set()
    assert service.call(lib, {"tool": "delete", "arguments": {}}) == {"error": "unknown tool: delete"}
    assert service.call(lib, {"tool": "info"})["result"]["chunks"] == 4
    assert len(lib.search_by_metadata(tag="X")) == 4 and lib.has_paper("/p/1.pdf")
    lib.refresh(spark.createDataFrame([("/p/1.pdf", "Renamed")], "source_path string, title string"), ("title",))
    assert [r["paper"] for r in lib.delete("Renamed")] == ["/p/1.pdf"] and lib.chunks.count() == 3


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert cli.main(["init-config", "--path", path]) == 0
    assert config.load(path) == config.Settings()
    with pytest.raises(FileExistsError):
        config.write_default(path)
    (tmp_path / "d.json").write_text(json.dumps({"data_dir": "/d/", "papers": [{"root_path": ["/a", "/b"], "tags": ["t"]}], "retrieval": {"fusion": "linear"}}))
    s = config.load(str(tmp_path / "d.json"))
    assert s.papers[0].paths() == ["/a", "/b"] and s.retrieval.fusion == "linear" and s.indexing.metadata_path == "/d/paper_metadata.json"
    (tmp_path / "e.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "e.json"))
    assert library.pushed() is None


def packed(text, size, overlap):
    """Brute force: whole sentences up to size words, with the last ones again up to overlap."""
    import re

    units = []
    for s in re.split(r"(?<=[.!?])\s+|\n+", text):
        w = s.split()
        units += [w[k : k + size] for k in range(0, len(w), size)]
    out, held = [], []
    for u in units:
        if sum(map(len, held)) + len(u) > size:
            out.append(held)
            back = []
            for x in reversed(held):
                if sum(map(len, back)) + len(x) > min(overlap, size - len(u)):
                    break
                back.insert(0, x)
            held = back
        held = [*held, u]
    return [" ".join(" ".join(u) for u in c) for c in (*out, held) if c]


def test_chunks_of_tokens(spark):
    r = random.Random(3)
    texts = ["", " \n ", "one", "word " * 50, "a b. c d! e f? " * 20, *(" ".join("w" * r.randint(1, 4) + (". " if r.random() < 0.2 else "") for _ in range(r.randint(1, 300))) for _ in range(20))]
    df = spark.createDataFrame([(k, f"/{k}", t) for k, t in enumerate([None, *texts])], "k int, source_path string, text string")
    for size, overlap in ((20, 5), (7, 6), (3, 0)):
        got = {}
        for row in chunking.by_tokens(df, size, overlap).orderBy("k", "chunk_index").collect():
            got.setdefault(row.k, []).append(row.chunk_text)
        assert got == {k: c for k, t in enumerate(["", *texts]) if (c := packed(t, size, overlap))}


def test_chunks_linear(spark):
    def took(n):
        df = spark.createDataFrame([(f"/{n}", "A sentence of some words. " * n)], "source_path string, text string")
        best = []
        for _ in range(3):
            t = time.perf_counter()
            assert chunking.by_sentences(df).count() > 0 and chunking.by_tokens(df).count() > 0
            best.append(time.perf_counter() - t)
        return min(best)

    assert took(16_000) < 2.2 * took(8_000) + 2


def test_near_vectors_of_all_lengths(spark):
    pairs = lambda rows: sorted((r.left, r.right) for r in vector.first_near(spark.createDataFrame(rows, "seq long, embedding array<double>"), 0.9, block=2).collect())
    assert pairs([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])]) == [(1, 2)]
    assert pairs([(1, []), (2, [])]) == [] == pairs([(1, None), (2, [0.0]), (3, [0.0])])
    assert pairs([(1, [1.0]), (2, [2.0]), (3, [None]), (4, [3.0]), (5, [1.0, 1.0]), (6, [1.0, 1.1]), (7, [float("nan")])]) == [(1, 2), (1, 4), (5, 6)]


def test_mermaid_labels(spark):
    rows = spark.createDataFrame([('a\\b "c"\nd', "10.1/X", "W1", "n"), ("", "https://doi.org/10.1/X", "W1", "n"), (None, None, "https://o.org/W1", "n"), (None, None, None, "doi:10.2/y"), (None, None, None, "https://o.org/W2"), (None, " ", "", "path:/a/b.pdf")], "t string, d string, o string, n string")
    got = [r[0] for r in rows.select(citations.mermaid_label(*(F.col(c) for c in "tdon"))).collect()]
    assert got == ['a\\\\b \\"c\\" d', "10.1/x", "W1", "10.2/y", "W2", "path:/a/b.pdf"]


def test_lexical_top(spark, tmp_path):
    """Documents without a shared term fill up, and those whose terms weigh less than nothing come after them."""
    from lectern.operators import lexical

    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, ""), (4, "a c c"), (5, None), (6, "a d")], "seq long, text string")
    index = lexical.write(docs, f"file://{tmp_path}/i")
    top = lambda q, k, **m: [(r.id, r["rank"], round(r.bm25_raw, 4)) for r in lexical.top(index, q, k, **m).orderBy("rank").collect()]
    raw = {t: r for t, r in ((r.term, r.idf) for r in index.terms.collect())}
    assert top("c c", 3)[0][0] == 4 and [x[0] for x in top("c", 3)] == [4, 1, 2] and top("zzz", 2) == [(1, 1, 0.0), (2, 2, 0.0)] and top("", 1) == [(1, 1, 0.0)]
    assert [x[0] for x in top("a", 6)] == ([3, 5, 1, 2, 4, 6] if raw["a"] < 0 else [x[0] for x in top("a", 6)])
    assert [x[0] for x in top("c", 2, candidates=docs, condition=F.col("seq") < 4)] == [1, 2] and top("a", 0) == []
    again = lexical.read(spark, f"file://{tmp_path}/i")
    assert sorted(again.lengths.collect()) == sorted(index.lengths.collect()) and again.lengths.count() == 6
