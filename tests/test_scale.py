"""What moves, is held or is sent must not grow faster than the input; results against brute force."""

import collections
import contextlib
import io
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import lexical, vector
from lectern.sources import files

WORDS = ["ab", "Cd", "ef", "x1", "中文", "zz", "q_r", "ñu"]


def _docs(spark, n=60):
    rows = [(k * 7 % 1000, " ".join(WORDS[(k * j * j + j) % (2 + k % 7)] for j in range(k % 23))) for k in range(n)] + [(5001, None), (5002, "ab ab Ab zz")]
    return spark.createDataFrame(rows, "seq long, text string").repartition(3)


def _plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_like_documents_score_alike_whatever_the_order(spark):  # F1
    words = [("a", 9, 7.5), ("b", 5, 1.2), ("c", 4, 1.4), ("d", 1, 7.0)]
    orders = [(0, 1, 2, 3), (0, 3, 1, 2), (1, 2, 0, 3), (2, 0, 1, 3), (2, 3, 0, 1), (3, 1, 0, 2)]
    postings = spark.createDataFrame([(words[k][0], n, words[k][1], 13) for n, o in enumerate(orders) for k in o], "term string, id long, tf long, dl long").coalesce(1)
    terms = spark.createDataFrame([(t, 1, i) for t, _, i in words], "term string, df long, idf double")
    index = lexical.LexicalIndex(postings, postings.select("id", "dl").distinct(), terms, spark.createDataFrame([(6, 11.3, 1.0)], "n long, avgdl double, mean double"))
    found = lexical.hits(index, "a b c d").collect()
    assert len({r.bm25_raw for r in found}) == 1
    assert [r.id for r in lexical.top(index, "a b c d", 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_postings_are_not_dealt_out(spark):  # F2
    assert "Exchange" not in _plan(lexical.build(_docs(spark).coalesce(1).localCheckpoint()).postings)


@pytest.mark.parametrize("run", [3, 1 << 20])
def test_postings_and_statistics(spark, tmp_path, monkeypatch, run):  # F2, F3, F4, F7
    monkeypatch.setattr(lexical, "RUN_TOKENS", run)
    monkeypatch.setattr(lexical, "BATCH_ROWS", 5)
    docs = _docs(spark)
    index = lexical.write(docs, f"file://{tmp_path}/i")
    from lectern.functions.text import tokenize

    tokens = {r.seq: r.t for r in docs.select("seq", tokenize(F.col("text")).alias("t")).collect()}
    want = sorted((t, i, n, len(ts)) for i, ts in tokens.items() for t, n in collections.Counter(ts).items())
    for one in (index, lexical.read(spark, f"file://{tmp_path}/i")):
        assert sorted((r.term, r.id, r.tf, r.dl) for r in one.postings.collect()) == want
        assert {r.id: r.dl for r in one.lengths.collect()} == {i: len(ts) for i, ts in tokens.items()}
        assert {r.term: r.df for r in one.terms.collect()} == dict(collections.Counter(w[0] for w in want))


def test_an_empty_corpus(spark, tmp_path):
    index = lexical.write(_docs(spark).where("false"), f"file://{tmp_path}/i")
    assert lexical.top(index, "ab", 3).count() == index.terms.count() == index.lengths.count() == 0


@pytest.mark.parametrize("segment, queries", [(3, 2), (8192, 1024)])
def test_best_of_many_queries(spark, tmp_path, monkeypatch, segment, queries):  # F6
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "QUERIES", queries)
    index = lexical.write(_docs(spark), f"file://{tmp_path}/i")
    asked = spark.createDataFrame([("p", "ab ab zz"), ("q", "Cd"), ("r", "nothing like it"), ("s", ""), ("t", "x1 ef ñu 中 ab")], "query_id string, query string")
    want = collections.defaultdict(list)
    for r in lexical.scores(index, asked).collect():
        want[r.query_id].append((-round(r.bm25_raw, 6), r.id))
    got = collections.defaultdict(list)
    for r in lexical.best(index, asked, 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.bm25_raw, r.id))
    assert got == {q: sorted(rows)[:4] for q, rows in want.items()} and len(got) == 3


def test_blocks_do_not_grow_with_the_rows():  # F8, F9
    assert vector.blocks_for(100_000, 64, 4) == vector.blocks_for(1_000_000, 64, 4) == vector.BLOCKS
    n = 50_000_000
    assert n * 64 * 4 / vector.blocks_for(n, 64, 4) <= vector.BLOCK_BYTES


@pytest.mark.parametrize("kind, strip", [("float", 1), ("double", 1 << 20)])
def test_first_near_is_brute_force(spark, monkeypatch, kind, strip):  # F8, F9
    monkeypatch.setattr(vector, "STRIP_BYTES", strip)
    made = np.random.default_rng(3)
    x = made.normal(size=(700, 6)).astype(np.float32 if kind == "float" else np.float64)
    x[300:400] = 2 * x[100:200]
    ids = made.permutation(5000)[:700]
    found = vector.first_near(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], f"seq long, embedding array<{kind}>"), 0.95)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s, want = u @ u.T, {}
    for j in range(700):
        near = [i for i in range(700) if ids[i] < ids[j] and s[i, j] >= 0.95]
        if near:
            i = min(near, key=lambda i: ids[i])
            want[int(ids[j])] = (int(ids[i]), round(s[i, j], 9))
    assert {r.right: (r.left, round(r.similarity, 9)) for r in found.collect()} == want


def test_embedding_words_are_sent_as_texts(spark):  # F10
    docs = spark.createDataFrame([(1, "Ab ab cd, 中文 x_1"), (2, ""), (3, None)], "doc_id long, text string")
    assert "array_join" in _plan(vector.hashed_embeddings(docs, 8))  # not as lists, which Python would hold word by word
    got = {r.doc_id: r.embedding for r in vector.hashed_embeddings(docs, 8).collect()}
    v = np.zeros(8, np.float32)
    for w in ("ab", "ab", "cd", "中", "文", "x_1"):
        h = zlib.crc32(w.encode())
        v[h % 8] += 1 if h >> 31 else -1
    assert got == {1: (v / np.linalg.norm(v)).tolist(), 2: [0.0] * 8, 3: [0.0] * 8}


def test_metadata_file_is_written_and_read_without_the_driver(spark, tmp_path, monkeypatch):  # F5
    path = str(tmp_path / "m.json")
    names = ['a "q"', "ü\\x", "b\n\tc\u0001", "z/é", "日本", *(f"k{n:03d}" for n in range(50))]
    rows = spark.createDataFrame([(k, json.dumps({"title": f"{k}, }}", "year": n})) for n, k in enumerate(names)], "meta_key string, entry string").repartition(7)
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    files.save_metadata(rows, path)
    want = {k: {"title": f"{k}, }}", "year": n} for n, k in enumerate(names)}
    text = open(path, encoding="utf-8").read()
    assert json.loads(text) == want and list(json.loads(text)) == sorted(want, key=str.encode) and len(text.splitlines()) == len(names) + 2
    assert files._by_lines(spark, path) is not None and [p.name for p in tmp_path.iterdir()] == ["m.json"]
    read = lambda: {r.meta_key: json.loads(r.v) for r in files.metadata_json(spark, path).select("meta_key", F.to_json("value").alias("v")).collect()}
    assert read() == want
    (tmp_path / "m.json").write_text(json.dumps(want, indent=4) + "\n")  # as people or other programs lay it out
    assert files._by_lines(spark, path) is None and read() == want
    files.save_metadata(rows.limit(0), path)
    assert open(path).read() == "{\n}\n" and read() == {}


@pytest.mark.parametrize("text", ['{\n  "a": 1\n  "b": 2,\n}\n', '{\n  "a": 1,\n  "b": 2,\n}\n', '{\n  "a": 1,\n}\n  "b": 2\n}\n', '{\n  "a": 1,\n  "a": 2\n}\n', '{\n  "a": 1,\n  b\n}\n', "[1]\n", "{\n"])
def test_broken_metadata_files_fail_as_before(spark, tmp_path, text):  # F5
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(Exception, match="JSON|DUPLICATE|MALFORMED"):
        files.metadata_json(spark, str(tmp_path / "m.json")).collect()
