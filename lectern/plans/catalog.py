"""All queries of the engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import titles
from ..operators import chunking, citations, dedup, enrich, fusion, indexing, lexical, library, vector
from ..session import scratch
from ..sources import snapshots
from .corpus import CHUNKS_SQL, PAPERS_SQL, QUERY_TEXT, chunks, papers, table

FLAGSHIP = "bm25_topk"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


# -- lexical -----------------------------------------------------------------------------------------------------------

_TOKENS = r"toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ts FROM documents)"
_BM25 = f"""{_TOKENS}, lens AS (SELECT doc_id, len(ts)::BIGINT AS dl FROM toks),
post AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM toks) GROUP BY ALL),
size AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM lens),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term), size),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower('{QUERY_TEXT}'), '[\\p{{L}}\\p{{N}}_]+')) AS term) GROUP BY term),
hits AS (SELECT doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s
  FROM post JOIN asked USING (term) JOIN terms USING (term) JOIN lens USING (doc_id), size GROUP BY doc_id)"""


def _bm25_sql(k: int, pool: str = "SELECT doc_id FROM documents") -> str:
    return f"""{_BM25}, pool AS ({pool}),
lex0 AS (SELECT doc_id AS id, coalesce(s, 0) AS bm25_raw FROM pool LEFT JOIN hits USING (doc_id) ORDER BY bm25_raw DESC, id LIMIT {k}),
lex AS (SELECT id, row_number() OVER (ORDER BY bm25_raw DESC, id)::INT AS rank, bm25_raw, bm25_raw / (CASE WHEN max(bm25_raw) OVER () = 0 THEN 1 ELSE max(bm25_raw) OVER () END) AS bm25_score FROM lex0)"""


_INDEXES: dict[tuple[str, str], lexical.LexicalIndex] = {}


def bm25_index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    """The index of a folder's documents, written once for each application."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _INDEXES:
        _INDEXES[own] = lexical.write(table(spark, sf_dir, "documents"), scratch(spark, "bm25"), key="doc_id")
    return _INDEXES[own]


@query(f"WITH {_TOKENS} SELECT doc_id, len(ts)::INT AS n_tokens, len(list_distinct(ts))::INT AS n_distinct, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM toks")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("ts"))
    return d.select("doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_distinct"), F.md5(F.array_join("ts", " ").cast("binary")).alias("tokens_md5"))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_index(spark, sf_dir).terms.select("term", "df", r6("idf").alias("idf"))


@query(f"WITH {_bm25_sql(12)} SELECT id AS doc_id, rank, round(bm25_raw, 6) AS bm25_raw, round(bm25_score, 6) AS bm25_score FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(bm25_index(spark, sf_dir), QUERY_TEXT, 12).select(F.col("id").alias("doc_id"), "rank", r6("bm25_raw").alias("bm25_raw"), r6("bm25_score").alias("bm25_score"))


@query(f"""WITH {CHUNKS_SQL}, {_bm25_sql(12, "SELECT seq AS doc_id FROM chunks WHERE year = 2007 AND contains(lower(array_to_string(tags, ', ')), 'en')")}
SELECT id AS doc_id, rank, round(bm25_raw, 6) AS bm25_raw, round(bm25_score, 6) AS bm25_score FROM lex""")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.top(bm25_index(spark, sf_dir), QUERY_TEXT, 12, chunks(spark, sf_dir), condition=library.matches(year=2007, tag="EN"))
    return found.select(F.col("id").alias("doc_id"), "rank", r6("bm25_raw").alias("bm25_raw"), r6("bm25_score").alias("bm25_score"))


@query(f"""WITH {_BM25.replace("asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower('" + QUERY_TEXT + "'), '[\\p{L}\\p{N}_]+')) AS term) GROUP BY term)", "asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL)").replace("hits AS (SELECT doc_id,", "hits AS (SELECT item_id, doc_id,").replace("GROUP BY doc_id)", "GROUP BY item_id, doc_id)")}
SELECT item_id, doc_id, rank, round(s, 6) AS bm25_raw FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id)::INT AS rank FROM hits) WHERE rank <= 3""")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of every benchmark text, in one job."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.best(bm25_index(spark, sf_dir), asked, 3).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", "bm25_raw")


# -- vectors and fusion ------------------------------------------------------------------------------------------------

_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"


def _vec_sql(k: int, fetch: int, where: str = "true", residual: str = "true") -> str:
    return f"""{_Q}, vec0 AS (SELECT vec_id AS id, greatest(0, list_cosine_similarity(embedding::DOUBLE[], q)) AS s FROM embeddings, q WHERE {where} ORDER BY s DESC, id LIMIT {fetch}),
vec AS (SELECT id, row_number() OVER (ORDER BY s DESC, id)::INT AS rank, s AS vector_score FROM vec0 WHERE {residual} ORDER BY s DESC, id LIMIT {k})"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "seq").withColumn("year", (2000 + F.pmod("seq", F.lit(25))).cast("int"))
    return v, [float(x) for x in v.where("seq = 7").first().embedding]  # the query's own vector


@query(f"WITH {_vec_sql(12, 24)} SELECT id AS vec_id, rank, round(vector_score, 6) AS vector_score FROM vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return vector.top(v, q, 12, 24).select(F.col("id").alias("vec_id"), "rank", r6("vector_score").alias("vector_score"))


@query(f"WITH {_vec_sql(12, 24, '2000 + vec_id % 25 = 2007', 'id % 3 = 1')} SELECT id AS vec_id, rank, round(vector_score, 6) AS vector_score FROM vec")
def vector_prefilter_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    found = vector.top(v, q, 12, 24, where=F.col("year") == 2007, residual=F.pmod("seq", F.lit(3)) == 1)
    return found.select(F.col("id").alias("vec_id"), "rank", r6("vector_score").alias("vector_score"))


def _fused_sql(score: str) -> str:
    return f"""{_bm25_sql(12)}, {_vec_sql(12, 24)},
fused AS (SELECT coalesce(v.id, b.id) AS id, {score} AS score, coalesce(vector_score, 0) AS vector_score, coalesce(bm25_score, 0) AS bm25_score, v.rank AS vr, b.rank AS br FROM vec v FULL JOIN lex b ON v.id = b.id),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, vr NULLS LAST, br NULLS LAST)::INT AS rank FROM fused)"""


_RRF = "coalesce(1::DOUBLE / (60 + v.rank), 0) + coalesce(1::DOUBLE / (60 + b.rank), 0)"
_LINEAR = "0.65::DOUBLE * coalesce(vector_score, 0) + 0.35::DOUBLE * coalesce(bm25_score, 0)"
_SHOWN = "SELECT id, rank, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score FROM ranked"


def _fused(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return fusion.fuse(vector.top(v, q, 12, 24), lexical.top(bm25_index(spark, sf_dir), QUERY_TEXT, 12), how)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", "rank", *[r6(c).alias(c) for c in ("score", "vector_score", "bm25_score")])


@query(f"WITH {_fused_sql(_RRF)} {_SHOWN} WHERE rank <= 8")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_fused(spark, sf_dir, "rrf").where("rank <= 8"))


@query(f"WITH {_fused_sql(_LINEAR)} {_SHOWN} WHERE rank <= 8")
def hybrid_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_fused(spark, sf_dir, "linear").where("rank <= 8"))


@query(f"""WITH {_fused_sql(_RRF)}, g AS (SELECT id // 40 AS paper, min(rank) AS best, count(*)::INT AS pool_chunk_count, array_to_string(list(id ORDER BY rank)[2:], ',') AS others FROM ranked GROUP BY 1 ORDER BY best LIMIT 8)
SELECT r.id, round(r.score, 6) AS score, g.pool_chunk_count, g.others, row_number() OVER (ORDER BY g.best)::INT AS rank FROM g JOIN ranked r ON r.rank = g.best""")
def hybrid_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fused(spark, sf_dir, "rrf").withColumn("chunk_id", F.col("id").cast("string")).withColumn("source_path", F.floor(F.col("id") / 40))
    out = fusion.group_by_paper(rows, 8, F.col("source_path"))
    return out.select("id", r6("score").alias("score"), "pool_chunk_count", F.array_join("other_chunk_ids", ",").alias("others"), "rank")


@query(f"""WITH {_fused_sql(_RRF)}, rr AS (SELECT *, CASE WHEN rank <= 5 THEN ((id * 37) % 11)::DOUBLE / 10 END AS rerank_score FROM ranked)
SELECT id, rerank_score, row_number() OVER (ORDER BY CASE WHEN rank <= 5 THEN 0 ELSE 1 END, rerank_score DESC NULLS LAST, CASE WHEN rank <= 5 THEN -score END, rank)::INT AS rank FROM rr""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fusion.rerank(_fused(spark, sf_dir, "rrf"), F.pmod(F.col("id") * 37, F.lit(11)) / 10, 5)
    return scored.select("id", "rerank_score", "rank")


_LOGPROBS = [(1, [("Yes", -0.1), (" no", -2.5)], None), (2, [("NO", -0.3), ("yes ", -1.5), ("YES", -4.0)], "no"), (3, [("maybe", -0.1)], " Yes, it is"), (4, None, "not sure"), (5, [], "surely yes"), (6, None, None), (7, [("no", None)], "No.")]


@query("""SELECT * FROM (VALUES (1, round(exp(-0.1) / (exp(-0.1) + exp(-2.5)), 6)), (2, round((exp(-1.5) + exp(-4.0)) / (exp(-1.5) + exp(-4.0) + exp(-0.3)), 6)),
(3, 1.0), (4, 0.0), (5, 1.0), (6, 0.0), (7, 0.0)) t(pair_id, score)""".replace("(1, ", "(1::BIGINT, ").replace("round(", "round((", 0))
def rerank_pyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_LOGPROBS, "pair_id long, top array<struct<token string, logprob double>>, answer string")
    return rows.select("pair_id", r6(fusion.judge_score(F.col("top"), F.col("answer"))).alias("score"))


# -- library -----------------------------------------------------------------------------------------------------------

_PAPERS = f"""{CHUNKS_SQL}, lib AS (SELECT source_path AS paper, count(*)::BIGINT AS chunk_count, min(seq) AS first_seq, min(file_name) AS file_name,
  coalesce(arg_min(title, seq) FILTER (WHERE title IS NOT NULL), regexp_replace(min(file_name), '\\.pdf$', '')) AS title, min(year) AS year, min(doi) AS doi FROM chunks GROUP BY source_path)"""
_NEWEST = "coalesce(year::VARCHAR, '') DESC, title DESC, first_seq"


@query(f"""WITH {_PAPERS} SELECT paper, chunk_count, title, year, doi, (SELECT count(*) FROM lib)::BIGINT AS paper_count, (SELECT sum(chunk_count) FROM lib)::BIGINT AS library_chunks FROM lib ORDER BY {_NEWEST} LIMIT 25""")
def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.summary(chunks(spark, sf_dir), 25).select("paper", "chunk_count", "title", "year", "doi", "paper_count", "library_chunks")


@query(f"""WITH {_PAPERS}, sel AS (SELECT * FROM lib WHERE contains(lower(title), 'topic 13') ORDER BY {_NEWEST} LIMIT 5)
SELECT paper, title, chunk_count, (SELECT string_agg(chunk_id, ',' ORDER BY seq) FROM chunks c WHERE c.source_path = sel.paper) AS ids FROM sel""")
def paper_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.details(chunks(spark, sf_dir), "Topic 13", 5).select("paper", "title", "chunk_count", F.array_join("chunk_ids", ",").alias("ids"))


@query(f"WITH {_PAPERS} SELECT paper FROM lib WHERE contains(paper, '5555/1') OR contains(file_name, '5555/1') OR contains(lower(title), '5555/1') OR contains(coalesce(doi, ''), '5555/1')")
def selector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.papers(chunks(spark, sf_dir)).where(library.selected(" 5555/1 ")).select("paper")


@query(f"WITH {_PAPERS} SELECT paper, file_name, title, year, doi, 'Author ' || (first_seq // 4 % 7) || ', Writer, ' || (first_seq // 4 % 11) AS authors FROM lib")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.papers(chunks(spark, sf_dir)).select("paper", "file_name", "title", "year", "doi", T.join_list(F.col("authors")).alias("authors"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, seq, score FROM (SELECT *, 1.0::DOUBLE AS score FROM chunks WHERE year = 2011 AND contains(lower(array_to_string(authors, ', ')), 'author 4') ORDER BY seq LIMIT 20)")
def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.metadata_search(chunks(spark, sf_dir), 20, year=2011, author="AUTHOR 4").select("chunk_id", "seq", "score")


@query(f"""WITH {CHUNKS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY chunk_index, seq) AS n, count(*) OVER (PARTITION BY source_path)::INT AS pool_chunk_count FROM chunks WHERE contains(lower(array_to_string(tags, ', ')), 'de') AND year = 2003)
SELECT chunk_id, seq, pool_chunk_count, coalesce((SELECT string_agg(o.chunk_id, ',' ORDER BY o.n) FROM m o WHERE o.source_path = m.source_path AND o.n > 1), '') AS others FROM m WHERE n = 1 ORDER BY chunk_index, seq LIMIT 10""")
def metadata_search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = library.metadata_search(chunks(spark, sf_dir), 10, True, tag="de", year=2003)
    return out.select("chunk_id", "seq", "pool_chunk_count", F.array_join("other_chunk_ids", ",").alias("others"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, seq, text FROM chunks WHERE chunk_id = (SELECT chunk_id FROM chunks WHERE seq = 42)")
def get_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    wanted = c.where("seq = 42").select("chunk_id").first().chunk_id
    return c.where(F.col("chunk_id") == wanted).select("chunk_id", "seq", "text")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN regexp_replace(substr(text, 1, 80), '\\s+$', '') || ' …' ELSE text END AS shown FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 80).alias("shown"))


@query(f"""WITH {CHUNKS_SQL}, ids AS (SELECT * FROM (VALUES (0, 9), (1, 4), (3, 9), (4, 24)) t(pos, seq))
SELECT pos::INT AS pos, '## ' || coalesce(title, file_name) || chr(10) || '- chunk_id: ' || chunk_id || coalesce(chr(10) || '- doi: ' || doi, '') || chr(10) || chr(10) || text AS section FROM ids JOIN chunks USING (seq)""")
def export_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    by = {r.seq: r.chunk_id for r in c.where(F.col("seq").isin(4, 9, 24)).select("seq", "chunk_id").collect()}
    return library.export_sections(c, [by[9], by[4], "unknown", by[9], by[24]])


@query(f"""WITH {CHUNKS_SQL} SELECT chunk_id, CASE WHEN seq // 4 % 5 = 0 THEN 'Corrected ' || (seq // 4) ELSE title END AS title, CASE WHEN seq // 4 % 10 = 0 THEN 1999 ELSE year END::INT AS year, doi FROM chunks""")
def refresh_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    p = F.floor(F.col("seq") / 4)
    fixed = c.where((F.pmod(p, F.lit(5)) == 0) & (F.col("chunk_index") == 0)).select("source_path", F.concat(F.lit("Corrected "), p.cast("string")).alias("title"), F.when(F.pmod(p, F.lit(10)) == 0, F.lit(1999)).alias("year"), F.lit("").alias("doi"))
    return library.refreshed(c, fixed, ("title", "year", "doi")).select("chunk_id", "title", "year", "doi")


@query(f"""WITH {_PAPERS}, gone AS (SELECT paper FROM lib WHERE contains(lower(title), 'topic 2') ORDER BY {_NEWEST} LIMIT 10) SELECT chunk_id FROM chunks WHERE source_path NOT IN (SELECT paper FROM gone)""")
def delete_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.deleted(chunks(spark, sf_dir), "topic 2")[0].select("chunk_id")


# -- citations ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {PAPERS_SQL}, own AS (SELECT id, arg_max(title, seq) AS title, arg_max(coalesce(doi, ''), seq) AS doi FROM placed GROUP BY id)
SELECT id, title, nullif(doi, '') AS doi, true AS indexed FROM own UNION ALL SELECT DISTINCT target, NULL, NULL, false FROM edges WHERE target NOT IN (SELECT id FROM own)""")
def citation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.nodes(papers(spark, sf_dir)).select("id", "title", "doi", "indexed")


@query(f"WITH {PAPERS_SQL} SELECT DISTINCT source, target FROM edges")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.edges(papers(spark, sf_dir))


@query(f"WITH {PAPERS_SQL} SELECT DISTINCT source, target FROM edges WHERE inside")
def citation_edges_local_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.edges(papers(spark, sf_dir), external=False)


@query(f"""WITH {PAPERS_SQL}, hit AS (SELECT k.seq, min(struct_pack(kind := r.kind, ref := r.ref)) AS o FROM refs r JOIN known k USING (kind, ref) WHERE r.seq = 21 AND k.seq <> 21 GROUP BY k.seq)
SELECT seq, title, row_number() OVER (ORDER BY o)::INT AS position FROM hit JOIN papers USING (seq)""")
def citations_outgoing_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.outgoing_local(papers(spark, sf_dir), 21).select("seq", "title", "position")


@query(f"WITH {PAPERS_SQL} SELECT DISTINCT kind::INT AS kind, ref FROM refs WHERE seq = 17 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.kind = refs.kind AND k.ref = refs.ref)")
def citations_outgoing_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.outgoing_external(papers(spark, sf_dir), 17).select("kind", "ref")


@query(f"""WITH {PAPERS_SQL}, me AS (SELECT 0 AS kind, doi AS ref FROM papers WHERE seq = 33 UNION ALL SELECT 1, openalex_id FROM papers WHERE seq = 33),
c AS (SELECT DISTINCT seq FROM refs JOIN me USING (kind, ref) WHERE seq <> 33) SELECT seq, title, year FROM c JOIN papers USING (seq) ORDER BY coalesce(year::VARCHAR, '') DESC, title DESC, seq LIMIT 50""")
def citations_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.incoming(papers(spark, sf_dir), 33).select("seq", "title", "year")


_MERMAID = "CASE WHEN regexp_matches(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '^\\p{{N}}') THEN 'n_' ELSE '' END || regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '_', 'g')"


@query(f"""WITH {PAPERS_SQL}, own AS (SELECT id, arg_max(CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN 'On "' || title || '"' WHEN 2 THEN 'a\\b' || chr(10) || title ELSE title END, seq) AS title, arg_max(coalesce(doi, ''), seq) AS doi, arg_max(coalesce(openalex_id, ''), seq) AS work FROM placed GROUP BY id),
n AS (SELECT id, title, doi, work FROM own UNION ALL SELECT DISTINCT target, '', CASE WHEN starts_with(target, 'doi:') THEN target[5:] ELSE '' END, CASE WHEN starts_with(target, 'doi:') THEN '' ELSE target END FROM edges WHERE target NOT IN (SELECT id FROM own))
SELECT 0 AS part, '  ' || {_MERMAID.format("id")} || '["' || replace(replace(replace(coalesce(nullif(title, ''), nullif(doi, ''), nullif(regexp_extract(work, '[^/]*$'), ''), id), '\\', '\\\\'), '"', '\\"'), chr(10), ' ') || '"]' AS line FROM n
UNION ALL SELECT 1, '  ' || {_MERMAID.format("source")} || ' --> ' || {_MERMAID.format("target")} FROM (SELECT DISTINCT source, target FROM edges)""")
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.pmod("seq", F.lit(5)) == 0, "").when(F.pmod("seq", F.lit(5)) == 1, F.concat(F.lit('On "'), F.col("title"), F.lit('"'))).when(F.pmod("seq", F.lit(5)) == 2, F.concat(F.lit("a\\b\n"), F.col("title"))).otherwise(F.col("title"))
    return citations.mermaid(papers(spark, sf_dir).withColumn("title", title)).select("part", "line")


# -- duplicates --------------------------------------------------------------------------------------------------------

_DUP = 'dup AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN \' 10.1/\' || upper(source) || \' \' || (doc_id // 100) END AS doi, \'The  Title \' || (doc_id % 40) AS title, CASE WHEN doc_id % 3 <> 0 THEN (2000 + doc_id % 5)::INT END AS year FROM documents)'


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(i.alias("seq"), F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit(" 10.1/"), F.upper("source"), F.lit(" "), F.floor(i / 100).cast("string"))).alias("doi"), F.concat(F.lit("The  Title "), F.pmod(i, F.lit(40)).cast("string")).alias("title"), F.when(F.pmod(i, F.lit(3)) != 0, (2000 + F.pmod(i, F.lit(5))).cast("int")).alias("year"))


_BY_DOI = "doi_pairs AS (SELECT * FROM (SELECT min(seq) OVER (PARTITION BY lower(trim(doi))) AS \"left\", seq AS \"right\" FROM dup WHERE doi IS NOT NULL) WHERE \"left\" < \"right\")"
_BY_TITLE = "title_pairs AS (SELECT * FROM (SELECT min(seq) OVER (PARTITION BY title, year) AS \"left\", seq AS \"right\" FROM dup WHERE doi IS NULL) WHERE \"left\" < \"right\")"


@query(f"WITH {_DUP}, {_BY_DOI} SELECT *, 1.0::DOUBLE AS similarity, 'doi' AS reason FROM doi_pairs")
def dedup_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_doi(_copies(spark, sf_dir))


@query(f"WITH {_DUP}, {_BY_TITLE} SELECT *, 1.0::DOUBLE AS similarity, 'title_year' AS reason FROM title_pairs")
def dedup_title_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_title_year(_copies(spark, sf_dir))


_SEMANTIC = """sem AS (SELECT "left", "right", round(s, 6) AS similarity FROM (SELECT a.vec_id AS "left", b.vec_id AS "right", list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY b.vec_id ORDER BY a.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4) WHERE n = 1)"""


@query(f"WITH {_SEMANTIC} SELECT *, 'semantic' AS reason FROM sem")
def dedup_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.semantic(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "seq"), 0.4)
    return found.withColumn("similarity", r6("similarity"))


@query(f"""WITH {_DUP}, {_BY_DOI}, {_BY_TITLE}, {_SEMANTIC}, u AS (SELECT 0 AS o, "left", "right", 1.0::DOUBLE AS similarity, 'doi' AS reason FROM doi_pairs UNION ALL SELECT 1, "left", "right", 1.0, 'title_year' FROM title_pairs UNION ALL SELECT 2, "left", "right", similarity, 'semantic' FROM sem)
SELECT "left", "right", similarity, reason FROM (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY o) AS n FROM u) WHERE n = 1""")
def dedup_pairs_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_pairs(dedup_doi(spark, sf_dir), dedup_title_year(spark, sf_dir), dedup_semantic(spark, sf_dir))


@query(f"WITH {_DUP}, {_BY_DOI} SELECT seq FROM dup WHERE seq NOT IN (SELECT \"right\" FROM doi_pairs)")
def dedup_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _copies(spark, sf_dir)
    return dedup.without_duplicates(rows, dedup.by_doi(rows)).select("seq")


# -- titles, identifiers -----------------------------------------------------------------------------------------------

_PAGE_TITLE = "pt AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"
_CLEAN = "trim(regexp_replace({0}, '[\\s\\x{{a0}}]+', ' ', 'g'))"
_RATIO = "CASE WHEN regexp_replace({0}, '\\s', '', 'g') = '' THEN 1.0::DOUBLE ELSE length(regexp_replace(regexp_replace({0}, '\\s', '', 'g'), '[\\p{{L}}\\p{{N}}:,.;()\\[\\]/-]', '', 'g'))::DOUBLE / length(regexp_replace({0}, '\\s', '', 'g')) END"
_ADS = " OR ".join(f"contains(lower({{0}}), '{w}')" for w in titles.AD_KEYWORDS)
_TRUSTED = (
    "(length({0}) BETWEEN 3 AND 260 AND NOT regexp_matches({0}, '(?i)https?://|www\\.|[a-z0-9-]+\\.(com|cn|net|org|top|xyz)\\b') AND NOT (" + _ADS + ") AND (" + _RATIO + ") <= 0.28 AND regexp_matches({0}, '[A-Za-z][A-Za-z0-9-]+|[\\x{{4e00}}-\\x{{9fff}}]'))"
)


def _page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(f"WITH {_PAGE_TITLE}, c AS (SELECT page_id, {_CLEAN.format('title')} AS t FROM pt) SELECT page_id, {_TRUSTED.format('t')} AS trusted FROM c")
def title_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_titles(spark, sf_dir).select("page_id", titles.trusted(F.col("title")).alias("trusted"))


@query(f"WITH {_PAGE_TITLE} SELECT page_id, round({_RATIO.format('title')}, 6) AS ratio FROM pt")
def title_symbol_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_titles(spark, sf_dir).select("page_id", r6(titles.symbol_ratio(F.col("title"))).alias("ratio"))


@query("SELECT p_partkey, trim(regexp_replace(replace(p_name, '-', ' '), '\\s+', ' ', 'g')) || ' v1.2' AS title FROM part")
def title_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("a/b/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_v1.2.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", titles.from_file_name(name).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'On ' || o_orderpriority || ' - part' END AS title, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate)::INT END AS year FROM orders""")
def filename_title_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit("n.d.")).otherwise(F.year("o_orderdate").cast("string"))
    name = F.concat(F.lit("C:\\x\\Smith et al. - "), year, F.lit(" - On "), F.col("o_orderpriority"), F.lit(" - part.pdf"))
    p = titles.file_name_parts(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", p["title"].alias("title"), p["year"].alias("year"))


_LOOKS = "(length(x) BETWEEN 12 AND 200 AND NOT regexp_matches(x, '(?i)^\\s*\\d*\\.?\\s*(" + titles.SECTION_NAMES + ")\\s*:?\\s*$') AND " + _TRUSTED.format("x") + ")"


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_CLEAN.format("x")}), lambda x: x <> '' AND NOT starts_with(x, '[Page '))[1:12] AS ls FROM documents)
SELECT doc_id, coalesce(list_filter(ls, lambda x: {_LOOKS})[1], 'doc ' || doc_id) AS title FROM l""")
def title_pick_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", titles.pick_line(F.col("text"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("title"))


_REF = "ref AS (SELECT l_orderkey, l_linenumber, 'See HTTPS://dx.DOI.org/10.' || (1000 + l_partkey) || '/Ab.' || l_suppkey || (CASE WHEN l_linenumber % 2 = 0 THEN ').' ELSE ', and' END) AS s FROM lineitem)"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.pmod("l_linenumber", F.lit(2)) == 0, ").").otherwise(", and")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("See HTTPS://dx.DOI.org/10."), (1000 + F.col("l_partkey")).cast("string"), F.lit("/Ab."), F.col("l_suppkey").cast("string"), end).alias("s"))


@query(f"WITH {_REF} SELECT l_orderkey, l_linenumber, rtrim(regexp_extract(s, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+'), '.,;:)]}}>\"''') AS doi FROM ref")
def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).select("l_orderkey", "l_linenumber", T.extract_doi(F.col("s")).alias("doi"))


@query("SELECT l_orderkey, l_linenumber, '10.' || (1000 + l_partkey) || '/Ab.' || l_suppkey AS bare, 'https://dx.doi.org/10.' || (1000 + l_partkey) || '/ab.' || l_suppkey || ')' AS keyed, 'https://dx.doi.org/10.' || (1000 + l_partkey) || '/ab.' || l_suppkey || ')' AS plain FROM lineitem")
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit(" https://dx.DOI.org/10."), (1000 + F.col("l_partkey")).cast("string"), F.lit("/Ab."), F.col("l_suppkey").cast("string"), F.lit(") "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.doi_bare(s).alias("bare"), T.doi_key(s).alias("keyed"), T.plain_key(s).alias("plain"))


@query("""WITH f AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS a, string_split(trim(regexp_replace(regexp_replace(lower(p_type), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') || ['part'] AS b FROM part)
SELECT p_partkey, round(len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(a || b)), 6) AS jaccard FROM f""")
def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = titles.compare_form(F.col("p_name")), titles.compare_form(F.concat(F.col("p_type"), F.lit(": part")))
    return table(spark, sf_dir, "part").select("p_partkey", r6(titles.token_jaccard(a, b)).alias("jaccard"))


@query()
def title_similarity_difflib(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", r6(enrich.title_similarity(F.col("p_name"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")))).alias("similarity"))


# -- chunks and indexing -----------------------------------------------------------------------------------------------

_SENTENCES = """s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS u FROM documents),
w AS (SELECT doc_id, u, unnest(generate_series(0, greatest(ceil((len(u) - 2) / 6.0)::INT, 1) - 1)) AS i, greatest(ceil((len(u) - 2) / 6.0)::INT, 1) AS n FROM s WHERE len(u) > 0),
c AS (SELECT doc_id, i::INT AS chunk_index, n::INT AS chunk_count, array_to_string(u[i * 6 + 1 : i * 6 + 8], ' ') AS t FROM w)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("/p/"), F.col("doc_id").cast("string")).alias("source_path"))
    return chunking.by_sentences(d)


@query(f"WITH {_SENTENCES} SELECT doc_id, chunk_index, chunk_count, length(t)::INT AS n_chars FROM c")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "chunk_index", "chunk_count", F.length("chunk_text").alias("n_chars"))


@query(f"WITH {_SENTENCES} SELECT doc_id, chunk_index, substr(sha256('/p/' || doc_id || ':' || chunk_index || ':' || t), 1, 24) AS chunk_id FROM c")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "chunk_index", "chunk_id")


@query()
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sentences up to 1200 tokens with 180 repeated; a fold, held against brute force in the tests."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("/p/"), F.col("doc_id").cast("string")).alias("source_path"))
    return chunking.by_tokens(d).select("doc_id", "chunk_index", "chunk_count", "chunk_id", F.length("chunk_text").alias("n_chars"))


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("/r/"), F.col("source"), F.lit("/"), i.cast("string"), F.lit(".pdf"))
    files = d.select(path.alias("path"), i.alias("seq"), F.concat(F.lit("/r/"), F.col("lang")).alias("root_path"), F.col("n_chars").alias("size"), (i * 10).alias("mtime"), F.sha2("text", 256).alias("digest"))
    old = d.where(F.pmod(i, F.lit(5)) != 0)
    manifest = old.select(path.alias("path"), F.when(F.pmod(i, F.lit(3)) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), (i * 10).alias("mtime"), F.when(F.pmod(i, F.lit(2)) == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("digest"), F.lit(1).alias("chunk_count"))
    return files, manifest


_REASON = "why AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 <> 0 THEN 'same_stat' WHEN doc_id % 2 = 0 THEN 'changed' ELSE 'same_content' END AS why FROM documents), num AS (SELECT *, CASE WHEN why IN ('new', 'changed') THEN row_number() OVER (PARTITION BY why IN ('new', 'changed') ORDER BY doc_id) END AS k FROM why)"


@query(f"WITH {_REASON} SELECT doc_id AS seq, CASE WHEN k > 100 THEN 'over_limit' ELSE why END AS reason FROM num")
def index_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.targets(*_files(spark, sf_dir), max_files=100).select("seq", "reason")


@query(f"WITH {_REASON} SELECT '/r/' || lang AS root_path, count(*)::BIGINT AS files, min(doc_id) AS first_seq FROM why WHERE why IN ('new', 'changed') GROUP BY lang")
def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.plan(indexing.targets(*_files(spark, sf_dir)))


@query(f"WITH {_REASON} SELECT count(*) FILTER (WHERE why IN ('new', 'changed'))::BIGINT AS indexed, count(*) FILTER (WHERE why NOT IN ('new', 'changed'))::BIGINT AS skipped FROM why")
def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.counters(indexing.targets(*_files(spark, sf_dir)))


@query("SELECT '/r/' || source || '/' || doc_id || '.pdf' AS path FROM documents WHERE source NOT IN ('src1', 'src7')")
def skip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spark.createDataFrame([("/r/src1",), ("/r/src7",), ("/r/src77",)], "dir string")
    return indexing.without_marked(_files(spark, sf_dir)[0], marked).select("path")


@query("""SELECT '/r/' || source || '/' || doc_id || '.pdf' AS path, n_chars AS size, (doc_id * 10) AS mtime,
CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 'old' ELSE sha256(text) END AS digest FROM documents""")
def manifest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, manifest = _files(spark, sf_dir)
    found = indexing.targets(files, manifest)
    done = found.where(F.col("reason").isin("new", "changed")).withColumn("chunk_count", F.lit(1))
    return indexing.manifest_after(manifest, done, found).select("path", "size", "mtime", "digest")


@query("""SELECT provider, k, payload FROM (SELECT *, row_number() OVER (PARTITION BY provider, k ORDER BY made DESC) AS n FROM (
SELECT 'p' || (event_id % 3) AS provider, user_id AS k, event_id::VARCHAR AS payload, event_id AS made FROM events)) WHERE n = 1""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.pmod("event_id", F.lit(3)).cast("string")).alias("provider"), F.col("user_id").alias("k"), F.col("event_id").cast("string").alias("payload"), F.col("event_id").alias("updated_at"))
    return snapshots.upserted(e.where("updated_at % 2 = 0"), e.where("updated_at % 2 = 1"), ["provider", "k"]).select("provider", "k", "payload")


# -- enrichment --------------------------------------------------------------------------------------------------------


def _crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    date = lambda y: F.struct(F.array(F.array(y, F.lit(3))).alias("date-parts"))
    m = F.struct(
        F.concat(F.lit("10.7/"), i.cast("string")).alias("DOI"), F.array(F.lit(" "), F.col("p_name")).alias("title"),
        F.array(F.struct(F.lit("Ada").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("").alias("family"))).alias("author"),
        F.when(F.pmod(i, F.lit(2)) == 0, date((1990 + F.pmod(i, F.lit(30))).cast("int"))).alias("published"), date(F.lit(1985)).alias("issued"), F.array(F.col("p_type")).alias("container-title"),
        F.array(F.struct(F.concat(F.lit("https://doi.org/10.8/"), F.pmod(i, F.lit(9)).cast("string")).alias("DOI")), F.struct(F.lit("doi:10.8/1.").alias("DOI"))).alias("reference"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name"), F.to_json(F.when(F.pmod(i, F.lit(10)) != 7, m)).alias("payload"))


@query("""SELECT p_partkey, '10.7/' || p_partkey AS doi, trim(p_name) AS title, 'Ada ' || p_brand AS authors, CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_partkey % 30 ELSE 1985 END::INT AS year, p_type AS container_title,
array_to_string(list_sort(list_distinct(['10.8/' || (p_partkey % 9), '10.8/1'])), '|') AS refs FROM part WHERE p_partkey % 10 <> 7""")
def enrich_crossref_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = enrich.parse_crossref(_crossref(spark, sf_dir)).where("work is not null")
    return w.select("p_partkey", "work.doi", "work.title", F.array_join("work.authors", "; ").alias("authors"), "work.year", "work.container_title", F.array_join("work.referenced_dois", "|").alias("refs"))


@query("""SELECT p_partkey, '10.9/' || p_partkey AS doi, p_name AS title, 'https://doi.org/10.9/' || p_partkey AS url, 'we study ' || p_partkey || ' we' AS abstract, 'W1|W' || p_partkey AS works, p_size::INT AS cited_by_count FROM part""")
def enrich_openalex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey").cast("string")
    m = F.struct(
        F.concat(F.lit("https://doi.org/10.9/"), i).alias("doi"), F.col("p_name").alias("display_name"), F.array(F.lit(" W1 "), F.lit(""), F.concat(F.lit("W"), i)).alias("referenced_works"), F.col("p_size").alias("cited_by_count"),
        F.create_map(F.lit("we"), F.array(F.lit(0), F.lit(3)), i, F.array(F.lit(2)), F.lit("study"), F.array(F.lit(1))).alias("abstract_inverted_index"),
    )
    w = enrich.parse_openalex(table(spark, sf_dir, "part").select("p_partkey", F.to_json(m).alias("payload")))
    return w.select("p_partkey", "work.doi", "work.title", "work.url", "work.abstract", F.array_join("work.referenced_work_ids", "|").alias("works"), "work.cited_by_count")


@query("SELECT c_custkey, (c_custkey % 11 = 0) OR ((c_custkey % 100)::DOUBLE / 100 >= 0.6 AND (c_custkey % 4 = 0 OR abs(2000 - (1995 + c_custkey % 9)) <= 2)) AS accepted FROM customer")
def enrich_accept_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    year = F.when(F.pmod(i, F.lit(4)) != 0, 1995 + F.pmod(i, F.lit(9)))
    return table(spark, sf_dir, "customer").select("c_custkey", enrich.accepted(F.pmod(i, F.lit(11)) == 0, F.pmod(i, F.lit(100)) / 100, F.lit(2000), year).alias("accepted"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as papers with some metadata, and the work found for most."""
    i = F.col("p_partkey")
    none = F.array().cast("array<string>")
    w = enrich.parse_crossref(_crossref(spark, sf_dir))
    text = lambda c: F.lit(None).cast("string").alias(c)
    return w.select(
        "p_partkey", "work", F.concat(F.lit("part_"), i.cast("string"), F.lit(".pdf")).alias("file_name"), F.when(F.pmod(i, F.lit(3)) == 0, F.lit("10.1/own")).alias("doi"),
        F.when(F.pmod(i, F.lit(4)) == 0, F.lit("%%% *** ###")).when(F.pmod(i, F.lit(4)) == 1, F.lit("An Own Title")).alias("title"), none.alias("authors"), F.when(F.pmod(i, F.lit(5)) == 0, F.lit(1970)).alias("year"),
        F.lit("").alias("container_title"), text("publisher"), text("url"), text("openalex_id"), text("abstract"), none.alias("referenced_dois"), none.alias("referenced_work_ids"), none.alias("related_work_ids"), F.lit(None).cast("int").alias("cited_by_count"), text("metadata_source"), text("metadata_enriched_at"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 7 THEN CASE WHEN p_partkey % 3 = 0 THEN '10.1/own' END WHEN p_partkey % 3 = 0 THEN '10.1/own' ELSE '10.7/' || p_partkey END AS doi,
CASE WHEN p_partkey % 10 = 7 THEN CASE p_partkey % 4 WHEN 0 THEN '%%% *** ###' WHEN 1 THEN 'An Own Title' END WHEN p_partkey % 4 = 1 THEN 'An Own Title' ELSE p_name END AS title,
CASE WHEN p_partkey % 5 = 0 THEN 1970 WHEN p_partkey % 10 = 7 THEN NULL WHEN p_partkey % 2 = 0 THEN 1990 + p_partkey % 30 ELSE 1985 END::INT AS year, CASE WHEN p_partkey % 10 <> 7 THEN 'crossref' END AS metadata_source FROM part""")
def enrich_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.merged(_metadata(spark, sf_dir)).select("p_partkey", "doi", "title", "year", "metadata_source")


@query("SELECT p_partkey, 'part_' || p_partkey || '.pdf' AS file_name, NULL::VARCHAR AS doi, NULL::VARCHAR AS title, NULL::INT AS year FROM part")
def enrich_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.cleared(_metadata(spark, sf_dir)).select("p_partkey", "file_name", "doi", "title", "year")


@query("""SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN p_partkey % 10 <> 7 THEN 'updated' WHEN p_partkey % 4 = 3 THEN 'failed' WHEN p_partkey % 3 = 0 THEN 'cleared' ELSE 'skipped' END AS outcome FROM part) GROUP BY outcome""")
def enrich_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metadata(spark, sf_dir)
    out = enrich.outcome(F.col("doi").isNotNull(), F.col("work").isNotNull(), F.pmod("p_partkey", F.lit(4)) == 3, reverify=True)
    return m.select(out.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '10.1234/A.' || p_partkey END AS trusted, CASE WHEN p_partkey % 3 = 1 THEN '10.4321/b' || p_partkey END AS speculative FROM part""")
def doi_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    url = F.when(F.pmod(i, F.lit(3)) == 0, F.concat(F.lit("http://x.org/10.1234/A."), i.cast("string"), F.lit(".")))
    text = F.when(F.pmod(i, F.lit(3)) == 1, F.concat(F.lit("as in 10.4321/b"), i.cast("string"), F.lit("), and 10.9999/zzz")))
    trusted, mined = enrich.doi_choice(F.lit(None).cast("string"), url, F.lit(None).cast("string"), text)
    return table(spark, sf_dir, "part").select("p_partkey", trusted.alias("trusted"), mined.alias("speculative"))


# -- rows only ---------------------------------------------------------------------------------------------------------


@query()
def hashing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vector.hashed_embeddings(table(spark, sf_dir, "documents").select("doc_id", "text"), 64)
    return e.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 4).cast("string")), " ").alias("components"))


@query("""SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY user_id, event_type""")
def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search log's analogue: events by user and kind."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
