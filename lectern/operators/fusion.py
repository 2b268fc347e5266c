"""Fusion of two ranked lists, reranking of its head, and grouping by paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, VECTOR_WEIGHT, BM25_WEIGHT = 60, 0.65, 0.35


def fuse(vector: DataFrame, lexical: DataFrame, how: str = "rrf", k: int = RRF_K, weights: tuple[float, float] = (VECTOR_WEIGHT, BM25_WEIGHT)) -> DataFrame:
    """id, score, vector_score, bm25_score, rank: reciprocal ranks or a weighted sum; a missing side counts 0.

    Ties keep the vector list's order, then the lexical list's.
    """
    v = vector.select("id", F.col("rank").alias("v_rank"), "vector_score")
    b = lexical.select("id", F.col("rank").alias("b_rank"), "bm25_score")
    both = v.join(b, "id", "full_outer")
    if how == "rrf":
        score = F.coalesce(1 / (k + F.col("v_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("b_rank")), F.lit(0.0))
    elif how == "linear":
        score = weights[0] * F.coalesce("vector_score", F.lit(0.0)) + weights[1] * F.coalesce("bm25_score", F.lit(0.0))
    else:
        raise ValueError(f"unknown fusion: {how}")
    order = [F.desc("score"), F.col("v_rank").asc_nulls_last(), F.col("b_rank").asc_nulls_last()]
    scored = both.withColumn("score", score).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # two short lists
    return scored.select("id", "score", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "rank")


def rerank(ranked: DataFrame, score: Column, top_k: int = 20) -> DataFrame:
    """ranked with rerank_score and a new rank: the first top_k rows by the new score, then the old; the rest follow as they were."""
    head = F.col("rank") <= top_k
    scored = ranked.withColumn("rerank_score", F.when(head, score))
    order = [F.when(head, 0).otherwise(1), F.desc_nulls_last("rerank_score"), F.when(head, -F.col("score")), F.col("rank")]
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def group_by_paper(ranked: DataFrame, top_k: int, paper: Column | None = None) -> DataFrame:
    """The best row of each paper, how many rows of it are in the pool, and the others' ids in rank order."""
    key = paper if paper is not None else F.coalesce("source_path", "chunk_id")
    keyed = ranked.withColumn("__paper", key)
    grouped = keyed.groupBy("__paper").agg(F.min("rank").alias("__best"), F.count(F.lit(1)).cast("int").alias("pool_chunk_count"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("__rows"))
    others = F.transform(F.slice("__rows", F.lit(2), F.greatest(F.size("__rows") - 1, F.lit(0))), lambda x: x["chunk_id"])
    firsts = grouped.orderBy("__best").limit(top_k).withColumn("other_chunk_ids", others).drop("__rows")
    out = keyed.join(F.broadcast(firsts), (keyed["__paper"] == firsts["__paper"]) & (F.col("rank") == F.col("__best")))  # top_k rows
    order = F.row_number().over(Window.orderBy("__best"))
    return out.drop("__paper").withColumn("rank", order).drop("__best")


# -- scores of a judging model -----------------------------------------------------------------------------------------

#: What the judging model is asked, the chat template around it, and how much of a document it reads.
JUDGE = 'Judge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".'
PROMPT_HEAD, PROMPT_USER, PROMPT_TAIL = "<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
PROMPT_CHARS = 4000


def yes_share(top: Column) -> Column:
    """P(yes) among yes and no of array<struct<token, logprob>>; null if neither is there."""

    def mass(word: str) -> Column:
        own = F.filter(top, lambda t: (F.lower(F.trim(t["token"])) == word) & t["logprob"].isNotNull())
        return F.aggregate(own, F.lit(0.0), lambda s, t: s + F.exp(t["logprob"].cast("double")))

    total = mass("yes") + mass("no")
    return F.when(total != 0, mass("yes") / total)


def said_yes(answer: Column) -> Column:
    """1 or 0 from an answer in words."""
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    first = F.btrim(F.regexp_extract(text, r"^\S+", 0), F.lit(".,;:!?)\"'"))
    vague = F.contains(text, F.lit("yes")) & ~F.contains(text, F.lit("no"))
    return F.when(first == "yes", 1.0).when(first == "no", 0.0).when(vague, 1.0).otherwise(0.0)


def judge_score(top: Column, answer: Column) -> Column:
    return F.coalesce(yes_share(top), said_yes(answer))


def prompt(instruction: str, query: Column, document: Column) -> Column:
    """A raw chat prompt that asks for yes or no about at most PROMPT_CHARS characters."""
    head = f"{PROMPT_HEAD}{JUDGE}{PROMPT_USER}<Instruct>: {instruction}\n<Query>: "
    return F.concat(F.lit(head), query, F.lit("\n<Document>: "), F.substring(F.coalesce(document, F.lit("")), 1, PROMPT_CHARS), F.lit(PROMPT_TAIL))
