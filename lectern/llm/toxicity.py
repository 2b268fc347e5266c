"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's bag is its hashed character n-grams (3 to 6, with marks at its ends) and the word itself, so an unseen spelling
shares most of its vectors with known ones. A run of over LONGEST characters without separators is a sequence of pieces of
PIECE characters, each a word; they overlap such that every n-gram of the run is in one. Embeddings are averaged over the
bags of every WINDOW words in a row; a linear softmax over the two classes gives the window's evidence z. A text's evidence is
the average of its windows' under weights in proportion to exp(SHARPNESS * z), since a few words make a long text toxic. It is
an average: but for the windows over the seams, texts joined to one have an evidence between the least and the greatest of
theirs, so length alone raises no score.
Embeddings and softmax are trained jointly in numpy, through these weights, on a bounded sample of labelled texts, on the
driver; scoring is one pass over all texts, and needs per word only the sum of its bag's scores.

Defined results: a null or wordless text gets the score of no evidence (the bias); labels of null or unknown documents
are ignored, of repeated ones the highest counts; of rows that repeat a doc_id the least text is learnt; without labels of
both classes every score is 0; repeated rows are each scored; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

#: The sample: at most so many texts of each class (the least hashes of doc_id), and so many characters of both together, half
#: of them for each class. A text that doesn't fit in what is left of its class's half is passed over, not the ones after it.
TRAIN_DOCS, TRAIN_CHARS = 2500, 9_000_000
BUCKETS, DIM, WINDOW, ROUNDS, RATE, THRESHOLD = 1 << 17, 8, 4, 60, 0.1, 0.3
SHARPNESS = 0.8
#: Longer words are cut to pieces, which share OVERLAP characters: one fewer than the longest n-gram.
LONGEST, PIECE, OVERLAP = 64, 16, 5
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    out = []
    for w in _WORD.findall((text or "").lower()):
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out.extend(w[at : at + PIECE] for at in range(0, len(w) - OVERLAP, PIECE - OVERLAP))
    return out


def bag(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)} | {marked}
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


@dataclass
class Model:
    """gram: each bucket's embedding times the difference of the softmax's two rows; that and the bias give any score."""

    gram: np.ndarray
    bias: float

    def word(self, word: str) -> tuple[float, int]:
        b = bag(word)
        return float(self.gram[b].sum(dtype=np.float64)), len(b)


def _windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of n words begin and end: one for each WINDOW words in a row, or one of all if they are fewer."""
    at = np.arange(max(1, n - WINDOW + 1), dtype=np.int32)
    return at, np.minimum(at + np.int32(WINDOW), np.int32(n))


def _sums(x: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1)
    np.cumsum(x, out=total[1:])
    return total[end] - total[at]


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Joint training by full-batch Adam of embeddings (BUCKETS x DIM) and the softmax's direction and bias."""
    vocab: dict[str, int] = {}
    seqs = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in words_of(t)), np.int32) for t in texts]
    y = np.array([t for t, s in zip(toxic, seqs, strict=True) if len(s)], np.float64)
    seqs = [s for s in seqs if len(s)]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    flat, sizes = array("i"), array("i")  # 4 bytes a gram; lists of numbers would take ten times that
    for w in vocab:
        b = bag(w)
        flat.extend(b)
        sizes.append(len(b))
    grams_of, n_grams, n_words = np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int32), len(vocab)
    del vocab
    word_at = np.concatenate([[0], np.cumsum(n_grams, dtype=np.int64)])
    blocks = [(a, min(a + 30_000, n_words)) for a in range(0, n_words, 30_000)]  # what a step makes of all grams is made in blocks
    per_word = np.empty(n_words)
    seen = np.zeros(BUCKETS, bool)
    seen[grams_of] = True
    used = np.flatnonzero(seen)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    grams_of = place[grams_of]
    tokens = np.concatenate(seqs)
    doc_at = np.concatenate([[0], np.cumsum([len(s) for s in seqs])[:-1]])
    win_at, win_end = (np.concatenate([np.int32(a) + _windows(len(s))[k] for a, s in zip(doc_at, seqs, strict=True)]) for k in (0, 1))
    wins = np.array([max(1, len(s) - WINDOW + 1) for s in seqs])
    win_doc_at = np.concatenate([[0], np.cumsum(wins)[:-1]])
    size = _sums(n_grams[tokens], win_at, win_end)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 1, DIM), np.array(-4.0)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for step in range(1, ROUNDS + 1):
        emb, u, b = params
        per_gram = emb @ u
        for a, e in blocks:
            per_word[a:e] = np.add.reduceat(per_gram[grams_of[word_at[a] : word_at[e]]], word_at[a:e] - word_at[a])
        z = _sums(per_word[tokens], win_at, win_end) / size + b
        # the weighted average over the windows of a text, and its slope: a window's weight depends on its z too
        share = np.exp(SHARPNESS * (z - np.repeat(np.maximum.reduceat(z, win_doc_at), wins)))
        share /= np.repeat(np.add.reduceat(share, win_doc_at), wins)
        logit = np.add.reduceat(share * z, win_doc_at)
        d_logit = weight * (1 / (1 + np.exp(-logit)) - y)
        d_z = np.repeat(d_logit, wins) * share * (1 + SHARPNESS * (z - np.repeat(logit, wins)))
        d_z /= size  # each word of a window has it: added at the window's begin, taken off after its end
        d_token = np.cumsum(np.bincount(win_at, d_z, len(tokens) + 1) - np.bincount(win_end, d_z, len(tokens) + 1))
        d_word = np.bincount(tokens, d_token[:-1], n_words)
        d_gram = np.zeros(len(used))
        for a, e in blocks:
            d_gram += np.bincount(grams_of[word_at[a] : word_at[e]], np.repeat(d_word[a:e], n_grams[a:e]), len(used))
        grads = [d_gram[:, None] * u[None, :] + 1e-7 * emb, emb.T @ d_gram, (d_z * size).sum()]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
            params[k] = params[k] - move * (d_gram != 0)[:, None] if k == 0 else params[k] - move
    gram = np.zeros(BUCKETS, np.float32)
    gram[used] = params[0] @ params[1]
    return Model(gram, float(params[2]))


class Scorer:
    """Scores texts; words that come again are looked up."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def score(self, text: str | None) -> float:
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        found = []
        for w in words_of(text):
            x = memo.get(w)
            if x is None:
                x = memo[w] = self.model.word(w)
            found.append(x)
        if not found:
            logit = self.model.bias
        else:
            a = np.array(found)
            at, end = _windows(len(a))
            z = _sums(a[:, 0], at, end) / _sums(a[:, 1], at, end) + self.model.bias
            share = np.exp(SHARPNESS * (z - z.max()))
            logit = (share * z).sum() / share.sum()
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _choose(sizes: list[tuple[int, int, int]], max_chars: int) -> dict[int, int]:
    """sizes: doc_id, class, characters. doc_id -> characters to learn from, within half of max_chars for each class.

    A class of which no text fits is learnt from the beginning of its shortest.
    """
    out: dict[int, int] = {}
    for y in {c for _, c, _ in sizes}:
        left, own = max_chars // 2, sorted((x for x in sizes if x[1] == y), key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0]))
        for i, _, n in own:
            if n <= left:
                out[i] = n
                left -= n
        if not any(i in out for i, _, _ in own):
            out[min(own, key=lambda x: (x[2], x[0]))[0]] = max_chars // 2
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Model:
    """The model of a bounded sample of the labelled rows that aren't held out. The driver gets the chosen texts only."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    parts = [known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1])  # at most 2 * per_class rows of two numbers
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    rows = materialise(rows.groupBy("doc_id", "__y").agg(F.min("text").alias("text")), "toxicity-sample")
    chosen = _choose([tuple(r) for r in rows.select("doc_id", "__y", F.length("text")).collect()], max_chars)  # 2 * per_class rows of numbers
    if not chosen:
        return train([], [])
    take = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, __n int")
    found = rows.join(F.broadcast(take), "doc_id").select("doc_id", F.substring("text", F.lit(1), F.col("__n")).alias("text"), "__y")
    got = sorted(found.toLocalIterator(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return train([r.text for r in got], [r["__y"] for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a last column __tox_score; all columns pass through."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.withColumn("__tox_score", F.pandas_udf(run, "double")(F.col("text")))


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__tox_score").alias("score"), F.when(F.col("__tox_score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
