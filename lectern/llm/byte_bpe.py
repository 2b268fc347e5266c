"""Byte-level BPE encoding and decoding against a public rank file.

``encode_words_sql`` is the named method: Spark higher-order functions fold ranked merges over the byte arrays of distinct
words, with the ranks as a literal map. The query folds a vocabulary that way, the most frequent words of a bounded sample of
documents (which words those are changes no result), and sends their ids to all tasks, as their number and length are bounded.
A task splits its texts, looks up most of their words there, and folds each other word once by the same ranked merges
(``merge_word``), kept in a bounded memo. Decoding is in higher-order functions too: the ids' binary pieces, concatenated.

No text is shuffled, a task holds one batch of texts and bounded tables, and a lost task is run again from its input alone.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each for itself;
an empty table gives no rows. Texts of any length are encoded whole; a word of n bytes takes O(n log n) in a task.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tokenizer_file

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: A task forgets its words beyond so many, and words longer than so many characters at once.
MEMO_WORDS, MEMO_CHARS = 500_000, 64
#: The vocabulary: so many words at most, of MEMO_CHARS at most, from so many documents (the least hashes of their ids).
VOCABULARY, SAMPLE_DOCS = 50_000, 4000


@cache
def load_ranks(name: str = RANK_FILE, folder: str | None = None) -> dict[bytes, int]:
    with open(tokenizer_file(name, folder), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def load_pieces(name: str = RANK_FILE, folder: str | None = None) -> dict[int, bytes]:
    return {v: k for k, v in load_ranks(name, folder).items()}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge_word(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """Ids of one word: the pair of least rank merges first, the leftmost of equals, until none is in the table.

    whole: a word that is in the table is one id at once.
    """
    if whole and (own := ranks.get(word)) is not None:
        return [own]
    n = len(word)
    ends = list(range(1, n + 1))  # of the piece that starts at i; 0: no piece starts there
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = ends[i]
        if not mid or mid >= n or ends[mid] != end:
            continue
        ends[i], ends[mid] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class Encoder:
    """Encodes texts; words that come again are looked up."""

    def __init__(self, name: str = RANK_FILE, folder: str | None = None, known: dict[str, bytes] | None = None):
        self.ranks, self.pieces = load_ranks(name, folder), load_pieces(name, folder)
        self.split = regex.compile(pattern()).findall
        self.known = known or {}
        self.memo: dict[str, bytes] = dict(self.known)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, parts = self.memo, []
        if len(memo) > MEMO_WORDS + len(self.known):
            memo.clear()
            memo.update(self.known)
        for word in self.split(text or ""):
            ids = memo.get(word)
            if ids is None:
                ids = np.array(merge_word(word.encode(), self.ranks), "<u4").tobytes()
                if len(word) <= MEMO_CHARS:
                    memo[word] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = VOCABULARY, sample: int = SAMPLE_DOCS) -> DataFrame:
    """word: the most frequent words of a sample of documents, found in one pass over these."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern()).findall
        for b in batches:
            found = Counter(w for t in b.column(0).to_pylist() for w in split(t or "") if len(w) <= MEMO_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    ids = docs.select(F.col(key).alias("__v_id")).where("__v_id is not null").distinct().orderBy(F.xxhash64("__v_id"), "__v_id").limit(sample)
    some = docs.join(F.broadcast(ids), F.col(key) == F.col("__v_id"), "left_semi").select(F.col(text).cast("string").alias("text"))  # sample rows of ids
    counted = some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(words).select("word")


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = RANK_FILE, folder: str | None = None, words: int = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    folded = encode_words_sql(vocabulary(docs, text, key, words), load_ranks(name, folder)) if words else None
    known = {r.word: np.array(r.ids, "<u4").tobytes() for r in folded.collect()} if folded else {}  # words rows of bounded length
    sent = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(name, folder, sent.value)
        for b in batches:
            ids = [enc.encode(x) for x in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").view("<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def digest_encoded(encoded: DataFrame, name: str = RANK_FILE, folder: str | None = None) -> DataFrame:
    """Decode the ids again: counts and digests."""
    ranks = load_ranks(name, folder)
    little = _strings(encoded.sparkSession, "little", [r.to_bytes(4, "little").hex() for r in range(max(ranks.values()) + 1)])
    decoded = decode_ids_sql(encoded, ranks)
    as_bytes = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(little, i)), ""))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(as_bytes, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# -- the form in higher-order functions --------------------------------------------------------------------------------

#: A map is searched key by key, so the rank map is many small ones; a pair's place is its number times this, shifted.
_BITS, _FACTOR, _SHIFT = 16, 2_654_435_761, 20
_NONE = 1 << 30


def _variable(spark: SparkSession, name: str, sql_type: str, values: pa.Array) -> Column:
    """A constant as one literal of a plan, by way of a session variable of that name."""
    name = f"lectern_{name}"
    spark.createDataFrame(pa.table({"v": values})).createOrReplaceTempView(name)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {sql_type}")
    spark.sql(f"SET VAR {name} = (SELECT v FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(name)


def _strings(spark: SparkSession, name: str, values: list[str]) -> Column:
    return _variable(spark, name, "ARRAY<STRING>", pa.array([values], pa.list_(pa.string())))


def _slot(pair: int) -> int:
    return (pair * _FACTOR) >> _SHIFT & ((1 << _BITS) - 1)


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map: from two pieces (their ids as one number) to the rank, which is the id, of what they merge to."""
    slots: list[list[tuple[int, int]]] = [[] for _ in range(1 << _BITS)]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                slots[_slot(a << 16 | b)].append((a << 16 | b, rank))
    return _variable(spark, "ranks", "ARRAY<MAP<BIGINT, INT>>", pa.array([slots], pa.list_(pa.map_(pa.int64(), pa.int32()))))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def encode_words_sql(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """word, ids (array of int) of the distinct non-null words, by a fold of ranked merges over their byte arrays.

    The fold holds the word's pieces and the ranks of neighbouring pairs. Each step merges the leftmost pair of least rank and
    looks up the two pairs that this makes; a word of n bytes needs n - 1 steps at most, each linear in its pieces. That merges
    alone lead to every piece of the table, so that a word that is one needs no look-up, is checked for the ranks given.
    """
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("two ids must fit in one number of 32 bits")
    rank_map = rank_literal(words.sparkSession, ranks)
    single = F.array(*[F.lit(ranks[bytes([b])]) for b in range(256)])
    hidden = [p for p in ranks if len(p) > 1 and merge_word(p, ranks, whole=False) != [ranks[p]]]
    if hidden:
        raise ValueError(f"{len(hidden)} pieces can't be reached by merges")

    def find(pair: Column) -> Column:
        slot = F.shiftrightunsigned(pair * F.lit(_FACTOR), _SHIFT).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")
        return F.coalesce(F.try_element_at(F.get(rank_map, slot), pair), F.lit(_NONE))

    def rank(a: Column, b: Column) -> Column:
        return _let(a.cast("long") * F.lit(1 << 16) + b, find)

    none = F.array().cast("array<int>")

    def fold(start: Column) -> Column:
        n = F.size(start)
        pairs = F.zip_with(F.slice(start, 1, n - 1), F.slice(start, 2, n - 1), rank)

        def step(acc: Column, _: Column) -> Column:
            p, r = acc["p"], acc["r"]

            def merge(at: Column) -> Column:
                made, m = F.element_at(r, at), F.size(p)
                before = F.when(at > 1, F.array(rank(F.get(p, at - 2), made))).otherwise(none)
                after = F.when(at + 1 < m, F.array(rank(made, F.get(p, at + 1)))).otherwise(none)
                pieces = F.concat(F.slice(p, F.lit(1), at - 1), F.array(made), F.slice(p, at + 2, m))
                return F.struct(pieces.alias("p"), F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(r, at + 2, m)).alias("r"))

            return _let(F.array_min(r), lambda least: F.when(least < _NONE, _let(F.array_position(r, least).cast("int"), merge)).otherwise(acc))

        folded = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.struct(start.alias("p"), pairs.alias("r")), step, lambda acc: acc["p"])
        return F.when(n < 2, start).otherwise(folded)

    distinct = words.where(F.col(word).isNotNull()).select(F.col(word).alias("word")).distinct()
    held = F.hex(F.col("word").cast("binary"))
    n = F.octet_length("word")
    bytes_ = F.when(n == 0, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(single, F.conv(F.substring(held, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))))
    return distinct.select("word", _let(bytes_, fold).alias("ids"))


def decode_ids_sql(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """encoded with ``decoded`` (binary): the pieces of an array of ids, concatenated."""
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, r in ranks.items():
        by_id[r] = piece.hex()
    pieces = _strings(encoded.sparkSession, "pieces", by_id)
    return encoded.withColumn("decoded", F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_encoded(encode_documents(table(spark, sf_dir, "documents")))
