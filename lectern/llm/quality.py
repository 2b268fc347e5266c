"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good, bad or abstain on each text. Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of rules, whatever the corpus) estimates how accurate each rule is and how common good texts are; the posterior
probability that a text is good replaces the filter that all rules must pass. Texts failing the base rule go regardless.

Defined results: a null or wordless text has no words and fails the base rule; repeated rows each keep a row; an empty
table gives an empty result; helper columns are prefixed with ``__q_``, so extra columns can't clash.
Windows of eight words are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

WINDOW, SYMBOLS, SPACE = 8, "#*$%&|<>", " \t\n\u000b\f\r"
KEEP = 0.5


def _pairs_apart(hashes: Column, k: int) -> Column:
    """Hash of each element with the one k places on; k elements shorter."""
    n = F.greatest(F.size(hashes) - k, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __q_ columns: words, characters, symbols, duplicate lines, words in repeated windows and case counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__q_text", F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != ""))
    hashes = F.transform("__q_text", lambda w: F.xxhash64(w))
    bare = F.length(F.array_join("__q_text", ""))
    out = out.withColumn("__q_word_chars", bare.cast("long")).withColumn("__q_words", hashes).drop("__q_text")
    n = F.size("__q_words")
    grams = F.col("__q_words")
    for k in (1, 2, 4):  # hashes of 2, 4 and then 8 words; the last k positions have none
        grams = _pairs_apart(grams, k)
    grams = F.when(n >= WINDOW, grams).otherwise(F.array().cast("array<long>"))
    out = out.withColumn("__q_grams", grams)
    # positions of windows that occur twice or more: sort (hash, position), keep those equal to a neighbour
    pairs = F.array_sort(F.transform(F.col("__q_grams"), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn("__q_pairs", F.when(F.size(F.array_distinct("__q_grams")) < F.size("__q_grams"), pairs))
    again = F.filter(
        F.col("__q_pairs"),
        lambda p, k: (p["g"] == F.get(F.col("__q_pairs"), k - 1)["g"]) | (p["g"] == F.get(F.col("__q_pairs"), k + 1)["g"]),
    )
    out = out.withColumn("__q_at", F.array_sort(F.transform(again, lambda p: p["i"])))
    covered = F.aggregate(
        F.col("__q_at"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    plain = t
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    return (
        out.withColumn("__q_n_words", n.cast("long"))
        .withColumn("__q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("__q_n_distinct", F.size(F.array_distinct("__q_words")).cast("long"))
        .drop("__q_words", "__q_grams", "__q_pairs", "__q_at")
        .withColumn("__q_lines", lines)
        .withColumn("__q_n_symbols", (F.length(t) - F.length(plain)).cast("long"))
        .withColumn("__q_n_lines", F.size("__q_lines").cast("long"))
        .withColumn("__q_n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
        .withColumn("__q_n_punct", F.regexp_count(t, F.lit("[!?.,;:]")).cast("long"))
        .withColumn("__q_n_upper", F.regexp_count(t, F.lit("\\p{Lu}")).cast("long"))
        .drop("__q_lines")
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes of each rule: 1 good, -1 bad, 0 abstains. Columns are those of ``measures``."""
    c = {k: F.col(f"__q_{k}") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_punct", "n_upper")}
    n, chars, never = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1)), F.lit(False)
    length = chars / n
    return {
        "length": _vote(c["n_words"] >= 50, c["n_words"] < 20),
        "word_length": _vote((length >= 3) & (length <= 12), (length < 2.5) | (length > 16)),
        "symbols_to_words": _vote(c["n_symbols"] * 100 <= n, c["n_symbols"] * 10 > n),
        "symbols_to_characters": _vote(c["n_symbols"] * 1000 <= chars, c["n_symbols"] * 25 > chars),
        "marked_words": _vote(c["n_symbols"] * 50 <= n, c["n_symbols"] * 3 > n),
        "duplicate_lines": _vote(never, c["n_dup_lines"] * 10 > c["n_lines"] * 3),
        "repeats": _vote(never, c["n_repeat_words"] * 5 > n),
        "capitals": _vote(never, c["n_upper"] * 2 > chars),
        "punctuation": _vote(never, c["n_punct"] > n),
        "variety": _vote(never, (n >= 50) & (c["n_distinct"] * 10 < n)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200) -> tuple[float, list[float]]:
    """Expectation-maximisation over (votes, count): the share of good texts and each rule's accuracy where it votes."""
    prior, acc = 0.8, [0.8] * n_rules
    for _ in range(rounds):
        good = total = 0.0
        right, votes = [1.6] * n_rules, [2.0] * n_rules  # two votes' worth of belief that rules are better than chance
        for vote, count in patterns:
            p = posterior(vote, prior, acc)
            good, total = good + p * count, total + count
            for j, v in enumerate(vote):
                if v:
                    right[j] += count * (p if v > 0 else 1 - p)
                    votes[j] += count
        new = [min(0.99, max(0.55, r / v)) for r, v in zip(right, votes, strict=True)]
        was, prior = prior, min(0.99, max(0.01, good / total)) if total else prior
        moved = max([abs(a - b) for a, b in zip(acc, new, strict=True)] + [abs(was - prior)])
        acc = new
        if moved < 1e-9:
            break
    return prior, acc


def posterior(vote: tuple[int, ...], prior: float, acc: list[float]) -> float:
    odds = math.log(prior / (1 - prior))
    for v, a in zip(vote, acc, strict=True):
        odds += v * math.log(a / (1 - a))
    return 1 / (1 + math.exp(-odds))


def quality(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs (its columns but the text) with the measures, base_failed, p_good and kept."""
    named = rules()
    base = measures(docs, text).drop(text)
    voted = materialise(base.withColumn("__q_votes", F.concat_ws(",", *[v.cast("string") for v in named.values()])), "votes")
    counts = voted.groupBy("__q_votes").count().collect()  # at most 3^rules rows
    patterns = sorted((tuple(int(x) for x in r[0].split(",")), r[1]) for r in counts)
    prior, acc = estimate(patterns, len(named))
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, a in enumerate(acc):
        odds = odds + F.split("__q_votes", ",")[j].cast("double") * F.lit(math.log(a / (1 - a)))
    failed = (F.col("__q_n_words") < 20) | (100 * F.col("__q_n_repeat_words") > 30 * F.col("__q_n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in names], "base_failed", "kept", "p_good")
