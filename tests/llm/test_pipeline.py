"""The pipeline's stages, each against brute force on its own input."""

import re

import pytest

import corpus_pipeline
from lectern.llm import line_dedup, near_copies, pii, toxicity

from . import odd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert sorted(after.columns) == ["doc_id", "lang", "n_chars", "source", "text"] and dict(after.dtypes) == dict(before.dtypes)


def test_toxicity_stage(spark, stages):
    before, after = stages[0]
    scorer = toxicity.Scorer(toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet")))
    rows = by_id(before)
    assert set(by_id(after)) == {i for i, r in rows.items() if scorer.score(r.text) < 0.3}
    assert len(by_id(after)) > 0.8 * len(rows)


def test_line_stage(stages):
    before, after = (by_id(x) for x in stages[1])
    pages, count = {}, {}
    for r in before.values():
        pages[r.source] = pages.get(r.source, 0) + 1
        for line in {x for x in r.text.split("\n") if x.strip(" \t\n\x0b\f\r")}:
            count[r.source, line] = count.get((r.source, line), 0) + 1
    for i, r in before.items():
        lines = r.text.split("\n")
        kept = [x for x in lines if not (count.get((r.source, x), 0) >= line_dedup.MIN_PAGES and count[r.source, x] > line_dedup.MAX_RATIO * pages[r.source])]
        want = "\n".join(kept) if any(x.strip(" \t\n\x0b\f\r") for x in kept) else r.text
        assert after[i].text == want and after[i].n_chars == len(want)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """Brute force: the least id of each group that links of 0.8 join."""
    ids, sets = [i for i, _ in rows], [shingles(t) for _, t in rows]
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return set(least.values())


def test_near_copies_stage(stages):
    before, after = stages[2]
    assert set(by_id(after)) == groups([(r.doc_id, r.text) for r in before.collect()])


def test_near_copies_odd(spark, tmp_path):
    docs = spark.read.parquet(odd.write(tmp_path) + "/documents.parquet")
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert len({r.text or "" for r in kept}) == len(kept) == len({r.text or "" for r in docs.collect()}) - 2  # two near copies of the base text
    assert {r.doc_id for r in kept} >= {0, 6} and not {7, 8, 9} & {r.doc_id for r in kept}
    assert near_copies.keep_one(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", k % 3, [k]) for k in range(9)], "doc_id long, text string, rank int, extra array<int>").repartition(5)
    assert [tuple(r) for r in near_copies.keep_one(twice).collect()] == [(1, "a b c d e f", 0, [0])]


def test_near_copies_split(spark, monkeypatch):
    """Anchors of many texts go in blocks, and groups stay whole."""
    import random

    monkeypatch.setattr(near_copies, "BLOCK", 20)
    r = random.Random(1)
    base = [f"w{r.randrange(9999)}" for _ in range(200)]
    rows = []
    for k in range(150):
        w = list(base)
        w[r.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join(f"z{r.randrange(99999)}" for _ in range(80))) for k in range(150, 180)]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == groups(rows) == {0, *range(150, 180)}


def test_near_copies_wide_family(spark, monkeypatch):
    """In a family below the threshold, larger than a block, the closer pairs are found wherever they are dealt."""
    import random

    monkeypatch.setattr(near_copies, "BLOCK", 20)
    monkeypatch.setattr(near_copies, "LEADERS", 1)
    r = random.Random(4)
    common, rows = [f"c{k}" for k in range(300)], []
    for k in range(0, 240, 2):
        own = [f"u{k}x{j}" for j in range(40)]
        rows.append((k, " ".join(common + own)))
        other = own[:18] + [f"v{k}x{j}" for j in range(22)] if k % 10 == 0 else [f"v{k}x{j}" for j in range(40)]
        rows.append((k + 1, " ".join(common + other)))
    r.shuffle(rows)
    want = groups(rows)
    assert len(want) == 240 - 24
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == want


def test_near_copies_long(spark, monkeypatch):
    """Texts of thousands of shingles just below and just above the threshold; anchors are split by bytes too."""
    rows = []
    for k in range(0, 80, 2):
        a = [f"w{k}x{j}" for j in range(2000)]
        n = 2000 - 2000 * (2 * (0.795 + 0.01 * (k % 4 // 2))) / (1.795 + 0.01 * (k % 4 // 2))
        rows += [(k, " ".join(a)), (k + 1, " ".join([*a[: 2000 - round(n)], *(f"y{k}x{j}" for j in range(round(n)))]))]
    want = groups(rows)
    assert len(want) == 60
    for size in (near_copies.BYTES, 10_000):
        monkeypatch.setattr(near_copies, "BYTES", size)
        kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {x.doc_id for x in kept.collect()} == want


def test_near_copies_code(spark):
    """A pair that shares no view's fingerprint meets by the covering code; equal fingerprints alone make no copy."""
    head = " ".join(["a297 b297 c297 d297 e297"] * 40)
    tail = " ".join(f"{c}297" for c in "fghijklmnopqrs")
    rows = [(0, f"{head} {tail}"), (1, f"{head} {tail[:-9]}y297 z297"), (2, f"{head} " + " ".join(f"o{k}" for k in range(14)))]
    (code, *views), (other, *others) = (near_copies.describe(t)[0] for _, t in rows[:2])
    assert simhash_bits(code, other) <= near_copies.WITHIN and not set(enumerate(views)) & set(enumerate(others))
    assert simhash_bits(code, near_copies.describe(rows[2][1])[0][0]) <= near_copies.WITHIN
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == groups(rows) == {0, 2}


def simhash_bits(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def test_near_copies_code_alone(spark, monkeypatch):
    """Without the views, all near copies whose fingerprints are within two bits are joined still."""
    import random

    monkeypatch.setattr(near_copies, "ROUNDS", ((0, 1),))
    r = random.Random(6)
    rows = []
    for k in range(0, 120, 4):
        base = [f"w{k}x{j}" for j in range(400)]
        for j in range(4):
            at = r.randrange(400)
            rows.append((k + j, " ".join([*base[:at], f"y{k}x{j}", *base[at + 1 :]])))
    r.shuffle(rows)
    prints = {i: near_copies.describe(t)[0][0] for i, t in rows}
    root = {i: i for i in prints}
    for _ in prints:
        for a in sorted(prints):
            for b in range(a // 4 * 4, a):
                if simhash_bits(prints[a], prints[b]) <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    want = set(root.values())
    assert 30 < len(want) < 110
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == want


def test_pii_stage(stages):
    before, after = (by_id(x) for x in stages[3])
    assert {i: r.text for i, r in after.items()} == {i: pii.redacted(r.text) for i, r in before.items()}


def test_packing_stage(stages):
    before, after = stages[4]
    seen = {}
    for r in after.collect():
        seen.setdefault(r.doc_id, []).append((r.start, r.length, len(r.ids) // 4, r.doc_tokens))
    assert set(seen) == set(by_id(before))
    for parts in seen.values():
        at = 0
        for start, n, ids, total in sorted(parts):
            assert start == at and ids == n
            at += n
        assert at == total


@pytest.mark.parametrize("empty", [False, True])
def test_run_odd(spark, tmp_path, empty):
    out = corpus_pipeline.run(spark, odd.write(tmp_path, empty=empty))
    assert (out.count() == 0) == empty
