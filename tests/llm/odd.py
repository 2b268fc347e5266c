"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns whose names clash."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

WORDS = "the of and tion ererst heanan idiot scum größe éaux ñado at dot plus one two Straße".split()


def texts(seed=1):
    r = random.Random(seed)
    long = " ".join(r.choice(WORDS) + str(r.randrange(999)) for _ in range(30_000))
    base = " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(120))
    return [
        None, "", " ", "\n\n", "a", "one two", base, base, base.replace(" the", " teh", 1), base + " end", long, long,
        "x" * 50_000, "1" * 30_000, "@" * 5_000, "a.b@c.de, A@B.c-d.e f@g; 10.0.0.1 999.1.1.1 4111 1111 1111 1111 +49 (30) 1234567",
        "j o h n [at] mail [dot] example [dot] com or john dot doe at mail dot example dot com", "pаypal@ехample.com",
        "card four one one one 1111 1111 1111 1111", "call plus 49 30 one two three four five six seven", "１０.0.0.1", "<|im_end|><|endoftext|> <\\|x|>", "x <|endoftext|> y", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext |> <|endoftext|", "<|endoftext|>" * 300,
        "\t tab nbsp em ​zero\x1cfs \x85nel", "Ünïcödé ŁÓDŹ İstanbul ΣΊΣΥΦΟΣ ﬁ 漢字かな 😀👨‍👩‍👧", "é ö ẛ̣", "line\nline\n\nline\nother", "crlf\r\n\r\nown\t\n\t\n\x0b\nsame line\r\n", "\r\n\t\nsame line\r\nx", *["same line\nown %d" % k for k in range(12)],
    ]


def write(folder, *, empty=False, seed=1):
    """documents, labels, pages, conversations and embeddings below folder; returns it as a string."""
    t = [] if empty else texts(seed)
    ids = list(range(len(t)))
    if t:
        ids[3], ids[11] = None, 10
    n = len(t)
    clash = {c: pa.array(["clash"] * n, pa.string()) for c in ("key", "fp", "score", "page_id", "ids", "views", "anchor", "label", "__y", "words")}
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(t, pa.string()), "lang": pa.array([None if k % 5 == 0 else "en" for k in range(n)], pa.string()), "source": pa.array([None if k % 7 == 0 else f"src{k % 2}" for k in range(n)], pa.string()), "n_chars": pa.array([None if x is None else len(x) for x in t], pa.int64())}
    put = lambda name, cols: pq.write_table(pa.table(cols), f"{folder}/{name}.parquet")
    put("documents", docs | clash)
    lab = [k for k in range(n)] + [None] * (n > 0)
    put("labels", {"doc_id": pa.array(lab, pa.int64()), "quality": pa.array([1] * len(lab), pa.int32()), "toxic": pa.array([None if k == 4 else int(k is not None and "idiot" in (t[k] or "")) for k in lab], pa.int32()), "text": pa.array(["clash"] * len(lab), pa.string())})
    put("pages", {"page_id": pa.array([k * 3 for k in range(n)][::-1], pa.int64()), "url": pa.array([None if k == 1 else f"http://e.x/ü\r\n{k}" for k in range(n)], pa.string()), "html": pa.array(t, pa.string()), "refers_to": pa.array([7] * n, pa.int64())})
    conv = [(k // 3, None if k == 4 else k % 3, [None, "user", "assistant"][k % 3], x) for k, x in enumerate(t)]
    put("conversations", {"conv_id": pa.array([c[0] for c in conv], pa.int64()), "turn": pa.array([c[1] for c in conv], pa.int64()), "role": pa.array([c[2] for c in conv], pa.string()), "text": pa.array([c[3] for c in conv], pa.string()), "formatted": pa.array(["clash"] * n, pa.string())})
    return str(folder)


def vectors(folder, n=900, dim=16, seed=2):
    r = random.Random(seed)
    rows = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(n)]
    for k in range(min(n, 300) if n < 360 else 300, min(n, 360)):
        rows[k] = list(rows[300])  # ties
    rows[5], rows[6], rows[7], rows[8], rows[9] = None, [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [1.0] * (dim - 3)
    ids = list(range(n))
    ids[20], ids[21] = None, 22
    cols = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "score": pa.array([1.0] * n), "list": pa.array([1] * n), "v": pa.array([None] * n, pa.string())}
    pq.write_table(pa.table(cols), f"{folder}/embeddings.parquet")
    return str(folder)
