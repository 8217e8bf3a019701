import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelweave.llm import q_resampling, resampling

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def grams(text, longest=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10_000


def brute(docs, items):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)[1]))
    for _, text in items:
        t.update(map(bucket, grams(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for doc_id, text in docs:
        n, found = grams(text)
        weight = sum(gain(bucket(g)) for g in found)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for place, row in enumerate(able[:5 * sum(r[5] >= 20 for r in out) // 100], 1):
        row[4] = place
    return sorted(((r[0], r[1], r[4], r[3], r[2]) for r in out), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé Z-9\n中"), max_size=40) | st.sampled_from(["x" * 255, "y" * 256, "z é" * 300, "q" * 5000]), max_size=6))
def test_crc_of_every_gram(texts):
    found = resampling.Prefixes([t.encode() for t in texts])
    for n in (1, 2, 3, 4):
        places = [int(b) for _, part in found.buckets(n, 1 << 31) for b in part]
        words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
        assert places == [zlib.crc32(" ".join(w[i:i + n]).encode()) % (1 << 31) for w in words for i in range(len(w) - n + 1)]


def test_pieces_of_a_long_text(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "c", "déf"]) for _ in range(1000))
    whole = [b for _, part in resampling.Prefixes([text.encode()] * 2).buckets(3, 10_000) for b in part]
    monkeypatch.setattr(resampling, "WORDS", 37)
    assert whole == [b for _, part in resampling.Prefixes([text.encode()] * 2).buckets(3, 10_000) for b in part]
    assert len(whole) == 2 * 998


def rows(n=400):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma9", "δέλτα", "x", "longer-word", "中文"]
    made = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 60])))) for i in range(n)]
    return [*made, (n, None), (n + 1, ""), (None, "null id " * 20), (7, made[7][1]), (n + 2, "word " * 30_000), (n + 3, "w" * 3000)]


ITEMS = [(1, "Alpha beta, gamma9 alpha"), (2, None), (3, "x"), (4, "δέλτα alpha beta")]


def test_query_equals_brute_force(spark, documents, rows_of, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(rows(), extra=("rank", "weight", "bucket"))
    monkeypatch.setattr(q_resampling, "read_table", lambda _, __, name: docs if name == "documents" else items)
    out = q_resampling.op13_resampling(spark, "")
    assert [n for n, _ in out.dtypes] == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    assert rows_of(out) == brute(rows(), ITEMS)


def test_drawn_rows_and_edges(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(rows(), extra=("rank", "n"))
    out = resampling.resample(docs, items)
    assert set(out.columns) == set(docs.columns) and out.count() == 5 * sum(grams(t)[0] >= 20 for _, t in rows()) // 100
    drawn = {r["doc_id"] for r in out.collect()}
    share = lambda ids: np.mean(["alpha" in (t or "") for i, t in rows() if i in ids])
    assert share(drawn) >= share({i for i, _ in rows()})
    assert resampling.draw(resampling.score(documents([]), items)).count() == 0
    scored = resampling.score(documents(rows()), items.limit(0))
    assert scored.filter(F.col("weight").isNull()).count() == 0
    ties = spark.createDataFrame([(i, 50, 1, 7) for i in range(100)], "doc_id long, n_words long, n_features long, score long")
    assert sorted(r["doc_id"] for r in resampling.draw(ties).filter("rank is not null").collect()) == [0, 1, 2, 3, 4]
