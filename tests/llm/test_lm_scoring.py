import random
from collections import Counter
from math import isclose, log10

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import lm_scoring

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute(rows, order):
    """PPM with explicit exclusion lists, method D, byte by byte; and the unigram base."""
    texts = [(i, (t or "").encode().translate(FOLD).split(), held) for i, t, held in rows]
    count, grams = Counter(), [{} for _ in range(order + 1)]
    padded = [b"\n" * order + b" ".join(w) + b"\n" for _, w, _ in texts]
    for (_, words, held), data in zip(texts, padded, strict=True):
        if not held:
            count.update([*words, None])
            for at in range(order, len(data)):
                for k in range(order + 1):
                    grams[k].setdefault(data[at - k:at], Counter())[data[at]] += 1
    total, kinds = sum(count.values()), len(count)
    out = {}
    for (i, words, _), data in zip(texts, padded, strict=True):
        score = 0.0
        for at in range(order, len(data)):
            out_of: set = set()
            for k in range(order, -1, -1):
                seen = {s: n for s, n in grams[k].get(data[at - k:at], {}).items() if s not in out_of}
                if not seen:
                    continue
                mass = sum(seen.values())
                if data[at] in seen:
                    score += log10((2 * seen[data[at]] - 1) / (2 * mass))
                    break
                score += log10(len(seen) / (2 * mass))
                out_of |= set(seen)
            else:
                score += log10(1 / (256 - len(out_of)))
        base = sum(log10((count[w] + 1) / (total + kinds + 1)) for w in [*words, None])
        out[i] = (len(words) + 1, sum(w in count for w in [*words, None]), total, base, score)
    return out


def make(n=60, seed=2):
    random.seed(seed)
    parts = ["th", "er", "on", "an", "re", "é", "ß", "st", "x", "7", "Q"]
    text = lambda: random.choice([" ", "\n", "  "]).join("".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(random.randint(0, 40)))
    return [(i, text(), i % 5 == 2) for i in range(n)] + [(100, None, False), (101, "", True), (102, " \t ", False), (103, "日本 " * 9, True)]


def check(spark, rows, order, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").withColumn("score", F.lit("mine"))
    out = {r["doc_id"]: r for r in lm_scoring.score(docs, ~F.col("held"), order=order, **options).collect()}
    want = brute(rows, order)
    assert out.keys() == want.keys()
    for i, (n, known, total, base, score) in want.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert isclose(r["base_score"], base, rel_tol=1e-9) and isclose(r["score"], score, rel_tol=1e-5, abs_tol=1e-5)
        assert r["held_out"] == {x[0]: x[2] for x in rows}[i]


def test_equal_to_byte_by_byte(spark):
    check(spark, make(), 5, block_bytes=600)
    check(spark, make(), 2)


def test_many_blocks_are_merged_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN", 4)
    check(spark, make(), 3, block_bytes=100)


def test_chunks_inside_a_block(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 150)
    keys, counts = lm_scoring.Block([b"ab ab", b"", b"x" * 400, b"ab"], [True, False, True, True], 3).cells()
    assert (np.diff(keys.astype(object)) > 0).all()
    grams = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert grams[int.from_bytes(b"\n\n\na", "big")] == 2 and grams[int.from_bytes(b"xxxx", "big")] == 397
    assert grams[int.from_bytes(b"\n\n\n\n", "big")] == 0  # the empty text is held out


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    counts = rng.integers(0, 1 << 30, len(keys)).astype(np.uint32)
    got = lm_scoring.unpack(lm_scoring.pack(keys, counts), np.uint64, np.uint32)
    assert (got[0] == keys).all() and (got[1] == counts).all()


def test_probabilities_sum_to_one(spark):
    rows = [(i, t, False) for i, t, _ in make(20)]
    texts = [lm_scoring.canonical((t or "").encode()) for _, t, _ in rows]
    pairs = np.zeros((256, 256), dtype=np.int64)
    for t in texts:
        data = b"\n\n" + t + b"\n"
        for at in range(2, len(data)):
            pairs[data[at - 1], data[at]] += 1
    counts = Counter()
    for t in texts:
        data = b"\n\n" + t + b"\n"
        counts.update(int.from_bytes(data[at - 2:at + 1], "big") for at in range(2, len(data)))
    for context in (b"th", b"er", b"\n\n"):
        keys = np.unique(np.array(sorted({*counts, *(int.from_bytes(context, "big") << 8 | s for s in range(256))}), dtype=np.uint64))
        values = lm_scoring.gram_values(keys, np.array([counts.get(int(k), 0) for k in keys]), pairs, 2)
        assert isclose((10 ** values[keys >> np.uint64(8) == int.from_bytes(context, "big")]).sum(), 1, rel_tol=1e-6)


def test_edges(spark):
    held_only = [(1, "ab cd", True), (2, None, True)]
    docs = spark.createDataFrame(held_only, "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, ~F.col("held")).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and isclose(got[1]["score"], -6 * log10(256), rel_tol=1e-6)
    assert lm_scoring.score(docs.limit(0), ~F.col("held")).count() == 0
    twice = spark.createDataFrame([(1, "same text", False)] * 3 + [(None, "other", None)], "doc_id long, text string, held boolean")
    got = lm_scoring.score(twice, ~F.col("held")).collect()
    assert len(got) == 4 and {r["train_tokens"] for r in got} == {11} and not any(r["held_out"] for r in got)
