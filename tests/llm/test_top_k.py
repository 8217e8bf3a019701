import random

import numpy as np
import pytest

from panelweave.llm import q_top_k, top_k

SCHEMA = "vec_id long, embedding array<float>, score int, query string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "mine") for i, v in rows], SCHEMA)


def made(n=900, width=12, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, .3) for _ in range(width)]) for i in range(n)]
    common = rows[5][1]
    rows += [(n + i, common) for i in range(60)]  # ties, decided by the id
    rows += [(1000, None), (1100, [NAN] * width), (1200, [None] * width), (1300, [INF] + [0.0] * (width - 1)), (1400, [1.5] * width)]
    rng.shuffle(rows)
    return rows


def test_query_equals_sql(spark, rows_of, sql_rows, monkeypatch):
    table = vectors(spark, made())
    monkeypatch.setattr(q_top_k, "read_table", lambda *_: table)
    for block, probe, first in ((4096, 4, 100), (64, 3, 5), (7, 1, 1)):
        for name, value in (("BLOCK", block), ("PROBE", probe), ("FIRST", first)):
            monkeypatch.setattr(top_k, name, value)
        out = q_top_k.op12_top_k(spark, "")
        assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
        assert rows_of(out) == sql_rows(q_top_k.SQL, embeddings=table)


def brute(base, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in base if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_lengths_groups_of_queries_and_few_candidates(spark):
    rng = random.Random(8)
    base = [(i, [rng.randrange(-9, 9) for _ in range(rng.choice([0, 3, 5]))]) for i in range(200)]
    queries = [(i, base[i][1]) for i in range(0, 200, 9)] + [(5000, [2] * 6)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    for k, size in ((3, 1 << 20), (500, 1 << 20), (4, 400)):
        got = [tuple(r) for r in top_k.search(frame(base), frame(queries + queries[:3]), k, query_bytes=size).collect()]
        assert sorted(got) == brute(base, queries, k)
    assert top_k.search(frame(base).limit(0), frame(queries)).count() == 0
    assert top_k.search(frame(base), frame(queries).limit(0)).count() == 0
    twice = top_k.search(frame(base + base[:50]), frame(queries[:2]), 6).collect()
    assert sorted(tuple(r) for r in twice) == brute(base + base[:50], queries[:2], 6)


def test_large_numbers(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    base = [(i, [(1 << 29) + i, -(1 << 29) - 3 * i]) for i in range(50)]
    got = [tuple(r) for r in top_k.search(frame(base), frame(base[:2]), 5).collect()]
    assert sorted(got) == brute(base, base[:2], 5)
    with pytest.raises(Exception, match="64 bits"):
        top_k.search(frame([(1, [1 << 40]), (2, [1 << 40])]), frame([(1, [1 << 40])])).collect()


def test_terms_are_split_and_candidates_pruned():
    """With a bound to start from, most candidates leave before their last terms."""
    rng = np.random.default_rng(1)
    block = rng.integers(-300, 300, (4000, 32))
    probes = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple):
                probes.append(len(key[1]))
            return np.asarray(super().__getitem__(key))

    vector = block[0].copy()
    vector[8:] //= 30
    queries = (np.array([0]), np.array([0]), vector[None, :], np.array([np.iinfo(np.int64).min]))
    best = top_k.Best(queries, 10)
    best.add(np.arange(4000), block)
    ends = np.stack([vector * block.min(axis=0), vector * block.max(axis=0)])
    order = np.argsort(ends.min(axis=0) - ends.max(axis=0), kind="stable")
    rest = np.concatenate([np.cumsum(ends.max(axis=0)[order][::-1])[::-1], [0]])
    floor = np.concatenate([[0], np.cumsum(ends.min(axis=0)[order])])
    best._query(0, np.arange(4000, 8000), np.ascontiguousarray(block.T).astype(float).view(Counted), order, rest, floor)
    assert probes and sum(probes) < 4000 and probes[1] < 400
