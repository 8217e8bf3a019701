import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st

from panelweave.llm import periodic_runs, q_periodic_runs


def brute(words, times=4, shortest=6):
    """Every maximal stretch of each lag, the smallest lag of equal stretches."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(shortest, times * q):
                found.setdefault((first - q, i - first + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_runs_of_few_words(words):
    assert periodic_runs.runs(np.array(words, dtype=np.int64)) == brute(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8), st.integers(0, 8)), max_size=6))
def test_runs_of_repeated_pieces(pieces):
    words = [w for piece, n, more in pieces for w in (piece * (n + 1))[:len(piece) * n + more]]
    assert periodic_runs.runs(np.array(words, dtype=np.int64)) == brute(words)


def test_nested_and_long_runs():
    rng = random.Random(5)
    inner = [0] * 7 + [1, 2] * 5 + [rng.randrange(9) for _ in range(60)]
    words = [9, 8] + inner * 6 + [3]
    assert periodic_runs.runs(np.array(words)) == brute(words)
    assert periodic_runs.runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    blocks = [w for i in range(20_000) for w in [0] * 8 + [i + 1]]  # one frequent word: no diagonal to each earlier place
    assert len(periodic_runs.runs(np.array(blocks))) == 20_000


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (sha(b" ".join(w for i, w in enumerate(words) if i not in gone)), doc_id, 1000 * best[1] // best[2] if found else None,
            best[1], len(found), best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), best[0])


def test_query_equals_brute_force(spark, documents, rows_of, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "cé", "D d"]) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(300)]
    rows += [(300, "x \t\r\n\x0b\x0c y " * 9), (301, None), (None, "q " * 8), (302, ""), (303, "a " * 50), (303, "a " * 50)]
    docs = documents(rows, extra=("runs", "collapsed", "length"))
    monkeypatch.setattr(q_periodic_runs, "read_table", lambda *_: docs)
    out = q_periodic_runs.op11_periodic_runs(spark, "")
    assert rows_of(out) == sorted((expected(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10


def test_edges(spark, documents):
    docs = documents([(1, "one two " * 4 + "three"), (2, None)], extra=("runs", "collapsed"))
    out = periodic_runs.find(docs)
    assert out.columns == [c for c in docs.columns if c not in ("runs", "collapsed")] + ["n_words", "runs", "strongest", "collapsed"]
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()}
    assert got == {1: (9, [(0, 8, 2)], "one two three"), 2: (0, [], "")}
    assert periodic_runs.find(docs.limit(0)).count() == 0
