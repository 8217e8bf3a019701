import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from panelweave.llm import near_dups

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w]
    n = min(5, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows):
    """Class of every doc_id: components of pairs with a Jaccard similarity of 0.8 or more, or without any words."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus(seed=1):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[random.choice(vocabulary) for _ in range(random.choice([6, 30, 120, 400]))] for _ in range(60)]
    boiler = [random.choice(vocabulary) for _ in range(25)]
    rows = []
    for words in base:
        rows.append(words)
        for _ in range(random.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(random.choice([0, 1, 2, 8])):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append(copy)
        rows.append(boiler + [random.choice(vocabulary) for _ in range(12)])  # alike by a passage only
    hub = [random.choice(vocabulary) for _ in range(100)]
    for _ in range(60):  # one large group, each with edits of its own
        copy = list(hub)
        copy[random.randrange(100)] = random.choice(vocabulary)
        rows.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  two")]


@pytest.mark.parametrize(("divide", "tile"), [(4096, 1024), (3, 8)])
def test_classes_match_brute_force(spark, documents, monkeypatch, divide, tile):
    monkeypatch.setattr(near_dups, "DIVIDE", divide)
    monkeypatch.setattr(near_dups, "TILE", tile)
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(documents(rows)).collect()}
    assert got == brute(rows)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    x = dict(zip(keys[:200].tolist(), rng.choice([1.0, 2.0, 4.0], 200).tolist(), strict=True))
    y = dict(zip(keys[80:].tolist(), rng.choice([1.0, 2.0, 4.0], 220).tolist(), strict=True))
    exact = sum(1 / sum(max(x.get(d, 0) / x[k], y.get(d, 0) / y[k]) for d in {*x, *y}) for k in x if k in y)
    owner = np.repeat([0, 1], [len(x), len(y)])
    signed = near_dups.prob_min_hash(owner, np.array([*x, *y], dtype=np.uint64), np.array([*x.values(), *y.values()]), 2, registers=4096)
    assert abs((signed[0] == signed[1]).mean() - exact) < 0.03


def test_word_hashes_ignore_place_and_case():
    data = np.frombuffer("Straße word  WORD\tstraße wordy".encode(), dtype=np.uint8)
    _, h = near_dups.word_hashes(data)
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(300, 200), (300, 250), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = defaultdict(set)
    for r in near_dups.components(df).collect():
        got[r["root"]].add(r["id"])
    assert {k: len(v) for k, v in got.items()} == {0: 40, 100: 39, 200: 2}


def test_keep_one_and_edges(spark, documents):
    text = "a text that is long enough for a few shingles of five words each"
    rows = [(5, text), (3, text), (3, text), (9, text + " more"), (1, "something else altogether that nobody copied from here"), (7, None), (8, "")]
    docs = documents(rows, extra=("id", "root", "class_id", "shingles"))
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7]
    sizes = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dups.classes(docs).collect()}
    assert sizes[9] == (3, 4) and sizes[8] == (7, 2) and sizes[1] == (1, 1)
    assert near_dups.classes(documents(rows).limit(0)).count() == near_dups.keep_one(documents(rows).limit(0)).count() == 0
    nulls = documents([(None, text, "en", "s"), (None, text, "en", "s"), (4, text)])
    assert [r["doc_id"] for r in near_dups.keep_one(nulls).collect()] == [4]


def test_wide_groups_keep_pairs_that_meet_in_one_band(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dups, "DIVIDE", 3)
    rng = random.Random(8)
    lists = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(12)]
    lists += [[*w[:98], "an", "end"] for w in lists]
    rows = sorted(((" ".join(w) for w in lists)), key=lambda t: hashlib.md5(t.encode()).digest())
    first = rows[0].split()[:90]  # the leader is compared with all anyway
    rows = [(i, t) for i, t in enumerate(rows) if i == 0 or t.split()[:90] != first]
    signed = spark.createDataFrame([(i, hashlib.md5(t.encode()).digest(), [7, 1000 + i]) for i, t in rows], "doc_id long, id binary, bands array<long>")
    roots = {bytes(r["id"]): bytes(r["root"]) for r in near_dups.connect(signed, documents(rows)).collect()}
    names = {i: hashlib.md5(t.encode()).digest() for i, t in rows}
    got = {i: roots.get(name, name) for i, name in names.items()}
    want = brute(rows)
    assert len(rows) - len(set(want.values())) == 11
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in want for j in want if i < j)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    often = rng.integers(0, 5, near_dups.SLOTS)
    for n in range(1, 60):
        x = rng.choice(1 << 32, n, replace=False).astype(np.uint32)
        kept = x[:-(-4 * n // 5)]  # exactly 0.8 wherever 5 divides n
        y = np.unique(kept)
        assert np.isin(near_dups.prefix(np.unique(x), often), near_dups.prefix(y, often)).any()


def test_repeated_lines_weigh_no_more(spark, documents):
    rng, rows = random.Random(3), []
    for k in range(30):
        body = [f"b{rng.randrange(9000)}" for _ in range(120)]
        for _ in range(2):
            footer = [f"f{rng.randrange(9000)}" for _ in range(8)]
            rows.append((len(rows), " ".join(body + footer * (2, 10, 30)[k % 3])))
    want = brute(rows)
    assert len(set(want.values())) == 30
    assert {r["doc_id"]: r["class_id"] for r in near_dups.classes(documents(rows)).collect()} == want
