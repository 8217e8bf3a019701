import random
from collections import defaultdict

from pyspark.sql import functions as F

from panelweave.llm import mixing, q_mixing


def test_matches_sql(spark, documents, rows_of, sql_rows):
    random.seed(3)
    rows = [(i, "w " * random.randint(0, 40), random.choice(["en", "de", "fr"]), f"src{random.randint(0, 5)}") for i in range(600)]
    rows += [(600 + i, "w " * 30, "en", "src1") for i in range(300)] + [(2000, None, None, None), (2001, "a b", None, "src1")]
    docs = documents(rows)
    out = q_mixing.mixture(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")
    assert rows_of(out) == sql_rows(q_mixing.sql(), documents=docs)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "d string, l string, tokens long")
    share = {(r["d"], r["l"]): r["share"] for r in mixing.allocate(leaves, ["d", "l"], {}, 400, 1).collect()}
    assert share == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    share = {(r["d"], r["l"]): r["share"] for r in mixing.allocate(leaves.filter("d = 'b' OR l = 'x'"), ["d", "l"], {}, 400, 1).collect()}
    assert share == {("a", "x"): 10, ("b", "x"): 195, ("b", "y"): 195}


def test_prefix_by_digit_groups_equals_sort(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FINE_ROWS", 5)
    random.seed(5)
    rows = [("a" if i % 3 else "b", f"{random.getrandbits(40):010x}" + "0" * 22, random.randint(1, 9), 700 if i % 3 else 90) for i in range(900)]
    got = {r["leaf"]: r["end"] for r in mixing.prefix_ends(spark.createDataFrame(rows, "leaf string, key string, tokens long, rest long"), ["leaf"]).collect()}
    for leaf, rest in (("a", 700), ("b", 90)):
        total, end = 0, None
        for _, key, n, _ in sorted(r for r in rows if r[0] == leaf):
            total += n
            if total > rest:
                break
            end = key
        assert got[leaf] == end


def test_edges(spark, documents):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "d e f")]
    clash = documents(rows, extra=("epoch", "domain", "tokens", "share"))
    levels = {"domain": F.lit("d"), "lang": F.col("lang")}
    out = mixing.select(clash, levels, {}, budget=18, max_epochs=2)
    count = defaultdict(int)
    for r in out.collect():
        count[r["doc_id"]] += 1
        assert r["tokens"] == "mine" and r["domain"] == "d"
    assert count == {1: 4, 4: 2}
    assert mixing.select(documents(rows).limit(0), levels, {}).count() == 0
    assert mixing.select(documents(rows), levels, {("d",): 0}).count() == 0


def test_columns_named_like_the_plan(spark, documents):
    docs = documents([(i, "w " * (1 + i % 9), "en", f"s{i % 3}") for i in range(200)])
    clash = documents([(i, "w " * (1 + i % 9), "en", f"s{i % 3}") for i in range(200)], extra=("full", "end", "rest", "share", "left", "others", "open"))
    plain = sorted(map(tuple, q_mixing.mixture(docs).select("doc_id", "n_tokens", "epoch").collect()))
    out = q_mixing.mixture(clash)
    assert sorted(map(tuple, out.select("doc_id", "n_tokens", "epoch").collect())) == plain
    assert out.select("full", "end").distinct().collect() == [("mine", "mine")]


def test_order_of_siblings_beyond_doubles(spark):
    big = (1 << 60) + 1
    leaves = spark.createDataFrame([("a", big), ("b", big - 1), ("c", 1 << 61)], "s string, tokens long")
    share = {r["s"]: r["share"] for r in mixing.allocate(leaves, ["s"], {}, 3 * (big - 1) + 1, 1).collect()}
    assert share == {"b": big - 1, "a": big - 1, "c": big - 1} or share == {"b": big - 1, "a": big - 1, "c": big}
