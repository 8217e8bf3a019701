import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from panelweave.llm import line_dedup, q_line_dedup

LONG = "This line is long enough to count"


def brute(rows):
    """(doc_id, n_lines, n_dropped, kept_sha256) by definition; doc_ids are distinct."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    lines = {i: (t or "").split("\n") for i, t in rows}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fold)
    for i, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = []
    for i, ls in lines.items():
        kept = [x for x in ls if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        out.append((i, hashlib.sha256("\n".join(kept).encode()).hexdigest(), len(ls) - len(kept), len(ls)))
    return sorted(out, key=str)


ROWS = [(1, f"{LONG}\nother\n{LONG}"), (2, f"  {LONG.upper()}\t\nx"), (3, f"y\n{LONG}\r"), (4, None), (5, ""), (6, "\n\n"),
        (7, "É" * 20 + "\n" + "short"), (8, "É" * 20), (9, "é" * 20), (10, "É" * 20 + "\n"), (11, LONG + " twice only"), (12, LONG + " twice only"),
        (13, "\n".join([LONG] * 200 + ["keep me, I am only here " * 3]))]


def test_matches_definition_and_sql(spark, documents, rows_of, sql_rows):
    docs = documents(ROWS)
    out = line_dedup.decide(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
    assert rows_of(out) == brute(ROWS) == sql_rows(q_line_dedup.SQL, documents=docs)


def test_bitmaps_are_sparse_words(spark, documents):
    row = line_dedup.bitmaps(documents(ROWS + [(14, LONG)])).filter("_pw_doc = 13").first()
    assert [w["word"] for w in row["kept"]] == [0, 1, 2, 3]
    assert sum(bin(w["bits"] & (1 << 64) - 1).count("0") - 1 for w in row["kept"][3:]) == 8  # less the 0 of 0b
    assert [w["bits"] for w in row["kept"][:3]] == [0, 0, 0]  # 200 lines go, the last stays


def test_first_occurrences_are_streamed_off_sorted_ranges(spark, documents):
    """One exchange by range, one sort by hash, document and position, no hash exchange before the first rows."""
    many = documents([(i, f"{LONG}\n{LONG}\nonly in {i:020d}") for i in range(600)])
    lines = line_dedup.line_rows(many, 20)
    first = line_dedup.first_occurrences(lines)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(_pw_hash" in plan and "Sort [_pw_hash" in plan and "Window" in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = first.withColumn("part", F.spark_partition_id()).groupBy("_pw_hash").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n"))
    hot = spread.orderBy(F.desc("n")).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert hot["n"] == 600 and hot["parts"] > 1  # one hash over several partitions
    assert sorted(r["n_dropped"] for r in line_dedup.decide(many).collect()) == [0] + [2] * 599


def test_edges(spark, documents):
    clash = documents(ROWS, extra=("keep_bits", "word", "kept", "bits", "kept_text", "n_lines"))
    out = line_dedup.apply(clash)
    assert out.columns == clash.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    assert len(kept) == len(ROWS) and kept[4]["text"] is None and kept[1]["text"] == "other" and kept[1]["n_chars"] == 5
    assert {r["kept_text"] for r in kept.values()} == {"mine"}
    assert line_dedup.apply(documents(ROWS).limit(0)).count() == 0
    # repeated rows are one document, so two ids are not enough; null ids are one document that never keeps a line
    twice = documents([(1, LONG), (1, LONG), (1, LONG), (2, LONG)])
    assert [r["n_dropped"] for r in line_dedup.decide(twice).collect()] == [0] * 4
    nulls = documents([(None, LONG, "en", "s"), (None, LONG, "en", "s"), (1, LONG), (2, LONG)])
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in line_dedup.decide(nulls).collect()) == [("1", 1), ("2", 0), ("None", 1), ("None", 1)]
