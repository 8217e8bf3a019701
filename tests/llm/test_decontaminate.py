from panelweave.llm import decontaminate, q_decontaminate

ITEM = "What is the capital city of the largest island in the northern sea today"
ROWS = [(1, f"Before it. {ITEM.upper()}! After."), (2, "What is the capital city of the largest island"), (3, None), (4, ""), (5, "yes, NO maybe"),
        (6, "Before " + ITEM.replace(" ", "\n--") + " x " + ITEM), (7, "no may be"), (8, "é Éa naïve naïveté"), (9, "in the northern sea today " + ITEM)]
ITEMS = [(1, ITEM), (2, "no maybe"), (3, None), (4, ""), (5, "É"), (10, ITEM + " and more"), (11, "?!")]


def scan(spark, documents, item_bytes=decontaminate.ITEM_BYTES):
    return decontaminate.scan(documents(ROWS), spark.createDataFrame(ITEMS, "item_id long, text string"), item_bytes=item_bytes)


def test_matches_sql(spark, documents, rows_of, sql_rows):
    from pyspark.sql import functions as F
    expected = sql_rows(q_decontaminate.SQL, documents=documents(ROWS), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    for item_bytes in (decontaminate.ITEM_BYTES, 60):  # one automaton, and several
        out = scan(spark, documents, item_bytes).select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
        assert rows_of(out) == expected


def test_spans_point_into_the_original_text(spark, documents):
    for r in scan(spark, documents).filter("doc_id IN (1, 5, 6)").collect():
        found = [r["text"][s["start"]:s["end"]] for s in r["spans"]]
        assert found == {1: [ITEM.upper()], 5: ["NO maybe"], 6: [ITEM.replace(" ", "\n--"), ITEM]}[r["doc_id"]]


def test_edges(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clash = documents(ROWS, extra=("items", "spans", "n_words", "hits"))
    out = decontaminate.scan(clash, items)
    assert out.columns.count("items") == 1 and out.filter("contaminated").count() == 4
    kept = decontaminate.clean(clash, items)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 7, 8]
    assert decontaminate.clean(documents(ROWS), items.limit(0)).count() == len(ROWS)
    assert decontaminate.scan(documents(ROWS).limit(0), items).count() == 0
    long_text = "filler words " * 100_000 + ITEM
    assert decontaminate.scan(documents([(1, long_text)] * 2), items).select("n_hit").distinct().first()["n_hit"] == 14


def test_items_without_an_id(spark, documents, rows_of, sql_rows):
    from pyspark.sql import functions as F
    items = spark.createDataFrame([*ITEMS, (None, ITEM), (None, "no maybe")], "item_id long, text string")
    expected = sql_rows(q_decontaminate.SQL, documents=documents(ROWS), benchmark=items)
    for item_bytes in (decontaminate.ITEM_BYTES, 60):
        out = decontaminate.scan(documents(ROWS), items, item_bytes=item_bytes).select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
        assert rows_of(out) == expected
