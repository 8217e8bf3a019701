from pyspark.sql import functions as F

from panelweave.llm import chat_threads

MESSAGES = [
    (1, 0, "user", "How do I sort\na large table?\n\nAnd how do I join it?"),
    (1, 1, "assistant", "Use the sort operator."),
    (1, 2, "user", "Ann wrote:\n> And how do  I JOIN it?\n\nThat one first."),
    (1, 3, "assistant", "> Bob wrote:\n>> And how do I join it?\n> That one first.\nUse a hash join."),
    (1, 4, "user", "> Use the sort operator.\nThanks.\n> > nobody said this\nok"),
    (1, 5, "user", "> unknown words\nplain"),
    (1, 6, "user", "> How do I sort a large table?\nrewrapped"),
    (2, 0, "user", "> Use the sort operator.\nother conversation"),
    (2, 1, "user", None), (2, 2, "user", ""), (2, None, "user", "> other conversation\nx"), (None, 1, "user", "lost"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links_and_paths(spark):
    out = {(r["conv_id"], r["turn"]): r for r in chat_threads.link(spark.createDataFrame(MESSAGES, SCHEMA)).collect()}
    assert len(out) == len(MESSAGES)
    reply = {k: r["reply_to"] for k, r in out.items() if k[0] == 1}
    assert reply == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 2, (1, 4): 1, (1, 5): None, (1, 6): 0}
    assert out[1, 3]["path"] == [0, 2, 3] and out[1, 3]["depth"] == 2 and out[1, 3]["n_quotes"] == 3 and out[1, 3]["n_linked"] == 2
    assert out[1, 3]["own_text"] == "Use a hash join." and out[1, 2]["own_text"] == "That one first." and out[1, 4]["own_text"] == "Thanks.\nok"
    assert out[2, 0]["reply_to"] is None and out[2, 1]["own_text"] == "" and out[2, None]["reply_to"] is None


def test_examples_read_reply_by_reply(spark):
    rows = chat_threads.examples(chat_threads.link(spark.createDataFrame(MESSAGES, SCHEMA).filter("conv_id = 1"))).collect()
    found = {r["first_turn"]: [m["text"] for m in r["messages"]] for r in rows}
    assert found[0][1:] == ["That one first.", "Use a hash join.", "rewrapped"] and found[1] == ["Use the sort operator.", "Thanks.\nok"]


def test_long_chain_takes_few_rounds(spark):
    rows = [(1, i, "user", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(70)]
    out = chat_threads.link(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert [r["depth"] for r in out] == list(range(70)) and out[69]["path"] == list(range(70))


def test_quote_levels():
    assert [chat_threads.quote_level(x)[0] for x in ["a > b", ">a", "> >a", ">>> a", "  > a", "-> a", ""]] == [0, 1, 2, 3, 1, 0, 0]


def test_edges(spark):
    messages = spark.createDataFrame(MESSAGES, SCHEMA).withColumns({"reply_to": F.lit("mine"), "key": F.lit("mine"), "level": F.lit(1)})
    out = chat_threads.link(messages)
    assert out.columns.count("reply_to") == 1 and out.select("key").distinct().first()["key"] == "mine"
    assert chat_threads.link(messages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "one two three"), (1, 1, "user", "> one two three\nx"), (1, 1, "user", "> one two three\nx")], SCHEMA)
    assert [r["reply_to"] for r in chat_threads.link(twice).orderBy("turn").collect()] == [None, 0, 0]
