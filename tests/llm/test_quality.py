import re

import pytest
from pyspark.sql import functions as F

from panelweave.llm import q_quality, quality

CLEAN = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of herbs and roots."
ROWS = [(1, CLEAN), (2, None), (3, ""), (4, " \n\t "), (5, "one two three"), (6, "a b c d e " * 30), (7, "x# " * 40), (8, CLEAN.upper()),
        (9, "\n".join(["Same line here"] * 6 + [CLEAN])), (10, " word word2 " + CLEAN), (11, CLEAN + "\n" + CLEAN), (12, "日本語のテキスト " * 3 + CLEAN)]


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.sub(r"[\x20\x09-\x0d]", "", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_match_definition_and_sql(spark, documents, rows_of, sql_rows):
    docs = documents(ROWS)
    out = quality.judge(docs)
    for r in out.collect():
        n, chars, symbols, dup, repeat = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows_of(out.select(*columns)) == sql_rows(q_quality.SQL, documents=docs)


def test_cascade_keeps_what_all_rules_pass(spark, documents):
    docs = documents(ROWS)
    assert sorted(r["doc_id"] for r in quality.keep(docs).collect()) == sorted(r["doc_id"] for r in quality.judge(docs).filter("kept").collect()) == [1, 10, 12]


def test_order_is_rejections_per_cost(spark, documents):
    order = quality.plan(documents(ROWS * 20))
    gains = [rate / cost for _, cost, rate in order]
    assert gains == sorted(gains, reverse=True) and len(order) == 6
    rates = {name: rate for name, _, rate in order}
    assert 0.1 < rates["too_short"] < 0.6 and 0 < rates["symbols"] < rates["too_short"]


def test_later_rules_are_not_evaluated(spark, documents):
    """A rule behind one that a row fails would raise; rules evaluated in all are fewer than rows times rules."""
    docs = documents(ROWS)
    text = F.col("text")

    def rules(s):
        words_of_few = quality.Rule("few", s["n_words"] < 10_000)
        return [words_of_few, quality.Rule("raises", F.raise_error(F.lit("evaluated")).cast("boolean"))]

    assert [r[0] for r in docs.select(quality.cascade(text, ["few", "raises"], rules)).collect()] == ["few"] * len(ROWS)
    with pytest.raises(Exception, match="evaluated"):
        docs.select(quality.cascade(text, ["raises", "few"], rules)).collect()
    order = [name for name, _, _ in quality.plan(docs)]
    first = [r[0] for r in docs.select(quality.cascade(text, order)).collect()]
    evaluated = sum(order.index(name) + 1 if name else len(order) for name in first)
    assert evaluated < 0.8 * len(ROWS) * len(order)


def test_edges(spark, documents):
    clash = documents(ROWS, extra=("kept", "n_words", "failed_rule"))
    assert quality.judge(clash).select("kept").distinct().count() == 2
    assert quality.keep(clash).columns == clash.columns
    assert quality.judge(documents(ROWS).limit(0)).count() == quality.keep(documents(ROWS).limit(0)).count() == 0
    assert quality.keep(documents([(1, CLEAN)] * 3)).count() == 3
    long_text = " ".join(f"w{i}" for i in range(60_000))
    assert quality.judge(documents([(1, long_text)])).first()["kept"]
