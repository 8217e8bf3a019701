import random
import re
import sys
from pathlib import Path

import corpus_pipeline
from panelweave.llm import q_mixing

sys.path.insert(0, str(Path(__file__).parent))
import test_line_dedup  # noqa: E402
import test_near_dups  # noqa: E402
import test_quality  # noqa: E402

ITEM = "Which of the seven rivers in the northern valley carries most of its water in spring"


def corpus():
    random.seed(12)
    vocabulary = [f"word{i}" for i in range(2000)]
    rows = []
    for i in range(120):
        words = random.choices(vocabulary, k=random.randint(12, 120))
        lines = [" ".join(words[k:k + 15]) for k in range(0, len(words), 15)]
        if i % 7 == 0:
            lines.insert(1, "All rights reserved by the owners of this page")
        if i % 11 == 0:
            lines[-1] += " " + ITEM.lower()
        rows.append("\n".join(lines))
        if i % 9 == 0:
            rows.append(rows[-1] + " more")
        if i % 10 == 0:
            rows.append(rows[-1])
    rows += ["too short", "", None, "x# " * 40, " ".join(["again and again the same words"] * 20)]
    return [(i, t, random.choice(["en", "de"]), f"src{random.randint(0, 4)}") for i, t in enumerate(rows)]


def keeps(text):
    n, chars, symbols, dup, repeat = test_quality.brute(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    letters, capitals = len(re.findall("[A-Za-z]", text or "")), len(re.findall("[A-Z]", text or ""))
    return not (n < 10 or 100 * repeat > 20 * n or 100 * symbols > 8 * chars or (100 * dup > 30 * len(lines) and dup >= 3)
                or (100 * capitals > 60 * letters and 2 * letters > chars) or chars < 2 * n or chars > 60 * n)


def brute(rows):
    """The stages before the mixture, by definition."""
    left = [r for r in rows if keeps(r[1])]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fold)
    holders: dict = {}
    for i, t, *_ in left:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)])
    left = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x)), *rest) for i, t, *rest in left]
    classes = test_near_dups.brute([(r[0], r[1]) for r in left])
    left = [r for r in left if classes[r[0]] == r[0]]
    words = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(fold))) + " "
    item = words(ITEM).split()
    windows = [" " + " ".join(item[k:k + 10]) + " " for k in range(len(item) - 9)]
    return [r for r in left if not any(w in words(r[1]) for w in windows)]


def test_run_matches_brute_force(spark, documents, tmp_path, rows_of, sql_rows):
    rows = corpus()
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = brute(rows)
    assert 0 < len(left) < len(rows) - 20
    out = corpus_pipeline.run(spark, str(tmp_path))
    text = dict((r[0], r[1]) for r in left)
    assert all(r["text"] == text[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in out.collect())
    got = rows_of(out.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch"))
    assert got == sql_rows(q_mixing.sql(), documents=documents(left))


def test_stages_keep_the_columns_and_take_empty_tables(spark, documents, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    odd = documents([(1, None, None, None), (1, None, None, None), (None, "", "en", "src1"), (2, test_line_dedup.LONG * 3, "en", None)], extra=("key", "root", "epoch"))
    for df in (odd, odd.limit(0)):
        for _, function in corpus_pipeline.STAGES[:-1]:
            assert function(spark, df, str(tmp_path)).columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() >= 0
