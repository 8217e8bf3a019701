import random

import pytest

from panelweave.llm import q_token_counts, token_counts

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


def library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=q_token_counts.default_model())
    return [len(ids) for ids in model.encode(texts, num_threads=1)]


def test_equal_to_the_library_on_odd_texts(monkeypatch):
    random.seed(4)
    parts = [" ", "  ", "\n", "a", "the", "▁", "é", "<s>", "</s>", "<unk>", "\t", "漢", "1", "234", "\x00", "\r\n", "　", " \n", "\n ", "\U0001f600", "Word"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(5000)]
    path = q_token_counts.default_model()
    monkeypatch.setattr(token_counts, "MEMORY", 500)  # the memory is emptied on the way
    counter = token_counts.Counter(path, token_counts.prove(path))
    got = [n for at in range(0, 5000, 500) for n in counter.counts(texts[at:at + 500])]
    assert got == library(texts)


def test_proven_words_are_one_token():
    proven = sorted(token_counts.prove(q_token_counts.default_model()))
    assert len(proven) > 10_000 and set(library(proven)) == {1}


def test_edges(spark, documents):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "Hello world"), (4, "Hello world")]
    docs = documents(rows, extra=("n_tokens", "over_limit"))
    out = token_counts.count_tokens(docs, q_token_counts.default_model())
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    counts = library([t or "" for _, t in rows])
    assert got == sorted((i, len(t or ""), n, n > 4096) for (i, t), n in zip(rows, counts, strict=True)) and got[2][3]
    assert token_counts.count_tokens(docs.limit(0), q_token_counts.default_model()).count() == 0
