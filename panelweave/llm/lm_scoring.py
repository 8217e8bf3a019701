"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes, counted over the training documents.  A byte that its context
has not shown escapes to the context one byte shorter, in which the symbols of the longer one are excluded (they were
possible there and did not come).  Escapes are estimated by method D: with n occurrences of d symbols in a context, a
symbol seen c times has (2c - 1) / 2n and the escape d / 2n; below order 0 the symbols left are equally likely.  The score
of a text is the log10 probability of its words, A-Z lower-cased, one space between them, and of its end.

A longer context's symbols are among those of its shorter ones, so exclusion needs no lists: the mass left after it is the
shorter context's count less that of the symbols seen in the longer one.  So the value of a (context, symbol) gram is
computed once for the corpus, from tables of grams sorted by their bytes.

How it runs on Spark.  One pass packs documents into blocks of about ``BLOCK_BYTES`` and counts each block's distinct grams
and words into packed cells; grams are dealt into parts by the last two bytes of their context, words by hash.  Cells of a
part are merged, ``FAN`` blocks at a time and then all, so no task sees more than a part's distinct grams; only order 1,
at most 65,536 counts, goes to all tasks.  Values go back to the blocks that hold the gram, and blocks score their
documents.  Nothing is broadcast or collected that grows with the corpus, and what moves grows with it.

Words are counted by a 63-bit hash; among 100 million distinct words the chance of one shared hash is 1 in 2,000.

Defined cases: a null text is empty: only its end is scored; without training documents every byte has 1/256 and every
word count is 0; rows that repeat a document count and are scored as often as they occur; a null doc_id is a training
document; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage
from .near_dups import word_hashes

ORDER = 5
BLOCK_BYTES = 16 << 20
#: Bytes looked at a time inside a block.
CHUNK_BYTES = 2 << 20
#: Blocks whose cells meet in one task.
FAN = 256

_U = np.uint64
_PAD = b"\n"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD_BIT = _U(1) << _U(63)


def canonical(text: bytes) -> bytes:
    """Lower-cased words with one space between them."""
    return b" ".join(text.translate(_FOLD).split())


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, the first of them sorted 64-bit keys, compressed byte plane by byte plane."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for k, array in enumerate(arrays):
        if k == 0:
            array = np.diff(array, prepend=_U(0))
        planes = np.ascontiguousarray(np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T).tobytes()
        body = pa.Codec("zstd", 1).compress(planes, asbytes=True)
        out += [len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for k, kind in enumerate(types):
        size = int.from_bytes(data[at:at + 8], "little")
        width = np.dtype(kind).itemsize
        raw = pa.Codec("zstd").decompress(data[at + 8:at + 8 + size], n * width, asbytes=True)
        array = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(kind).reshape(n)
        out.append(np.cumsum(array, dtype=np.uint64) if k == 0 else array)
        at += 8 + size
    return out


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(keys) == 1:
        return keys[0], counts[0].astype(np.int64)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")  # runs that are sorted already are merged
    key, count = key[order], np.concatenate(counts).astype(np.int64)[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


class Block:
    """Documents of one block: grams and words, by chunks."""

    def __init__(self, texts: list[bytes], train: list[bool], order: int) -> None:
        self.texts, self.train, self.order = texts, np.array(train, dtype=bool), order

    def chunks(self) -> Iterator[tuple[int, int]]:
        at = size = 0
        for i, text in enumerate(self.texts):
            size += len(text) + self.order + 1
            if size >= CHUNK_BYTES:
                yield at, i + 1
                at, size = i + 1, 0
        if at < len(self.texts):
            yield at, len(self.texts)

    def keys(self, a: int, b: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """((key, document) of grams, (key, document) of words) of documents a to b; documents count from a."""
        k, part = self.order, self.texts[a:b]
        data = np.frombuffer(b"".join(_PAD * k + t + _PAD for t in part), dtype=np.uint8)
        sizes = np.array([len(t) + 1 for t in part])
        starts = np.cumsum(sizes + k) - (sizes + k)
        code = np.zeros(len(data) - k, dtype=np.uint64)
        for i in range(k + 1):
            code = (code << _U(8)) | data[i:len(data) - k + i]
        document = np.repeat(np.arange(b - a), sizes)
        place = np.arange(len(document)) + k * document
        at, word = word_hashes(data)
        return (code[place], document), (word | _WORD_BIT, np.searchsorted(starts, at, side="right") - 1)

    def sorted_chunks(self) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
        """For each chunk: a, b and, of grams and of words, (distinct keys, their counts, documents in order of key)."""
        for a, b in self.chunks():
            found = []
            for key, document in self.keys(a, b):
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
                found.append((key[first], np.diff(first, append=len(key)), document[order].astype(np.int32)))
            yield a, b, found

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the block in order, with their counts in training documents."""
        keys, counts = [], []
        for a, b, found in self.sorted_chunks():
            for key, times, document in found:
                seen = np.add.reduceat(self.train[a:b][document].astype(np.int64), np.cumsum(times) - times) if len(key) else times
                keys.append(key)
                counts.append(seen)
        return _merge(keys, counts)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of a key: grams by the last two bytes of their context, words by their hash."""
    word = keys >= _WORD_BIT
    pair = (keys >> _U(8)) & _U(0xFFFF)
    spread = np.where(word, keys ^ (keys >> _U(29)), pair * _U(0x9E3779B97F4A7C15) >> _U(20))
    return (spread % _U(parts)).astype(np.int64) + np.where(word, parts, 0)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys) of each part that has keys; places stay in order of key."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)) if len(keys) else np.zeros(1, dtype=np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[order[a]]), order[a:b]


#: Kinds of rows of the first pass.
DOCS, CELLS, PAIRS = 0, 1, 2


def _docs_body(ids: pa.Array, train: list[bool], texts: list[bytes]) -> bytes:
    table = pa.table({"doc_id": ids, "train": pa.array(train), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _first_pass(order: int, parts: int, block_bytes: int):
    """(doc_id, train, text) to the rows of blocks."""
    def rows(ids: pa.Array, train: list[bool], texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        keys, counts = Block(texts, train, order).cells()
        yield DOCS, 0, _docs_body(ids, train, texts)
        grams = keys < _WORD_BIT
        low = np.bincount((keys[grams] & _U(0xFFFF)).astype(np.int64), counts[grams], minlength=1).astype(np.int64)
        seen = np.flatnonzero(low)
        yield PAIRS, 0, pack(seen.astype(np.uint64), low[seen])
        for part, at in by_part(keys, parts):
            yield CELLS, part, pack(keys[at], counts[at].astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        train: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            block = int.from_bytes(np.random.default_rng().bytes(7), "little")
            made = list(rows(pa.concat_arrays(ids), train, texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in made], pa.int32()), pa.array([block] * len(made), pa.int64()),
                 pa.array([r[1] for r in made], pa.int32()), pa.array([r[2] for r in made], pa.binary())], ["kind", "block", "part", "body"])

        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                texts.append(canonical(text))
                size += len(texts[-1]) + order + 1
                if size >= block_bytes:
                    ids.append(batch.column(0).slice(at, i + 1 - at))
                    train += batch.column(1).slice(at, i + 1 - at).to_pylist()
                    yield flush()
                    ids, train, texts, size, at = [], [], [], 0, i + 1
            if at < batch.num_rows:
                ids.append(batch.column(0).slice(at))
                train += batch.column(1).slice(at).to_pylist()
        if texts:
            yield flush()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0).to_pylist():
            pair, n = unpack(body, np.uint64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])


def _merged(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    found = [unpack(body, np.uint64, kind) for body in table.column("body").to_pylist()]
    return _merge([k for k, _ in found], [c for _, c in found])


def _merge_some(table: pa.Table) -> pa.Table:
    keys, counts = _merged(table, np.uint32)
    return pa.table({"part": table.column("part").slice(0, 1), "body": pa.array([pack(keys, counts.astype(np.uint64))], pa.binary())})


def gram_values(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each gram's last byte after its other bytes.

    ``keys`` hold all grams whose contexts end in the pairs of bytes they end in; ``pairs`` (256 x 256) are the counts of
    order 1 over the corpus.
    """
    def log(x: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(x, 1e-300))

    c0 = pairs.sum(axis=0)
    n0, d0 = c0.sum(), (c0 > 0).sum()
    if not n0:
        return np.full(len(keys), -np.log10(256))
    below = np.full(256, -np.log10(max(256 - d0, 1)))  # with the symbols of order 0 excluded
    value = np.where(c0 > 0, log((2 * c0 - 1) / (2 * n0)), np.log10(d0 / (2 * n0)) + below)

    def step(c, n, d, e, seen, parent_c, parent_n, parent_d, parent_below, parent_value):
        """Values with and without the context's own symbols excluded, from those one order below."""
        mass, rest = parent_n - e, parent_d - d
        escape = np.where(parent_c > 0, log((2 * parent_c - 1) / np.maximum(2 * mass, 1)), log(rest / np.maximum(2 * mass, 1)) + parent_below)
        below = np.where(rest == 0, parent_below, escape)
        here = np.where(c > 0, log((2 * c - 1) / np.maximum(2 * n, 1)), log(d / np.maximum(2 * n, 1)) + below)
        return below, np.where(seen, here, parent_value)

    n, d = pairs.sum(axis=1), (pairs > 0).sum(axis=1)
    e = np.where(pairs > 0, c0[None, :], 0).sum(axis=1)
    c, (n_, d_, e_) = pairs, (x[:, None] for x in (n, d, e))
    below, value = step(c, n_, d_, e_, n_ > 0, c0[None, :], n0, d0, below[None, :], value[None, :])
    tables = [(keys, counts)]
    links = []
    for k in range(order - 1, 1, -1):
        low = tables[-1][0] & ((_U(1) << _U(8 * (k + 1))) - _U(1))
        key, back = np.unique(low, return_inverse=True)
        links.append(back)
        tables.append((key, np.bincount(back, tables[-1][1], minlength=len(key)).astype(np.int64)))
    at = (tables[-1][0] & _U(0xFFFF)).astype(np.int64)
    links.append(at)
    above = (pairs.ravel(), np.repeat(n, 256), np.repeat(d, 256), below.ravel(), value.ravel())
    for (key, c), back in zip(reversed(tables), reversed(links), strict=True):
        pc, pn, pd_, pb, pv = (x[back] for x in above)
        context, of = np.unique(key >> _U(8), return_inverse=True)
        n = np.bincount(of, c, minlength=len(context))[of]
        d = np.bincount(of, c > 0, minlength=len(context))[of]
        e = np.bincount(of, np.where(c > 0, pc, 0), minlength=len(context))[of]
        below, value = step(c, n, d, e, n > 0, pc, pn, pd_, pb, pv)
        above = (c, n, d, below, value)
    return value


def _model(pairs: Broadcast, parts: int, order: int, counts_as: type):
    """Cells of one part to its model: keys and values (words: counts), and sums over its words."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, counts = _merged(table, counts_as)
        values, total, known = counts.astype(np.float64), int(counts.sum()), int((counts > 0).sum())
        if part < parts:
            values, total, known = gram_values(keys, counts, pairs.value, order), 0, 0
        return pa.table({"part": pa.array([part], pa.int32()), "body": pa.array([pack(keys, values)], pa.binary()),
                         "total": pa.array([total], pa.int64()), "known": pa.array([known], pa.int64())})

    return run


def _value_type(part: int, parts: int) -> type:
    return np.float32 if part < parts else np.float64


def _answer(parts: int):
    """The values of each block's keys of one part, in order of key."""
    def run(cells: pa.Table, model: pa.Table) -> pa.Table:
        out = []
        if cells.num_rows:
            keys, values = unpack(model.column("body")[0].as_py(), np.uint64, np.float64)
            kind = _value_type(model.column("part")[0].as_py(), parts)
            for body in cells.column("body").to_pylist():
                found = values[np.searchsorted(keys, unpack(body, np.uint64, np.uint32)[0])].astype(kind)
                out.append(pack(np.zeros(len(found), dtype=np.uint64), found))
        return pa.table({"block": cells.column("block"), "part": cells.column("part"), "body": pa.array(out, pa.binary())})

    return run


def _score(order: int, parts: int, n: int, v: int, ends: int):
    """Documents of one block, with the values of its keys, to their scores."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        bodies = dict(zip(answers.column("part").to_pylist(), answers.column("body").to_pylist(), strict=True))
        table = pa.ipc.open_stream(docs.column("body")[0].as_py()).read_all()
        block = Block(table.column("text").to_pylist(), table.column("train").to_pylist(), order)
        chunks = list(block.sorted_chunks())
        keys = _merge([k for _, _, found in chunks for k, _, _ in found], [c for _, _, found in chunks for _, c, _ in found])[0]
        values = np.zeros(len(keys))
        for part, at in by_part(keys, parts):
            values[at] = unpack(bodies[part], np.uint64, _value_type(part, parts))[1]
        score, base, words, known = (np.zeros(len(block.texts)) for _ in range(4))
        for a, b, ((gram, times, gram_doc), (word, word_times, word_doc)) in chunks:
            score[a:b] = np.bincount(gram_doc, np.repeat(values[np.searchsorted(keys, gram)], times), minlength=b - a)
            count = np.repeat(values[np.searchsorted(keys, word)], word_times)
            base[a:b] = np.bincount(word_doc, np.log10((count + 1) / (n + v + 1)), minlength=b - a)
            words[a:b] = np.bincount(word_doc, minlength=b - a)
            known[a:b] = np.bincount(word_doc, count > 0, minlength=b - a)
        size = len(block.texts)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": pa.array(~block.train), "n_tokens": pa.array(words.astype(np.int64) + 1),
            "n_known": pa.array(known.astype(np.int64) + (ends > 0)), "train_tokens": pa.array(np.full(size, n, dtype=np.int64)),
            "base_score": pa.array(base + np.log10((ends + 1) / (n + v + 1))), "score": pa.array(score)})

    return run


def score(docs: DataFrame, train: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with what is learnt from the rows where ``train`` is true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram words) and score (this model).  Orders
    from 2 to 6.  ``parts`` deals out the grams and the words; by default as many as there are shuffle partitions.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    spark = docs.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    learn = F.coalesce(train, F.lit(True))
    rows = docs.select("doc_id", learn.alias("train"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    first = stage(rows.mapInArrow(_first_pass(order, parts, block_bytes), "kind int, block long, part int, body binary"), ["kind"])
    packed = first.filter(F.col("kind") == DOCS).select("block", "body")
    cells = first.filter(F.col("kind") == CELLS).select("block", "part", "body")
    ends = docs.filter(learn).count()
    # order 1: at most 65,536 rows
    low = first.filter(F.col("kind") == PAIRS).select("body").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.zeros(65536, dtype=np.int64)
    for row in low.collect():
        pairs[row["pair"]] = row["n"]
    shared = spark.sparkContext.broadcast(pairs.reshape(256, 256))
    salts = -(-max(packed.count(), 1) // FAN)
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    merged, counts_as = cells.select("part", "body"), np.uint32
    if salts > 1:
        merged = cells.groupBy("part", salt.alias("salt")).applyInArrow(_merge_some, "part int, body binary")
        counts_as = np.uint64
    model = stage(merged.groupBy("part").applyInArrow(_model(shared, parts, order, counts_as), "part int, body binary, total long, known long"))
    sums = model.agg(F.sum("total").alias("n"), F.sum("known").alias("v")).first()
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    spread = model.select("part", "body", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    answers = (cells.withColumn("salt", salt).groupBy("part", "salt").cogroup(spread.groupBy("part", "salt"))
               .applyInArrow(_answer(parts), "block long, part int, body binary"))
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, parts, n, v, ends),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
