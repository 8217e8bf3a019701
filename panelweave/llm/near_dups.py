"""Near-duplicates by ProbMinHash.

ProbMinHash throws the arrivals of each of a text's five-word shingles, a Poisson process whose rate is its weight, into
``REGISTERS`` registers; a register keeps the shingle that arrived first, and a process ends once its next arrival is later
than every register (early termination).  Two texts agree in a register with the probability Jaccard similarity of their
weighted shingles.  Every distinct shingle weighs 1, however often it occurs, so this is the Jaccard similarity of the
shingle sets.  Registers are cut into bands; texts that agree in a band meet, and their shingle sets are compared exactly:
a link is a Jaccard similarity of at least ``SIMILARITY``.

Equal texts are one class from the start.  Texts that agree in a band are a group.  First, a group is compared with one leader, so a group of n sends n rows, not
n * n pairs.  What is then still in another class than most of its group, is compared with the rest of the group inside
tasks, in tiles of ``TILE`` by ``TILE`` texts; only links leave a task.  Groups of more than ``DIVIDE`` classes (texts
that share a frequent passage and little else) are divided by an exact prefix filter before that: with shingles in one order,
rarest first, two sets as similar as 0.8 share one of their first n - ceil(0.8 n) + 1, n being the size of each.  So texts meet
by a shingle of their prefixes, and every pair that is a link is still compared.  Classes are the connected components of
the links, named by their smallest doc_id.

Defined cases: words are split at white space, A-Z lower-cased; a text of fewer than five words is one shingle; texts
without words (null, empty, blank) are one class; rows that repeat a doc_id and text are one document; a doc_id with
several texts is as many documents; null doc_ids are grouped like others; other columns are ignored by ``classes`` and
carried by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, drop_staged, small_join, stage

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Texts on either side of a tile, and differing classes from which a group is divided by its texts' rarest shingles.
TILE = 1024
DIVIDE = 4096
#: Slots by which shingles are counted for their order; shingles of a slot count as one there.
SLOTS = 1 << 18
#: md5 of the empty text.
NO_WORDS = bytes.fromhex("d41d8cd98f00b204e9800998ecf8427e")

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer of integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done:done + take] = out[:take] * _U(step)
        step, done = step * step % (1 << 64), done * 2
    return out


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of every word, hash of every word) in bytes; words of one text must not touch those of the next."""
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_FOLD[data]] * _powers(_BASE, len(data)), out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * _powers(_BACK, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(text: np.ndarray) -> np.ndarray:
    """Hashes of the distinct shingles of one text's bytes."""
    _, words = word_hashes(text)
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    width = min(WIDTH, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = mix(total + words[k:len(words) - width + 1 + k] + _U(k))
    return np.unique(total)


def prob_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers (texts x registers) of weighted sets: ``element`` of set ``owner`` with ``weight``.

    Every set must have an element.  Arrivals are drawn for all sets at a time, round by round.
    """
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, dtype=np.uint64)
    at = np.zeros(len(element))
    state = element.copy()
    latest = np.full(texts, np.inf)
    while len(state):
        state = mix(state + _U(0x9E3779B97F4A7C15))
        at = at - np.log(((state >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weight
        live = at < latest[owner]
        owner, element, weight, at, state = owner[live], element[live], weight[live], at[live], state[live]
        place = owner * registers + (mix(state ^ _U(0xD1B54A32D192ED03)) % _U(registers)).astype(np.int64)
        np.minimum.at(first, place, at)
        won = at == first[place]
        winner[place[won]] = element[won]
        latest = first.reshape(texts, registers).max(axis=1)
    return winner.reshape(texts, registers)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed shingles of each text (id, keys, text)."""
    for batch in batches:
        packed = [_packed(shingles(np.frombuffer(t.as_buffer(), dtype=np.uint8))) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "keys", "shingles"])


def _packed(hashes: np.ndarray) -> bytes:
    return np.unique((hashes >> _U(32)).astype(np.uint32)).tobytes()


def band_keys(found: list[np.ndarray]) -> np.ndarray:
    """Band keys (texts x bands) of texts given as shingle hashes, none of them empty."""
    element = np.concatenate(found)
    signed = prob_min_hash(np.repeat(np.arange(len(found)), [len(h) for h in found]), element, np.ones(len(element)), len(found))
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(found), BANDS))
    for r in range(ROWS):
        keys = mix(keys + signed[:, r::ROWS])
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, id, text) to (doc_id, id, bands); a text without words has the id of the empty text and no bands."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [shingles(np.frombuffer(t.as_buffer(), dtype=np.uint8)) for t in part.column(2)]
            full = [bool(len(h)) for h in found]
            keys = band_keys([f for f, ok in zip(found, full, strict=True) if ok]) if any(full) else np.zeros((0, BANDS), dtype=np.uint64)
            ends = np.concatenate(([0], np.cumsum(full))).astype(np.int32) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            ids = pa.array([i if ok else NO_WORDS for i, ok in zip(part.column(1).to_pylist(), full, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), ids, bands], ["doc_id", "id", "bands"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard similarity of the shingle sets of pairs (a, b, of_a, of_b)."""
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            p, q = np.frombuffer(x.as_buffer(), dtype=np.uint32), np.frombuffer(y.as_buffer(), dtype=np.uint32)
            if min(len(p), len(q)) < SIMILARITY * max(len(p), len(q)):
                continue
            both = np.sort(np.concatenate((p, q)), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = shared / (len(both) - shared)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "similarity"])


def _ragged(lists: list[np.ndarray], some: np.ndarray, member: np.ndarray) -> np.ndarray:
    """For each of the lists ``some``: how many of its values are in ``member``."""
    picked = [lists[i] for i in some]
    ends = np.cumsum([len(x) for x in picked])
    hits = np.concatenate(([0], np.cumsum(np.isin(np.concatenate(picked), member))))
    return hits[ends] - hits[np.concatenate(([0], ends[:-1]))]


def _tile(table: pa.Table) -> pa.Table:
    """Links between the probes and the targets of one tile (key, probe, id, root, keys, shingles) of a group.

    Pairs of one class are left out, and those that meet in another group with a smaller key.
    """
    probe = np.array(table.column("probe").to_pylist(), dtype=bool)
    here, ids = table.column("key")[0].as_py(), table.column("id").to_pylist()
    _, root = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)
    keys = [np.array([k for k in x if k < here], dtype=np.int64) for x in table.column("keys").to_pylist()]
    sets = [np.frombuffer(x, dtype=np.uint32) for x in table.column("shingles").to_pylist()]
    sizes, targets, found = np.array([len(x) for x in sets]), np.flatnonzero(~probe), []
    for x in np.flatnonzero(probe):
        small, large = np.minimum(sizes[x], sizes[targets]), np.maximum(sizes[x], sizes[targets])
        some = targets[(root[targets] != root[x]) & (small >= SIMILARITY * large)]
        if len(some) and len(keys[x]):
            some = some[_ragged(keys, some, keys[x]) == 0]
        if len(some):
            shared = _ragged(sets, some, sets[x])
            similarity = shared / (sizes[x] + sizes[some] - shared)
            found += [(ids[x], ids[y], v) for y, v in zip(some, similarity, strict=True) if v >= SIMILARITY]
    return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary()),
                     "similarity": pa.array([f[2] for f in found], pa.float64())})


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of text ids, those that are similar enough, with their similarity."""
    own = sets.select("id", "shingles")
    both = (pairs.join(own.withColumnsRenamed({"id": "a", "shingles": "of_a"}), "a")
            .join(own.withColumnsRenamed({"id": "b", "shingles": "of_b"}), "b").select("a", "b", "of_a", "of_b"))
    return both.mapInArrow(_similar, "a binary, b binary, similarity double").filter(F.col("similarity") >= SIMILARITY)


def links_inside(members: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different classes of the open groups: what is not in a group's largest class against all its members."""
    sized = groups.select("key", "main", F.ceil(F.col("members") / TILE).cast("int").alias("rows"),
                          F.ceil(F.col("outside") / TILE).cast("int").alias("columns"))
    rows = small_join(members, sized, ["key"])
    place = F.xxhash64("id")
    row, column = F.pmod(place, F.col("rows")).cast("int"), F.pmod(place, F.col("columns")).cast("int")
    targets = rows.select("key", "id", "root", F.lit(False).alias("probe"), row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    probes = rows.filter("root <> main").select("key", "id", "root", F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), column.alias("column"))
    filled = small_join(targets.unionByName(probes), sets, ["id"])
    return filled.groupBy("key", "row", "column").applyInArrow(_tile, "a binary, b binary, similarity double")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root), staged: the smallest id that every end of an edge is connected with; ids without an edge are left out.

    Neighbours are handed to the smallest one among them, first those larger than oneself, then the others, until
    nothing changes; the number of rounds follows the logarithm of the number of edges.
    """
    both = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _checksum(both)
    while seen[0]:
        around = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = around.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        after = stage(small.select("e.a", "e.b").filter("a <> b").distinct())
        now = _checksum(after)
        drop_staged(both)
        both = after
        if now == seen:
            break
        seen = now
    return both.select(F.col("a").alias("id"), F.col("b").alias("root"))


def extend(roots: DataFrame, new: DataFrame) -> DataFrame:
    """``roots`` (id, root) after the links ``new`` (a, b) have come; both staged."""
    ends = new.select("a", "b")
    for end in ("a", "b"):
        ends = small_join(ends, roots.withColumnsRenamed({"id": end, "root": "_root"}), [end], "left")
        ends = ends.withColumn(end, F.coalesce("_root", end)).drop("_root")
    more = components(ends)
    moved = small_join(roots, more.select(F.col("id").alias("root"), F.col("root").alias("_root")), ["root"], "left")
    moved = moved.select("id", F.coalesce("_root", "root").alias("root"))
    return stage(moved.unionByName(more.join(roots.select("id"), "id", "left_anti")))


def _id() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the root of their id, their own id where it has none."""
    return small_join(members, roots, ["id"], "left").withColumn("root", F.coalesce("root", "id"))


def _open_groups(left: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, id, root) of groups that still hold several classes; (key, members, outside, classes, main) of these.

    ``main`` is the largest class, ``outside`` the number of members that are not in it.
    """
    rooted = stage(_rooted(left.select("key", "id"), roots))
    classes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    groups = classes.groupBy("key").agg(F.sum("n").alias("members"), F.count("*").alias("classes"), F.max(F.struct("n", "root")).alias("most"))
    groups = stage(groups.filter("classes > 1").select(
        "key", "members", "classes", (F.col("members") - F.col("most.n")).alias("outside"), F.col("most.root").alias("main")))
    return small_join(rooted, groups.select("key"), ["key"]), groups


def connect(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, root), staged: the class of every text that is linked to another text."""
    texts = signed.groupBy("id").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands")).filter(F.size("bands") > 0)
    members = stage(texts.select("id", "doc", F.explode("bands").alias("key")))
    groups = stage(members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter("n > 1").select("key", "leader"))
    met = stage(small_join(members, groups, ["key"]))
    drop_staged(members)
    wanted = stage(met.groupBy("id").agg(F.first("doc").alias("doc"), F.array_sort(F.collect_set("key")).alias("keys")))
    of = docs.select(F.col("doc_id").alias("_pw_doc"), _id().alias("_pw_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = small_join(of, wanted, F.col("_pw_doc").eqNullSafe(F.col("doc")) & (F.col("_pw_id") == F.col("id")))
    sets = stage(own.select("id", "keys", "text").mapInArrow(_sets, "id binary, keys array<long>, shingles binary").dropDuplicates(["id"]))
    pairs = met.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    roots = components(links(pairs, sets))
    members, groups = _open_groups(met, roots)
    found = links_inside(members, groups.filter(F.col("classes") <= DIVIDE), sets)
    wide = groups.filter(F.col("classes") > DIVIDE).select("key")
    if not wide.isEmpty():
        found = found.unionByName(_links_of_wide(members.join(wide, "key").select("id").distinct(), roots, sets))
    return extend(roots, stage(found))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n) of the shingles of a task's texts (id, shingles)."""
    n = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for x in batch.column(1):
            np.add.at(n, np.frombuffer(x.as_buffer(), dtype=np.uint32) % SLOTS, 1)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["slot", "n"])


def prefix(shingles: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, of which two sets of a similarity of ``SIMILARITY`` or more share at least one."""
    size = len(shingles) - math.ceil(SIMILARITY * len(shingles) - 1e-9) + 1
    return shingles[np.lexsort((shingles, often[shingles % SLOTS]))[:size]]


def _prefixes(often: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [prefix(np.frombuffer(x.as_buffer(), dtype=np.uint32), often).astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), batch.column(1)], ["id", "keys", "shingles"])
    return run


def _links_of_wide(wide: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the texts ``wide`` (id), which meet by the shingles of their prefixes instead of by bands."""
    own = stage(small_join(sets.select("id", "shingles"), wide, ["id"]))
    often = np.zeros(SLOTS, dtype=np.int64)
    for slot, n in own.mapInArrow(_slots, "slot long, n long").groupBy("slot").agg(F.sum("n")).toLocalIterator():
        often[slot] = n
    parts = stage(own.mapInArrow(_prefixes(often), "id binary, keys array<long>, shingles binary"))
    return links_inside(*_open_groups(parts.select("id", F.explode("keys").alias("key")), roots), parts)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, id, bands) for every row, staged; id is the md5 of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return stage(rows.mapInArrow(_signatures, f"doc_id {kind}, id binary, bands array<long>"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, id, root, staged), (roots: root, class_id, class_text, class_size, staged)."""
    signed = sign(docs)
    rows = stage(_rooted(signed.select("doc_id", "id"), connect(signed, docs)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first")
    roots = rows.groupBy("root").agg(first, F.count("*").alias("class_size"))
    return rows, stage(roots.select("root", F.col("first.doc_id").alias("class_id"), F.col("first.id").alias("class_text"), "class_size"))


def classes(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: doc_id, class_id (the smallest doc_id of its class) and class_size (rows)."""
    rows, roots = _classes(docs)
    shared = stage(roots.filter("class_size > 1"))
    out = small_join(rows, shared, ["root"], "left")
    alone = F.col("class_size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of its smallest doc_id."""
    rows, roots = _classes(docs)
    shared = stage(roots.filter("class_size > 1"))
    inside = stage(small_join(rows, shared, ["root"]))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("id") == F.col("class_text"))
    gone = stage(inside.filter(~first).select(F.col("doc_id").alias("_pw_doc"), F.col("id").alias("_pw_gone")).distinct())
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE)) == ""
    own = docs.withColumn("_pw_id", F.when(blank, F.lit(NO_WORDS)).otherwise(_id()))
    kept = small_join(own, gone, F.col("doc_id").eqNullSafe(F.col("_pw_doc")) & (F.col("_pw_id") == F.col("_pw_gone")), "left_anti")
    repeated = inside.filter(first).groupBy("root").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_pw_id"])
    return kept.drop("_pw_id")
