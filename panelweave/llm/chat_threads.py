"""Chat formatting by quotation linking.

Each message is read line by line: its quote level is the number of leading ``>``.  Consecutive lines of one level are a
passage; the lines of level 0 are the message's own text, without lines that only announce a quote ("... wrote:").
Passages and their single lines are normalised (A-Z lower-cased, words joined by one space) and hashed.  The original of a
quoted passage is the first message of the conversation that holds it as a paragraph or line of its own text, if that
comes before.  A message replies to the original of its level-1 passages with the most words (the latest, if equal).

Replies make trees.  ``path`` is the list of turns from the tree's first message; in order of path, conversations read
reply by reply.  Paths are joined by doubling: each round appends the path of the message a path starts from, so rounds
follow the logarithm of the depth.  ``examples`` puts the own texts of a tree, in that order, into one row.

No message is compared with all others: one row per (conversation, hash), its first turn, is joined to quoted passages.

Defined cases: a null or empty text has no passages and an empty own text; a message without a linked quote starts a tree;
a conversation without quotes keeps the order of its turns; rows that repeat (conv_id, turn) share their place and their
reply (the smaller turn, if they differ); null turns can neither quote nor be quoted; passages without words are ignored;
input columns named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import stage

_LEVEL = re.compile(r"[ \t]*((?:>[ \t]?)*)")
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: How lines that announce a quote end.
_ANNOUNCES = re.compile(r"(?:wrote|writes|said|schrieb|a écrit|écrivait|escribió)\s*:\s*$", re.I)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARSED = "own string, own_keys array<string>, quotes array<struct<level:int,keys:array<string>,words:array<int>>>"


def quote_level(line: str) -> tuple[int, str]:
    """(level, the line without its quote marks)."""
    marks = _LEVEL.match(line)
    level = marks[1].count(">")
    return level, line[marks.end():] if level else line


def normal(text: str) -> tuple[str | None, int]:
    """(hash of the normalised text, its number of words); no hash without words."""
    words = _WORD.findall(text.translate(_FOLD))
    return (hashlib.md5(" ".join(words).encode("utf-8", "replace")).hexdigest(), len(words)) if words else (None, 0)


def _units(lines: list[str]) -> dict[str, int]:
    """Hashes and word counts of the paragraphs and the lines of a passage."""
    found: dict[str, int] = {}
    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
        elif paragraph:
            for unit in {" ".join(paragraph), *paragraph}:
                key, n = normal(unit)
                if key:
                    found[key] = n
            paragraph = []
    return found


def passages(text: str | None) -> list[tuple[int, list[str]]]:
    """(level, lines) of a message, in order."""
    found: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        level, rest = quote_level(line)
        if not found or found[-1][0] != level:
            found.append((level, []))
        found[-1][1].append(rest)
    for i, (level, lines) in enumerate(found[:-1]):
        if found[i + 1][0] > level:  # the announcement belongs to the quote
            while lines and (not lines[-1].strip() or _ANNOUNCES.search(lines[-1])):
                lines.pop()
    return found


def _parse_one(text: str | None) -> tuple:
    own: list[str] = []
    quotes = []
    for level, lines in passages(text):
        if level:
            units = _units(lines)
            quotes.append({"level": level, "keys": list(units), "words": list(units.values())})
        else:
            own += lines
    return "\n".join(own).strip(), list(_units(own)), quotes


def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([_parse_one(t) for t in texts], columns=["own", "own_keys", "quotes"])


def link(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, text, ...) with own_text, n_quotes, n_linked, reply_to, path, depth; without quotes in own_text."""
    kept = [c for c in messages.columns if c not in ("own_text", "n_quotes", "n_linked", "reply_to", "path", "depth")]
    parse = F.pandas_udf(_parse, _PARSED)
    read = stage(messages.select(*kept, parse(F.coalesce("text", F.lit(""))).alias("_pw_m")))
    first = (read.select("conv_id", "turn", F.explode("_pw_m.own_keys").alias("key")).filter("turn IS NOT NULL")
             .groupBy("conv_id", "key").agg(F.min("turn").alias("original")))
    quoted = (read.select("conv_id", "turn", F.explode("_pw_m.quotes").alias("q")).filter("turn IS NOT NULL")
              .select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(F.arrays_zip("q.keys", "q.words")).alias("u"))
              .groupBy("conv_id", "turn", "level", F.col("u.keys").alias("key")).agg(F.first("u.words").alias("words")))
    found = quoted.join(first, ["conv_id", "key"]).filter("original < turn")
    sums = found.groupBy("conv_id", "turn", "level", "original").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    replies = stage(sums.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("level") == 1, F.struct("words", "original"))).alias("best"), F.sum("n").alias("n_linked"))
        .select("conv_id", "turn", F.col("best.original").alias("reply_to"), "n_linked"))
    trees = paths(replies.filter("reply_to IS NOT NULL").select("conv_id", "turn", "reply_to"))
    placed = replies.join(trees, ["conv_id", "turn"], "left").withColumnsRenamed({"conv_id": "_pw_c", "turn": "_pw_t"})
    out = read.drop("reply_to", "n_linked", "path").join(
        placed, F.col("conv_id").eqNullSafe(F.col("_pw_c")) & (F.col("turn") == F.col("_pw_t")), "left")
    path = F.coalesce("path", F.array("turn"))
    return out.select(*kept, F.col("_pw_m.own").alias("own_text"), F.size("_pw_m.quotes").cast("long").alias("n_quotes"),
                      F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "reply_to", path.alias("path"),
                      (F.size(path) - 1).cast("long").alias("depth"))


def paths(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, path) of every reply (conv_id, turn, reply_to): the turns from its tree's first message to itself."""
    state = stage(replies.select("conv_id", "turn", F.col("reply_to").alias("start"), F.array("turn").alias("path")))
    while True:
        above = state.select("conv_id", F.col("turn").alias("start"), F.col("start").alias("above"), F.col("path").alias("upper"))
        joined = stage(state.join(above, ["conv_id", "start"], "left"))
        if joined.filter("upper IS NOT NULL").isEmpty():
            return state.select("conv_id", "turn", F.concat(F.array("start"), "path").alias("path"))
        state = joined.select("conv_id", "turn", F.coalesce("above", "start").alias("start"),
                              F.when(F.col("upper").isNull(), F.col("path")).otherwise(F.concat("upper", "path")).alias("path"))


def examples(linked: DataFrame) -> DataFrame:
    """One row per tree of ``link``'s result: conv_id, first_turn and messages (role, text) in reply order.

    A row holds one whole tree, as an example for training does.
    """
    message = F.struct("path", F.col("role").alias("role"), F.col("own_text").alias("text"))
    rows = linked.groupBy("conv_id", F.get("path", F.lit(0)).alias("first_turn")).agg(F.array_sort(F.collect_list(message)).alias("m"))
    return rows.select("conv_id", "first_turn", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
