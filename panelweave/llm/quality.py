"""Quality rules as a short-circuit cascade.

Every rule is a Boolean column that is true when the text fails.  On a sample spread over the table the cost of each rule
(its running time beyond cutting the words) and its rejection rate are measured; rules are then asked in the order of
rejections per cost, and a row is finished with at its first failing rule: ``CASE`` stops there, and what the later rules
need is never worked out.  The order changes only the time taken: a row is kept when no rule fails, whatever the order.

Defined cases: a null text has no words; an empty text too, so both fail ``too_short``.  Texts are taken whole.  Repeated
rows are judged alike.  Input columns named as an output column are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, drop_staged, let, stage, words


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)


def _repeated(tokens: Column, width: int) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more in the text."""
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def repeated_at(windows: Column) -> Column:
        """Positions, in order, of the windows that are not alone."""
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.array_sort(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                     lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False))
                     | F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))),
            lambda k: F.get(s, k)["i"])))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(positions, start, lambda a, p: F.struct(
            (a["n"] + p + width - F.greatest(p, a["end"])).alias("n"), (p + width).alias("end")))["n"]

    return let(tokens, lambda w: F.when(F.size(w) < width + 1, 0).otherwise(let(hashes(w), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(repeated_at(h))))))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: Column, tokens: Column) -> dict[str, Column]:
    """The measures the rules are made of, each a long, from a text and its words."""
    whole = F.coalesce(text, F.lit(""))
    found = {
        "n_words": F.size(tokens),
        "word_chars": F.char_length(F.array_join(tokens, "")),
        "n_symbols": F.char_length(whole) - F.char_length(F.regexp_replace(whole, "[#*$%&|<>]+", "")),
        "n_dup_lines": let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated(tokens, 5),
        "n_lines": F.size(_lines(text)),
        "n_letters": F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, "[A-Za-z]+", "")),
        "n_capitals": F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, "[A-Z]+", "")),
    }
    return {name: column.cast("long") for name, column in found.items()}


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def base_rules(s: dict[str, Column]) -> list[Rule]:
    return [Rule("too_short", s["n_words"] < 10), Rule("repeated_windows", 100 * s["n_repeat_words"] > 20 * s["n_words"])]


def method_rules(s: dict[str, Column]) -> list[Rule]:
    """Wide limits: ordinary prose in any script passes all of them."""
    return [
        Rule("symbols", 100 * s["n_symbols"] > 8 * s["word_chars"]),
        Rule("repeated_lines", (100 * s["n_dup_lines"] > 30 * s["n_lines"]) & (s["n_dup_lines"] >= 3)),
        Rule("shouting", (100 * s["n_capitals"] > 60 * s["n_letters"]) & (2 * s["n_letters"] > s["word_chars"])),
        Rule("word_length", (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 60 * s["n_words"])),
    ]


def all_rules(s: dict[str, Column]) -> list[Rule]:
    return base_rules(s) + method_rules(s)


Rules = Callable[[dict[str, Column]], list[Rule]]


def cascade(text: Column, order: list[str], rules: Rules = all_rules) -> Column:
    """Name of the first rule, in the order given, that a text fails; null when it passes all.

    The words are cut once for all rules.  What else a rule needs is worked out inside its own branch, so a text that
    failed an earlier rule never pays for it.
    """
    def asked(tokens: Column) -> Column:
        by_name = {rule.name: rule for rule in rules(counts(text, tokens))}
        return first_failing([by_name[name] for name in order])

    return let(words(text), asked)


def plan(docs: DataFrame, rules: Rules = all_rules, sample_rows: int = 512, runs: int = 3, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejection rate) by falling rejections per second, from about ``sample_rows`` rows of the whole table.

    The sample is written once.  A rule's cost is the median time of ``runs`` passes over it, less that of a pass that
    only cuts the words.  Equal gains keep the order given, and so does an empty table.
    """
    names = [rule.name for rule in rules(counts(F.col("text"), words(F.col("text"))))]
    n = docs.count()
    sample = stage(docs.select("text").sample(min(1.0, 1.2 * sample_rows / max(n, 1)), seed).coalesce(8)) if n else None
    seen = sample.count() if n else 0
    if not seen:
        return [(name, 0.0, 0.0) for name in names]

    def seconds(column: Column) -> float:
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            sample.select(column.alias("_pw_x")).agg(F.count("_pw_x")).collect()
            times.append(time.perf_counter() - began)
        return median(times)

    flag = {name: cascade(F.col("text"), [name], rules) for name in names}
    failed = sample.agg(*[F.count(column).alias(name) for name, column in flag.items()]).first()
    idle = seconds(let(words(F.col("text")), lambda w: F.size(w)))
    measured = [(name, max(seconds(column) - idle, 1e-4), failed[name] / seen) for name, column in flag.items()]
    drop_staged(sample)
    return sorted(measured, key=lambda m: -m[2] / m[1])


def first_failing(rules: list[Rule]) -> Column:
    """Name of the first rule that a row fails, null when it passes all; later rules are not evaluated."""
    result = None
    for rule in rules:
        fails = F.coalesce(rule.fails, F.lit(False))
        result = F.when(fails, rule.name) if result is None else result.when(fails, rule.name)
    return F.lit(None).cast("string") if result is None else result


def judge(docs: DataFrame, sample_rows: int = 512, seed: int = 7) -> DataFrame:
    """``docs`` with the statistics ``BASE``, ``base_failed``, ``failed_rule`` (of the method's rules) and ``kept``.

    The base statistics are wanted of every row and worked out once.  The method's rules are asked in the cascade's order,
    only of rows that pass the base rules, and what they need besides only in their branch.
    """
    order = [name for name, _, _ in plan(docs, method_rules, sample_rows, seed=seed)]
    made = [*BASE, "base_failed", "failed_rule", "kept"]
    base = let(words(F.col("text")), lambda w: F.struct(*[c.alias(n) for n, c in counts(F.col("text"), w).items() if n in BASE]))
    out = docs.drop(*made).withColumn("_pw_s", base)
    out = out.select(*[c for c in out.columns if c != "_pw_s"], *[F.col(f"_pw_s.{n}").alias(n) for n in BASE])
    s = {n: c for n, c in counts(F.col("text"), words(F.col("text"))).items() if n not in BASE} | {n: F.col(n) for n in BASE}
    rules = {rule.name: rule for rule in method_rules(s)}
    failed = F.lit(False)
    for rule in base_rules(s):
        failed = failed | rule.fails
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit(None)).otherwise(first_failing([rules[n] for n in order])))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def keep(docs: DataFrame, sample_rows: int = 512, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that fail no rule, base rules included; a rule runs only on rows that passed those before it."""
    order = [name for name, _, _ in plan(docs, all_rules, sample_rows, seed=seed)]
    return docs.filter(cascade(F.col("text"), order).isNull())
