"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (say domain, language, source) has documents in its leaves.  A token budget is handed down from the root
by integer weights.  A node takes at most what its leaves can give, their tokens times ``max_epochs``; what it can't take
goes to its siblings by their weights, and only what no sibling can take has already gone to the siblings of an ancestor,
as a node is never handed more than it can give.  Shares are rounded down to whole tokens.

A leaf with a budget of e whole passes and a rest takes all its documents e times, then those at the front of a seeded
order, md5 of (seed, epoch, doc_id), whose tokens fit into the rest: the longest prefix.  The end of the prefix is found by
counting tokens per leading digits of that order, digit group by digit group, so a leaf of any size is never sorted in one
task.

Defined cases: null levels form a node of their own, written ``(none)``; documents without tokens or in a node of weight 0
are not taken; rows that repeat a doc_id stand at the same place of the order and are taken or left together; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, small_join, stage

#: Leading hexadecimal digits by which one round narrows the end of a prefix.
DIGITS = 2
#: Rows per leaf that a window may sort at the end.
FINE_ROWS = 1_000


def word_count(text: Column) -> Column:
    """Tokens of a text: its words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def node(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("(none)"))


def weight_of(names: list[str], weights: dict[tuple[str, ...], int], default: int) -> Column:
    """Weight of a node by its path; paths that are not listed have the default."""
    result = None
    for path, weight in sorted(weights.items()):
        if len(path) == len(names):
            hit = F.lit(True)
            for name, value in zip(names, path, strict=True):
                hit = hit & (F.col(name) == value)
            result = F.when(hit, weight) if result is None else result.when(hit, weight)
    return (F.lit(default) if result is None else result.otherwise(default)).cast("long")


def allocate(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], budget: int | Column, max_epochs: int,
             default: int = 1) -> DataFrame:
    """``leaves`` (levels, tokens) with ``share``: whole tokens for each leaf."""
    capped = leaves.withColumn("_pw_cap", F.col("tokens") * max_epochs)
    above = capped.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_pw_all"), F.coalesce(F.sum("_pw_cap"), F.lit(0)).alias("_pw_most"))
    total = budget if isinstance(budget, Column) else F.lit(budget)
    above = above.select(F.least(total.cast("long"), F.col("_pw_most")).alias("share"), F.lit(1).alias("_pw_root"))
    parents = ["_pw_root"]
    for depth, _ in enumerate(levels):
        names = levels[:depth + 1]
        at = (capped.groupBy(*names).agg(F.sum("_pw_cap").alias("cap")).withColumn("_pw_root", F.lit(1))
              .withColumn("w", weight_of(names, weights, default)).filter((F.col("w") > 0) & (F.col("cap") > 0)))
        over = above.withColumnRenamed("share", "b")
        order = Window.partitionBy(*parents).orderBy(F.expr("cap div w"), F.expr("(cap % w) / w"), names[-1])  # exact beyond 2^53
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        kin = Window.partitionBy(*parents)
        at = (at.join(over, parents)
              .withColumns({"left": F.col("b") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
                            "others": F.sum("w").over(kin) - F.coalesce(F.sum("w").over(before), F.lit(0)), "place": F.row_number().over(order)})
              .withColumn("full", F.col("cap") * F.col("others") <= F.col("left") * F.col("w"))
              .withColumn("open", F.min(F.when(~F.col("full"), F.struct("place", "left", "others"))).over(kin)))
        rest = F.expr("(open.left * w) div open.others")
        at = at.withColumn("share", F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap")).otherwise(rest))
        above, parents = at.select(*names, "_pw_root", "share"), ["_pw_root", *names]
    return leaves.join(above.drop("_pw_root"), levels)


def order_key(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))


def prefix_ends(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Of ``rows`` (levels, key, tokens, rest): per leaf, the last key of the longest prefix whose tokens fit into ``rest``.

    Rows with equal keys count as one; a leaf whose first key does not fit has no row.
    """
    found, prefix, state = [], 0, rows.withColumn("room", F.col("rest"))
    while True:
        largest = state.groupBy(*levels).count().agg(F.max("count")).first()[0] or 0
        if largest <= FINE_ROWS or prefix >= 30:
            break
        prefix += DIGITS
        part = F.substring("key", 1, prefix)
        sums = state.groupBy(*levels, "room", part.alias("part")).agg(F.sum("tokens").alias("n"), F.max("key").alias("last"))
        running = Window.partitionBy(*levels).orderBy("part")
        sums = sums.withColumn("upto", F.sum("n").over(running)).withColumn("next", F.lead("part").over(running))
        found.append(sums.filter(F.col("upto") <= F.col("room")).groupBy(*levels).agg(F.max("last").alias("end")))
        edge = sums.filter((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("n") <= F.col("room"))).select(
            *levels, "part", (F.col("room") - F.col("upto") + F.col("n")).alias("left"))
        edge = stage(edge)
        state = stage(small_join(state.withColumn("part", part), edge, [*levels, "part"]).select(
            *levels, "key", "tokens", F.col("left").alias("room")))
    running = Window.partitionBy(*levels).orderBy("key")
    keys = state.groupBy(*levels, "room", "key").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(running))
    ends = keys.filter(F.col("upto") <= F.col("room")).groupBy(*levels).agg(F.max("key").alias("end"))
    for other in found:
        ends = ends.unionByName(other)
    return ends.groupBy(*levels).agg(F.max("end").alias("end"))


def select(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], int], budget: int | None = None,
           fraction: tuple[int, int] = (1, 2), max_epochs: int = 4, seed: int = 11, tokens: Column | None = None) -> DataFrame:
    """Rows of ``docs`` that make up the mixture, one per pass, with the levels, ``n_tokens`` and ``epoch``.

    ``budget`` is in tokens; without one it is ``fraction`` of all tokens.  Columns of ``docs`` with these names are replaced.
    """
    names = list(levels)
    own = {name: node(column) for name, column in levels.items()}
    made = {f"_pw_{name}": column for name, column in own.items()}
    count = word_count(F.col("text")) if tokens is None else tokens
    keep = [c for c in docs.columns if c not in {*names, "n_tokens", "epoch"}]
    marked = docs.withColumns(made | {"_pw_n": count})
    slim = stage(marked.select(F.col("doc_id").alias("_pw_doc"), *[F.col(f"_pw_{n}").alias(n) for n in names],
                               F.col("_pw_n").alias("tokens")).filter("tokens > 0"))
    leaves = stage(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    if budget is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        budget = total * fraction[0] // fraction[1]
    shares = allocate(leaves, names, weights, budget, max_epochs)
    shares = stage(shares.withColumn("full", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens")))
    keyed = small_join(slim, shares.filter("rest > 0").select(*names, "full", "rest"), names).select(
        *names, order_key(seed, F.col("full"), F.col("_pw_doc")).alias("key"), "tokens", "rest")
    plan = stage(shares.select(*names, "full").join(prefix_ends(keyed, names), names, "left"))
    plan = plan.withColumnsRenamed({n: f"_pw_{n}" for n in names} | {"full": "_pw_passes", "end": "_pw_last"})
    joined = small_join(marked.filter(F.col("_pw_n") > 0), plan, list(made))
    last = F.coalesce(order_key(seed, F.col("_pw_passes"), F.col("doc_id")) <= F.col("_pw_last"), F.lit(False))
    passes = F.col("_pw_passes") + last.cast("long")
    return joined.filter(passes > 0).select(
        *[F.col(c) for c in keep], *[F.col(f"_pw_{n}").alias(n) for n in names], F.col("_pw_n").alias("n_tokens"),
        F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("epoch"))
