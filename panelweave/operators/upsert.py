"""Merging new rows into stored ones.

Latest-row merges are aggregations (``max_by`` over the whole row), not windows:
rows are combined before the shuffle, and a key with very many versions is
never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .normalize import keep_one


def both(existing: DataFrame, incoming: DataFrame, tag: str = "_new") -> DataFrame:
    return existing.withColumn(tag, F.lit(0)).unionByName(incoming.withColumn(tag, F.lit(1)), allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Newest row per key: incoming beats existing, then ``order``."""
    return keep_one(both(existing, incoming), keys, [F.col("_new"), *(order or [])]).drop("_new")


def insert_only(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Known keys stay as first recorded; of several new rows of a key the smallest by ``order`` is kept."""
    fresh = incoming.join(existing, keys, "left_anti")
    if order:
        rest = [c for c in fresh.columns if c not in keys]
        fresh = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return existing.unionByName(fresh.select(*existing.columns))


def latest_state(existing: DataFrame, incoming: DataFrame, key: list[str], updated: str, arrival: str) -> DataFrame:
    """Latest state per plan: newest update (no update is oldest), then the later arrival."""
    rank = F.coalesce(F.col(updated).cast("timestamp").cast("double"), F.lit(-1e18))
    return keep_one(both(existing, incoming), key, [rank, F.col("_new"), F.col(arrival)]).drop("_new")


def append_versions(existing: DataFrame, incoming: DataFrame, keys: list[str], hash_: str = "content_hash",
                    version: str = "version") -> DataFrame:
    """Rows of ``incoming`` whose content differs from the latest stored version, numbered on."""
    latest = existing.groupBy(*keys).agg(F.max_by(F.struct(F.col(version).alias("v"), F.col(hash_).alias("h")), version).alias("_l"))
    joined = incoming.join(latest, keys, "left")
    changed = F.col("_l").isNull() | (F.col("_l.h") != F.col(hash_))
    return joined.filter(changed).withColumn(version, F.coalesce(F.col("_l.v"), F.lit(0)) + 1).drop("_l")


def keep_known(existing: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """Newest row per key, with the last known non-null value of one column."""
    rows = both(existing, incoming)
    rest = [c for c in existing.columns if c not in (key, column)]
    known = F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_new")))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_new").alias("_r"), known.alias(column)).select(
        key, "_r.*", column).select(*existing.columns)


def table_of_latest_notice(rows: DataFrame, keys: list[str], notice: str, article: str) -> DataFrame:
    """Whole tables replace each other: only rows of the latest notice of a key remain."""
    latest = rows.groupBy(*keys).agg(F.max_by(article, F.struct(notice, article)).alias(article))
    return rows.join(latest, [*keys, article], "left_semi")


def replace_symbols(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The rows of every key present in ``incoming`` are replaced as a whole."""
    return existing.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def carry_forward(previous: DataFrame, current: DataFrame, key: str, status: str, gone: str = "delisted") -> DataFrame:
    """Keys that vanished stay: marked ``gone`` with an unknown date unless they already were."""
    missing = previous.join(current, key, "left_anti")
    was_gone = F.col(status) == gone
    kept = missing.withColumns({status: F.lit(gone), "delist_date": F.when(was_gone, F.col("delist_date")),
                                "source": F.when(was_gone, F.col("source")).otherwise("inferred.missing_from_listing")})
    return current.unionByName(kept.select(*current.columns))


def frames_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each side has that the other lacks (counting duplicates)."""
    tagged = a.select(*a.columns, F.lit(1).alias("_d")).unionByName(b.select(*a.columns, F.lit(-1).alias("_d")))
    diff = tagged.groupBy(*a.columns).agg(F.sum("_d").alias("_d"))
    zero = F.lit(0).cast("long")
    return diff.agg(F.coalesce(F.sum(F.greatest(F.col("_d"), zero)), zero).alias("only_left"),
                    F.coalesce(F.sum(F.greatest(-F.col("_d"), zero)), zero).alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full-outer comparison on the key: rows on one side only and changed values per column."""
    l = left.select(*keys, F.lit(1).alias("_l"), *[F.col(v).alias(f"_l_{v}") for v in values])
    r = right.select(*keys, F.lit(1).alias("_r"), *[F.col(v).alias(f"_r_{v}") for v in values])
    joined = l.join(r, keys, "full")
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    changes = {v: matched & ~F.col(f"_l_{v}").eqNullSafe(F.col(f"_r_{v}")) for v in values}
    any_change = F.lit(False)
    for c in changes.values():
        any_change = any_change | c
    return joined.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
                      F.count_if(matched).alias("matched"), *[F.count_if(c).alias(f"changed_{v}") for v, c in changes.items()],
                      F.countDistinct(F.when(any_change, F.struct(*keys))).alias("changed_keys"))


def latest_runs(raw: DataFrame, name: list[str], run: str = "run_id") -> DataFrame:
    """Raw rows of the newest run of each frame name."""
    return raw.join(raw.groupBy(*name).agg(F.max(run).alias(run)), [*name, run], "left_semi")


def run_order(raw: DataFrame, name: list[str], run: str = "run_id") -> DataFrame:
    """The runs of each frame name in replay order (one row per run)."""
    runs = raw.groupBy(*name, run).agg(F.count("*").alias("rows"))
    return runs.withColumn("step", F.row_number().over(Window.partitionBy(*name).orderBy(run)))


def missing_windows(wanted: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """What still has to be fetched: wanted keys without a log entry."""
    return wanted.join(log.select(*keys).distinct(), keys, "left_anti")


def minute_totals(minutes: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    return minutes.groupBy(*keys).agg(F.sum("volume").alias("volume"), F.max_by("open_interest", time).alias("open_interest"),
                                      F.count("*").alias("minutes"))
