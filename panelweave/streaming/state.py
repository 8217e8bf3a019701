"""Ordered folds as keyed streaming state with event-time timers.

Events of a key may come in any order within the watermark's delay, over any number of files.  A key's state holds the
fold's state at the last closed day and the events of the days that are still open.  Every batch that brings events of a key
folds the open ones again, in order, and returns them as provisional; when the watermark passes a day, its events are
folded into the state for good, returned once as closed, and forgotten.  Each file is read once, and the state of a key is
bounded by the delay.  Ids of closed events are kept as long as a late copy may come, so that a copy is known as one.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, FloatType, LongType, NumericType, StringType, StructField, StructType

from . import jobs

Step = Callable[[dict, dict], tuple[dict, dict]]
DAY_MS = 86_400_000
#: Keys are dealt to groups, which share calls, timers and the batches sent to and from Python; each key has its own entry in the state.
#: Rows of a group where the size of the stream's table is known, the least number of groups, and their number where it is not known.
GROUP_ROWS, LEAST_GROUPS, GROUPS = 4096, 256, 1 << 14
ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "date": pa.date32(), "boolean": pa.bool_()}
LINE = ""  # the name of a row's own text, which no column has


@functools.lru_cache(1 << 16)
def _millis(day: str) -> int:
    """The first moment after a day."""
    return int((datetime.fromisoformat(day).replace(tzinfo=timezone.utc) + timedelta(days=1)).timestamp() * 1000)


@functools.lru_cache(1 << 16)
def _day(text: str) -> date:
    return date.fromisoformat(text)


@functools.lru_cache(16)
def _days_before(watermark: int, days: int) -> str:
    """The day of a watermark, less so many days."""
    return (datetime.fromtimestamp(max(watermark, 0) / 1000, timezone.utc) - timedelta(days=days)).date().isoformat()


class OrderedFold(StatefulProcessor):
    """``step(state, row)`` over the rows of a key in the order of ``order`` (its first column is the day)."""

    def __init__(self, step: Step, columns: list[str], order: list[str], shown: list[str], keep_days: int, unique: str | None,
                 numbers: set[str], whole: set[str]) -> None:
        self.step, self.columns, self.order, self.shown, self.keep_days, self.unique = step, columns, order, shown, keep_days, unique
        self.numbers, self.whole = numbers, whole  # number columns that come, whole-number columns that are shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.body = handle.getValueState("body", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._advance([self._taken(row) for row in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance([], timerValues)

    def _taken(self, row: Row | dict) -> dict:
        one = {c: math.nan if row[c] is None and c in self.numbers else row[c] for c in self.columns}
        return one | {self.order[0]: str(one[self.order[0]])[:10]}

    def _advance(self, new: list[dict], timers) -> list[Row]:
        kept = self.body.get()
        body = json.loads(kept[0]) if kept else {"open": [], "due": None}
        opened = [dict(zip(self.columns, values, strict=True)) for values in body.pop("open")]
        before = body.pop("due")
        body, opened, out = self.advance(body, opened, new, timers.getCurrentWatermarkInMs())
        if body is None:
            return []
        due = self.due(opened)
        self.body.update((json.dumps(body | {"open": [[r[c] for c in self.columns] for r in opened], "due": due}),))
        if due is not None and due != before:
            self.handle.registerTimer(due)
        return [Row(**{c: self._shown(c, v) for c, v in zip(self.shown, row)}, closed=row[-2], version=row[-1]) for row in out]

    def due(self, opened: list[dict]) -> int | None:
        """One timer a key, for its first open day: it closes what is due and sets the next."""
        return _millis(opened[0][self.order[0]]) if opened else None

    def advance(self, body: dict, opened: list[dict], new: list[dict], watermark: int) -> tuple[dict | None, list[dict], list[tuple]]:
        """Folds a key's open and new rows: its body (state, ids of closed events, version) after those that are closed now, the rows still
        open, and what is shown of each row, with closed and version.  No body where there is nothing to do.
        """
        rows, day, unique, step = opened + new, self.order[0], self.unique, self.step
        rows.sort(key=itemgetter(*self.order))
        today = _days_before(watermark, 0)
        closing = sum(r[day] < today for r in rows)  # days that have ended: the first ones, as rows are in order of their days
        if not new and not closing:  # another timer of the batch has closed them
            return None, opened, []
        version, state, seen, out, first = body.get("version", 0) + 1, body.get("state", {}), body.get("seen", {}), [], []
        closed_state, shown_of = state, itemgetter(*self.shown, self.shown[0])  # one more: a tuple, however few are shown
        for i, row in enumerate(rows):
            row["again"] = unique is not None and row[unique] in seen
            state, shown = step(state, row)
            if unique is not None and not row["again"]:
                seen[row[unique]] = row[day]
                if i >= closing:
                    first.append(row[unique])
            if i + 1 == closing:
                closed_state = state
            out.append((*shown_of(shown)[:-1], i < closing, version))
        for one in first:  # ids of open events are found again with them
            del seen[one]
        oldest = _days_before(watermark, self.keep_days + 1)
        return {"state": closed_state, "seen": {k: d for k, d in seen.items() if d >= oldest}, "version": version}, rows[closing:], out

    def _shown(self, column: str, value: object) -> object:
        if column == self.order[0]:
            return _day(value)
        value = value.item() if hasattr(value, "item") else value
        if isinstance(value, float):
            return None if math.isnan(value) else int(value) if column in self.whole else value
        return value


class GroupedFolds(OrderedFold):
    """:class:`OrderedFold` of every key of a group of keys: calls, timers and batches are the group's, the state is an entry a key.

    A key of a few dozen rows costs less than one call into the state and one Arrow batch of its own.
    """

    def __init__(self, keys: list[str], texts: list[str], others: list[str], types: dict[str, str], *fold) -> None:
        super().__init__(*fold)
        self.keys, self.texts, self.others = keys, texts, others  # texts and others: the columns as :func:`packed` sends them
        self.types = types  # of the columns that are shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        value = [StructField("json", StringType()), StructField("open", StringType()), StructField("due", LongType())]
        self.bodies = handle.getMapState("bodies", StructType([StructField("key", StringType())]), StructType(value))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        key_of, new = itemgetter(*self.keys), {}
        for pdf in rows:
            for row in self._rows(pdf["packed"].tolist()):
                new.setdefault(key_of(row), []).append(row)
        named: dict[str, list[dict]] = {}
        for k, some in new.items():  # a NaN of the rows is no other's equal, as text it is
            named.setdefault(json.dumps(k), []).extend(some)
        yield from self._moved(named, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._moved({}, timerValues)

    def _rows(self, lines: list[str]) -> list[dict]:
        """Rows of :func:`packed` lines, numbers that are null as NaN, each with its line, as which it stays in the state."""
        names, rows = [*self.texts, *self.others], []
        for line, (texts, *others) in zip(lines, json.loads(f"[{','.join(lines)}]"), strict=True):
            row = dict(zip(names, texts + others))
            row[LINE] = line
            if None in others:
                row.update([(c, math.nan) for c in self.numbers & row.keys() if row[c] is None])
            rows.append(row)
        return rows

    def _moved(self, new: dict[str, list[dict]], timers) -> Iterator[pd.DataFrame]:
        kept, watermark = {k[0]: v for k, v in self.bodies.iterator()}, timers.getCurrentWatermarkInMs()
        due = {k: v[2] for k, v in kept.items() if v[2] is not None}
        before, out = min(due.values(), default=None), []
        touched = new or {k: [] for k, at in due.items() if at <= watermark}
        for k, rows in touched.items():
            text, lines, _ = kept.get(k, ("{}", "", None))
            body, opened, found = self.advance(json.loads(text), self._rows(lines.split("\n") if lines else []), rows, watermark)
            if body is not None:
                due[k] = self.due(opened)
                self.bodies.updateValue((k,), (json.dumps(body), "\n".join([r[LINE] for r in opened]), due[k]))
                out += found
        after = min((at for at in due.values() if at is not None), default=None)
        if after is not None and after != before:
            self.handle.registerTimer(after)
        if out:
            types = self.types | {"closed": "boolean", "version": "long"}
            yield pd.DataFrame({c: self._column(c, kind, values) for (c, kind), values in zip(types.items(), zip(*out), strict=True)})

    def _column(self, name: str, kind: str, values: tuple) -> pd.Series:
        plain = name != self.order[0] and {*map(type, values)} <= {int, str, bool, type(None)}
        column = pa.array(values if plain else [self._shown(name, v) for v in values], ARROW.get(kind))
        return pd.Series(column, dtype=pd.ArrowDtype(column.type))


def packed(rows: DataFrame, texts: list[str], others: list[str], day: str) -> Column:
    """A row as JSON in one column, strings and days in a list before the numbers: Python takes many rows at a call."""
    number = lambda c: F.col(c).cast("double") if isinstance(rows.schema[c].dataType, FloatType) else F.col(c)
    plain = [F.concat(F.lit(","), F.coalesce(number(c).cast("string"), F.lit("null"))) for c in others]
    return F.concat(F.lit("["), F.to_json(F.array(*[F.substring(F.col(c).cast("string"), 1, 10) if c == day else F.col(c).cast("string") for c in texts])), *plain, F.lit("]"))


def fold_stream(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, step: Step, late_days: int,
                name: str, unique: str | None = None, rows: int = 0) -> DataFrame:
    """The rows of ``ordered_fold`` from a stream.  ``late_days``: how many days behind the newest event one may come; ``rows``: about how many come.

    Rows closed by the watermark stand; of a key's open rows those of its newest version do.  With ``unique``, a copy of an
    event id must come on the day of the first or within the delay after it.
    """
    types = dict(part.split() for part in schema.split(", "))
    spark = stream.sparkSession
    marked = stream.withColumn("_ts", F.col(order[0]).cast("timestamp")).withWatermark("_ts", f"{late_days} days")
    numbers = {f.name for f in stream.schema if isinstance(f.dataType, NumericType)}
    whole = {c for c, kind in types.items() if kind == "long"}
    sent = [*columns, *[k for k in keys if k not in columns]]
    others = [c for c in sent if isinstance(stream.schema[c].dataType, (NumericType, BooleanType))]
    texts = [c for c in sent if c not in others]
    groups = max(LEAST_GROUPS, rows // GROUP_ROWS) if rows else GROUPS
    dealt = marked.select(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("group"), packed(marked, texts, others, order[0]).alias("packed"), "_ts")
    folded = dealt.groupBy("group").transformWithStateInPandas(
        GroupedFolds(keys, texts, others, types, step, columns, order, [*types], late_days, unique, numbers, whole),
        outputStructType=f"{schema}, closed boolean, version long", outputMode="Append", timeMode="EventTime")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        written = jobs.run_available(folded, "append", name)
    finally:
        spark.conf.set(provider, before)
    if written.filter("batch_id > 0").isEmpty():  # a key has one version; null keys are equal to none
        return written.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).drop("batch_id", "version", "closed")
    newest = written.groupBy(*keys).agg(F.max("version").alias("_newest"))
    return written.join(newest, keys).filter("closed OR version = _newest").drop("batch_id", "version", "_newest", "closed")
