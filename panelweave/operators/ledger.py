"""Account ledger over all kinds of events, coupled across symbols by the account's cash.

An event changes its account only if it passes the account's checks; each event gets a verdict and the state after it.
The fold of an account can't be split: whether a purchase is refused depends on the cash that every earlier event left.
It runs per account in order, streaming rows, and holds one position per symbol.

Kinds (amounts in whole minor units, ``expected`` -1 for any holding):

====== =============================================================== ==========================================
kind   effect                                                          refused
====== =============================================================== ==========================================
deposit ``amount`` to the cash                                         amount not positive: invalid
buy    ``shares`` for ``amount`` and ``fees``; sellable next day        cash short: no_cash; bad numbers: invalid
sell   ``shares`` for ``amount`` less ``fees``                          more than can be sold: not_sellable
adjust shares times ``step_milli`` / 1000, the fraction paid in cash    nothing held, or not ``expected``: mismatch
       at ``amount`` a share; cost stays
delist holding paid out at ``amount`` a share                           nothing held, or not ``expected``: mismatch
correct holding becomes ``shares``, all sellable, at cost ``amount``    not ``expected``: mismatch
cash   signed ``amount`` to the cash                                    cash would be negative: no_cash
====== =============================================================== ==========================================

An event id seen before in the account is a duplicate and changes nothing, whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.io import written
from .series import ordered_scan

KINDS = ("deposit", "adjust", "buy", "sell", "correct", "cash", "delist")
ORDER = ["day", "seq", "event_id", "symbol", "shares", "amount"]
COLUMNS = ["account", "event_id", "day", "seq", "kind", "symbol", "shares", "amount", "fees", "step_milli", "expected"]
SCHEMA = ("account long, event_id string, day date, kind string, symbol string, verdict string, cash long, quantity long, "
          "sellable long, cost long")
TAKEN = ["again", "day", "kind", "symbol", "shares", "amount", "fees", "step_milli", "expected"]
FOUND = ["verdict", "cash", "quantity", "sellable", "cost"]


def verdict(again: bool, kind: str, shares: int, amount: int, fees: int, step_milli: int, expected: int, cash: int, quantity: int, sellable: int) -> str:
    if again:
        return "duplicate"
    if kind in ("adjust", "delist", "correct"):
        held = quantity > 0 or kind == "correct"
        if not held or (expected >= 0 and expected != quantity):
            return "mismatch"
        return "invalid" if amount < 0 or shares < 0 or step_milli < 0 else "ok"
    if kind in ("buy", "sell") and (shares <= 0 or amount <= 0 or fees < 0):
        return "invalid"
    if kind == "buy":
        return "ok" if cash >= amount + fees else "no_cash"
    if kind == "sell":
        return "ok" if shares <= sellable else "not_sellable"
    if kind == "deposit":
        return "ok" if amount > 0 else "invalid"
    return "ok" if cash + amount >= 0 else "no_cash"


def apply(kind: str, shares: int, amount: int, fees: int, step_milli: int, cash: int, quantity: int, sellable: int, cost: int) -> tuple[int, int, int, int]:
    """(cash, quantity, sellable, cost) after an event that passed."""
    if kind in ("deposit", "cash"):
        return cash + amount, quantity, sellable, cost
    if kind == "buy":
        return cash - amount - fees, quantity + shares, sellable, cost + amount + fees
    if kind == "sell":
        left = quantity - shares
        return cash + amount - fees, left, sellable - shares, cost * left // quantity
    if kind == "adjust":
        new, rest = divmod(quantity * step_milli, 1000)
        free = new if sellable == quantity else min(new, sellable * step_milli // 1000)
        return cash + rest * amount // 1000, new, free, cost if new else 0
    if kind == "delist":
        return cash + quantity * amount, 0, 0, 0
    return cash, shares, shares, amount if shares else 0


def start() -> dict:
    """An account before its first event: its cash, and (quantity, sellable, cost, day) per symbol."""
    return {"cash": 0, "held": {}}


def advance(state: dict, again: bool, day: object, kind: str, symbol: str, shares: int, amount: int, fees: int, step_milli: int,
            expected: int) -> tuple[str, int, int, int, int]:
    """One event of an account, whose state is changed in place: (verdict, cash, quantity, sellable, cost)."""
    cash, held = state["cash"], state["held"]
    quantity, sellable, cost, last = held.get(symbol, (0, 0, 0, None))
    if last != day:  # what was held overnight can be sold
        sellable = quantity
    found = verdict(again, kind, shares, amount, fees, step_milli, expected, cash, quantity, sellable)
    if found == "ok":
        cash, quantity, sellable, cost = apply(kind, shares, amount, fees, step_milli, cash, quantity, sellable, cost)
        state["cash"] = cash
        if symbol:
            if quantity:
                held[symbol] = (quantity, sellable, cost, day)
            else:
                held.pop(symbol, None)
    return found, cash, quantity, sellable, cost


def step(state: dict, row: dict) -> tuple[dict, dict]:
    """:func:`advance` for folds that keep an earlier state."""
    new = {"cash": state.get("cash", 0), "held": dict(state.get("held", {}))}
    kind, symbol = row["kind"], row["symbol"]
    found = advance(new, row["again"], str(row["day"]), kind, symbol, row["shares"], row["amount"], row["fees"], row["step_milli"], row["expected"])
    return new, {"account": row["account"], "event_id": row["event_id"], "day": row["day"], "kind": kind, "symbol": symbol,
                 "verdict": found[0], "cash": found[1], "quantity": found[2], "sellable": found[3], "cost": found[4]}


def fold(events: DataFrame) -> DataFrame:
    """Verdict of every event and the account's cash and position after it (``SCHEMA``)."""
    first = Window.partitionBy("account", "event_id").orderBy(*[c for c in ORDER if c != "event_id"])
    # dealt by account once, for the copies and for the fold
    marked = events.select(*COLUMNS).repartition("account").withColumn("again", F.row_number().over(first) > 1)
    return ordered_scan(marked, ["account"], ORDER, SCHEMA, start, advance, TAKEN, FOUND)


def numbered(folded: DataFrame) -> DataFrame:
    """What :func:`fold` returned with ``n``, which grows along an account: it is one task's, in order."""
    return folded.withColumn("n", F.monotonically_increasing_id())


def closing(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(account, cash) and (account, symbol, quantity, cost) after the last event of each, of :func:`numbered` rows."""
    # duplicates and refusals repeat the state; a number as the order keeps the aggregation in a hash table
    last = [F.max_by(c, "n").alias(c) for c in ("cash", "quantity", "cost")]
    after = written(folded.filter("verdict = 'ok'").groupBy("account", "symbol").agg(*last, F.max("n").alias("n")), "closing")
    cash = after.groupBy("account").agg(F.max_by("cash", "n").alias("cash"))
    return cash, after.filter("symbol <> '' AND quantity > 0").select("account", "symbol", "quantity", "cost")
