"""Factor library: one column expression per factor over the session panel.

``FACTORS`` maps a factor id to its family, sign, warm-up window, the effects it
is neutralised on and a builder.  Builders only name panel columns, so any set
of factors is computed in one pass after one shuffle by symbol.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .windows import lag_n, last_n, max_n, mean_n, pair_stats, std_n

# Family order, look-back lengths in sessions and the bar share a look-back needs.
FAMILIES = ("value", "quality", "growth", "momentum", "volatility", "liquidity", "size", "technical", "holders")
YEAR, HALF_YEAR, MONTH, MIN_COVERAGE = 240, 120, 20, 0.8


@dataclass(frozen=True)
class Limits:
    """How complete a window must be; ``relax`` scales every minimum count for sparse panels."""

    coverage: float = MIN_COVERAGE
    relax: float = 1.0

    def least(self, count: int) -> int:
        return max(2, int(count * self.relax))


@dataclass(frozen=True)
class Factor:
    family: str
    direction: int
    window: int
    build: Callable[[Limits], Column]
    neutralize: tuple[str, ...] = ("industry", "size")
    candidate: bool = False

    def definition(self, name: str) -> str:
        """Changes with any declared property or with the formula itself."""
        text = repr((name, self.family, self.direction, self.window, self.neutralize, self.candidate,
                     inspect.getsource(self.build)))
        return hashlib.sha256(text.encode()).hexdigest()


FACTORS: dict[str, Factor] = {}


def factor(name: str, family: str, direction: int, window: int, **options):
    if direction not in (1, -1) or family not in FAMILIES:
        raise ValueError(f"{name}: direction must be 1 or -1 and the family known")

    def register(build: Callable[[Limits], Column]) -> Callable[[Limits], Column]:
        if name in FACTORS:
            raise ValueError(f"factor {name} is registered twice")
        FACTORS[name] = Factor(family, direction, window, build, **options)
        return build

    return register


def over(a: Column, b: Column, where: Column | None = None) -> Column:
    """a / b where b is positive (or where ``where`` holds)."""
    return F.when(b > 0 if where is None else where, a / b)


def bar_coverage(n: int) -> Column:
    return F.when(F.col("idx") >= n, F.count(F.when(F.col("has_bar"), 1)).over(last_n(n)) / F.lit(n))


def price_change(limits: Limits, newer: int, older: int) -> Column:
    change = over(lag_n("adj_last", newer), lag_n("adj_last", older)) - 1
    return F.when(bar_coverage(older + 1) >= limits.coverage, change)


c = F.col


@factor("mom_12_1", "momentum", 1, YEAR + 1)
def mom_12_1(m: Limits) -> Column:
    return price_change(m, MONTH, YEAR)


@factor("mom_6_1", "momentum", 1, HALF_YEAR + 1)
def mom_6_1(m: Limits) -> Column:
    return price_change(m, MONTH, HALF_YEAR)


@factor("rev_1m", "momentum", -1, MONTH + 1)
def rev_1m(m: Limits) -> Column:
    return price_change(m, 0, MONTH)


@factor("high_52w", "momentum", 1, 244)
def high_52w(m: Limits) -> Column:
    return c("adj_last") / max_n(c("adj_close"), 244, m.least(180))


@factor("vol_60", "volatility", -1, 60)
def vol_60(m: Limits) -> Column:
    return std_n(c("ret"), 60, m.least(40))


@factor("ivol_60", "volatility", -1, 60)
def ivol_60(m: Limits) -> Column:
    s = pair_stats(c("ret"), c("market_ret"), 60, m.least(40))
    left = s["var_x"] - F.try_divide(s["cov"] * s["cov"], s["var_y"])
    return F.sqrt(F.when(left > 0, left).when(left <= 0, 0.0))


@factor("max_20", "volatility", -1, 20)
def max_20(m: Limits) -> Column:
    return max_n(c("ret"), 20, m.least(15))


@factor("turn_20", "liquidity", -1, 20)
def turn_20(m: Limits) -> Column:
    return mean_n(c("turnover_rate"), 20, m.least(15))


@factor("abn_turn", "liquidity", -1, 250)
def abn_turn(m: Limits) -> Column:
    return over(turn_20(m), mean_n(c("turnover_rate"), 250, m.least(150)))


@factor("amihud_20", "liquidity", 1, 20)
def amihud_20(m: Limits) -> Column:
    return mean_n(over(F.abs("ret"), c("amount")) * 1e8, 20, m.least(15))


@factor("ln_float_mcap", "size", -1, 1, neutralize=("industry",))
def ln_float_mcap(m: Limits) -> Column:
    return F.when(c("float_mcap") > 0, F.log("float_mcap"))


@factor("amplitude_20", "technical", -1, 20)
def amplitude_20(m: Limits) -> Column:
    return mean_n((c("high") - c("low")) / c("ref_close"), 20, m.least(15))


@factor("pv_corr_20", "technical", -1, 20)
def pv_corr_20(m: Limits) -> Column:
    return pair_stats(c("adj_close"), c("volume").cast("double"), 20, m.least(15))["corr"]


@factor("turn_vol_20", "technical", -1, 20)
def turn_vol_20(m: Limits) -> Column:
    return std_n(c("turnover_rate"), 20, m.least(15))


def statement_factor(name: str, family: str, direction: int, formula: Callable[[], Column], **options) -> None:
    """A factor read straight from point-in-time statement columns."""
    factor(name, family, direction, 1, **options)(lambda m: formula())


statement_factor("ep_ttm", "value", 1, lambda: over(c("ni_ttm"), c("total_mcap")))
statement_factor("bp", "value", 1, lambda: over(c("book"), c("total_mcap")))
statement_factor("sp_ttm", "value", 1, lambda: over(c("revenue_ttm"), c("total_mcap")))
statement_factor("cfp_ttm", "value", 1, lambda: over(c("ocf_ttm"), c("total_mcap")))
statement_factor("dy_ttm", "value", 1, lambda: over(c("dividend_ttm"), c("total_mcap")))
statement_factor("roe_ttm", "quality", 1, lambda: over(c("ni_ttm"), c("avg_book")))
statement_factor("roa_ttm", "quality", 1, lambda: over(c("ni_ttm"), c("avg_assets")))
statement_factor("gross_margin_ttm", "quality", 1, lambda: over(c("gross_profit_ttm"), c("revenue_ttm")))
statement_factor("accruals", "quality", -1, lambda: over(c("ni_ttm") - c("ocf_ttm"), c("avg_assets")))
statement_factor("leverage", "quality", -1, lambda: over(c("total_liabilities"), c("total_assets")))
statement_factor("ni_yoy", "growth", 1, lambda: c("ni_sq_yoy"))
statement_factor("rev_yoy", "growth", 1, lambda: c("rev_sq_yoy"))
statement_factor("dni_yoy", "growth", 1, lambda: c("dni_sq_yoy"))
statement_factor("holders_qoq", "holders", -1, lambda: c("holders_change"), candidate=True)


def market_return(panel: DataFrame, include: Column | None = None) -> DataFrame:
    """Equal-weight mean return of the traded names, attached to every row of its session."""
    traded = panel if include is None else panel.filter(include)
    return panel.join(traded.groupBy("idx").agg(F.avg("ret").alias("market_ret")), "idx")


def compute(panel: DataFrame, names: list[str], limits: Limits = Limits(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The named factors as columns of the panel's (symbol, idx) rows."""
    return panel.select("symbol", "idx", *keep, *[FACTORS[n].build(limits).alias(n) for n in names])


def to_long(wide: DataFrame, names: list[str], keys: tuple[str, ...] = ("symbol", "idx")) -> DataFrame:
    """Factor panel in long form: (keys, factor, raw); missing values are left out."""
    return wide.unpivot(list(keys), names, "factor", "raw").filter("raw is not null")
