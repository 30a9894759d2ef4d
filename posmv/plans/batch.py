"""The four outputs as one plan of DataFrames; flags leave out what is not asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from posmv.config import Config
from posmv.operators import dedup, marketvalue, prices as P
from posmv.operators.positions import ACCOUNT_TICKER, TICKER, positions, roll_up

OUTPUTS = ("position-by-account-ticker", "position-by-ticker", "mv-by-account-ticker", "mv-by-ticker")


def wanted(config: Config) -> tuple[str, ...]:
    """positions.only leaves out market values; single.output leaves out what is by account."""
    found = OUTPUTS
    if config.bool("positions.only"):
        found = tuple(o for o in found if o.startswith("position"))
    if config.bool("single.output"):
        found = tuple(o for o in found if "account" not in o)
    return found


def latest_price(prices: DataFrame, config: Config) -> DataFrame:
    salt, window = config.int("price.salt.factor"), config.int("price.conflate.ms")
    if window > 0:
        return P.latest_from_windows(P.tumble_last(prices, window))
    return P.salted_latest(prices, salt) if salt > 1 else P.latest(prices)


def outputs(trades: DataFrame, prices: DataFrame | None, config: Config, order: tuple[str, ...]) -> dict[str, DataFrame]:
    """Each wanted output. The account's positions, if they are wanted, are summed once more for the ticker's, so one
    plan of several outputs has dedup and positions once."""
    if config.bool("dedup.enabled"):
        trades = dedup.first_wins(trades, order)
    names, found = wanted(config), {}
    by_account = positions(trades, ACCOUNT_TICKER)
    by_ticker = roll_up(by_account) if any("account" in n for n in names) else positions(trades, TICKER)
    for name in names:
        held = by_account if "account" in name else by_ticker
        found[name] = held if name.startswith("position") else marketvalue.market_values(held, latest_price(prices, config))
    return found
