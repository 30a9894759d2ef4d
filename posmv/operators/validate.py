"""All checks over raw inputs and published outputs: one row for each, with what was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posmv.operators import checks, dedup
from posmv.operators import prices as px
from posmv.operators.positions import TICKER, positions


def _row(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail"))


def _equal(published: DataFrame, expected: DataFrame, keys: list[str], name: str) -> DataFrame:
    found = checks.compare(published, expected, keys, "net_qty")
    ok = (F.col("different") + F.col("missing") + F.col("unexpected")) == 0
    return found.select(F.lit(name).alias("check"), ok.alias("ok"), F.format_string("%d keys, %d different, %d missing, %d unexpected", "keys", "different", "missing", "unexpected").alias("detail"))


def _values(published: DataFrame, held: DataFrame, recent: DataFrame, latest: DataFrame, name: str) -> DataFrame:
    """Against the outputs' own positions and the final raw prices, so lag is told from error; what is skipped is told
    as well, as it is not proven right."""
    verdicts = checks.classify(published, held, recent, latest)
    count = lambda v: F.count_if(F.col("verdict") == v)
    return _row(verdicts, name, count("wrong") == 0, F.format_string("%d exact, %d lag, %d wrong", count("exact"), count("lag"), count("wrong")))


def validate(trades: DataFrame, prices: DataFrame, out: dict[str, DataFrame], order: tuple[str, ...], lag_ms: int = 2000) -> DataFrame:
    """check, ok, detail. A value is late, not wrong, if its price was in force within lag_ms of its symbol's newest tick. trades and prices as they were sent (ids may repeat); out by the names of the outputs."""
    first = dedup.first_wins(trades, order)
    by_account, by_ticker = out["position-by-account-ticker"], out["position-by-ticker"]
    rows = [
        dedup.accounting(trades).select(F.lit("uniqueness").alias("check"), (F.col("total") == F.col("distinct_ids") + F.col("duplicates")).alias("ok"), F.format_string("%d sent, %d ids, %d duplicates", "total", "distinct_ids", "duplicates").alias("detail")),
        _equal(by_account, positions(first), ["account", "ticker"], "positions by account and ticker"),
        _equal(by_ticker, positions(first, TICKER), ["ticker"], "positions by ticker"),
        _row(checks.completeness(by_account, by_ticker), "completeness", F.count_if(~F.col("complete")) == 0, F.format_string("%d tickers, %d incomplete", F.count("*"), F.count_if(~F.col("complete")))),
    ]
    if "mv-by-ticker" in out:
        latest, recent = px.latest(prices), px.stats(px.trailing(prices, lag_ms))
        rows.append(_values(out["mv-by-ticker"], by_ticker, recent, latest, "market values by ticker"))
        unpriced = by_ticker.join(out["mv-by-ticker"].select("ticker"), "ticker", "left_anti").join(latest.select(F.col("symbol").alias("ticker")), "ticker", "left_semi")
        rows.append(_row(unpriced, "coverage", F.count("*") == 0, F.format_string("%d tickers with a price have no value", F.count("*"))))
    if "mv-by-account-ticker" in out:
        rows.append(_values(out["mv-by-account-ticker"], by_account, recent, latest, "market values by account and ticker"))
        bad = checks.arithmetic_errors(out["mv-by-account-ticker"])
        rows.append(_row(bad, "arithmetic", F.count("*") == 0, F.format_string("%d rows where price times quantity is not the value", F.count("*"))))
    return reduce(DataFrame.unionByName, rows)


def ordering(log: DataFrame, key: str, time: str, arrival: str) -> DataFrame:
    """check, ok, detail of an upsert log: no key may go back in time or end on an older record."""
    found = checks.order_violations(log, key, time, arrival)
    back, stale = F.coalesce(F.sum("time_backwards"), F.lit(0)), F.count_if("ends_stale")
    return _row(found, "ordering", (back == 0) & (stale == 0), F.format_string("%d records back in time, %d keys end stale", back, stale))
