"""Operators with state of their own for each key, for what triggers cannot give: emission per event, timers that
run for each key by itself, and ids that expire by the clock.

They need the RocksDB state store. Queries with timers run on a processing-time trigger and are stopped; with
availableNow they would wait for timers without end.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from posmv.sources import schemas

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """Event time, then the source's order; a batch has no order of its own."""
    return sorted(rows, key=lambda r: (r.event_time, -1 if r.seq is None else r.seq, r.kind))


def newer(held: tuple | None, price: Decimal, time: int, seq: int) -> tuple:
    """The newer of a held (price, time, seq) and a tick; an older tick that comes late is dropped."""
    return held if held is not None and held[1:] > (time, seq) else (price, time, seq)


def value_row(ticker: str, account: str, qty: int, as_of: int, tick: tuple) -> Row:
    return Row(account=account, ticker=ticker, net_qty=qty, price=tick[0], mv=Decimal(qty) * tick[0], as_of=max(as_of, tick[1]))


class MarketValues(StatefulProcessor):
    """Rows of jobs.SOURCE by ticker to market values by account. interval_ms 0: a trade emits its holder, a tick
    all holders; or, if not `each`, a batch emits once what its inputs changed, all holders if the price did. Otherwise
    inputs only change the state and arm one timer; it emits all holders once.

    A batch reads and writes the state of a holder once: each access is a message to the JVM and back."""

    def __init__(self, interval_ms: int = 0, each: bool = True):
        self.interval_ms, self.each = interval_ms, each and interval_ms <= 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holders = handle.getMapState("holders", "account STRING", "qty BIGINT, as_of BIGINT")
        self.price = handle.getValueState("price", "price DECIMAL(18,2), event_time BIGINT, seq BIGINT")
        self.armed = handle.getValueState("armed", "at BIGINT")

    def _tick(self) -> tuple | None:
        return tuple(self.price.get()) if self.price.exists() else None

    def _all(self, ticker: str) -> Iterator[Row]:
        if (tick := self._tick()) is not None:
            for account, held in self.holders.iterator():
                yield value_row(ticker, account[0], held[0], held[1], tick)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tick = self._tick()
        held: dict = {}  # of the holders in use, as they are now
        changed: set = set()
        whole = False

        def everyone() -> dict:
            nonlocal whole
            if not whole:
                for account, stored in self.holders.iterator():
                    held.setdefault(account[0], tuple(stored))
                whole = True
            return held

        for r in _in_order(rows) if self.each else rows:
            if r.kind == "T":
                if r.account not in held and not whole and self.holders.containsKey((r.account,)):
                    held[r.account] = tuple(self.holders.getValue((r.account,)))
                qty, as_of = held.get(r.account, (0, r.event_time))
                held[r.account] = qty + r.qty, max(as_of, r.event_time)
                changed.add(r.account)
                if self.each and tick is not None:
                    yield value_row(key[0], r.account, *held[r.account], tick)
            elif (newest := newer(tick, r.price, r.event_time, r.seq)) is not tick:
                tick = newest
                if self.each:
                    for account, (qty, as_of) in everyone().items():
                        yield value_row(key[0], account, qty, as_of, tick)
        if self.interval_ms <= 0 and not self.each and tick is not None:
            for account in everyone() if tick is not before else changed:
                yield value_row(key[0], account, *held[account], tick)
        for account in changed:
            self.holders.updateValue((account,), held[account])
        if tick is not before:
            self.price.update(tick)
        if self.interval_ms > 0 and not self.armed.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.interval_ms
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.armed.clear()
        yield from self._all(key[0])

    def close(self) -> None:
        pass


class Positions(StatefulProcessor):
    """Trades by account and ticker to running positions; conflated like MarketValues."""

    def __init__(self, interval_ms: int = 0):
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "qty BIGINT, as_of BIGINT")
        self.armed = handle.getValueState("armed", "at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        qty, as_of = self.held.get() if self.held.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: r.event_time):
            qty, as_of = qty + r.qty, max(as_of, r.event_time)
            if self.interval_ms <= 0:
                yield Row(account=key[0], ticker=key[1], net_qty=qty, as_of=as_of)
        self.held.update((qty, as_of))
        if self.interval_ms > 0 and not self.armed.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.interval_ms
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.armed.clear()
        qty, as_of = self.held.get()
        yield Row(account=key[0], ticker=key[1], net_qty=qty, as_of=as_of)

    def close(self) -> None:
        pass


class FirstWins(StatefulProcessor):
    """The first row of each id; ids expire ttl_ms after they were first seen, by the clock. A repeat does not
    renew its id."""

    def __init__(self, ttl_ms: int | None = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes BOOLEAN", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda r: (r.event_time, r.qty, r.account, r.ticker))

    def close(self) -> None:
        pass


class NewestTick(StatefulProcessor):
    """Ticks by symbol and salt: the newest is emitted at the next multiple of interval_ms and forgotten; 0 passes
    all on."""

    def __init__(self, interval_ms: int = 0):
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "price DECIMAL(18,2), event_time BIGINT, seq BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            if self.interval_ms <= 0:
                yield Row(symbol=key[0], price=r.price, event_time=r.event_time, seq=r.seq)
                continue
            held = tuple(self.best.get()) if self.best.exists() else None
            if held is None:
                self.handle.registerTimer((timerValues.getCurrentProcessingTimeInMs() // self.interval_ms + 1) * self.interval_ms)
            self.best.update(newer(held, r.price, r.event_time, r.seq))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.best.exists():
            price, time, seq = self.best.get()
            yield Row(symbol=key[0], price=price, event_time=time, seq=seq)
            self.best.clear()

    def close(self) -> None:
        pass


def _mode(interval_ms: int) -> str:
    return "ProcessingTime" if interval_ms > 0 else "None"


def market_values(source: DataFrame, interval_ms: int = 0, each: bool = True) -> DataFrame:
    return source.groupBy("ticker").transformWithState(MarketValues(interval_ms, each), schemas.MARKET_VALUE, "Update", _mode(interval_ms))


def running_positions(trades: DataFrame, interval_ms: int = 0) -> DataFrame:
    return trades.groupBy("account", "ticker").transformWithState(Positions(interval_ms), schemas.POSITION, "Update", _mode(interval_ms))


def first_wins(trades: DataFrame, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """trades: trade_id, account, ticker, qty, event_time."""
    return trades.groupBy("trade_id").transformWithState(FirstWins(ttl_ms), schemas.TRADE, "Append", "ProcessingTime" if ttl_ms else "None")


def newest_ticks(prices: DataFrame, salt: int, interval_ms: int = 0) -> DataFrame:
    from posmv.functions import scalars as S

    salted = prices.withColumn("salt", S.floor_mod("event_time", salt))
    return salted.groupBy("symbol", "salt").transformWithState(NewestTick(interval_ms), "symbol STRING, price DECIMAL(18,2), event_time BIGINT, seq BIGINT", "Append", _mode(interval_ms))
