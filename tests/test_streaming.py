"""Streams against batch, restart, replay, and the state processors by themselves."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from posmv.config import Config
from posmv.operators import dedup
from posmv.operators.positions import positions
from posmv.plans import streams
from posmv.sources import schemas
from posmv.sources.readers import read_json_lines, stream_files
from posmv.streaming import jobs, observe, stateful
from posmv.streaming.sinks import KeyedTable
from tests.test_operators import GOLDEN, PRICES, prices, rows, trades

NOW = {"availableNow": True}


@pytest.fixture
def own(spark):
    return streams.session(spark)


def test_positions_with_restart(own, tmp_path):
    src, out = str(tmp_path / "in"), jobs.Outputs(own, str(tmp_path / "out"))
    config = Config({"dedup.state.ttl.ms": "0"})

    def run():
        jobs.finish(jobs.start_positions(stream_files(own, src, schemas.TRADE), out.by_account, ("account", "ticker"), out.checkpoint("p"), config, NOW), 120)

    trades(own, GOLDEN[:3]).coalesce(1).write.mode("append").parquet(src)
    run()
    trades(own, GOLDEN[2:]).coalesce(1).write.mode("append").parquet(src)  # the repeated trade comes after the restart
    run()
    assert rows(out.by_account.read(), "account", "ticker", "net_qty", "as_of") == [("ACC-001", "AAPL", 110, 5000), ("ACC-001", "MSFT", -30, 3000), ("ACC-002", "AAPL", 30, 4000)]


def test_market_values_of_both_inputs(own, tmp_path):
    t, p, out = str(tmp_path / "t"), str(tmp_path / "p"), jobs.Outputs(own, str(tmp_path / "out"))
    config = Config({"dedup.state.ttl.ms": "0"})
    ticks = prices(own, PRICES)

    def run():
        jobs.finish(jobs.start_market_values(stream_files(own, t, schemas.TRADE), stream_files(own, p, ticks.schema), out, config, NOW), 120)

    ticks.limit(0).write.parquet(p)
    trades(own).coalesce(1).write.parquet(t)
    run()
    assert out.mv_account.read().count() == 0  # no price yet
    ticks.coalesce(1).write.mode("append").parquet(p)
    run()
    assert rows(out.mv_ticker.read(), "ticker", "mv") == [("AAPL", Decimal("21770.00")), ("MSFT", Decimal("-12307.50"))]
    older = prices(own, [("AAPL", "1.00", 5, 99)])
    older.coalesce(1).write.mode("append").parquet(p)
    run()
    assert rows(out.mv_ticker.read(), "ticker", "mv")[0] == ("AAPL", Decimal("21770.00"))  # an older tick that comes late


def test_replay_replaces(own, tmp_path):
    table = KeyedTable(own, str(tmp_path / "t"), schemas.TICKER_POSITION, ("ticker",))
    frame = lambda *r: own.createDataFrame(list(r), schemas.TICKER_POSITION)
    table.upsert(frame(("A", 1, 1), ("B", 2, 2)), 0)
    table.upsert(frame(("A", 5, 3)), 1)
    table.upsert(frame(("A", 5, 3)), 1)
    assert rows(table.read(), "ticker", "net_qty") == [("A", 5), ("B", 2)]
    assert rows(table.read(1), "ticker", "net_qty") == [("A", 1), ("B", 2)]
    assert table.log().count() == 3
    twice = KeyedTable(own, str(tmp_path / "u"), schemas.TICKER_POSITION, ("ticker",), "at-least-once")
    twice.upsert(frame(("A", 5, 3)), 1)
    twice.upsert(frame(("A", 5, 3)), 1)
    assert twice.log().count() == 2 and twice.read().count() == 1


def test_fold(own, tmp_path):
    table = KeyedTable(own, str(tmp_path / "t"), schemas.TICKER_POSITION, ("ticker",), fold_after=2)
    for i in range(8):
        table.upsert(own.createDataFrame([("A", i, i), (f"K{i}", i, i)], schemas.TICKER_POSITION), i)
    assert rows(table.read(), "ticker", "net_qty") == sorted([("A", 7)] + [(f"K{i}", i) for i in range(8)])
    assert rows(table.read(7), "ticker", "net_qty") == sorted([("A", 6)] + [(f"K{i}", i) for i in range(7)])
    assert table.log().select("batch").distinct().count() <= 4
    before = table.log().count()
    table.fold(0)
    assert table.log().count() == before


def test_fold_that_breaks_off(own, tmp_path, monkeypatch):
    """The old batches are still there, or some of them: the state is the same."""
    table = KeyedTable(own, str(tmp_path / "t"), schemas.TICKER_POSITION, ("ticker",), fold_after=2)
    table.fold_after = 99
    for i in range(6):
        table.upsert(own.createDataFrame([("A", i, i), (f"K{i}", i, i)], schemas.TICKER_POSITION), i)
    want = rows(table.read(), "ticker", "net_qty")
    kept = {p.name: p for p in (tmp_path / "t").iterdir()}
    import shutil

    shutil.copytree(tmp_path / "t", tmp_path / "copy")
    table.fold_after = 2
    table.fold(4)
    assert rows(table.read(), "ticker", "net_qty") == want
    for name in list(kept)[:3]:  # as if their deletion had not been reached
        shutil.copytree(tmp_path / "copy" / name, tmp_path / "t" / name, dirs_exist_ok=True)
    assert rows(table.read(), "ticker", "net_qty") == want
    table.upsert(own.createDataFrame([("A", 9, 9)], schemas.TICKER_POSITION), 6)
    table.fold(5)
    assert dict(rows(table.read(), "ticker", "net_qty"))["A"] == 9


def test_dedup_within_time(own, tmp_path):
    src = str(tmp_path / "in")
    trades(own, [("T", "A", "X", 1, 1000), ("T", "A", "X", 1, 1000), ("U", "A", "X", 2, 2000)]).coalesce(1).write.parquet(src)
    out = jobs.Outputs(own, str(tmp_path / "out"))
    jobs.finish(jobs.start_positions(stream_files(own, src, schemas.TRADE), out.by_ticker, ("ticker",), out.checkpoint("p"), Config(), NOW), 120)
    assert rows(out.by_ticker.read(), "net_qty") == [(3,)]


def test_state_machine_query(own, tmp_path):
    stateful.use_rocksdb(own)
    src = str(tmp_path / "in")
    once = dedup.first_wins(trades(own), ("event_time",))
    jobs.tagged(once, prices(own, PRICES)).coalesce(1).write.parquet(src)
    source = stream_files(own, src, jobs.SOURCE)
    table = KeyedTable(own, str(tmp_path / "out"), schemas.MARKET_VALUE, ("account", "ticker"))

    def last(batch, n):
        newest = batch.withColumn("at", F.monotonically_increasing_id()).groupBy("account", "ticker").agg(F.max_by(F.struct("net_qty", "price", "mv", "as_of"), "at").alias("v"))
        table.upsert(newest.select("account", "ticker", "v.*"), n)

    q = stateful.market_values(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(**NOW).foreachBatch(last).start()
    jobs.finish(q, 120)
    assert rows(table.read(), "account", "ticker", "mv") == [("ACC-001", "AAPL", Decimal("17105.00")), ("ACC-001", "MSFT", Decimal("-12307.50")), ("ACC-002", "AAPL", Decimal("4665.00"))]


def test_progress_lines(own, tmp_path):
    src = str(tmp_path / "in")
    own.createDataFrame([('{"a":1}',), ("{bad",)], "value string").coalesce(1).write.text(src)
    listener = observe.Progress(str(tmp_path / "lines"))
    own.streams.addListener(listener)
    try:
        raw = observe.metered(own.readStream.text(src), "raw")
        jobs.finish(raw.writeStream.format("noop").queryName("meter").option("checkpointLocation", str(tmp_path / "c")).trigger(**NOW).start(), 120)
        own.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        import time

        for _ in range(50):
            lines = [json.loads(x) for x in open(tmp_path / "lines")] if (tmp_path / "lines").exists() else []
            if any(x["event"] == "progress" and x["observed"] for x in lines):
                break
            time.sleep(0.2)
    finally:
        own.streams.removeListener(listener)
    seen = [x["observed"]["raw"] for x in lines if x["event"] == "progress" and x["observed"]]
    assert sum(x["records"] for x in seen) == 2 and sum(x["malformed"] for x in seen) == 1


def test_json_dump_skips_bad_lines(own, tmp_path):
    (tmp_path / "f.json").write_text('{"symbol":"X","price":"1.00","event_time":5}\nnot json\n')
    assert read_json_lines(own, str(tmp_path / "f.json"), schemas.PRICE).count() == 1


# The processors by themselves, on state that is held in memory and a clock that the test moves.


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = tuple(v)

    def clear(self):
        self.v = None


class Map(dict):
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__

    def iterator(self):
        return iter(list(self.items()))


class Harness:
    """One key."""

    def __init__(self, processor, key):
        self.p, self.key, self.now, self.timers = processor, key, 0, []
        self.ttl = {}
        processor.init(self)

    def getValueState(self, name, schema, ttl=None):
        self.ttl[name] = ttl
        return Value()

    def getMapState(self, name, key, value):
        return Map()

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def send(self, *given):
        return list(self.p.handleInputRows(self.key, iter(given), self))

    def to(self, now):
        out = []
        self.now = now
        for at in [t for t in self.timers if t <= now]:
            self.timers.remove(at)
            out += self.p.handleExpiredTimer(self.key, self, None)
        return out


def T(account, qty, time):
    return Row(kind="T", account=account, ticker="AAPL", qty=qty, price=None, event_time=time, seq=None)


def P(price, time, seq=0):
    return Row(kind="P", account=None, ticker="AAPL", qty=None, price=Decimal(price), event_time=time, seq=seq)


def test_position_waits_for_price_then_all_are_revalued():
    h = Harness(stateful.MarketValues(0), ("AAPL",))
    assert h.send(T("A", 100, 1)) == []
    assert [r.mv for r in h.send(P("150.00", 2))] == [Decimal("15000.00")]
    assert [r.mv for r in h.send(T("B", -40, 3))] == [Decimal("-6000.00")]
    assert {r.account: r.mv for r in h.send(P("160.00", 4))} == {"A": Decimal("16000.00"), "B": Decimal("-6400.00")}
    assert h.send(P("1.00", 3)) == []  # older, late
    assert {r.price for r in h.send(P("161.00", 4, 1))} == {Decimal("161.00")}  # same time, later in the source


def test_batch_reads_and_writes_a_holder_once():
    def counted(processor):
        h, n = Harness(processor, ("AAPL",)), [0]

        class Counted(Map):
            def containsKey(self, k):
                n[0] += 1
                return k in self

            def updateValue(self, k, v):
                n[0] += 1
                self[k] = v

        processor.holders = Counted()
        return h, n

    batches = [[T("A", 1, i) for i in range(200)] + [P("2.00", 50), P("3.00", 60)] + [T("B", 5, 70)], [T("A", 7, 300), T("C", -2, 1)], [P("1.00", 10)], [P("4.00", 400)], [T("B", -5, 500), P("5.00", 450)]]
    (each, n), (once, m) = counted(stateful.MarketValues(0)), counted(stateful.MarketValues(0, each=False))
    for batch in batches:
        shown = {r.account: r for r in each.send(*batch)}
        got = once.send(*reversed(batch))  # in any order
        assert {r.account: r for r in got} == shown and len(got) == len(shown)
    assert {r.account: (r.net_qty, r.mv) for r in got} == {"A": (207, Decimal("1035.00")), "B": (0, Decimal("0.00")), "C": (-2, Decimal("-10.00"))}
    assert n[0] <= 2 * 5 and m[0] == 2 * 5


def test_burst_gives_one_row():
    h = Harness(stateful.MarketValues(1000), ("AAPL",))
    out = [r for i in range(21) for r in h.send(P(f"100.{i:02}", i, i))] + h.send(T("A", 10, 30), T("A", 45, 40))
    assert out == [] and len(h.timers) == 1
    got = h.to(1000)
    assert [(r.net_qty, r.mv) for r in got] == [(55, Decimal("5511.00"))]
    assert h.to(5000) == []


def test_steady_ticks_give_one_row_an_interval():
    h = Harness(stateful.MarketValues(1000), ("AAPL",))
    h.send(T("A", 1, 0))
    h.to(1000)
    emitted = []
    for interval in range(1, 6):
        for tick in range(50):
            h.now = interval * 1000 + tick * 20
            h.send(P("10.00", h.now, tick))
        emitted.append(len(h.to((interval + 1) * 1000)))
    assert sum(emitted) == 5


def test_positions_conflate():
    h = Harness(stateful.Positions(250), ("A", "AAPL"))
    row = lambda q, t: Row(qty=q, event_time=t)
    assert h.send(row(100, 1000)) + h.send(row(-30, 2000)) + h.send(row(5, 3000)) == []
    assert [(r.net_qty, r.as_of) for r in h.to(250)] == [(75, 3000)]
    h.send(row(50, 4000))
    assert [r.net_qty for r in h.to(600)] == [125]
    each = Harness(stateful.Positions(0), ("A", "AAPL"))
    assert [r.net_qty for r in each.send(row(100, 1), row(-30, 2))] == [100, 70]


def test_first_wins_and_its_time_to_live():
    h = Harness(stateful.FirstWins(1000), ("T-9",))
    row = lambda q, t: Row(trade_id="T-9", account="A", ticker="X", qty=q, event_time=t)
    assert [r.qty for r in h.send(row(100, 1), row(999, 2))] == [100]
    assert h.send(row(999, 3)) == [] and h.ttl["seen"] == 1000


def test_newest_tick_on_aligned_timers():
    h = Harness(stateful.NewestTick(250), ("X", 0))
    h.now = 260
    row = lambda p, t: Row(price=Decimal(p), event_time=t, seq=t)
    assert h.send(row("2.00", 20), row("1.00", 10)) == [] and h.timers == [500]
    assert [(r.price, r.event_time) for r in h.to(500)] == [(Decimal("2.00"), 20)]
    assert h.to(1000) == []
    assert len(Harness(stateful.NewestTick(0), ("X", 0)).send(row("2.00", 20), row("1.00", 10))) == 2
