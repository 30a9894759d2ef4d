"""Properties that hold for any input."""

from collections import defaultdict
from decimal import Decimal

import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from posmv.config import Config  # noqa: E402
from posmv.operators import checks, dedup  # noqa: E402
from posmv.operators import positions as pos  # noqa: E402
from posmv.operators import prices as px  # noqa: E402
from posmv.plans import batch  # noqa: E402
from posmv.streaming import stateful  # noqa: E402
from tests.test_operators import prices, rows, trades  # noqa: E402
from tests.test_streaming import Harness, P, T  # noqa: E402

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
many = settings(max_examples=200, deadline=None, derandomize=True)

trade = st.tuples(st.integers(0, 8).map("T-{}".format), st.sampled_from(["A", "B"]), st.sampled_from(["X", "Y", "Z"]), st.integers(-(10**12), 10**12), st.integers(0, 50))
tick = st.tuples(st.sampled_from(["X", "Y"]), st.decimals(0, 10**9, places=2).map(str), st.integers(0, 50))
ORDER = ("event_time", "qty", "account", "ticker")


@few
@given(st.lists(trade, max_size=20), st.lists(tick, max_size=12), st.randoms())
def test_order_of_arrival_does_not_matter(spark, sent, ticks, rng):
    numbered = [(*t, i) for i, t in enumerate(ticks)]
    want = batch.outputs(trades(spark, sent), prices(spark, numbered), Config(), ORDER)
    other, others = sent[:], numbered[:]
    rng.shuffle(other)
    rng.shuffle(others)
    got = batch.outputs(trades(spark, other), prices(spark, others), Config({"price.salt.factor": "4"}), ORDER)
    for name, df in want.items():
        assert rows(df, *df.columns) == rows(got[name], *df.columns)


@few
@given(st.lists(trade, max_size=20))
def test_dedup_twice_is_dedup_once_and_accounts_add_up(spark, sent):
    once = dedup.first_wins(trades(spark, sent), ORDER)
    assert rows(once, *once.columns) == rows(dedup.first_wins(once, ORDER), *once.columns)
    assert once.count() == len({t[0] for t in sent})
    assert checks.completeness(pos.positions(once), pos.positions(once, pos.TICKER)).filter("NOT complete").count() == 0


@few
@given(st.lists(tick, max_size=20), st.integers(1, 16), st.integers(1, 30))
def test_newest_of_newest(spark, ticks, factor, window):
    p = prices(spark, [(*t, i) for i, t in enumerate(ticks)])
    want = rows(px.latest(p), "symbol", "price", "event_time")
    assert rows(px.salted_latest(p, factor), "symbol", "price", "event_time") == want
    assert rows(px.latest_from_windows(px.tumble_last(p, window)), "symbol", "price", "event_time") == want


@many
@given(st.lists(st.one_of(st.tuples(st.just("T"), st.sampled_from("AB"), st.integers(-100, 100), st.integers(0, 9)), st.tuples(st.just("P"), st.integers(0, 9999), st.integers(0, 9))), max_size=30))
def test_state_machine_agrees_with_recomputation(events):
    """After any events, in any order, a fired timer gives every holder's quantity times the newest price."""
    h = Harness(stateful.MarketValues(1000), ("AAPL",))
    held, newest = defaultdict(int), None
    for i, e in enumerate(events):
        if e[0] == "T":
            h.send(T(e[1], e[2], e[3]))
            held[e[1]] += e[2]
        else:
            price = Decimal(e[1]) / 100
            h.send(P(str(price), e[2], i))
            newest = max(newest or (-1, -1, None), (e[2], i, price))
    got = {r.account: r.mv for r in h.to(10**6)}
    assert got == ({a: q * newest[2] for a, q in held.items()} if newest and events else {})


@many
@given(st.lists(st.tuples(st.integers(0, 9999), st.integers(0, 9)), min_size=1, max_size=20), st.integers(1, 500))
def test_conflation_never_loses_the_newest(ticks, gap):
    h = Harness(stateful.NewestTick(250), ("X", 0))
    from pyspark.sql import Row

    out = []
    for i, (cents, time) in enumerate(ticks):
        out += h.to(i * gap)
        h.send(Row(price=Decimal(cents) / 100, event_time=time, seq=i))
    out += h.to(10**9)
    best = max(range(len(ticks)), key=lambda i: (ticks[i][1], i))
    assert (ticks[best][1], best) == max((r.event_time, r.seq) for r in out)
    assert len(out) <= len(ticks)
