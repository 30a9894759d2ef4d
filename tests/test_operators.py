"""Golden data, hand-computed cases and properties of the batch operators."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from posmv.config import Config
from posmv.functions import scalars as S
from posmv.operators import cadence, checks, dedup, generate, marketvalue, parse
from posmv.operators import positions as pos
from posmv.operators import prices as px
from posmv.plans import batch, sqltext
from posmv.sources import schemas

ORDER = ("event_time", "qty")
GOLDEN = [
    ("T-1", "ACC-001", "AAPL", 100, 1000), ("T-2", "ACC-002", "AAPL", 50, 2000), ("T-1", "ACC-001", "AAPL", 100, 1000),
    ("T-3", "ACC-001", "MSFT", -30, 3000), ("T-4", "ACC-002", "AAPL", -20, 4000), ("T-5", "ACC-001", "AAPL", 10, 5000),
]
PRICES = [("AAPL", "155.50", 9000), ("MSFT", "410.25", 9000)]


def trades(spark, rows=GOLDEN):
    return spark.createDataFrame(rows, schemas.TRADE)


def prices(spark, rows):
    """(symbol, price, event_time[, seq])"""
    full = [(s, Decimal(p), t, r[0] if r else i) for i, (s, p, t, *r) in enumerate(rows)]
    return spark.createDataFrame(full, "symbol string, price decimal(18,2), event_time bigint, seq bigint")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def outputs(spark, given=GOLDEN, ticks=PRICES, **config):
    return batch.outputs(trades(spark, given), prices(spark, ticks), Config(config), ORDER)


def test_golden_outputs(spark):
    out = outputs(spark)
    assert rows(out["position-by-account-ticker"], "account", "ticker", "net_qty", "as_of") == [("ACC-001", "AAPL", 110, 5000), ("ACC-001", "MSFT", -30, 3000), ("ACC-002", "AAPL", 30, 4000)]
    assert rows(out["position-by-ticker"], "ticker", "net_qty") == [("AAPL", 140), ("MSFT", -30)]
    assert rows(out["mv-by-account-ticker"], "account", "ticker", "mv") == [("ACC-001", "AAPL", Decimal("17105.00")), ("ACC-001", "MSFT", Decimal("-12307.50")), ("ACC-002", "AAPL", Decimal("4665.00"))]
    assert rows(out["mv-by-ticker"], "ticker", "mv", "as_of") == [("AAPL", Decimal("21770.00"), 9000), ("MSFT", Decimal("-12307.50"), 9000)]


def test_golden_any_order(spark):
    want = {k: rows(v, *v.columns) for k, v in outputs(spark).items()}
    for seed in range(3):
        shuffled = GOLDEN[:]
        random.Random(seed).shuffle(shuffled)
        assert {k: rows(v, *v.columns) for k, v in outputs(spark, shuffled).items()} == want


def test_flags_prune(spark):
    assert set(outputs(spark, **{"positions.only": "true"})) == {"position-by-account-ticker", "position-by-ticker"}
    assert set(outputs(spark, **{"single.output": "true"})) == {"position-by-ticker", "mv-by-ticker"}
    assert set(outputs(spark, **{"positions.only": "true", "single.output": "true"})) == {"position-by-ticker"}


def test_without_dedup_repeats_count(spark):
    out = outputs(spark, **{"dedup.enabled": "false"})
    assert ("AAPL", 240) in rows(out["position-by-ticker"], "ticker", "net_qty")


def test_sql_text_gives_the_same(spark):
    raw = trades(spark).select(F.to_json(F.struct("*")).alias("value"))
    ticks = prices(spark, PRICES).select(F.to_json(F.struct("symbol", F.col("price").cast("string").alias("price"), "event_time")).alias("value"), "seq")
    got = sqltext.outputs(spark, raw, ticks)
    for name, df in outputs(spark).items():
        assert rows(got[name], *df.columns) == rows(df, *df.columns)


def test_first_wins_with_differing_rows(spark):
    t = trades(spark, [("T-9", "ACC-001", "AAPL", 999, 2), ("T-9", "ACC-001", "AAPL", 100, 1)])
    assert rows(dedup.first_wins(t, ORDER), "qty") == [(100,)]
    assert dedup.accounting(t).first().asDict() == {"total": 2, "distinct_ids": 1, "duplicates": 1}
    assert dedup.accounting(trades(spark, [])).first().asDict() == {"total": 0, "distinct_ids": 0, "duplicates": 0}
    assert "__rank" not in dedup.first_wins(t, ORDER).columns


def test_running_sums(spark):
    t = trades(spark, [("1", "ACC-001", "AAPL", 100, 1000), ("2", "ACC-001", "AAPL", -30, 2000), ("3", "ACC-002", "AAPL", 50, 3000), ("4", "ACC-001", "MSFT", 10, 4000), ("5", "ACC-001", "AAPL", 5, 5000)])
    assert rows(pos.snapshots(t), "trade_id", "net_qty") == [("1", 100), ("2", 70), ("3", 50), ("4", 10), ("5", 75)]
    by_ticker = trades(spark, [("1", "A", "X", 100, 1), ("2", "B", "X", 50, 2), ("3", "A", "X", -20, 3)])
    assert rows(pos.snapshots(by_ticker, pos.TICKER), "trade_id", "net_qty") == [("1", 100), ("2", 150), ("3", 130)]


def test_concat_key_equals_two_columns(spark):
    a = pos.positions(trades(spark))
    b = pos.positions_concat_key(trades(spark))
    assert rows(a, "account", "ticker", "net_qty", "as_of") == rows(b, "account", "ticker", "net_qty", "as_of")
    assert rows(pos.roll_up(a), "ticker", "net_qty") == rows(pos.positions(trades(spark), pos.TICKER), "ticker", "net_qty")


def test_no_value_before_a_price(spark):
    held = pos.positions(trades(spark))
    assert marketvalue.market_values(held, px.latest(prices(spark, []))).count() == 0
    assert rows(marketvalue.without_price(held, px.latest(prices(spark, PRICES[:1]))), "ticker") == [("MSFT",)]


def test_each_tick_revalues_all_holders(spark):
    held = spark.createDataFrame([("A", "X", 100, 1), ("B", "X", -40, 1)], schemas.POSITION)
    ticks = prices(spark, [("X", "150.00", 2), ("X", "160.00", 3)])
    out = marketvalue.revalue_on_ticks(held, ticks)
    assert out.count() == 4
    assert rows(out.filter("seq = 1"), "account", "mv") == [("A", Decimal("16000.00")), ("B", Decimal("-6400.00"))]
    assert checks.arithmetic_errors(out).count() == 0


def test_changed_tickers_only(spark):
    held = pos.positions(trades(spark))
    changed = spark.createDataFrame([("MSFT",), ("MSFT",)], "ticker string")
    assert rows(marketvalue.changed_only(held, px.latest(prices(spark, PRICES)), changed), "ticker") == [("MSFT",)]


def test_extreme_price_is_exact(spark):
    held = spark.createDataFrame([("A", "X", 999_999, 1)], schemas.POSITION)
    out = marketvalue.market_values(held, px.latest(prices(spark, [("X", "10000000000000.00", 2)]))).first()
    assert out.mv == Decimal("9999990000000000000.00")


def test_newest_price_under_disorder_and_ties(spark):
    p = prices(spark, [("X", "3.00", 30, 2), ("X", "1.00", 10, 5), ("X", "2.00", 30, 1), ("Y", "9.00", 1, 0)])
    want = [("X", Decimal("3.00"), 30), ("Y", Decimal("9.00"), 1)]
    assert rows(px.latest(p), "symbol", "price", "event_time") == want
    assert rows(px.latest_by_rank(p), "symbol", "price", "event_time") == want
    for factor in (1, 2, 3, 8, 16):
        assert rows(px.salted_latest(p, factor), "symbol", "price", "event_time") == want
    assert rows(px.latest_from_windows(px.tumble_last(p, 7)), "symbol", "price", "event_time") == want


def test_windows_keep_their_last_tick(spark):
    p = prices(spark, [("X", "1.00", 0), ("X", "2.00", 249), ("X", "3.00", 250), ("X", "4.00", 499)])
    want = [(0, Decimal("2.00")), (250, Decimal("4.00"))]
    assert rows(px.tumble_last(p), "window_start", "price") == want
    assert rows(px.salted_tumble(p, 250, 4), "window_start", "price") == want


def test_negative_times(spark):
    df = spark.createDataFrame([(-3,)], "v bigint").select(S.floor_mod("v", 8).alias("f"), S.sign_mod("v", 8).alias("s"))
    assert tuple(df.first()) == (5, -3)


def test_parse_faults(spark):
    raw = spark.createDataFrame([("{not json",), ("",), ('{"trade_id":"a","account":"b","ticker":"c","qty":5,"event_time":6,"more":1}',), ('{"trade_id":"a","account":"b","ticker":"c"}',), ('{"trade_id":"a","ticker":"c","qty":5}',), (None,)], "value string")
    assert rows(parse.parse_trades(raw), "qty", "event_time") == [(0, 0), (5, 6)]
    seen, counter = parse.counted(raw, "raw")
    seen.count()
    assert counter.get["records"] == 6 and counter.get["malformed"] >= 2


@pytest.mark.parametrize("text, strict, rounded", [("184.52", 18452, 18452), ("0.005", None, 1), ("1.234", None, 123), ("abc", None, None), ("", None, None), ("7", 700, 700), ("-2.50", -250, -250), ("92233720368547758.07", 2**63 - 1, 2**63 - 1), ("92233720368547758.08", None, None), ("1.10000", 110, 110)])
def test_price_texts(spark, text, strict, rounded):
    df = spark.createDataFrame([(text,)], "p string").select(S.exact_cents(F.col("p")).alias("s"), S.rounded_cents(F.col("p")).alias("r"))
    assert tuple(df.first()) == (strict, rounded)


def test_keyed_json(spark):
    out = outputs(spark)["mv-by-ticker"]
    got = {r.key: r.value for r in parse.to_keyed_json(out, ["ticker"]).collect()}
    assert got["AAPL"] == '{"ticker":"AAPL","net_qty":140,"price":"155.50","mv":"21770.00","as_of":9000}'
    back = parse.from_keyed_json(parse.to_keyed_json(out, ["ticker"]), schemas.TICKER_MARKET_VALUE)
    assert rows(back, "ticker", "mv") == rows(out, "ticker", "mv")
    sentinel = parse.to_keyed_json(spark.createDataFrame([(None, "X", 1, 2)], schemas.POSITION), ["account", "ticker"], "?").first()
    assert sentinel.key == "?|X" and "account" not in sentinel.value


def test_cumulate(spark):
    t = trades(spark, [("1", "A", "X", 5, 100), ("2", "A", "X", 7, 1200), ("3", "A", "X", 1, 4100)])
    got = rows(pos.cumulate(t, 1000, 4000), "window_start", "window_end", "net_qty")
    assert got == [(0, 1000, 5), (0, 2000, 12), (0, 3000, 12), (0, 4000, 12), (4000, 5000, 1), (4000, 6000, 1), (4000, 7000, 1), (4000, 8000, 1)]


def test_conflation_and_rates(spark):
    up = spark.createDataFrame([("A", 75, 1), ("A", 70, 2), ("A", 100, 3), ("A", 150, 300), ("B", 1, 260)], "k string, v int, as_of bigint")
    out = cadence.conflate(up, ("k",), 250, ("as_of",), ("v",))
    assert rows(out, "k", "v") == [("A", 100), ("A", 150), ("B", 1)]
    assert cadence.rates(up, ("k",), 250, 1).first().within_limit is False
    assert cadence.rates(out, ("k",), 250, 1).first().asDict() == {"keys": 2, "updates": 3, "worst": 1, "mean": 1.0, "within_limit": True}
    assert cadence.conflate(up, ("k",), 0, ("as_of",), ("v",)).count() == 5


def test_compare_counts_both_sides(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 1), ("z", None)], "k string, v int")
    assert checks.compare(a, b, ["k"], "v").first().asDict() == {"keys": 4, "equal": 2, "different": 1, "missing": 1, "unexpected": 0}
    assert checks.compare(a.limit(0), b, ["k"], "v").first().missing == 4


def test_upsert_log_state(spark):
    log = spark.createDataFrame([("a", "1", 1), ("a", "2", 3), ("b", "9", 2), ("b", None, 4)], "key string, value string, offset int")
    assert rows(checks.last_per_key(log), "key", "value") == [("a", "2")]


def test_order_checks(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 3, 3), ("b", 1, 1), ("b", 2, 2)], "k string, t int, at int")
    got = {r.k: (r.records, r.time_backwards, r.ends_stale) for r in checks.order_violations(log, "k", "t", "at").collect()}
    assert got == {"a": (3, 1, True), "b": (2, 0, False)}


def test_records_of_one_arrival_come_in_the_sources_order(spark, tmp_path):
    from posmv.plans import catalogue

    # ids 104,729 apart have one arrival; the file has them backwards
    n = 7
    spark.sql(f"SELECT 104729L * ({n} - id) AS event_id, timestamp_seconds(1700000000 + 60 * ({n} - id)) AS ts, 5L AS user_id, double({n} - id) AS value FROM range({n})").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.order_violations(spark, str(tmp_path)).first()
    assert (got.symbol, got.records, got.time_backwards, got.value_backwards, got.ends_stale) == ("SYM0005", n, 0, 0, False)
    assert catalogue.ends_stale(spark, str(tmp_path)).first().ends_stale == 0


@pytest.mark.parametrize("n", [1, 2, 4, 11, 100])
def test_percentiles_by_formula(spark, n):
    import math

    values = sorted((i * 37) % 101 for i in range(n))
    df = spark.createDataFrame([(1, v) for v in values], "g int, v bigint")
    near = checks.nearest_rank(df, "v").first()
    floor = checks.floor_rank(df, "v", ("g",)).first()
    for p in (50, 90, 99):
        assert near[f"p{p}"] == values[max(0, min(math.ceil(p / 100 * n) - 1, n - 1))]
        assert floor[f"q{p}"] == values[min(math.floor(p / 100 * n), n - 1)]


def test_verdicts(spark):
    held = spark.createDataFrame([("X", 10, 1), ("Y", 10, 1), ("Z", 10, 1), ("Q", 0, 1)], schemas.TICKER_POSITION)
    p = prices(spark, [(s, v, t) for s in "XYZQ" for v, t in (("1.00", 1), ("3.00", 2))])
    published = spark.createDataFrame([("X", Decimal("30.00")), ("Y", Decimal("20.00")), ("Z", Decimal("31.00")), ("Q", Decimal("1.00"))], "ticker string, mv decimal(38,2)")
    got = checks.classify(published, held, px.stats(p), px.latest(p))
    assert rows(got, "ticker", "verdict") == [("Q", "wrong"), ("X", "exact"), ("Y", "lag"), ("Z", "wrong")]


def test_old_prices_are_wrong_not_late(spark):
    held = spark.createDataFrame([("X", 10, 1)], schemas.TICKER_POSITION)
    p = prices(spark, [("X", "1.00", 1), ("X", "2.00", 5000), ("X", "3.00", 6000)])
    verdict = lambda mv, lag: checks.classify(spark.createDataFrame([("X", Decimal(mv))], "ticker string, mv decimal(38,2)"), held, px.stats(px.trailing(p, lag)), px.latest(p)).first().verdict
    assert [verdict("20.00", 2000), verdict("10.00", 2000), verdict("10.00", 5999), verdict("20.00", 999)] == ["lag", "wrong", "lag", "wrong"]


def test_samples_of_mismatches(spark):
    want = spark.createDataFrame([(k, i) for i, k in enumerate("ABCDE")], "k string, v int")
    got = spark.createDataFrame([("A", 0), ("B", 9), ("C", None), ("Z", 1)], "k string, v int")
    assert [tuple(r) for r in checks.samples(got, want, ["k"], "v").collect()] == [("B", 9, 1), ("C", None, 2), ("D", None, 3)]
    assert checks.samples(want, want, ["k"], "v").count() == 0


def test_staleness_in_ticks(spark):
    p = prices(spark, [("X", f"1.0{i}", 1000 * i) for i in range(5)])
    out = spark.createDataFrame([("X", 10, Decimal("10.20")), ("X", 10, Decimal("10.40"))], "ticker string, net_qty bigint, mv decimal(38,2)")
    got = sorted(round(r.stale_ms) for r in checks.staleness(out, px.latest(p), px.stats(p)).collect())
    assert got == [0, 2000]


def test_rings_and_trails(spark):
    p = prices(spark, [("X", "1.00", i) for i in range(10)])
    assert rows(px.ring(p, 3), "event_time", "age") == [(7, 3), (8, 2), (9, 1)]
    assert rows(px.trailing(p, 2), "event_time") == [(7,), (8,), (9,)]


def test_harness_arithmetic():
    assert checks.reachable(20, 10) == {"billed": 6.0, "waste": 0.5, "ok": False}
    assert checks.total_rate(2.5, 4) == 10
    assert checks.calibrated(110, 100) and not checks.calibrated(130, 100) and not checks.calibrated(1, 0)
    assert checks.drain_capacity([(0, 1000), (10, 900), (20, 800)], 5) == pytest.approx(15)
    assert [checks.lag_trend(100, x) for x in (110, 100, 80)] == ["growing", "flat", "shrinking"]


def test_workload(spark):
    w = generate.Workload(trades=500, prices=500, tickers=40, duplicate_ratio=0.2, qty=1, price_per_symbol=True)
    t = generate.trades(spark, w)
    a = dedup.accounting(t).first()
    assert a.distinct_ids == 500 and 50 < a.duplicates < 160
    assert rows(t, "trade_id") == rows(generate.trades(spark, w), "trade_id")
    p = generate.prices(spark, w)
    per = p.groupBy("symbol").agg(F.min(F.col("price").cast("double")).alias("lo"), F.max(F.col("price").cast("double")).alias("hi"), F.count("*").alias("n")).collect()
    assert all(round((r.hi - r.lo) * 100) == r.n - 1 for r in per)
    hot = generate.prices(spark, generate.Workload(prices=2000, hot_share=0.5, hot_ticker=3)).filter("symbol = 'AMZN'").count()
    assert 900 < hot < 1300
    assert generate.prices(spark, generate.Workload(prices=50)).filter("cast(price as double) < 1").count() == 0
    cdf = [r.cdf for r in generate.zipf_cdf(spark, 3).orderBy("rank").collect()]
    assert cdf == pytest.approx([6 / 11, 9 / 11, 1])
    assert generate.recents(t, 5).count() == 5


def test_adaptive_keys(spark):
    p = spark.range(20).select(F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id"))).alias("symbol"), F.col("id").alias("seq"))
    got = generate.adaptive_keys(p, 10, 2.0, 4, settle=10)
    assert got.filter("key like '%#%' and symbol != 'HOT'").count() == 0
    assert got.filter("symbol = 'HOT' and seq >= 10 and key not like 'HOT#%'").count() == 0
    assert got.filter("seq < 9 and key like '%#%'").count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("a|b", 1767, '{"p": "1.5", "t": 7}')], "key string, n bigint, j string").select(
        S.key_account().alias("a"), S.key_ticker().alias("t"), S.base36("n").alias("b"), S.field_by_pattern("j", "p").alias("p"), S.field_by_pattern("j", "t").alias("n"), S.field_by_pattern("j", "x").alias("x"), S.payload_bytes("j").alias("size"))
    assert tuple(df.first()) == ("a", "b", "1d3", "1.5", "7", None, 20)


def test_plans(spark, sf):
    from posmv.plans import catalogue

    def plan(name):
        return catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    assert "partial_sum" in plan("position_by_ticker_nodedup") or "partial" in plan("position_by_ticker_nodedup")
    assert "Cartesian" not in plan("mv_by_account_ticker") and "NestedLoop" not in plan("mv_by_account_ticker")
    assert "WindowGroupLimit" in plan("dedup_trades_first_wins")
    scan = plan("price_stats")
    assert "props" not in scan and "event_type" not in scan  # only the columns that are used are read
