"""All registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posmv.config import Config
from posmv.functions import scalars as S
from posmv.operators import cadence, checks, dedup, generate, marketvalue, parse
from posmv.operators import positions as pos
from posmv.operators import prices as px
from posmv.plans import batch, streams
from posmv.sources import fixtures
from posmv.sources.fixtures import FIRST

HOUR, DAY = 3_600_000, 86_400_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Common parts of the SQL.
_T = """trades AS (SELECT 'T-' || l_orderkey || '-' || l_linenumber AS trade_id, 'ACC-' || lpad((o_custkey % 50 + 1)::VARCHAR, 3, '0') AS account,
  'SYM' || lpad((l_partkey % 120)::VARCHAR, 4, '0') AS ticker, ((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_quantity)::BIGINT AS qty,
  epoch_us(l_shipdate) // 1000 AS event_time, l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_F = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY event_time, l_partkey, l_suppkey, l_extendedprice, qty, account, ticker) AS rn FROM trades) WHERE rn = 1)"""
_P = """prices AS (SELECT 'SYM' || lpad((user_id % 100)::VARCHAR, 4, '0') AS symbol, value::DECIMAL(18,2) AS price, epoch_us(ts) // 1000 AS event_time, event_id AS seq FROM events)"""
_PA = "by_account AS (SELECT account, ticker, sum(qty)::BIGINT AS net_qty, max(event_time) AS as_of FROM firsts GROUP BY account, ticker)"
_PT = "by_ticker AS (SELECT ticker, sum(qty)::BIGINT AS net_qty, max(event_time) AS as_of FROM firsts GROUP BY ticker)"
_L = "latest AS (SELECT symbol, price, event_time FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC, seq DESC) AS rn FROM prices) WHERE rn = 1)"
_ST = """stats AS (SELECT symbol, min(price) AS min_price, max(price) AS max_price, min(event_time) AS first_ts, max(event_time) AS last_ts, count(*) AS ticks FROM prices GROUP BY symbol)"""
_MV = "(p.net_qty::DECIMAL(20,0) * l.price)::DECIMAL(38,2)"


def _sql(*parts: str) -> str:
    """Common table expressions and the query; the last part may begin with more expressions."""
    *ctes, body = parts
    return f"WITH {', '.join(ctes)}{' ' if body.startswith('SELECT') else ', '}{body}"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(fixtures.trades(spark, d), FIRST)


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return px.latest(fixtures.prices(spark, d))


# --- parsing -------------------------------------------------------------------------------------------------


@query(_sql(_T, "SELECT trade_id, account, ticker, CASE WHEN l_orderkey % 103 = 0 THEN 0 ELSE qty END AS qty, event_time FROM trades WHERE l_orderkey % 97 <> 0 AND l_orderkey % 101 <> 0"))
def parse_trades(spark, d):
    return parse.parse_trades(fixtures.raw_trades(spark, d))


_GOOD = "seq % 97 <> 0 AND (seq % 89 = 0 OR seq % 83 <> 0)"


@query(_sql(_P, f"SELECT symbol, price, (price * 100)::BIGINT AS price_cents, event_time, seq FROM prices WHERE {_GOOD} AND seq % 89 <> 0"))
def parse_prices(spark, d):
    return parse.parse_prices(fixtures.raw_prices(spark, d), keep=("seq",))


@query(_sql(_P, f"SELECT symbol, (price + CASE WHEN seq % 89 = 0 THEN 0.01 ELSE 0 END)::DECIMAL(18,2) AS price, (price * 100)::BIGINT + CASE WHEN seq % 89 = 0 THEN 1 ELSE 0 END AS price_cents, event_time, seq FROM prices WHERE {_GOOD}"))
def parse_prices_round(spark, d):
    return parse.parse_prices(fixtures.raw_prices(spark, d), mode="round", keep=("seq",))


@query(_sql(_T, _P, "SELECT 'trades' AS source, count(*) AS records, count(*) FILTER (l_orderkey % 97 = 0 OR l_orderkey % 101 = 0) AS malformed FROM trades UNION ALL SELECT 'prices', count(*), count(*) FILTER (seq % 97 = 0 OR seq % 89 = 0 OR seq % 83 = 0) FROM prices"))
def parse_malformed_count(spark, d):
    t, p = fixtures.raw_trades(spark, d), fixtures.raw_prices(spark, d)

    def count(name: str, raw: DataFrame, parsed: DataFrame) -> DataFrame:
        good = parsed.agg(F.count("*").alias("good"))
        return raw.agg(F.count("*").alias("records")).join(good).select(F.lit(name).alias("source"), "records", (F.col("records") - F.col("good")).alias("malformed"))

    return count("trades", t, parse.parse_trades(t)).unionByName(count("prices", p, parse.parse_prices(p)))


@query(_sql(_P, "SELECT seq, (price * 100)::BIGINT AS cents, price, price::VARCHAR AS price_text FROM prices"))
def price_cents_roundtrip(spark, d):
    cents = fixtures.prices(spark, d).select("seq", S.exact_cents(F.col("price").cast("string")).alias("cents"))
    return cents.select("seq", "cents", S.cents_to_money("cents").alias("price"), S.plain_text(S.cents_to_money("cents")).alias("price_text"))


@query(_sql(_P, "SELECT seq, symbol, price::VARCHAR AS price_text, event_time FROM prices WHERE seq % 97 <> 0 AND seq % 89 <> 0 AND seq % 83 <> 0"))
def field_by_pattern(spark, d):
    raw = fixtures.raw_prices(spark, d).filter("seq % 97 <> 0 AND seq % 89 <> 0 AND seq % 83 <> 0")
    return raw.select("seq", S.field_by_pattern("value", "symbol").alias("symbol"), S.field_by_pattern("value", "price").alias("price_text"), S.field_by_pattern("value", "event_time").cast("bigint").alias("event_time"))


@query(_sql(_P, "SELECT event_time - 1704067200000 - 500 AS v, ((event_time - 1704067200500) % 8 + 8) % 8 AS floor_mod, (event_time - 1704067200500) % 8 AS sign_mod, seq FROM prices"))
def modulo(spark, d):
    shifted = fixtures.prices(spark, d).select("seq", (F.col("event_time") - 1704067200500).alias("v"))
    return shifted.select("seq", "v", S.floor_mod("v", 8).alias("floor_mod"), S.sign_mod("v", 8).alias("sign_mod"))


# --- keys ----------------------------------------------------------------------------------------------------


@query(_sql(_T, "SELECT trade_id, account || '|' || ticker AS key, qty FROM trades"))
def composite_key(spark, d):
    return fixtures.trades(spark, d).select("trade_id", S.composite_key().alias("key"), "qty")


@query(_sql(_T, "SELECT DISTINCT account || '|' || ticker AS key, account, ticker FROM trades"))
def composite_key_split(spark, d):
    keys = fixtures.trades(spark, d).select(S.composite_key().alias("key")).distinct()
    return keys.select("key", S.key_account().alias("account"), S.key_ticker().alias("ticker"))


@query(_sql(_T, "SELECT (CASE WHEN account = 'ACC-007' THEN '?' ELSE account END) || '|' || (CASE WHEN ticker = 'SYM0003' THEN '?' ELSE ticker END) AS key, sum(qty)::BIGINT AS net_qty FROM trades GROUP BY 1"))
def null_key_sentinel(spark, d):
    t = fixtures.trades(spark, d).select(F.expr("nullif(account, 'ACC-007')").alias("account"), F.expr("nullif(ticker, 'SYM0003')").alias("ticker"), "qty")
    return t.groupBy(S.composite_key(sentinel="?").alias("key")).agg(F.sum("qty").alias("net_qty"))


# --- dedup and positions -------------------------------------------------------------------------------------


@query(_sql(_T, _F, "SELECT trade_id, account, ticker, qty, event_time FROM firsts"))
def dedup_trades_first_wins(spark, d):
    return _firsts(spark, d).select("trade_id", "account", "ticker", "qty", "event_time")


@query(_sql(_T, "SELECT count(*) AS total, count(DISTINCT trade_id) AS distinct_ids, count(*) - count(DISTINCT trade_id) AS duplicates FROM trades"))
def dedup_accounting(spark, d):
    return dedup.accounting(fixtures.trades(spark, d))


@query(_sql(_T, _F, _PA, "SELECT * FROM by_account"))
def position_by_account_ticker(spark, d):
    return pos.positions(_firsts(spark, d))


@query(_sql(_T, _F, _PT, "SELECT * FROM by_ticker"))
def position_by_ticker(spark, d):
    return pos.positions(_firsts(spark, d), pos.TICKER)


@query(_sql(_T, "SELECT account, ticker, sum(qty)::BIGINT AS net_qty, max(event_time) AS as_of FROM trades GROUP BY account, ticker"))
def position_by_account_ticker_nodedup(spark, d):
    return pos.positions(fixtures.trades(spark, d))


@query(_sql(_T, "SELECT ticker, sum(qty)::BIGINT AS net_qty, max(event_time) AS as_of FROM trades GROUP BY ticker"))
def position_by_ticker_nodedup(spark, d):
    return pos.positions(fixtures.trades(spark, d), pos.TICKER)


@query(_sql(_T, _F, "SELECT account || '|' || ticker AS key, account, ticker, sum(qty)::BIGINT AS net_qty, max(event_time) AS as_of FROM firsts GROUP BY account, ticker"))
def position_concat_key(spark, d):
    return pos.positions_concat_key(_firsts(spark, d))


_SN = """snaps AS (SELECT account, ticker, trade_id, (sum(qty) OVER w)::BIGINT AS net_qty, max(event_time) OVER w AS as_of FROM firsts
  WINDOW w AS (PARTITION BY account, ticker ORDER BY event_time, trade_id ROWS UNBOUNDED PRECEDING))"""


@query(_sql(_T, _F, _SN, "SELECT * FROM snaps"))
def position_snapshots(spark, d):
    return pos.snapshots(_firsts(spark, d))


@query(_sql(_T, _F, "SELECT ticker, trade_id, (sum(qty) OVER w)::BIGINT AS net_qty, max(event_time) OVER w AS as_of FROM firsts WINDOW w AS (PARTITION BY ticker ORDER BY event_time, trade_id ROWS UNBOUNDED PRECEDING)"))
def position_snapshots_ticker(spark, d):
    return pos.snapshots(_firsts(spark, d), pos.TICKER)


@query(_sql(_T, _F, f"""steps AS (SELECT ticker, event_time // {DAY} * {DAY} AS window_start, (event_time // {6 * HOUR} + 1) * {6 * HOUR} AS first_end, qty, event_time FROM firsts),
spread AS (SELECT ticker, window_start, unnest(range(first_end, window_start + {DAY} + 1, {6 * HOUR})) AS window_end, qty, event_time FROM steps)""",
"SELECT ticker, window_start, window_end, sum(qty)::BIGINT AS net_qty, max(event_time) AS as_of FROM spread GROUP BY ALL"))
def position_cumulate(spark, d):
    return pos.cumulate(_firsts(spark, d), 6 * HOUR, DAY)


@query(_sql(_P, f"""steps AS (SELECT symbol AS ticker, event_time // {DAY} * {DAY} AS window_start, (event_time // {HOUR} + 1) * {HOUR} AS first_end, seq % 7 - 3 AS qty, event_time FROM prices),
spread AS (SELECT ticker, window_start, unnest(range(first_end, window_start + {DAY} + 1, {HOUR})) AS window_end, qty, event_time FROM steps)""",
"SELECT ticker, window_start, window_end, sum(qty)::BIGINT AS net_qty, max(event_time) AS as_of FROM spread GROUP BY ALL"))
def cumulate_intraday(spark, d):
    ticks = fixtures.prices(spark, d).select(F.col("symbol").alias("ticker"), (F.col("seq") % 7 - 3).alias("qty"), "event_time")
    return pos.cumulate(ticks, HOUR, DAY)


# --- prices --------------------------------------------------------------------------------------------------


@query(_sql(_P, _L, "SELECT * FROM latest"))
def latest_price(spark, d):
    return _latest(spark, d)


@query(_sql(_P, _L, "SELECT * FROM latest"))
def latest_price_row_number(spark, d):
    return px.latest_by_rank(fixtures.prices(spark, d))


def _tumble(ms: int) -> str:
    return f"""tumbled AS (SELECT window_start, symbol, price, event_time FROM (SELECT *, event_time // {ms} * {ms} AS window_start,
  row_number() OVER (PARTITION BY symbol, event_time // {ms} ORDER BY event_time DESC, seq DESC) AS rn FROM prices) WHERE rn = 1)"""


@query(_sql(_P, _tumble(HOUR), f"SELECT window_start, window_start + {HOUR} AS window_end, symbol, price, event_time FROM tumbled"))
def price_tumble_last(spark, d):
    return px.tumble_last(fixtures.prices(spark, d), HOUR).select("window_start", "window_end", "symbol", "price", "event_time")


@query(_sql(_P, _tumble(250), "SELECT * FROM tumbled"))
def price_tumble_250ms(spark, d):
    return px.tumble_last(fixtures.prices(spark, d)).select("window_start", "symbol", "price", "event_time")


@query(_sql(_P, _L, "SELECT * FROM latest"))
def latest_price_from_windows(spark, d):
    return px.latest_from_windows(px.tumble_last(fixtures.prices(spark, d), HOUR))


@query(_sql(_P, _L, "SELECT * FROM latest"))
def price_salted_two_phase(spark, d):
    return px.salted_latest(fixtures.prices(spark, d), 8)


@query(_sql(_P, _tumble(HOUR), "SELECT * FROM tumbled"))
def price_salted_window(spark, d):
    return px.salted_tumble(fixtures.prices(spark, d), HOUR, 8)


@query(_sql(_P, "SELECT symbol, substring(max(lpad(event_time::VARCHAR, 20, '0') || price::VARCHAR), 21) AS price_text FROM prices GROUP BY symbol"))
def price_lexicographic_argmax(spark, d):
    return px.lexicographic_latest(fixtures.prices(spark, d))


@query(_sql(_P, _ST, "SELECT *, CASE WHEN ticks > 1 THEN (last_ts - first_ts)::DOUBLE / (ticks - 1) END AS ms_per_tick FROM stats"))
def price_stats(spark, d):
    return px.stats(fixtures.prices(spark, d))


@query(_sql(_P, "SELECT symbol, price, event_time, seq, rn AS age FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC, seq DESC) AS rn FROM prices) WHERE rn <= 40"))
def recent_prices_ring(spark, d):
    return px.ring(fixtures.prices(spark, d))


@query(_sql(_P, f"SELECT symbol, price, event_time, seq FROM (SELECT *, max(event_time) OVER (PARTITION BY symbol) AS newest FROM prices) WHERE event_time >= newest - {12 * HOUR}"))
def recent_prices_window(spark, d):
    return px.trailing(fixtures.prices(spark, d), 12 * HOUR)


@query(_sql(_P, "SELECT symbol, price, event_time FROM (SELECT *, max(event_time) OVER (PARTITION BY symbol ORDER BY (seq * 7919) % 104729, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM prices) WHERE held IS NULL OR held <= event_time"))
def stale_ticks_dropped(spark, d):
    """Ticks that are not older than any that came before, for a feed out of order."""
    from pyspark.sql import Window

    fed = fixtures.prices(spark, d).withColumn("arrival", F.col("seq") * 7919 % 104729)
    before = Window.partitionBy("symbol").orderBy("arrival", "seq").rowsBetween(Window.unboundedPreceding, -1)
    held = fed.withColumn("held", F.max("event_time").over(before))
    return held.filter("held IS NULL OR held <= event_time").select("symbol", "price", "event_time")


# --- market values -------------------------------------------------------------------------------------------

_MVA = f"mv AS (SELECT p.account, p.ticker, p.net_qty, l.price, {_MV} AS mv, greatest(p.as_of, l.event_time) AS as_of FROM by_account p JOIN latest l ON p.ticker = l.symbol)"
_MVT = f"mvt AS (SELECT p.ticker, p.net_qty, l.price, {_MV} AS mv, greatest(p.as_of, l.event_time) AS as_of FROM by_ticker p JOIN latest l ON p.ticker = l.symbol)"
_ALL = (_T, _F, _P, _PA, _PT, _L)


@query(_sql(*_ALL, _MVA, "SELECT * FROM mv"))
def mv_by_account_ticker(spark, d):
    return marketvalue.market_values(pos.positions(_firsts(spark, d)), _latest(spark, d))


@query(_sql(*_ALL, _MVT, "SELECT * FROM mvt"))
def mv_by_ticker(spark, d):
    return marketvalue.market_values(pos.positions(_firsts(spark, d), pos.TICKER), _latest(spark, d))


@query(_sql(*_ALL, _MVA, "SELECT * FROM mv"))
def mv_from_conflated(spark, d):
    config = Config({"price.conflate.ms": str(HOUR)})
    return batch.outputs(fixtures.trades(spark, d), fixtures.prices(spark, d), config, FIRST)["mv-by-account-ticker"]


@query(_sql(*_ALL, _MVA, "SELECT * FROM mv"))
def mv_from_salted(spark, d):
    config = Config({"price.salt.factor": "8"})
    return batch.outputs(fixtures.trades(spark, d), fixtures.prices(spark, d), config, FIRST)["mv-by-account-ticker"]


@query(_sql(*_ALL, _MVA, _MVT, """SELECT 'position-by-account-ticker' AS output, count(*) AS keys, sum(net_qty)::BIGINT AS net_qty FROM by_account
UNION ALL SELECT 'position-by-ticker', count(*), sum(net_qty)::BIGINT FROM by_ticker
UNION ALL SELECT 'mv-by-account-ticker', count(*), sum(net_qty)::BIGINT FROM mv UNION ALL SELECT 'mv-by-ticker', count(*), sum(net_qty)::BIGINT FROM mvt"""))
def all_outputs(spark, d):
    """Keys and quantities of the four outputs of one batch plan."""
    found = batch.outputs(fixtures.trades(spark, d), fixtures.prices(spark, d), Config(), FIRST)
    counts = [v.agg(F.lit(k).alias("output"), F.count("*").alias("keys"), F.sum("net_qty").alias("net_qty")) for k, v in found.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_RAW_F = """raw AS (SELECT trade_id, account, ticker, CASE WHEN l_orderkey % 103 = 0 THEN 0 ELSE qty END AS qty, event_time FROM trades WHERE l_orderkey % 97 <> 0 AND l_orderkey % 101 <> 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY event_time, qty, account, ticker) AS rn FROM raw) WHERE rn = 1),
good AS (SELECT * FROM prices WHERE seq % 97 <> 0 AND seq % 89 <> 0 AND seq % 83 <> 0)"""
_LG = _L.replace("FROM prices)", "FROM good)")


def _text_outputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    from posmv.plans import sqltext

    return sqltext.outputs(spark, fixtures.raw_trades(spark, d), fixtures.raw_prices(spark, d))


@query(_sql(_T, _P, _RAW_F, _PA, "SELECT * FROM by_account"))
def sql_position_by_account_ticker(spark, d):
    return _text_outputs(spark, d)["position-by-account-ticker"]


@query(_sql(_T, _P, _RAW_F, _PT, "SELECT * FROM by_ticker"))
def sql_position_by_ticker(spark, d):
    return _text_outputs(spark, d)["position-by-ticker"]


@query(_sql(_T, _P, _RAW_F, _PA, _LG, _MVA, "SELECT * FROM mv"))
def sql_mv_by_account_ticker(spark, d):
    return _text_outputs(spark, d)["mv-by-account-ticker"]


@query(_sql(_T, _P, _RAW_F, _PT, _LG, _MVT, "SELECT * FROM mvt"))
def sql_mv_by_ticker(spark, d):
    return _text_outputs(spark, d)["mv-by-ticker"]


@query(_sql(*_ALL, _MVA, "SELECT account || '|' || ticker AS key, account, ticker, net_qty::VARCHAR AS net_qty, price::VARCHAR AS price, mv::VARCHAR AS mv, as_of::VARCHAR AS as_of FROM mv"))
def mv_json_rows(spark, d):
    rows = parse.to_keyed_json(mv_by_account_ticker(spark, d), ["account", "ticker"])
    return rows.select("key", *[S.json_value("value", f).alias(f) for f in ("account", "ticker", "net_qty", "price", "mv", "as_of")])


@query(_sql(*_ALL, _MVT, "SELECT ticker AS key, false AS has_account, net_qty::VARCHAR AS net_qty, mv::VARCHAR AS mv FROM mvt"))
def mv_ticker_json_rows(spark, d):
    rows = parse.to_keyed_json(mv_by_ticker(spark, d), ["ticker"])
    return rows.select("key", S.json_value("value", "account").isNotNull().alias("has_account"), S.json_value("value", "net_qty").alias("net_qty"), S.json_value("value", "mv").alias("mv"))


@query("SELECT 'ACC-001' AS account, 'GME' AS ticker, 999999::BIGINT AS net_qty, 10000000000000.00::DECIMAL(18,2) AS price, 9999990000000000000.00::DECIMAL(38,2) AS mv, 2::BIGINT AS as_of")
def mv_extreme_price(spark, d):
    held = spark.range(1).selectExpr("'ACC-001' account", "'GME' ticker", "999999L net_qty", "1L as_of")
    tick = spark.range(1).selectExpr("'GME' symbol", "cast('10000000000000.00' as decimal(18,2)) price", "2L event_time")
    return marketvalue.market_values(held, tick)


@query(_sql(*_ALL, f"SELECT p.account, p.ticker, l.seq, p.net_qty, l.price, {_MV} AS mv, greatest(p.as_of, l.event_time) AS as_of FROM by_account p JOIN prices l ON p.ticker = l.symbol"))
def mv_per_tick(spark, d):
    """Every holder at each tick: what comes out without conflation."""
    return marketvalue.revalue_on_ticks(pos.positions(_firsts(spark, d)), fixtures.prices(spark, d))


@query(_sql(*_ALL, _MVT, "SELECT count(*) AS bad FROM mvt WHERE mv <> (net_qty::DECIMAL(20,0) * price)::DECIMAL(38,2)"))
def mv_arithmetic(spark, d):
    return checks.arithmetic_errors(mv_by_ticker(spark, d)).agg(F.count("*").alias("bad"))


# --- checks --------------------------------------------------------------------------------------------------


@query(_sql(_T, _F, _SN, "SELECT account || '|' || ticker AS key, arg_max(net_qty, (as_of, trade_id)) AS net_qty FROM snaps GROUP BY 1"))
def snapshot_last_per_key(spark, d):
    log = position_snapshots(spark, d).select(S.composite_key().alias("key"), "net_qty", F.struct("as_of", "trade_id").alias("offset"))
    return checks.last_per_key(log, value="net_qty")


@query(_sql(_T, _F, _PA, _PT, "SELECT coalesce(a.ticker, t.ticker) AS ticker, a.summed, t.net_qty AS published, a.summed IS NOT DISTINCT FROM t.net_qty AS complete FROM (SELECT ticker, sum(net_qty)::BIGINT AS summed FROM by_account GROUP BY ticker) a FULL JOIN by_ticker t ON a.ticker = t.ticker"))
def completeness_check(spark, d):
    t = _firsts(spark, d)
    return checks.completeness(pos.positions(t), pos.positions(t, pos.TICKER))


@query(_sql(*_ALL, "SELECT * FROM by_ticker WHERE ticker NOT IN (SELECT symbol FROM latest)"))
def coverage_anti_join(spark, d):
    return marketvalue.without_price(pos.positions(_firsts(spark, d), pos.TICKER), _latest(spark, d))


@query(_sql(_T, _F, _PA, "SELECT count(*) AS keys, count(*) FILTER (ticker <> 'SYM0005' AND account <> 'ACC-009') AS equal, count(*) FILTER (ticker <> 'SYM0005' AND account = 'ACC-009') AS different, count(*) FILTER (ticker = 'SYM0005') AS missing, 0 AS unexpected FROM by_account"))
def published_vs_recomputed(spark, d):
    want = pos.positions(_firsts(spark, d))
    got = want.filter("ticker <> 'SYM0005'").withColumn("net_qty", F.col("net_qty") + F.when(F.col("account") == "ACC-009", 1).otherwise(0))
    return checks.compare(got, want, ["account", "ticker"], "net_qty")


_LOG = "fed AS (SELECT symbol, price, event_time, (seq * 7919) % 104729 AS arrival FROM prices)"


@query(_sql(_P, _LOG, """l AS (SELECT *, lag(event_time) OVER w AS tb, lag(price) OVER w AS vb FROM fed WINDOW w AS (PARTITION BY symbol ORDER BY arrival))
SELECT symbol, count(*) AS records, count(*) FILTER (event_time < tb) AS time_backwards, count(*) FILTER (price < vb) AS value_backwards, arg_max(event_time, arrival) < max(event_time) AS ends_stale FROM l GROUP BY symbol"""))
def order_violations(spark, d):
    """Beyond 104,729 events arrivals repeat, which the SQL leaves open; here those of one arrival come in the source's order."""
    fed = fixtures.prices(spark, d).select("symbol", "price", "event_time", (F.col("seq") * 7919 % 104729).alias("arrival"), "seq")
    return checks.order_violations(fed, "symbol", "event_time", ("arrival", "seq"), "price")


@query(_sql(_P, _LOG, "SELECT count(*) AS keys, count(*) FILTER (stale) AS ends_stale FROM (SELECT symbol, arg_max(event_time, arrival) < max(event_time) AS stale FROM fed GROUP BY symbol)"))
def ends_stale(spark, d):
    return order_violations(spark, d).agg(F.count("*").alias("keys"), F.count_if("ends_stale").alias("ends_stale"))


@query(_sql(_T, _F, _PA, """w AS (SELECT account, ticker, CASE WHEN ticker = 'SYM0005' THEN NULL WHEN account = 'ACC-009' THEN net_qty + 1 ELSE net_qty END AS got, net_qty AS want FROM by_account)
SELECT * FROM w WHERE got IS DISTINCT FROM want ORDER BY account, ticker LIMIT 3"""))
def mismatch_samples(spark, d):
    """The first three keys that were published wrong or not at all."""
    want = pos.positions(_firsts(spark, d))
    got = want.filter("ticker <> 'SYM0005'").withColumn("net_qty", F.col("net_qty") + F.when(F.col("account") == "ACC-009", 1).otherwise(0))
    return checks.samples(got, want, ["account", "ticker"], "net_qty")


_DAY1 = "p0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC, seq DESC) AS rn FROM prices)"
_PREV = "prev AS (SELECT symbol, price FROM p0 WHERE rn = 2)"
#: The ticks of the tables are days apart.
_LAG = 5 * DAY
_WIN = f"win AS (SELECT symbol, min(price) AS wmin, max(price) AS wmax FROM (SELECT *, max(event_time) OVER (PARTITION BY symbol) AS newest FROM prices) WHERE event_time >= newest - {_LAG} GROUP BY symbol)"
_USED = "used AS (SELECT l.symbol, (CASE WHEN l.symbol < 'SYM0030' THEN coalesce(v.price, l.price) WHEN l.symbol < 'SYM0050' THEN s.max_price + 1 ELSE l.price END)::DECIMAL(18,2) AS price FROM latest l JOIN stats s ON s.symbol = l.symbol LEFT JOIN prev v ON v.symbol = l.symbol)"
_PUB = "pub AS (SELECT p.ticker, p.net_qty, u.price AS used, (p.net_qty::DECIMAL(20,0) * u.price)::DECIMAL(38,2) AS mv FROM by_ticker p JOIN used u ON p.ticker = u.symbol)"


def _published(spark, d):
    """Market values of which some were made with an older price and some with a price that never was."""
    prices = fixtures.prices(spark, d)
    latest, stats = px.latest(prices), px.stats(prices)
    older = px.ring(prices, 2).filter("age = 2").select("symbol", F.col("price").alias("older"))
    used = F.when(F.col("symbol") < "SYM0030", F.coalesce("older", "price")).when(F.col("symbol") < "SYM0050", F.col("max_price") + 1).otherwise(F.col("price"))
    fed = latest.join(stats.select("symbol", "max_price"), "symbol").join(older, "symbol", "left").select("symbol", used.cast("decimal(18,2)").alias("price"), "event_time")
    held = pos.positions(_firsts(spark, d), pos.TICKER)
    return marketvalue.market_values(held, fed), held, prices


@query(_sql(*_ALL, _DAY1, _PREV, _ST, _WIN, _USED, _PUB, """SELECT ticker, net_qty, mv, CASE WHEN net_qty * l.price = mv THEN 'exact' WHEN net_qty <> 0 AND used BETWEEN wmin AND wmax THEN 'lag' ELSE 'wrong' END AS verdict
FROM pub JOIN latest l ON l.symbol = ticker JOIN win w ON w.symbol = ticker"""))
def mv_check_classify(spark, d):
    """Only prices that were in force shortly before the newest tick count as lag."""
    published, held, prices = _published(spark, d)
    return checks.classify(published, held, px.stats(px.trailing(prices, _LAG)), px.latest(prices))


@query(_sql(*_ALL, _DAY1, _PREV, _ST, _USED, _PUB, """st AS (SELECT (l.price - used)::DOUBLE * 100 AS cents, (last_ts - first_ts) / (ticks - 1) AS per FROM pub JOIN latest l ON l.symbol = ticker JOIN stats s ON s.symbol = ticker WHERE net_qty <> 0 AND ticks > 1),
ms AS (SELECT CASE WHEN abs(cents) < 0.5 THEN 0.0 ELSE greatest(0.0, cents) * per END AS stale_ms FROM st), r AS (SELECT stale_ms, round(stale_ms)::BIGINT AS ms FROM ms)
SELECT count(*) AS n, count(*) FILTER (stale_ms = 0) AS exact, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.9) AS p90, quantile_disc(ms, 0.99) AS p99, max(ms) AS max,
  count(*) FILTER (ms > 2000) AS beyond_2000, count(*) FILTER (ms > 5000) AS beyond_5000, count(*) FILTER (ms > 10000) AS beyond_10000 FROM r"""))
def mv_staleness(spark, d):
    """How late the published values are, where a symbol's price rises by a cent a tick."""
    published, _, prices = _published(spark, d)
    return checks.staleness_distribution(checks.staleness(published, px.latest(prices), px.stats(prices)))


_GAP = "gaps AS (SELECT symbol, lead(event_time) OVER (PARTITION BY symbol ORDER BY event_time, seq) - event_time AS gap_ms FROM prices), g AS (SELECT * FROM gaps WHERE gap_ms IS NOT NULL)"


@query(_sql(_P, _GAP, "SELECT symbol, count(*) AS n, quantile_disc(gap_ms, 0.5) AS p50, quantile_disc(gap_ms, 0.9) AS p90, quantile_disc(gap_ms, 0.99) AS p99, max(gap_ms) AS max FROM g GROUP BY symbol"))
def staleness_percentiles(spark, d):
    return checks.nearest_rank(checks.tick_gaps(fixtures.prices(spark, d)), "gap_ms", ("symbol",))


@query(_sql(_P, _GAP, """r AS (SELECT symbol, gap_ms, row_number() OVER (PARTITION BY symbol ORDER BY gap_ms) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM g)
SELECT symbol, max(n) AS n, max(gap_ms) FILTER (place = least(floor(0.5 * n), n - 1)) AS q50, max(gap_ms) FILTER (place = least(floor(0.9 * n), n - 1)) AS q90, max(gap_ms) FILTER (place = least(floor(0.99 * n), n - 1)) AS q99 FROM r GROUP BY symbol"""))
def latency_percentiles(spark, d):
    return checks.floor_rank(checks.tick_gaps(fixtures.prices(spark, d)), "gap_ms", ("symbol",))


@query(_sql(_P, _tumble(HOUR), f"""l AS (SELECT symbol, window_start + {HOUR} - event_time AS latency_ms FROM tumbled),
r AS (SELECT symbol, latency_ms, row_number() OVER (PARTITION BY symbol ORDER BY latency_ms) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM l WHERE latency_ms BETWEEN 0 AND 599999)
SELECT symbol, max(n) AS n, max(latency_ms) FILTER (place = least(floor(0.5 * n), n - 1)) AS q50, max(latency_ms) FILTER (place = least(floor(0.9 * n), n - 1)) AS q90, max(latency_ms) FILTER (place = least(floor(0.99 * n), n - 1)) AS q99 FROM r GROUP BY symbol"""))
def end_to_end_latency(spark, d):
    """From a tick to the end of the window that sends it; more than ten minutes do not count."""
    sent = px.tumble_last(fixtures.prices(spark, d), HOUR)
    return checks.floor_rank(checks.latencies(sent, "window_end", "event_time"), "latency_ms", ("symbol",))


@query(_sql(_P, _L, _tumble(DAY), f"""closed AS (SELECT symbol, arg_max(price, window_start) AS conflated, max(event_time) AS seen FROM tumbled WHERE window_start + {DAY} <= (SELECT max(event_time) FROM prices) - 1000 GROUP BY symbol)
SELECT symbol, conflated, price AS final, event_time - seen AS behind_ms FROM closed JOIN latest USING (symbol) WHERE seen < event_time"""))
def freshness_warn(spark, d):
    """Symbols whose last closed window of a day is behind their final price."""
    prices = fixtures.prices(spark, d)
    end = prices.agg((F.max("event_time") - 1000).alias("watermark"))
    closed = px.tumble_last(prices, DAY).join(F.broadcast(end)).filter(F.col("window_end") <= F.col("watermark"))
    return checks.freshness(px.latest_from_windows(closed), px.latest(prices))


@query(_sql(_P, "SELECT symbol, count(*) AS samples, round(avg(price), 6)::DECIMAL(18,6) AS mean, max(price) AS peak FROM prices GROUP BY symbol"))
def sampled_metrics(spark, d):
    """Mean and largest of sampled values."""
    found = fixtures.prices(spark, d).groupBy("symbol").agg(F.count("*").alias("samples"), F.sum("price").alias("total"), F.max("price").alias("peak"))
    return found.select("symbol", "samples", F.round(F.col("total").cast("decimal(28,6)") / F.col("samples"), 6).cast("decimal(18,6)").alias("mean"), "peak")


@query(_sql(_P, _GAP, "SELECT count(*) AS n, count(*) FILTER (gap_ms > 2000) AS beyond_2000, count(*) FILTER (gap_ms > 5000) AS beyond_5000, count(*) FILTER (gap_ms > 10000) AS beyond_10000 FROM g"))
def ticks_beyond(spark, d):
    return checks.beyond(checks.tick_gaps(fixtures.prices(spark, d)), "gap_ms")


@query(_sql(_P, f"""s AS (SELECT symbol, event_time // {HOUR} AS slot, count(*) AS n FROM prices GROUP BY 1, 2), k AS (SELECT symbol, max(n) AS worst, sum(n) AS n FROM s GROUP BY symbol)
SELECT count(*) AS keys, sum(n)::BIGINT AS updates, max(worst) AS worst, avg(worst) AS mean, max(worst) <= 1 * 1.15 AS within_limit FROM k"""))
def cadence_rates(spark, d):
    updates = fixtures.prices(spark, d).withColumn("as_of", F.col("event_time"))
    return cadence.rates(updates, ("symbol",), HOUR, 1)


@query(_sql(_P, _tumble(HOUR), """k AS (SELECT symbol, count(*) AS n FROM tumbled GROUP BY symbol)
SELECT count(*) AS keys, sum(n)::BIGINT AS updates, 1 AS worst, 1.0::DOUBLE AS mean, true AS within_limit FROM k"""))
def cadence_rates_conflated(spark, d):
    updates = fixtures.prices(spark, d).withColumn("as_of", F.col("event_time"))
    return cadence.rates(cadence.conflate(updates, ("symbol",), HOUR, ("as_of", "seq"), ("price",)), ("symbol",), HOUR, 1)


@query(_sql(_P, f"""b AS (SELECT event_time // {DAY} * {DAY} AS bucket, max(event_time) AS newest, count(*) AS records FROM prices GROUP BY 1), h AS (SELECT *, max(newest) OVER (ORDER BY bucket) AS high FROM b)
SELECT bucket, newest, records, high, high - lag(high) OVER (ORDER BY bucket) AS advance FROM h"""))
def event_time_progress(spark, d):
    updates = fixtures.prices(spark, d).select(F.col("event_time").alias("arrived"), F.col("event_time").alias("as_of"))
    return cadence.progress(updates, DAY)


_MONTH = 30 * DAY


@query(_sql(_T, _F, _SN, f"SELECT account, ticker, as_of // {_MONTH} * {_MONTH} AS emit_from, arg_max(net_qty, (as_of, trade_id)) AS net_qty, max(as_of) AS as_of FROM snaps GROUP BY 1, 2, 3"))
def conflated_emission(spark, d):
    """The last position of each key and interval."""
    out = cadence.conflate(pos.snapshots(_firsts(spark, d)), ("account", "ticker"), _MONTH, ("as_of", "trade_id"), ("net_qty",))
    return out.select("account", "ticker", "emit_from", "net_qty", "as_of")


@query(_sql(_T, f"SELECT event_time // {_MONTH} * {_MONTH} AS bucket, count(*) AS records, sum(octet_length(encode(trade_id)))::BIGINT AS bytes FROM trades GROUP BY 1"))
def throughput_per_bucket(spark, d):
    return cadence.per_bucket(fixtures.trades(spark, d), "event_time", _MONTH, F.sum(S.payload_bytes("trade_id")).alias("bytes"))


# --- workload ------------------------------------------------------------------------------------------------


@query("WITH w AS (SELECT i AS rank, 1.0::DOUBLE / (i + 1) AS w FROM range(100) t(i)) SELECT rank, round(sum(w) OVER (ORDER BY rank) / sum(w) OVER (), 9) AS cdf FROM w")
def zipf_cdf(spark, d):
    return generate.zipf_cdf(spark, 100).select("rank", F.round("cdf", 9).alias("cdf"))


@query(_sql(_P, "SELECT seq, symbol || '#' || (seq % 64) AS key FROM prices"))
def salted_key(spark, d):
    return fixtures.prices(spark, d).select("seq", generate.salted_key("symbol", "seq").alias("key"))


@query(_sql(_P, """c AS (SELECT *, count(*) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM prices)
SELECT seq, symbol, CASE WHEN seq + 1 >= 1000 AND n * 100 > (seq + 1) * 1.05 THEN symbol || '#' || (seq % 48) ELSE symbol END AS key FROM c"""))
def adaptive_key(spark, d):
    return generate.adaptive_keys(fixtures.prices(spark, d), 100, 1.05).select("seq", "symbol", "key")


@query(_sql(_T, _P, """s(stage, cardinality) AS (SELECT 'dedup', count(DISTINCT trade_id) FROM trades UNION ALL SELECT 'position_by_account_ticker', count(DISTINCT account || '|' || ticker) FROM trades
UNION ALL SELECT 'position_by_ticker', count(DISTINCT ticker) FROM trades UNION ALL SELECT 'latest_price', count(DISTINCT symbol) FROM prices UNION ALL SELECT 'latest_price_salted', count(DISTINCT symbol || '|' || (event_time % 8)) FROM prices)
SELECT stage, cardinality, least(cardinality, 48) AS usable, cardinality >= 48 AS enough FROM s"""))
def utilization_audit(spark, d):
    return checks.utilization(fixtures.trades(spark, d), fixtures.prices(spark, d), 48, 8)


@query()
def gen_trades(spark, d):
    return generate.trades(spark, generate.Workload(trades=5000, duplicate_ratio=0.1, tickers=40))


@query()
def gen_prices(spark, d):
    return generate.prices(spark, generate.Workload(prices=5000, tickers=40, zipf_alpha=1.0, hot_share=0.3))


@query("SELECT i AS seq, CASE WHEN (i + 1) % 100 = 0 THEN true ELSE false END AS hundredth, (i + 1)::VARCHAR AS n FROM range(200) t(i)")
def gen_sequence(spark, d):
    """Trade ids are numbered without gaps."""
    t = generate.trades(spark, generate.Workload(trades=200, qty=1))
    n = F.expr("cast(cast(substring(trade_id, 7) as bigint) as string)")
    return t.select("seq", (n.cast("bigint") % 100 == 0).alias("hundredth"), n.alias("n"))


# --- streams -------------------------------------------------------------------------------------------------


@query(_sql(_T, _F, _PA, "SELECT * FROM by_account"))
def stream_positions_final(spark, d):
    return streams.positions_final(spark, d, pos.ACCOUNT_TICKER)


@query(_sql(_T, _F, _PT, "SELECT * FROM by_ticker"))
def stream_ticker_positions_final(spark, d):
    return streams.positions_final(spark, d, pos.TICKER)


@query(_sql(_T, _F, "SELECT trade_id, account, ticker, qty, event_time FROM firsts"))
def stream_dedup_final(spark, d):
    return streams.dedup_final(spark, d)


@query(_sql(*_ALL, _MVA, "SELECT * FROM mv"))
def stream_mv_final(spark, d):
    return streams.mv_final(spark, d).mv_account.read()


@query(_sql(*_ALL, _MVT, "SELECT * FROM mvt"))
def stream_mv_ticker_final(spark, d):
    return streams.mv_final(spark, d).mv_ticker.read()


@query(_sql(*_ALL, _MVA, "SELECT * FROM mv"))
def stream_tws_mv_final(spark, d):
    return streams.stateful_mv_final(spark, d)


@query(_sql(_P, _tumble(HOUR), f"SELECT window_start, symbol, price, event_time FROM tumbled WHERE window_start + {HOUR} <= (SELECT max(event_time) FROM prices) - 1000"))
def stream_tumble_closed(spark, d):
    """Windows that the watermark has closed; the last one of a feed stays open."""
    return streams.tumble_closed(spark, d, HOUR)
