"""A seeded workload of trades and ticking prices, as DataFrames over range()."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The first names of the universe; later ones are numbered.
TICKERS = (
    "AAPL", "MSFT", "GOOG", "AMZN", "NVDA", "META", "TSLA", "JPM", "GS", "MS",
    "BAC", "C", "WFC", "V", "MA", "XOM", "CVX", "PFE", "JNJ", "UNH",
    "HD", "PG", "KO", "PEP", "DIS", "NFLX", "INTC", "AMD", "CRM", "ORCL",
)


@dataclass(frozen=True)
class Workload:
    accounts: int = 5
    tickers: int = 10
    trades: int = 1000
    prices: int = 2000
    seed: int = 42
    run_id: str = "run"
    start_ms: int = 1_700_000_000_000
    trades_per_sec: int = 10
    prices_per_sec: int = 20
    duplicate_ratio: float = 0.0
    qty: int = 0
    price_cents: int = 0
    price_per_symbol: bool = False
    zipf_alpha: float = 0.0
    hot_share: float = 0.0
    hot_ticker: int = 0


def ticker_name(index: Column) -> Column:
    names = F.array(*map(F.lit, TICKERS))
    return F.when(index < len(TICKERS), F.get(names, index.cast("int"))).otherwise(F.format_string("SYM%04d", index.cast("int")))


def zipf_cdf(spark: SparkSession, n: int, alpha: float = 1.0) -> DataFrame:
    """rank (from 0), cdf: rank r has the weight 1 / (r + 1)**alpha. n is a parameter, not data."""
    weights = spark.range(n).select(F.col("id").alias("rank"), F.pow(F.col("id") + 1, F.lit(-alpha)).alias("w"))
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return weights.select("rank", (F.sum("w").over(so_far) / F.sum("w").over(every)).alias("cdf"))


def _pick(w: Workload, draw: Column, u: Column) -> Column:
    """The index of a ticker: the hot one for its share of the ticks, else by Zipf weight or evenly."""
    if w.zipf_alpha > 0:
        weights = [(i + 1) ** -w.zipf_alpha for i in range(w.tickers)]
        total, so_far, cdf = sum(weights), 0.0, []
        for x in weights:
            so_far += x / total
            cdf.append(so_far)
        even = F.least(F.size(F.filter(F.array(*map(F.lit, cdf)), lambda c: c < u)), F.lit(w.tickers - 1)).cast("bigint")
    else:
        even = F.floor(u * w.tickers)
    return F.when(draw < w.hot_share, F.lit(min(w.hot_ticker, w.tickers - 1)).cast("bigint")).otherwise(even) if w.hot_share > 0 else even


def trades(spark: SparkSession, w: Workload) -> DataFrame:
    """trade_id, account, ticker, qty, event_time, seq; with duplicate_ratio some rows are sent again verbatim."""
    base = spark.range(w.trades).withColumn("seq", F.col("id"))
    qty = F.lit(w.qty) if w.qty > 0 else (F.floor(F.rand(w.seed + 2) * 200) + 1) * 10 * F.when(F.rand(w.seed + 3) < 0.5, 1).otherwise(-1)
    once = base.select(
        F.format_string(f"T-{w.run_id}-%08d", F.col("seq") + 1).alias("trade_id"),
        F.format_string("ACC-%03d", (F.floor(F.rand(w.seed) * w.accounts) + 1).cast("int")).alias("account"),
        ticker_name(F.floor(F.rand(w.seed + 1) * w.tickers)).alias("ticker"),
        qty.cast("bigint").alias("qty"),
        (F.lit(w.start_ms) + F.floor(F.col("seq") / w.trades_per_sec) * 1000).cast("bigint").alias("event_time"),
        "seq",
    )
    if w.duplicate_ratio <= 0:
        return once
    again = F.when(F.rand(w.seed + 4) < w.duplicate_ratio, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return once.withColumn("copy", F.explode(again)).drop("copy")


def prices(spark: SparkSession, w: Workload) -> DataFrame:
    """symbol, price (text), event_time, seq. A walk with a deviation of 0.1 % a tick from $10 to $500, at least a
    dollar; or one cent a tick up from (index + 1) dollars; or a fixed price."""
    ticks = spark.range(w.prices).select(F.col("id").alias("seq"), _pick(w, F.rand(w.seed + 5), F.rand(w.seed + 6)).alias("i"), F.randn(w.seed + 7).alias("z"))
    so_far = Window.partitionBy("i").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    if w.price_per_symbol:
        cents = (F.col("i") + 1) * 100 + F.row_number().over(so_far) - 1
    elif w.price_cents > 0:
        cents = F.lit(w.price_cents)
    else:
        start = 1000 + F.pmod(F.xxhash64(F.lit(w.seed), F.col("i")), F.lit(49_000))
        cents = F.greatest(F.lit(100), F.round(start * F.exp(F.sum(F.log1p(F.greatest(F.col("z") * 0.001, F.lit(-0.5)))).over(so_far))))
    money = (cents.cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    return ticks.select(ticker_name(F.col("i")).alias("symbol"), money.cast("string").alias("price"), (F.lit(w.start_ms) + F.floor(F.col("seq") / w.prices_per_sec) * 1000).cast("bigint").alias("event_time"), "seq")


def salted_key(symbol: str, seq: str, width: int = 64) -> Column:
    return F.concat(F.col(symbol), F.lit("#"), F.pmod(F.col(seq), F.lit(width)))


def adaptive_keys(prices: DataFrame, symbols: int, hot_factor: float = 2.0, width: int = 48, settle: int = 1000) -> DataFrame:
    """prices with key: a symbol is salted once its share of the ticks so far exceeds hot_factor even shares, and
    not among the first `settle` ticks. seq counts ticks from 0 without gaps."""
    so_far = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = prices.withColumn("of_symbol", F.count("*").over(so_far)).withColumn("of_all", F.col("seq") + 1)
    hot = (F.col("of_all") >= settle) & (F.col("of_symbol") * symbols > F.col("of_all") * hot_factor)
    return seen.withColumn("key", F.when(hot, salted_key("symbol", "seq", width)).otherwise(F.col("symbol")))


def recents(sent: DataFrame, size: int = 100) -> DataFrame:
    """The last rows sent."""
    return sent.orderBy(F.desc("seq")).limit(size)


def stream_ticks(spark: SparkSession, w: Workload) -> DataFrame:
    """An endless stream of ticks at the workload's rate: timestamp, seq, symbol."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", w.prices_per_sec).load()
    return rate.select("timestamp", F.col("value").alias("seq"), ticker_name(F.pmod(F.xxhash64(F.lit(w.seed), F.col("value")), F.lit(w.tickers))).alias("symbol"))
