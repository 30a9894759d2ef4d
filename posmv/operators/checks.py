"""Independent validation: results are recomputed from the raw inputs and compared with what was published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posmv.functions import scalars as S


def compare(published: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: keys on either side, equal, different, missing, unexpected. Keys of both sides count, so an empty
    publication does not pass."""
    a = published.select(*keys, F.col(value).alias("got"), F.lit(True).alias("p"))
    b = expected.select(*keys, F.col(value).alias("want"), F.lit(True).alias("e"))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull() & F.col("got").eqNullSafe(F.col("want"))).alias("equal"),
        F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull() & ~F.col("got").eqNullSafe(F.col("want"))).alias("different"),
        F.count_if(F.col("p").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("unexpected"),
    )


def last_per_key(log: DataFrame, key: str = "key", value: str = "value", order: str = "offset") -> DataFrame:
    """The state that an upsert log stands for; a null value deletes its key."""
    last = log.groupBy(key).agg(F.max_by(F.struct(value), order).alias("v"))
    return last.select(key, f"v.{value}").filter(F.col(value).isNotNull())


def completeness(by_account: DataFrame, by_ticker: DataFrame) -> DataFrame:
    """ticker, summed, published, complete: accounts add up to the ticker's position."""
    summed = by_account.groupBy("ticker").agg(F.sum("net_qty").alias("summed"))
    both = summed.join(by_ticker.select("ticker", F.col("net_qty").alias("published")), "ticker", "full_outer")
    return both.withColumn("complete", F.col("summed").eqNullSafe(F.col("published")))


def order_violations(log: DataFrame, key: str, time: str, arrival: str | tuple[str, ...], value: str | None = None) -> DataFrame:
    """For each key: records, how often its time (and value) went back from one record to the next, and whether
    its last record is older than its newest. arrival: the column or columns that records come in the order of; where they
    tie, the result is open."""
    order = [arrival] if isinstance(arrival, str) else list(arrival)
    w = Window.partitionBy(key).orderBy(*order)
    seen = log.select(key, time, F.struct(*order).alias("arrived"), *([value] if value else []), F.lag(time).over(w).alias("before"), *([F.lag(value).over(w).alias("value_before")] if value else []))
    sums = [F.count("*").alias("records"), F.count_if(F.col(time) < F.col("before")).alias("time_backwards")]
    if value:
        sums.append(F.count_if(F.col(value) < F.col("value_before")).alias("value_backwards"))
    return seen.groupBy(key).agg(*sums, (F.max_by(time, "arrived") < F.max(time)).alias("ends_stale"))


def samples(published: DataFrame, expected: DataFrame, keys: list[str], value: str, first: int = 3) -> DataFrame:
    """The first keys, in their order, whose values differ or that one side lacks: keys, got, want."""
    a = published.select(*keys, F.col(value).alias("got"), F.lit(True).alias("p"))
    b = expected.select(*keys, F.col(value).alias("want"), F.lit(True).alias("e"))
    wrong = a.join(b, keys, "full_outer").filter(F.col("p").isNull() | F.col("e").isNull() | ~F.col("got").eqNullSafe(F.col("want")))
    return wrong.select(*keys, "got", "want").orderBy(*keys).limit(first)


def classify(published: DataFrame, positions: DataFrame, recent: DataFrame, latest: DataFrame) -> DataFrame:
    """published with verdict: exact if it is position times the final price, lag if its implied price lies in the range
    of `recent` (min_price and max_price of the symbol's ticks that are not too old), else wrong; rows without a
    position or price are left out."""
    by = [c for c in ("account", "ticker") if c in published.columns]
    joined = (
        published.select(*by, "mv").join(positions.select(*by, "net_qty"), by)
        .join(latest.select(F.col("symbol").alias("ticker"), "price"), "ticker")
        .join(recent.select(F.col("symbol").alias("ticker"), "min_price", "max_price"), "ticker")
    )
    implied = S.implied_price("mv", "net_qty")
    verdict = F.when(S.market_value() == F.col("mv"), "exact").when(implied.between(F.col("min_price"), F.col("max_price")), "lag").otherwise("wrong")
    return joined.select(*by, "net_qty", "mv", verdict.alias("verdict"))


def arithmetic_errors(values: DataFrame) -> DataFrame:
    """Rows whose mv is not price times net_qty."""
    return values.filter(~F.col("mv").eqNullSafe(S.market_value()))


def nearest_rank(df: DataFrame, value: str, by: tuple[str, ...] = (), points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles of rank ceil(p n), the maximum and n."""
    each = [F.expr(f"cast(percentile_disc({p}) within group (order by {value}) as bigint)").alias(f"p{round(p * 100)}") for p in points]
    return df.groupBy(*by).agg(F.count(value).alias("n"), *each, F.max(value).alias("max"))


def floor_rank(df: DataFrame, value: str, by: tuple[str, ...], points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles at place floor(q n) of the sorted values, the last at most, for each group."""
    w = Window.partitionBy(*by)
    placed = df.select(*by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("at"), F.count("*").over(w).alias("n"))
    each = [F.max(F.when(F.col("at") == F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col(value))).alias(f"q{round(q * 100)}") for q in points]
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *each)


def latencies(log: DataFrame, sent: str, as_of: str, limit_ms: int = 600_000) -> DataFrame:
    """log with latency_ms from as_of to the time of sending; records without a value, from the future or older than
    limit_ms (clocks apart, or history that is replayed) are left out."""
    late = log.withColumn("latency_ms", F.col(sent) - F.col(as_of))
    return late.filter((F.col("latency_ms") >= 0) & (F.col("latency_ms") < limit_ms))


def freshness(conflated: DataFrame, latest: DataFrame) -> DataFrame:
    """symbol, conflated, final, behind_ms: symbols whose conflated price is older than their final raw price."""
    a = conflated.select("symbol", F.col("price").alias("conflated"), F.col("event_time").alias("seen"))
    b = latest.select("symbol", F.col("price").alias("final"), "event_time")
    return a.join(b, "symbol").filter("seen < event_time").select("symbol", "conflated", "final", (F.col("event_time") - F.col("seen")).alias("behind_ms"))


def tick_gaps(prices: DataFrame) -> DataFrame:
    """symbol, gap_ms: time from each tick to the next of its symbol."""
    w = Window.partitionBy("symbol").orderBy("event_time", "seq")
    return prices.select("symbol", (F.lead("event_time").over(w) - F.col("event_time")).alias("gap_ms")).filter("gap_ms IS NOT NULL")


def staleness(published: DataFrame, latest: DataFrame, stats: DataFrame) -> DataFrame:
    """published with stale_ms: cents behind the final price, as ticks of one cent, times the symbol's mean gap."""
    joined = published.filter("net_qty != 0").join(latest.select(F.col("symbol").alias("ticker"), F.col("price").alias("final")), "ticker").join(stats.filter("ticks > 1").select(F.col("symbol").alias("ticker"), "ms_per_tick"), "ticker")
    cents = (F.col("final") - S.implied_price()).cast("double") * 100
    return joined.withColumn("stale_ms", F.when(F.abs(cents) < 0.5, 0.0).otherwise(F.greatest(F.lit(0.0), cents) * F.col("ms_per_tick")))


def staleness_distribution(stale: DataFrame, limits: tuple[int, ...] = (2000, 5000, 10000)) -> DataFrame:
    """One row over staleness: n, exact, p50, p90, p99 and max in ms, and how many are beyond each limit."""
    ms = stale.select("stale_ms", F.round("stale_ms").cast("bigint").alias("ms"))
    each = [F.expr(f"cast(percentile_disc({p}) within group (order by ms) as bigint)").alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)]
    return ms.agg(F.count("*").alias("n"), F.count_if(F.col("stale_ms") == 0).alias("exact"), *each, F.max("ms").alias("max"), *[F.count_if(F.col("ms") > x).alias(f"beyond_{x}") for x in limits])


def beyond(df: DataFrame, value: str, limits: tuple[int, ...] = (2000, 5000, 10000)) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.col(value) > x).alias(f"beyond_{x}") for x in limits])


def utilization(trades: DataFrame, prices: DataFrame, parallelism: int, salt: int) -> DataFrame:
    """stage, cardinality, usable, enough: how many workers each stage's keys can keep busy."""
    def stage(name: str, df: DataFrame, *keys) -> DataFrame:
        return df.select(*keys).distinct().agg(F.lit(name).alias("stage"), F.count("*").alias("cardinality"))

    found = (
        stage("dedup", trades, "trade_id").unionByName(stage("position_by_account_ticker", trades, "account", "ticker"))
        .unionByName(stage("position_by_ticker", trades, "ticker")).unionByName(stage("latest_price", prices, "symbol"))
        .unionByName(stage("latest_price_salted", prices, "symbol", S.floor_mod("event_time", salt).alias("salt")))
    )
    return found.select("stage", "cardinality", F.least("cardinality", F.lit(parallelism)).cast("bigint").alias("usable"), (F.col("cardinality") >= parallelism).alias("enough"))


def reachable(parallelism: int, narrowest: int, units: float = 4, waste_limit: float = 0.25) -> dict[str, float | bool]:
    """The share of workers that the narrowest stage cannot use, and billed units with one for coordination."""
    waste = 1 - min(parallelism, narrowest) / parallelism
    return {"billed": parallelism / units + 1, "waste": waste, "ok": waste <= waste_limit}


def total_rate(mean_per_task: float, tasks: int) -> float:
    return mean_per_task * tasks


def calibrated(measured: float, known: float, band: float = 0.2) -> bool:
    """Whether a measured rate agrees with one that is known by other means."""
    return known > 0 and abs(measured / known - 1) <= band


def drain_capacity(backlog: list[tuple[float, float]], live_rate: float) -> float:
    """Records a second from samples (second, records still waiting): the slope's fall plus what came in."""
    n = len(backlog)
    mt, mb = sum(t for t, _ in backlog) / n, sum(b for _, b in backlog) / n
    slope = sum((t - mt) * (b - mb) for t, b in backlog) / sum((t - mt) ** 2 for t, _ in backlog)
    return live_rate - slope


def lag_trend(first: float, last: float, band: float = 0.05) -> str:
    if last > first * (1 + band):
        return "growing"
    return "shrinking" if last < first * (1 - band) else "flat"
