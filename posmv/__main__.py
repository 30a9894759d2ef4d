"""python -m posmv generate|run|validate --key value ...

generate  writes JSON lines of trades and prices:   --out DIR [--generator.trades N --generator.prices N ...]
run       streams them into the keyed outputs:      --trades DIR --prices DIR --out DIR [--once] [--config FILE]
validate  recomputes the outputs from the inputs:   --trades DIR --prices DIR --out DIR
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posmv.config import Config
from posmv.operators import generate, parse, validate
from posmv.plans.batch import wanted
from posmv.sources import storage
from posmv.sources.readers import read_raw, stream_raw
from posmv.streaming.jobs import Outputs, finish, start_market_values


def workload(config: Config) -> generate.Workload:
    d = generate.Workload()
    g = lambda name, default: type(default)(config.get(f"generator.{name}", str(default)))
    zipf = g("zipf.alpha", 1.0) if config.get("generator.distribution", "uniform").lower() == "zipf" else 0.0
    hot = "ipo" if g("ipo.share", 0.0) > 0 else "hot"
    return generate.Workload(
        accounts=g("accounts", d.accounts), tickers=g("tickers", d.tickers), trades=g("trades", d.trades), prices=g("prices", d.prices), seed=g("seed", d.seed),
        run_id=g("run.id", d.run_id), trades_per_sec=g("trades.per.sec", d.trades_per_sec), prices_per_sec=g("prices.per.sec", d.prices_per_sec),
        duplicate_ratio=g("duplicate.ratio", 0.0), qty=g("qty.override", 0), price_cents=g("price.cents.override", 0),
        price_per_symbol=config.bool("generator.price.per.symbol", False), zipf_alpha=zipf, hot_share=g(f"{hot}.share", 0.0), hot_ticker=g(f"{hot}.ticker", 0),
    )


def do_generate(spark: SparkSession, config: Config) -> None:
    w, out = workload(config), config.get("out")
    storage.ensure(spark, f"{out}/trades", f"{out}/prices", recreate=config.bool("recreate", False))
    generate.trades(spark, w).select(F.to_json(F.struct("trade_id", "account", "ticker", "qty", "event_time")).alias("value")).write.mode("append").text(f"{out}/trades")
    generate.prices(spark, w).select(F.to_json(F.struct("symbol", "price", "event_time", "seq")).alias("value")).write.mode("append").text(f"{out}/prices")


def sequenced(raw: DataFrame) -> DataFrame:
    """raw with seq, which orders ticks of equal times: the sender's number if the record has one, else a hash of the
    record, so that every reader agrees."""
    return raw.withColumn("seq", F.coalesce(F.get_json_object("value", "$.seq").try_cast("bigint"), F.xxhash64("value")))


def do_run(spark: SparkSession, config: Config) -> None:
    trades = parse.parse_trades(stream_raw(spark, config.get("trades")))
    prices = parse.parse_prices(sequenced(stream_raw(spark, config.get("prices"))), mode=config.get("price.mode"), keep=("seq",)).drop("price_cents")
    out = Outputs(spark, config.get("out"), config.guarantee())
    once = config.bool("once", False)
    query = start_market_values(trades, prices, out, config, {"availableNow": True} if once else None)
    finish(query, 24 * 3600) if once else query.awaitTermination()


def do_validate(spark: SparkSession, config: Config) -> bool:
    trades = parse.parse_trades(read_raw(spark, config.get("trades")))
    prices = parse.parse_prices(sequenced(read_raw(spark, config.get("prices"))), mode=config.get("price.mode"), keep=("seq",))
    out = Outputs(spark, config.get("out"))
    tables = {"position-by-account-ticker": out.by_account, "position-by-ticker": out.by_ticker, "mv-by-account-ticker": out.mv_account, "mv-by-ticker": out.mv_ticker}
    found = validate.validate(trades, prices, {k: v.read() for k, v in tables.items() if k in wanted(config) or k.startswith("position")}, ("event_time", "qty", "account", "ticker"), config.int("validate.lag.ms")).collect()
    for r in found:
        print(f"[{'PASS' if r.ok else 'FAIL'}] {r.check}: {r.detail}")
    return all(r.ok for r in found)


def main(args: list[str]) -> int:
    if not args or args[0] not in ("generate", "run", "validate"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName(f"posmv-{args[0]}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = Config.load(args[1:])
    ok = {"generate": do_generate, "run": do_run, "validate": do_validate}[args[0]](spark, config)
    return 1 if ok is False else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
