"""From generated files through the stream to the checks."""

from pyspark.sql import functions as F

from posmv import __main__ as cli
from posmv.config import Config
from posmv.operators import validate
from posmv.plans import streams
from posmv.sources import storage
from posmv.streaming import sinks
from posmv.streaming.jobs import Outputs
from tests.test_operators import rows


def test_generate_run_validate(spark, tmp_path, capsys):
    own = streams.session(spark)
    d = str(tmp_path)
    cli.do_generate(own, Config({"out": d, "generator.trades": "400", "generator.prices": "300", "generator.duplicate.ratio": "0.2", "generator.tickers": "12"}))
    given = Config({"trades": f"{d}/trades", "prices": f"{d}/prices", "out": f"{d}/out", "once": "true"})
    cli.do_run(own, given)
    assert cli.do_validate(own, given)
    said = capsys.readouterr().out
    assert said.count("[PASS]") == 8 and "duplicates" in said

    # a value that is wrong, and one that is missing, must be found
    out = Outputs(own, f"{d}/out")
    broken = out.by_ticker.read().limit(1).withColumn("net_qty", F.col("net_qty") + 1)
    out.by_ticker.upsert(broken, 1000)
    assert not cli.do_validate(own, given)
    assert "[FAIL] positions by ticker" in capsys.readouterr().out


def test_empty_publication_fails(spark, tmp_path):
    own = streams.session(spark)
    t = own.createDataFrame([("a", "A", "X", 1, 1)], "trade_id string, account string, ticker string, qty bigint, event_time bigint")
    out = Outputs(own, str(tmp_path))
    p = own.createDataFrame([], "symbol string, price decimal(18,2), event_time bigint, seq bigint")
    got = dict(rows(validate.validate(t, p, {"position-by-account-ticker": out.by_account.read(), "position-by-ticker": out.by_ticker.read()}, ("event_time",)), "check", "ok"))
    assert got["positions by ticker"] is False and got["uniqueness"] is True


def test_ordering_row(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 3, 3)], "k string, t int, at int")
    r = validate.ordering(log, "k", "t", "at").first()
    assert not r.ok and r.detail == "1 records back in time, 1 keys end stale"


def test_folders(spark, tmp_path):
    p = str(tmp_path / "topic")
    assert storage.ensure(spark, p) == [p] and storage.ensure(spark, p) == [] and storage.exists(spark, p)
    (tmp_path / "topic" / "f").write_text("x")
    assert storage.ensure(spark, p, recreate=True) == [p] and not (tmp_path / "topic" / "f").exists()


def test_broker_options():
    o = sinks.broker_options("h:1", "t", "none", more={"security.protocol": "SSL"})
    assert o["kafka.acks"] == "0" and o["kafka.security.protocol"] == "SSL"


def test_usage(capsys):
    assert cli.main([]) == 2 and "generate" in capsys.readouterr().out
