"""Raw JSON text to trades and prices, and results to keyed JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from posmv.functions import scalars as S


def _fields(raw: DataFrame, value: str, names: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of JSON objects as text. A generator reads each line once, and filters stay above it."""
    return raw.select(*keep, F.json_tuple(value, *names).alias(*names))


def parse_trades(raw: DataFrame, value: str = "value") -> DataFrame:
    """Trades; lines that are no JSON or lack an id, account or ticker are dropped, a missing number is 0."""
    t = _fields(raw, value, ("trade_id", "account", "ticker", "qty", "event_time"))
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)).cast("bigint").alias(c)
    return t.filter("trade_id IS NOT NULL AND account IS NOT NULL AND ticker IS NOT NULL").select("trade_id", "account", "ticker", number("qty"), number("event_time"))


def parse_prices(raw: DataFrame, value: str = "value", mode: str = "strict", keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, price, price_cents, event_time and the columns `keep`. strict drops prices of more than two
    decimals; round rounds them half up. Others that are no number, or lack a symbol, are dropped."""
    p = _fields(raw, value, ("symbol", "price", "event_time"), keep)
    cents = S.exact_cents(F.col("price")) if mode == "strict" else S.rounded_cents(F.col("price"))
    priced = p.withColumn("price_cents", cents).filter("symbol IS NOT NULL AND price_cents IS NOT NULL")
    return priced.select("symbol", S.cents_to_money("price_cents").alias("price"), "price_cents", F.coalesce(F.col("event_time").try_cast("bigint"), F.lit(0)).cast("bigint").alias("event_time"), *keep)


def counted(raw: DataFrame, name: str, value: str = "value") -> tuple[DataFrame, Observation]:
    """raw with counters of records and bytes that fill as it is read."""
    seen = Observation(name)
    return raw.observe(seen, F.count("*").alias("records"), F.sum(S.payload_bytes(value)).alias("bytes"), F.count_if(F.get_json_object(value, "$").isNull()).alias("malformed")), seen


def to_keyed_json(df: DataFrame, key: list[str], sentinel: str | None = None) -> DataFrame:
    """key, value: rows as upserts; decimals become text, nulls are left out of the object."""
    parts = [F.coalesce(F.col(k), F.lit(sentinel)) if sentinel is not None else F.col(k) for k in key]
    text = [S.plain_text(f.name).alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema]
    joined = parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (F.lit("|"), p)][1:])
    return df.select(joined.alias("key"), S.json_object(*text).alias("value"))


def from_keyed_json(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of upsert rows, beside their key."""
    return rows.select("key", F.from_json("value", schema).alias("v")).select("key", "v.*")
