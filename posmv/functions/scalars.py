"""Scalar expressions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, VALUE = "decimal(18,2)", "decimal(38,2)"


def json_value(value: Column | str, field: str) -> Column:
    return F.get_json_object(value, f"$.{field}")


def composite_key(account: str = "account", ticker: str = "ticker", sentinel: str | None = None) -> Column:
    """account|ticker; null where either is null, or with the sentinel in its place."""
    parts = [F.col(account), F.col(ticker)]
    if sentinel is not None:
        parts = [F.coalesce(p, F.lit(sentinel)) for p in parts]
    return F.concat(parts[0], F.lit("|"), parts[1])


def key_account(key: str = "key") -> Column:
    return F.substring_index(key, "|", 1)


def key_ticker(key: str = "key") -> Column:
    return F.substring_index(key, "|", -1)


def exact_cents(price: Column) -> Column:
    """Cents of a decimal text, null unless it is a number of at most two decimals that fits 64 bits."""
    number = price.try_cast("decimal(38,18)")
    cents = F.expr("cast(null as bigint)") if number is None else (number * 100).try_cast("decimal(38,10)")
    whole = cents.try_cast("bigint")
    return F.when(whole.cast("decimal(38,10)") == cents, whole)


def rounded_cents(price: Column) -> Column:
    """Cents of a decimal text, half up."""
    return (F.round(price.try_cast("decimal(38,18)"), 2) * 100).try_cast("bigint")


def cents_to_money(cents: Column | str) -> Column:
    c = F.col(cents) if isinstance(cents, str) else cents
    return (c.cast("decimal(20,0)") / F.lit(100)).cast(MONEY)


def plain_text(money: Column | str) -> Column:
    """A decimal as text, both decimals kept."""
    return (F.col(money) if isinstance(money, str) else money).cast("string")


def market_value(qty: str = "net_qty", price: str = "price") -> Column:
    """Exact product; no digit of a 64-bit quantity times a price of 18 digits is lost."""
    return (F.col(qty).cast("decimal(20,0)") * F.col(price)).cast(VALUE)


def implied_price(mv: str = "mv", qty: str = "net_qty") -> Column:
    """mv / qty to six decimals, half up; null for quantity 0."""
    return F.round(F.col(mv).cast("decimal(28,2)") / F.when(F.col(qty) != 0, F.col(qty).cast("decimal(20,0)")), 6).cast("decimal(28,6)")


def floor_mod(value: str, n: int) -> Column:
    """The remainder with the sign of n."""
    return F.pmod(F.col(value), F.lit(n))


def sign_mod(value: str, n: int) -> Column:
    """The remainder with the sign of the value."""
    return F.col(value) % n


def base36(n: str) -> Column:
    return F.lower(F.conv(F.col(n).cast("string"), 10, 36))


def json_object(*columns: str | Column) -> Column:
    """An object of the columns in order; nulls are left out."""
    return F.to_json(F.struct(*columns))


def field_by_pattern(value: str, name: str) -> Column:
    """A field's text out of JSON text without parsing it; null where there is none."""
    found = F.regexp_extract(value, rf'"{name}"\s*:\s*"?([^",}}]*)"?', 1)
    return F.when(found != "", found)


def payload_bytes(value: str) -> Column:
    return F.octet_length(value)
