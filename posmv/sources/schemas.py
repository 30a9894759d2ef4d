"""Record schemas."""

TRADE = "trade_id STRING, account STRING, ticker STRING, qty BIGINT, event_time BIGINT"
PRICE = "symbol STRING, price STRING, event_time BIGINT"
POSITION = "account STRING, ticker STRING, net_qty BIGINT, as_of BIGINT"
TICKER_POSITION = "ticker STRING, net_qty BIGINT, as_of BIGINT"
MARKET_VALUE = "account STRING, ticker STRING, net_qty BIGINT, price DECIMAL(18,2), mv DECIMAL(38,2), as_of BIGINT"
TICKER_MARKET_VALUE = "ticker STRING, net_qty BIGINT, price DECIMAL(18,2), mv DECIMAL(38,2), as_of BIGINT"
RAW = "value STRING"
UPSERT = "key STRING, value STRING"
