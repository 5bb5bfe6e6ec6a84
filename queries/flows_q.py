"""Worked compositions on the given tables."""

from pyspark.sql import functions as F

from millrace.operators import joins, patterns
from millrace.plans import flows as P
from queries.registry import query
from queries.windows_time import EPOCH, session_sql


def bucket(size, ts="ts"):
    return f"time_bucket(INTERVAL {size}, {ts}, {EPOCH}) AS window_start, time_bucket(INTERVAL {size}, {ts}, {EPOCH}) + INTERVAL {size} AS window_end"


def sliding(source, ts, slide_h, size_h):
    """Rows of ``source`` once per sliding window, with window_start and window_end (whole hours)."""
    b = f"time_bucket(INTERVAL {slide_h} HOUR, {ts}, {EPOCH})"
    return (f"(SELECT *, ws AS window_start, ws + INTERVAL {size_h} HOUR AS window_end FROM (SELECT *, unnest(generate_series("
            f"{b} - INTERVAL {size_h - slide_h} HOUR, {b}, INTERVAL {slide_h} HOUR)) AS ws FROM {source}))")


# --- card transactions: events as payments ----------------------------------------------------
TXN = """SELECT event_id AS txn_id, user_id AS card_id, value * 20 AS amount, event_id AS merchant_id, ts,
  CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS geo, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS device,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS border,
  CASE event_type WHEN 'click' THEN 'ONLINE' WHEN 'view' THEN 'MOBILE' WHEN 'purchase' THEN 'POS' ELSE 'ATM' END AS channel,
  CASE user_id % 10 WHEN 1 THEN 'GAMBLING' WHEN 2 THEN 'CRYPTO' WHEN 9 THEN 'ATM_CASH' WHEN 5 THEN 'LUXURY' ELSE 'RETAIL' END AS category,
  CASE event_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' ELSE 'XX' END AS country FROM {events}"""
SCORED = "txn AS (" + TXN.replace("{events}", "events") + """),
 parts AS (SELECT *, CASE WHEN amount > 5000 THEN 20 WHEN amount > 2000 THEN 12 WHEN amount > 1000 THEN 6 ELSE 0 END AS score_amount,
  geo * 15 AS score_geo, device * 12 AS score_device, border * 10 AS score_border, CASE WHEN merchant_id % 8 < 2 THEN 8 ELSE 0 END AS score_time,
  CASE WHEN channel IN ('ONLINE', 'MOBILE') THEN 5 ELSE 0 END AS score_channel,
  CASE category WHEN 'GAMBLING' THEN 18 WHEN 'CRYPTO' THEN 20 WHEN 'ATM_CASH' THEN 15 WHEN 'LUXURY' THEN 8 ELSE 0 END AS score_merchant FROM txn),
 scored AS (SELECT *, least(100, score_amount + score_geo + score_device + score_border + score_time + score_channel + score_merchant) AS fraud_score FROM parts),
 labeled AS (SELECT *, CASE WHEN fraud_score >= 70 THEN 'HIGH_RISK' WHEN fraud_score >= 40 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS risk_label,
  CASE WHEN fraud_score >= 80 THEN 'BLOCK' WHEN fraud_score >= 60 THEN 'REVIEW' WHEN fraud_score >= 40 THEN 'FLAG' ELSE 'APPROVE' END AS action FROM scored)"""


def scored(t):
    return P.fraud_score(t.sql(TXN, "events"))


@query("flow_fraud_score", f"WITH {SCORED} SELECT txn_id, fraud_score, risk_label, action FROM labeled")
def flow_fraud_score(t):
    return scored(t).select("txn_id", "fraud_score", "risk_label", "action")


@query("flow_top_signal", f"""WITH {SCORED} SELECT txn_id, fraud_score, CASE WHEN score_merchant >= 18 THEN 'MERCHANT_CATEGORY'
 WHEN score_geo >= 15 THEN 'GEO_ANOMALY' WHEN score_device >= 12 THEN 'DEVICE_MISMATCH' WHEN score_amount >= 12 THEN 'AMOUNT'
 WHEN score_border >= 10 THEN 'CROSS_BORDER' ELSE 'COMPOUND' END AS top_signal FROM labeled WHERE fraud_score >= 40""")
def flow_top_signal(t):
    return P.top_signal(scored(t), 40).select("txn_id", "fraud_score", "top_signal")


@query("flow_card_velocity", f"""WITH {SCORED} SELECT {bucket('1 DAY')}, card_id, count(*) AS txn_count, round(sum(amount), 4) AS total_amount,
 max(amount) AS max_amount, count(DISTINCT merchant_id) AS unique_merchants, count(DISTINCT country) AS unique_countries,
 CASE WHEN count(*) > 4 THEN 'HIGH_VELOCITY' WHEN count(*) > 2 THEN 'ELEVATED' ELSE 'NORMAL' END AS velocity_flag FROM labeled GROUP BY 1, 2, 3""")
def flow_card_velocity(t):
    return P.card_velocity(scored(t), "1 day", 4, 2)


@query("flow_amount_stats", f"""WITH {SCORED} SELECT window_start, window_end, category, round(avg(amount), 8) AS avg_amount, max(amount) AS max_amount,
 round(stddev_pop(amount), 4) AS stddev_amount, count(CASE WHEN amount > 2000 THEN 1 END) AS high_amount_count
FROM {sliding('labeled', 'ts', 3, 24)} GROUP BY 1, 2, 3""")
def flow_amount_stats(t):
    return P.amount_stats(scored(t), "3 hours", "24 hours")


@query("flow_risk_rate", f"""WITH {SCORED} SELECT {bucket('1 DAY')}, category, count(*) AS total_txns,
 count(CASE WHEN risk_label = 'HIGH_RISK' THEN 1 END) AS fraud_txns,
 round(count(CASE WHEN risk_label = 'HIGH_RISK' THEN 1 END) * 100.0::DOUBLE / count(*), 8) AS fraud_rate_pct, round(avg(fraud_score), 8) AS avg_fraud_score,
 CASE WHEN count(CASE WHEN risk_label = 'HIGH_RISK' THEN 1 END) * 100.0 / count(*) > 15 THEN 'CRITICAL'
  WHEN count(CASE WHEN risk_label = 'HIGH_RISK' THEN 1 END) * 100.0 / count(*) > 8 THEN 'HIGH'
  WHEN count(CASE WHEN risk_label = 'HIGH_RISK' THEN 1 END) * 100.0 / count(*) > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier FROM labeled GROUP BY 1, 2, 3""")
def flow_risk_rate(t):
    return P.risk_rate(scored(t), "1 day")


@query("flow_rapid", "WITH " + SCORED + session_sql(12, "card_id", """count(*) AS txn_count, round(sum(amount), 4) AS total_amount,
 count(DISTINCT merchant_id) AS unique_merchants, max(fraud_score) AS max_score, CASE WHEN count(*) >= 5 AND max(fraud_score) >= 40 THEN 'FRAUD_PATTERN'
 WHEN count(*) >= 5 THEN 'RAPID_SUCCESSION' WHEN max(fraud_score) >= 70 THEN 'HIGH_SINGLE_SCORE' ELSE 'NORMAL' END AS rapid_flag""", "labeled").replace("\nWITH o AS", ", o AS"))
def flow_rapid(t):
    return P.rapid_succession(scored(t), "12 hours")


# --- personal data, bands, service levels ------------------------------------------------------
RAW = """SELECT e.event_id AS txn_id, e.user_id AS customer_id, c.c_name AS card, lower(c.c_mktsegment) || c.c_custkey || '@mail.example' AS email,
  e.value * 40 AS amount, CASE e.user_id % 4 WHEN 0 THEN ' usd' WHEN 1 THEN 'Eur ' WHEN 2 THEN '?' ELSE 'JPY' END AS currency,
  CASE c.c_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'EU' ELSE 'APAC' END AS country, e.event_type AS channel,
  least(1.0E0, e.value / 300) AS risk, CAST(e.event_id % 500 AS INT) AS latency_ms, e.ts FROM {events} e JOIN {customer} c ON e.user_id = c.c_custkey"""
CLEAN = "raw AS (" + RAW.replace("{events}", "events").replace("{customer}", "customer") + """),
 clean AS (SELECT txn_id, customer_id, CASE WHEN card IS NULL OR length(card) < 8 THEN '****-****-****-****' ELSE left(card, 4) || '-****-****-' || right(card, 4) END AS card,
  CASE WHEN email IS NULL OR strpos(email, '@') <= 2 THEN '**@***.***' ELSE left(email, 2) || '***' || substr(email, strpos(email, '@')) END AS email,
  round(amount, 2) AS amount, CASE WHEN upper(trim(currency)) IN ('USD','EUR','GBP','JPY','CHF','AUD','CAD','SGD') THEN upper(trim(currency)) ELSE 'UNKNOWN' END AS currency,
  country, channel, round(risk, 4) AS risk, latency_ms, ts FROM raw),
 cls AS (SELECT *, CASE WHEN risk >= 0.8 THEN 'CRITICAL' WHEN risk >= 0.55 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  CASE WHEN amount >= 10000 THEN 'WHALE' WHEN amount >= 2500 THEN 'LARGE' WHEN amount >= 500 THEN 'MEDIUM' WHEN amount >= 50 THEN 'SMALL' ELSE 'MICRO' END AS amount_band,
  CASE WHEN latency_ms < 50 THEN 'INSTANT' WHEN latency_ms < 150 THEN 'FAST' WHEN latency_ms < 400 THEN 'NORMAL' ELSE 'SLOW' END AS velocity_flag,
  CASE WHEN latency_ms < 100 AND risk < 0.3 THEN 'PLATINUM' WHEN latency_ms < 200 AND risk < 0.55 THEN 'GOLD' WHEN latency_ms < 400 AND risk < 0.8 THEN 'SILVER' ELSE 'BREACHED' END AS sla_tier FROM clean)"""


@query("flow_cleanse", f"WITH {CLEAN} SELECT txn_id, card, email, currency, risk_tier, amount_band, velocity_flag, sla_tier FROM cls")
def flow_cleanse(t):
    return P.classify(P.cleanse(t.sql(RAW, "events", "customer"))).select(
        "txn_id", "card", "email", "currency", "risk_tier", "amount_band", "velocity_flag", "sla_tier")


@query("flow_cleanse_kpi", f"""WITH {CLEAN} SELECT {bucket('1 DAY')}, country, channel, count(*) AS total_txns, round(sum(amount), 4) AS total_volume,
 round(avg(risk), 8) AS avg_risk, count(*) FILTER (WHERE risk_tier = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE risk_tier = 'HIGH') AS high_count,
 count(*) FILTER (WHERE amount_band = 'WHALE') AS whale_count, round(count(*) FILTER (WHERE risk_tier IN ('CRITICAL', 'HIGH')) / count(*) * 100.0::DOUBLE, 8) AS fraud_rate_pct,
 count(*) FILTER (WHERE sla_tier = 'BREACHED') AS breached_count FROM cls GROUP BY 1, 2, 3, 4""")
def flow_cleanse_kpi(t):
    return P.fraud_kpi(P.classify(P.cleanse(t.sql(RAW, "events", "customer"))), "1 day")


# --- trades: order lines ------------------------------------------------------------------------
TRADE = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * 10 AS notional, CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  CASE l_linestatus WHEN 'O' THEN 'LIMIT' ELSE 'MARKET' END AS order_type, CASE WHEN p_size < 10 THEN 500000.0E0 WHEN p_size < 25 THEN 250000.0E0 ELSE 50000.0E0 END AS vol_mean,
  CASE WHEN p_size < 10 THEN 25000.0E0 WHEN p_size < 25 THEN 150000.0E0 ELSE 500000.0E0 END AS vol_stddev, CASE WHEN p_size < 10 THEN 500000.0E0 ELSE 250000.0E0 END AS large_threshold
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


@query("flow_risk_score", "WITH x AS (" + TRADE.replace("{lineitem}", "lineitem").replace("{part}", "part") + """),
 z AS (SELECT *, (notional - vol_mean) / vol_stddev AS z FROM x),
 s AS (SELECT *, round(least(1.0::DOUBLE, CASE WHEN abs(z) > 2 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN order_type = 'LIMIT' AND notional > 50000 THEN 0.5::DOUBLE ELSE 0 END
  + CASE WHEN notional >= large_threshold THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN side = 'SELL' AND notional > 100000 THEN 0.7::DOUBLE ELSE 0 END
  + least(0.3::DOUBLE, abs(z) * 0.1::DOUBLE)), 10) AS risk_score FROM z)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(risk_score, 9) AS risk_score, CASE WHEN risk_score >= 0.7 THEN 'CRITICAL' WHEN risk_score >= 0.5 THEN 'HIGH' WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 concat_ws(',', CASE WHEN abs(z) > 2 THEN 'VOLUME_SPIKE' END, CASE WHEN order_type = 'LIMIT' AND notional > 50000 THEN 'SPOOFING' END,
  CASE WHEN notional >= large_threshold THEN 'LARGE_ORDER' END, CASE WHEN side = 'SELL' AND notional > 100000 THEN 'FLASH_CRASH_CONTRIBUTOR' END) AS triggered,
 'SANCTIONS_CHECK_PASSED,AML_CHECK_PASSED,KYC_VERIFIED' || CASE WHEN notional > 10000 THEN ',TAX_REPORTING_REQUIRED' ELSE '' END AS compliance,
 round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + z * 0.1::DOUBLE)), 9) AS volume_percentile FROM s""")
def flow_risk_score(t):
    return P.trade_risk(t.sql(TRADE, "lineitem", "part")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("risk_score", 9).alias("risk_score"), "risk_level", "triggered", "compliance",
        F.round("volume_percentile", 9).alias("volume_percentile"))


ORDER = """SELECT l_partkey AS symbol, l_returnflag AS side, CASE WHEN l_linenumber = 7 THEN 'REJECTED' WHEN o_orderstatus = 'F' THEN 'FILLED' WHEN o_orderstatus = 'P' THEN 'PARTIALLY_FILLED' ELSE 'NEW' END AS status,
  l_extendedprice AS value, l_extendedprice / l_quantity AS price, l_extendedprice * (1 - l_discount) / l_quantity AS paid, o_orderdate AS ts, l_orderkey, l_linenumber, l_suppkey,
  o_orderpriority FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
ORDERS = ORDER.replace("{lineitem}", "lineitem").replace("{orders}", "orders")


@query("flow_orders", f"""WITH x AS ({ORDERS}) SELECT {bucket('7 DAY')}, side, o_orderpriority, count(*) AS total_orders,
 count(*) FILTER (WHERE status = 'FILLED') AS filled_count, count(*) FILTER (WHERE status = 'PARTIALLY_FILLED') AS partial_count,
 count(*) FILTER (WHERE status = 'NEW') AS new_count, count(*) FILTER (WHERE status = 'REJECTED') AS rejected_count, round(sum(value), 4) AS total_value, round(avg(price), 7) AS avg_price,
 round(min(price), 9) AS min_price, round(max(price), 9) AS max_price FROM x GROUP BY 1, 2, 3, 4""")
def flow_orders(t):
    return P.order_summary(t.sql(ORDER, "lineitem", "orders"), "7 days", ("side", "o_orderpriority"))


@query("flow_slippage", f"""WITH x AS ({ORDERS}) SELECT l_orderkey, l_linenumber, symbol, l_suppkey,
 CASE WHEN price > 0 THEN round((paid - price) / price * 10000, 4) ELSE 0.0 END AS slippage_bps FROM x WHERE status IN ('FILLED', 'PARTIALLY_FILLED')""")
def flow_slippage(t):
    x = t.sql(ORDER, "lineitem", "orders").where(F.col("status").isin("FILLED", "PARTIALLY_FILLED"))
    return x.select("l_orderkey", "l_linenumber", "symbol", "l_suppkey", P.slippage_bps(F.col("paid"), F.col("price")).alias("slippage_bps"))


@query("flow_latency", f"""WITH x AS (SELECT ts, event_type, event_id % 1000 AS delay FROM events) SELECT {bucket('1 DAY')}, event_type, count(*) AS message_count,
 round(avg(delay), 8) AS avg_delay, max(delay) AS max_delay, min(delay) AS min_delay,
 CAST(floor(avg(delay) + 2.3::DOUBLE * stddev_pop(delay) + 1e-9::DOUBLE) AS BIGINT) AS p99_estimate FROM x GROUP BY 1, 2, 3""")
def flow_latency(t):
    return P.latency_p99(t.events.withColumn("delay", F.col("event_id") % 1000), "1 day", ["event_type"], "delay")


@query("flow_quotes", """WITH o AS (SELECT user_id AS symbol, event_id AS order_id, value AS price, ts AS order_ts FROM events WHERE event_type = 'purchase'),
 q AS (SELECT user_id AS symbol, event_id AS quote_id, value + 1 AS mid, ts AS quote_ts FROM events WHERE event_type = 'view')
SELECT o.symbol, order_id, quote_id, round((price - mid) / mid * 10000, 4) AS to_mid_bps FROM o JOIN q ON o.symbol = q.symbol
 AND quote_ts BETWEEN order_ts - INTERVAL 8 HOUR AND order_ts + INTERVAL 8 HOUR""")
def flow_quotes(t):
    o = t.events.where("event_type = 'purchase'").selectExpr("user_id AS symbol", "event_id AS order_id", "value AS price", "ts AS order_ts")
    q = t.events.where("event_type = 'view'").selectExpr("user_id AS symbol", "event_id AS quote_id", "value + 1 AS mid", "ts AS quote_ts")
    return P.orders_with_quotes(o, q, "8 hours").select("symbol", "order_id", "quote_id", "to_mid_bps")


# --- branching trades ----------------------------------------------------------------------------
DEAL = """SELECT l_orderkey * 10 + l_linenumber AS trade_id, l_partkey AS symbol, CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'UNK' END AS side,
  l_quantity AS quantity, l_extendedprice / 10 AS price, CASE l_suppkey % 5 WHEN 0 THEN 'BINANCE' WHEN 1 THEN 'COINBASE' WHEN 2 THEN 'NYSE' WHEN 3 THEN 'NASDAQ' ELSE 'OTC' END AS exchange,
  CASE l_suppkey % 3 WHEN 0 THEN 'CRYPTO' WHEN 1 THEN 'EQUITY' ELSE 'ETF' END AS category, l_shipdate AS ts, l_suppkey FROM {lineitem}"""
ENRICHED = "d AS (" + DEAL.replace("{lineitem}", "lineitem") + """), v AS (SELECT *, round(quantity * price, 4) AS trade_value,
  CASE exchange WHEN 'BINANCE' THEN 0.001::DOUBLE WHEN 'COINBASE' THEN 0.0025::DOUBLE WHEN 'NYSE' THEN 0.0005::DOUBLE WHEN 'NASDAQ' THEN 0.0005::DOUBLE ELSE 0.002::DOUBLE END AS fee_rate FROM d),
 e AS (SELECT *, CASE WHEN trade_value >= 500000 THEN 'CRITICAL' WHEN trade_value >= 100000 THEN 'HIGH' WHEN trade_value >= 10000 THEN 'MEDIUM' WHEN trade_value >= 1000 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level,
  CASE exchange WHEN 'BINANCE' THEN 'APAC' WHEN 'OTC' THEN 'GLOBAL' ELSE 'US' END AS region,
  CASE WHEN trade_value >= 500000 THEN 'MEGA' WHEN trade_value >= 100000 THEN 'LARGE' WHEN trade_value >= 10000 THEN 'MEDIUM' WHEN trade_value >= 1000 THEN 'SMALL' ELSE 'MICRO' END AS value_band FROM v)"""


def deals(t):
    return P.enrich_trades(t.sql(DEAL, "lineitem"))


@query("flow_branch_enriched", f"""WITH {ENRICHED} SELECT trade_id, symbol, l_suppkey, trade_value, risk_level, region, value_band, trade_value >= 50000 AS is_large,
 CASE side WHEN 'BUY' THEN -trade_value WHEN 'SELL' THEN trade_value ELSE 0 END AS pnl, round(trade_value * fee_rate, 1) AS fee,
 round(trade_value * (1 - fee_rate), 1) AS net_value FROM e""")
def flow_branch_enriched(t):
    # one decimal: the fees of many trades end exactly on half a cent
    e = deals(t).withColumn("fee_rate", P.lookup(F.col("exchange"), P.FEES, P.OTHER_FEE))
    return e.select("trade_id", "symbol", "l_suppkey", "trade_value", "risk_level", "region", "value_band", "is_large", "pnl",
                    F.round(F.col("trade_value") * F.col("fee_rate"), 1).alias("fee"),
                    F.round(F.col("trade_value") * (1 - F.col("fee_rate")), 1).alias("net_value"))


@query("flow_branch_alerts", f"""WITH {ENRICHED} SELECT CASE WHEN trade_value >= 500000 THEN 'CRIT-' ELSE 'HIGH-' END || trade_id AS alert_id, trade_id,
 CASE WHEN trade_value >= 500000 THEN 'CRITICAL' ELSE 'HIGH' END AS level, category || '-' || CASE WHEN trade_value >= 500000 THEN 'C1' ELSE 'H2' END AS alert_code,
 CASE WHEN trade_value >= 500000 THEN 10 WHEN trade_value >= 250000 THEN 8 WHEN trade_value >= 100000 THEN 6 ELSE 4 END AS severity_score,
 'Large ' || side || ' of ' || symbol || ' on ' || exchange AS reason FROM e WHERE trade_value >= 100000""")
def flow_branch_alerts(t):
    return P.trade_alerts(deals(t))


@query("flow_branch_summary", f"""WITH {ENRICHED} SELECT {bucket('30 DAY')}, exchange, side, count(*) AS trade_count, round(sum(quantity), 4) AS volume, round(sum(trade_value), 4) AS total_value,
 max(trade_value) AS max_value, count(*) FILTER (WHERE trade_value >= 100000) AS high_risk_count FROM e GROUP BY 1, 2, 3, 4""")
def flow_branch_summary(t):
    return P.trade_summary(deals(t), "30 days", ("exchange", "side"), 100000)


@query("flow_trades", f"""WITH {ENRICHED} SELECT {bucket('7 DAY')}, side, count(*) AS trade_count, round(sum(quantity), 4) AS volume, round(sum(trade_value), 4) AS total_value,
 max(trade_value) AS max_value, count(*) FILTER (WHERE trade_value >= 10000) AS high_risk_count FROM e WHERE quantity > 0 AND price > 0 GROUP BY 1, 2, 3""")
def flow_trades(t):
    return P.trade_summary(deals(t).where("quantity > 0 AND price > 0"), "7 days", ("side",))


@query("flow_orders_branches", f"""
WITH o AS (SELECT event_id AS order_id, user_id, value * 2 AS total, ts FROM events WHERE event_type = 'purchase')
SELECT 'high_value' AS branch, order_id AS key, NULL::TIMESTAMP AS at, round(total, 4) AS amount, 1::BIGINT AS n FROM o WHERE total > 100
UNION ALL SELECT 'daily', user_id, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) + INTERVAL 1 DAY, round(sum(total), 4), count(*) FROM o GROUP BY 2, 3
UNION ALL SELECT 'velocity', user_id, window_end, round(sum(total), 4), count(*) FROM {sliding('o', 'ts', 6, 24)} GROUP BY 2, 3
UNION ALL SELECT 'alert', order_id, ts, round(total, 4), 1 FROM (SELECT *, sum(total) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS spend FROM o) WHERE spend > 200.005""")
def flow_orders_branches(t):
    from millrace.operators import windows as W
    o = t.events.where("event_type = 'purchase'").selectExpr("event_id AS order_id", "user_id", "value * 2 AS total", "ts")
    money = {"amount": F.round(F.sum("total"), 4), "n": F.count("*")}

    def shaped(df, branch, key, at, amount="amount", n="n"):
        return df.select(F.lit(branch).alias("branch"), F.col(key).alias("key"), at.cast("timestamp_ntz").alias("at"),
                         F.round(amount, 4).alias("amount"), (F.lit(1).cast("long") if n is None else F.col(n)).alias("n"))

    end = F.col("window_end")
    return (shaped(o.where("total > 100"), "high_value", "order_id", F.lit(None), "total", None)
            .unionByName(shaped(W.tumble(o, "ts", "1 day", ["user_id"], money), "daily", "user_id", end))
            .unionByName(shaped(W.hop(o, "ts", "6 hours", "24 hours", ["user_id"], money), "velocity", "user_id", end))
            .unionByName(shaped(P.spend_alerts(o, "24 hours", 200.005), "alert", "order_id", F.col("ts"), "total", None)))


# --- sensors, towers, cars: events as readings ----------------------------------------------------
SENSOR = """SELECT event_id, user_id AS device_id, ts, value AS reading, value > 80 AS is_anomaly, event_id % 100 AS battery,
  CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'view' THEN 'DEGRADED' ELSE 'OK' END AS status, event_type AS device_type, least(100, CAST(floor(value) AS BIGINT)) AS risk FROM {events}"""
SENSORS = SENSOR.replace("{events}", "events")


@query("flow_sensor_stats", f"""WITH s AS ({SENSORS}) SELECT {bucket('6 HOUR')}, device_type, count(*) AS event_count, round(avg(reading), 8) AS avg_value, min(reading) AS min_value,
 max(reading) AS max_value, count(*) FILTER (WHERE is_anomaly) AS anomaly_count, count(*) FILTER (WHERE battery < 20) AS low_battery,
 count(*) FILTER (WHERE status = 'CRITICAL') AS critical_count FROM s GROUP BY 1, 2, 3""")
def flow_sensor_stats(t):
    return P.sensor_stats(t.sql(SENSOR, "events"), "6 hours", ["device_type"])


@query("flow_sensor_rate", f"""WITH s AS ({SENSORS}) SELECT window_start, window_end, device_type, count(*) AS total_events, count(*) FILTER (WHERE is_anomaly) AS anomaly_count,
 round(avg(CASE WHEN is_anomaly THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 8) AS anomaly_rate, round(avg(risk), 8) AS avg_risk FROM {sliding('s', 'ts', 2, 12)} GROUP BY 1, 2, 3""")
def flow_sensor_rate(t):
    return P.anomaly_rate(t.sql(SENSOR, "events"), "2 hours", "12 hours", ["device_type"])


@query("flow_sensor_health", f"""WITH s AS ({SENSORS}) SELECT event_id, CASE WHEN risk >= 80 THEN 'F' WHEN risk >= 60 THEN 'D' WHEN risk >= 40 THEN 'C' WHEN risk >= 20 THEN 'B' ELSE 'A' END AS health_grade,
 CAST(100 - risk AS INTEGER) AS health_score, battery < 20 OR status IN ('CRITICAL', 'DEGRADED') AS needs_attention FROM s""")
def flow_sensor_health(t):
    return P.sensor_health(t.sql(SENSOR, "events")).select("event_id", "health_grade", "health_score", "needs_attention")


@query("flow_sensor_fleet", "WITH s AS (" + SENSORS + ")" + session_sql(8, "device_id", """count(*) AS event_count, round(avg(reading), 8) AS avg_value,
 max(risk) AS max_risk, min(battery) AS min_battery""", "s").replace("\nWITH o AS", ", o AS").replace("FROM s GROUP", "FROM s2 GROUP").replace(" s AS (SELECT *, sum", " s2 AS (SELECT *, sum"))
def flow_sensor_fleet(t):
    return P.fleet_sessions(t.sql(SENSOR, "events"), "8 hours")


TOWER = """SELECT e.event_id, e.user_id AS tower_id, n.n_regionkey AS region, e.ts, -60 - e.value / 5 AS rssi, 100 - e.value / 4 AS uptime, least(100.0E0, e.value * 3) AS cpu,
  e.event_id % 400 AS subscribers, CASE WHEN e.value < 5 THEN 'EXCELLENT' WHEN e.value < 15 THEN 'GOOD' WHEN e.value < 40 THEN 'FAIR' ELSE 'POOR' END AS quality
  FROM {events} e JOIN {customer} c ON e.user_id = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey"""
TOWERS = TOWER.replace("{events}", "events").replace("{customer}", "customer").replace("{nation}", "nation")


@query("flow_telecom_sqi", f"""WITH s AS ({TOWERS}) SELECT window_start, window_end, region, round(avg(CASE quality WHEN 'EXCELLENT' THEN 100.0::DOUBLE WHEN 'GOOD' THEN 75.0::DOUBLE
 WHEN 'FAIR' THEN 50.0::DOUBLE ELSE 25.0::DOUBLE END), 8) AS avg_sqi, min(rssi) AS min_rssi, count(*) FILTER (WHERE quality = 'POOR') AS poor_count FROM {sliding('s', 'ts', 2, 12)} GROUP BY 1, 2, 3""")
def flow_telecom_sqi(t):
    return P.signal_index(t.sql(TOWER, "events", "customer", "nation"), "2 hours", "12 hours")


@query("flow_telecom_capacity", f"""WITH s AS ({TOWERS}) SELECT {bucket('1 DAY')}, region, CAST(sum(subscribers) AS BIGINT) AS total_subscribers, max(subscribers) AS peak_subscribers,
 round(avg(cpu), 8) AS avg_cpu, CASE WHEN avg(cpu) > 85 THEN 'OVERLOADED' WHEN avg(cpu) > 65 THEN 'HIGH' WHEN avg(cpu) > 40 THEN 'NORMAL' ELSE 'UNDERUTILIZED' END AS capacity_status FROM s GROUP BY 1, 2, 3""")
def flow_telecom_capacity(t):
    return P.capacity(t.sql(TOWER, "events", "customer", "nation"), "1 day")


@query("flow_telecom_outage", "WITH s AS (" + TOWERS + ")" + session_sql(10, "tower_id", """count(*) AS event_count, round(avg(uptime), 8) AS avg_uptime,
 CASE WHEN avg(uptime) < 80 THEN 'HIGH_RISK' WHEN avg(uptime) < 90 THEN 'MEDIUM_RISK' ELSE 'NORMAL' END AS outage_risk""", "s").replace("\nWITH o AS", ", o AS").replace("FROM s GROUP", "FROM s2 GROUP").replace(" s AS (SELECT *, sum", " s2 AS (SELECT *, sum"))
def flow_telecom_outage(t):
    return P.outages(t.sql(TOWER, "events", "customer", "nation"), "10 hours")


CAR = """SELECT event_id, user_id AS driver, ts, CAST(event_id div 100 AS BIGINT) AS lap, CAST(event_id % 3 AS BIGINT) AS sector, 40 + value * 2 AS speed, least(100.0E0, value * 2) AS brake,
  value / 30 AS g_lat, -value / 40 AS g_lon, 800 + value * 3 AS brake_temp, 70 + value / 2 AS tyre_temp, least(100.0E0, value) AS tyre_wear, 10 + value AS fuel,
  CASE event_type WHEN 'click' THEN 'SOFT' WHEN 'view' THEN 'MEDIUM' ELSE 'HARD' END AS tyre, CASE event_type WHEN 'error' THEN 'IN_PIT_BOX' ELSE 'ON_TRACK' END AS pit FROM {events}"""
CARS = CAR.replace("{events}", "events").replace("event_id div 100", "event_id // 100")


@query("flow_race_laps", f"""WITH s AS ({CARS}) SELECT {bucket('1 DAY')}, driver, max(lap) AS lap, round(avg(speed), 8) AS avg_speed, max(speed) AS max_speed, count(DISTINCT sector) AS sectors, max(tyre) AS tyre,
 CASE WHEN avg(speed) > 250 AND max(speed) > 320 THEN 'FLYING_LAP' WHEN count(*) FILTER (WHERE pit <> 'ON_TRACK') > 0 THEN 'PIT_LAP' WHEN min(speed) < 60 THEN 'SLOW_LAP' ELSE 'NORMAL_LAP' END AS lap_class FROM s GROUP BY 1, 2, 3""")
def flow_race_laps(t):
    return P.laps(t.sql(CAR, "events"), "1 day")


@query("flow_race_tyres", f"""WITH s AS ({CARS}) SELECT window_start, window_end, driver, round(avg(tyre_temp), 8) AS avg_temp, round(max(tyre_temp) - min(tyre_temp), 4) AS temp_delta,
 CASE WHEN avg(tyre_temp) > 115 OR avg(tyre_wear) > 80 THEN 'GRAINING' WHEN avg(tyre_temp) > 105 THEN 'OVERHEATING' WHEN avg(tyre_temp) < 75 THEN 'COLD' WHEN avg(tyre_wear) > 60 THEN 'HIGH_WEAR' ELSE 'NOMINAL' END AS thermal_state,
 count(*) FILTER (WHERE tyre_temp > 115) AS overheating_count FROM {sliding('s', 'ts', 4, 24)} GROUP BY 1, 2, 3""")
def flow_race_tyres(t):
    return P.tyre_state(t.sql(CAR, "events"), "4 hours", "24 hours")


@query("flow_race_incidents", f"""WITH s AS ({CARS}) SELECT event_id, CASE WHEN abs(g_lat) > 5 AND speed > 100 THEN 'SPIN' WHEN g_lon < -5 AND speed > 150 THEN 'HEAVY_BRAKING_EVENT'
 WHEN brake > 80 AND abs(g_lat) > 3 AND speed > 80 THEN 'LOCK-UP' WHEN g_lon < -4 AND brake < 20 THEN 'POSSIBLE_CONTACT' WHEN brake_temp > 1050 THEN 'BRAKE_OVERTEMP' ELSE 'ANOMALY' END AS incident,
 CASE WHEN abs(g_lat) > 5.5 OR g_lon < -5.5 THEN 'CRITICAL' WHEN abs(g_lat) > 4.5 OR g_lon < -4.5 THEN 'HIGH' WHEN abs(g_lat) > 3.5 OR g_lon < -3.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM s WHERE abs(g_lat) > 3.5 OR g_lon < -4 OR brake_temp > 1000""")
def flow_race_incidents(t):
    return P.incidents(t.sql(CAR, "events")).select("event_id", "incident", "severity")


@query("flow_race_pits", "WITH s AS (" + CARS + ")" + session_sql(12, "driver", """CAST(max(lap) - min(lap) AS INTEGER) AS laps, round(avg(tyre_wear), 8) AS avg_wear,
 count(*) FILTER (WHERE pit = 'IN_PIT_BOX') AS pit_events, CASE WHEN avg(tyre_wear) > 75 THEN 'STOP_NOW' WHEN avg(tyre_wear) > 55 THEN 'PREPARE_STOP' WHEN avg(tyre_temp) > 110 THEN 'THERMAL_DEGRADATION'
 WHEN avg(fuel) < 15 THEN 'FUEL_CRITICAL' ELSE 'CONTINUE' END AS advice""", "s").replace("\nWITH o AS", ", o AS").replace("FROM s GROUP", "FROM s2 GROUP").replace(" s AS (SELECT *, sum", " s2 AS (SELECT *, sum"))
def flow_race_pits(t):
    return P.pit_signals(t.sql(CAR, "events"), "12 hours")


# --- alerts from windows ---------------------------------------------------------------------------
NOTE = """SELECT event_id, user_id, user_id % 20 AS symbol, ts, value AS price, value * 3000 AS notional FROM {events}"""
NOTES = NOTE.replace("{events}", "events")


@query("flow_proxy_score", f"""WITH x AS ({NOTES}) SELECT event_id, round(CASE WHEN notional >= 500000 THEN 95.0::DOUBLE WHEN notional >= 100000 THEN 80.0::DOUBLE + (notional - 100000) / 400000 * 15.0::DOUBLE
 WHEN notional >= 10000 THEN 50.0::DOUBLE + (notional - 10000) / 90000 * 30.0::DOUBLE WHEN notional >= 1000 THEN 20.0::DOUBLE + (notional - 1000) / 9000 * 30.0::DOUBLE ELSE notional / 1000 * 20.0::DOUBLE END, 9) AS score FROM x""")
def flow_proxy_score(t):
    return t.sql(NOTE, "events").select("event_id", P.proxy_score(F.col("notional"), 9).alias("score"))


@query("flow_window_alerts", f"""WITH x AS ({NOTES}),
 v AS (SELECT {bucket('1 DAY')}, user_id, count(*) AS n, sum(notional) AS total FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND sum(notional) >= 100000),
 c AS (SELECT {bucket('6 HOUR')}, symbol, count(*) AS n, sum(notional) AS total FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND 1.0 - min(price) / nullif(max(price), 0) >= 0.3)
SELECT 'VOLUME_SPIKE' AS pattern, 'u' || user_id AS subject, window_start, n, round(total, 2) AS total, CASE WHEN total >= 1000000 THEN 'CRITICAL' WHEN total >= 500000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM v
UNION ALL SELECT 'FLASH_CRASH', 's' || symbol, window_start, n, round(total, 2), 'CRITICAL' FROM c
UNION ALL SELECT 'LARGE_ORDER', 'e' || event_id, ts, 1, round(notional, 2), CASE WHEN notional >= 500000 THEN 'CRITICAL' WHEN notional >= 250000 THEN 'HIGH' ELSE 'MEDIUM' END FROM x
 WHERE notional >= CASE symbol WHEN 1 THEN 500000 WHEN 2 THEN 250000 WHEN 3 THEN 100000 WHEN 4 THEN 50000 WHEN 5 THEN 75000 ELSE 100000 END""")
def flow_window_alerts(t):
    x = t.sql(NOTE, "events")
    limits = P.lookup(F.col("symbol"), {1: 500000, 2: 250000, 3: 100000, 4: 50000, 5: 75000}, 100000)

    def level(c, critical, high):
        return F.when(c >= critical, "CRITICAL").when(c >= high, "HIGH").otherwise("MEDIUM")

    def shaped(df, pattern, letter, key, at, n, total, severity):
        return df.select(F.lit(pattern).alias("pattern"), F.concat(F.lit(letter), F.col(key)).alias("subject"),
                         F.col(at).alias("window_start"), n.alias("n"), F.round(total, 2).alias("total"), severity.alias("severity"))

    n, total, one = F.col("trade_count"), F.col("total"), F.lit(1).cast("long")
    return (shaped(P.volume_spikes(x, "1 day", 4, 100000), "VOLUME_SPIKE", "u", "user_id", "window_start", n, total, level(total, 1000000, 500000))
            .unionByName(shaped(P.flash_crashes(x, "6 hours"), "FLASH_CRASH", "s", "symbol", "window_start", n, total, F.lit("CRITICAL")))
            .unionByName(shaped(x.where(F.col("notional") >= limits), "LARGE_ORDER", "e", "event_id", "ts", one, F.col("notional"),
                                level(F.col("notional"), 500000, 250000))))


WATCH = """SELECT user_id AS trader_id, ts, least(1.0E0, value / 100) AS risk, value * 1000 AS asset, user_id % 30 AS tx_rate, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS sanctioned FROM {events}"""


@query("flow_watchlist", "WITH x AS (" + WATCH.replace("{events}", "events") + f"""), s AS (SELECT *, CASE WHEN sanctioned = 1 THEN 'CRITICAL' ELSE ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(1, least(4,
  CASE WHEN risk >= 0.8 THEN 4 WHEN risk >= 0.55 THEN 3 WHEN risk >= 0.3 THEN 2 ELSE 1 END + (asset >= 50000)::INT + (tx_rate >= 20)::INT - (asset < 100 AND tx_rate < 3)::INT))] END AS severity FROM x),
 w AS (SELECT {bucket('1 DAY')}, trader_id, count(*) AS tx_count, sum(risk * asset) / nullif(sum(asset), 0) AS wr, round(sum(asset), 2) AS total_asset, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count FROM s GROUP BY 1, 2, 3)
SELECT window_start, window_end, trader_id, tx_count, round(wr, 8) AS weighted_risk, CASE WHEN wr >= 0.8 THEN 'CRITICAL' WHEN wr >= 0.55 THEN 'HIGH' END AS level, total_asset, critical_count FROM w WHERE wr >= 0.55""")
def flow_watchlist(t):
    return P.watchlist(t.sql(WATCH, "events"), "1 day")
