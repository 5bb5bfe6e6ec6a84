"""Worked compositions: fraud, trading, order, sensor, network and telemetry analytics.

Each is a function of DataFrames with the named columns, batch or stream unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import library as L, scalar as S
from millrace.operators import joins, over, windows

# Points, limits and labels of the scoring rules.
AMOUNT_POINTS = ((5000, 20), (2000, 12), (1000, 6))
FLAG_POINTS = {"geo": 15, "device": 12, "border": 10}
QUIET_HOURS_POINTS, REMOTE_POINTS = 8, 5
REMOTE_CHANNELS = ("ONLINE", "MOBILE")
CATEGORY_POINTS = {"GAMBLING": 18, "CRYPTO": 20, "ATM_CASH": 15, "LUXURY": 8}
RISK_LABELS = ((70, "HIGH_RISK"), (40, "MEDIUM_RISK"))
ACTIONS = ((80, "BLOCK"), (60, "REVIEW"), (40, "FLAG"))
TRADE_RISK = ((0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM"))
NOTIONAL_LEVELS = ((500000, "CRITICAL"), (100000, "HIGH"), (10000, "MEDIUM"), (1000, "LOW"))
VALUE_BANDS = ((500000, "MEGA"), (100000, "LARGE"), (10000, "MEDIUM"), (1000, "SMALL"))
ALERT_SCORES = ((500000, 10), (250000, 8), (100000, 6))
FX = {"CRYPTO": 1.00, "EQUITY": 1.05, "ETF": 0.98}
FEES = {"BINANCE": 0.001, "COINBASE": 0.0025, "NYSE": 0.0005, "NASDAQ": 0.0005}
OTHER_FEE = 0.002
REGIONS = {"BINANCE": "APAC", "COINBASE": "US", "NYSE": "US", "NASDAQ": "US"}
HEALTH_GRADES = ((80, "F"), (60, "D"), (40, "C"), (20, "B"))
SIGNAL_INDEX = {"EXCELLENT": 100.0, "GOOD": 75.0, "FAIR": 50.0}
OTHER_SIGNAL = 25.0


def lookup(c: Column, table: dict, default) -> Column:
    """Simple CASE from a table of values."""
    chain = F
    for key, value in table.items():
        chain = chain.when(c == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def points_above(c: Column, table) -> Column:
    """Points of the first limit that is exceeded."""
    chain = F
    for limit, points in table:
        chain = chain.when(c > limit, F.lit(points))
    return chain.otherwise(F.lit(0))


def fraud_score(txns: DataFrame) -> DataFrame:
    """Seven signals, their sum capped at 100, a label and an action.

    Needs amount, geo, device, border (0/1), merchant_id, channel, category.
    """
    signals = {
        "score_amount": points_above(F.col("amount"), AMOUNT_POINTS),
        **{f"score_{f}": F.col(f) * p for f, p in FLAG_POINTS.items()},
        "score_time": F.when(F.col("merchant_id") % 8 < 2, QUIET_HOURS_POINTS).otherwise(0),
        "score_channel": F.when(F.col("channel").isin(*REMOTE_CHANNELS), REMOTE_POINTS).otherwise(0),
        "score_merchant": lookup(F.col("category"), CATEGORY_POINTS, 0),
    }
    total = sum((F.col(s) for s in signals), F.lit(0))
    scored = txns.withColumns({n: c.cast("int") for n, c in signals.items()}).withColumn(
        "fraud_score", F.least(F.lit(100), total).cast("int"))
    return scored.withColumns({"risk_label": L.band_from(F.col("fraud_score"), RISK_LABELS, "LOW_RISK"),
                               "action": L.band_from(F.col("fraud_score"), ACTIONS, "APPROVE")})


def top_signal(scored: DataFrame, minimum: int = 60) -> DataFrame:
    """High scores with their leading signal."""
    signal = (F.when(F.col("score_merchant") >= 18, "MERCHANT_CATEGORY").when(F.col("score_geo") >= 15, "GEO_ANOMALY")
              .when(F.col("score_device") >= 12, "DEVICE_MISMATCH").when(F.col("score_amount") >= 12, "AMOUNT")
              .when(F.col("score_border") >= 10, "CROSS_BORDER").otherwise("COMPOUND"))
    return scored.where(F.col("fraud_score") >= minimum).withColumn("top_signal", signal)


def card_velocity(scored: DataFrame, size: str = "1 minute", high: int = 20, elevated: int = 10) -> DataFrame:
    """Transactions, amounts and distinct merchants and countries per card and window (exact distincts: batch)."""
    n = F.count("*")
    return windows.tumble(scored, "ts", size, ["card_id"], {
        "txn_count": n, "total_amount": S.rounded(F.sum("amount"), 4), "max_amount": F.max("amount"),
        "unique_merchants": F.count_distinct("merchant_id"), "unique_countries": F.count_distinct("country"),
        "velocity_flag": F.when(n > high, "HIGH_VELOCITY").when(n > elevated, "ELEVATED").otherwise("NORMAL")})


def amount_stats(scored: DataFrame, slide: str = "10 seconds", size: str = "2 minutes", large: float = 2000) -> DataFrame:
    """Sliding amount statistics per category."""
    return windows.hop(scored, "ts", slide, size, ["category"], {
        "avg_amount": S.rounded(F.avg("amount"), 8), "max_amount": F.max("amount"),
        "stddev_amount": S.rounded(F.stddev_pop("amount"), 4), "high_amount_count": F.count_if(F.col("amount") > large)})


def risk_rate(scored: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Share of high-risk transactions per category and window, with a tier."""
    rate = F.count_if(F.col("risk_label") == "HIGH_RISK") * F.lit(100.0) / F.count("*")
    return windows.tumble(scored, "ts", size, ["category"], {
        "total_txns": F.count("*"), "fraud_txns": F.count_if(F.col("risk_label") == "HIGH_RISK"),
        "fraud_rate_pct": S.rounded(rate, 8), "avg_fraud_score": S.rounded(F.avg("fraud_score"), 8),
        "risk_tier": F.when(rate > 15, "CRITICAL").when(rate > 8, "HIGH").when(rate > 3, "MEDIUM").otherwise("LOW")})


def rapid_succession(scored: DataFrame, gap: str = "30 seconds", many: int = 5) -> DataFrame:
    """Sessions of a card and what they look like."""
    n, worst = F.count("*"), F.max("fraud_score")
    return windows.session(scored, "ts", gap, ["card_id"], {
        "txn_count": n, "total_amount": S.rounded(F.sum("amount"), 4), "unique_merchants": F.count_distinct("merchant_id"),
        "max_score": worst,
        "rapid_flag": F.when((n >= many) & (worst >= 40), "FRAUD_PATTERN").when(n >= many, "RAPID_SUCCESSION")
        .when(worst >= 70, "HIGH_SINGLE_SCORE").otherwise("NORMAL")})


def cleanse(txns: DataFrame) -> DataFrame:
    """Masked card and mail, normal currency, rounded figures."""
    return txns.select("txn_id", "customer_id", S.mask_card("card").alias("card"), S.mask_email("email").alias("email"),
                       S.rounded("amount", 2).alias("amount"), S.normalize_currency("currency").alias("currency"),
                       "country", "channel", S.rounded("risk", 4).alias("risk"), "latency_ms", "ts")


def classify(clean: DataFrame) -> DataFrame:
    return clean.withColumns({
        "risk_tier": L.classify_risk(F.col("risk")), "amount_band": L.amount_band(F.col("amount")),
        "velocity_flag": L.velocity_flag(F.col("latency_ms")), "sla_tier": L.sla_tier(F.col("latency_ms"), F.col("risk"))})


def fraud_kpi(classified: DataFrame, size: str = "1 minute") -> DataFrame:
    tier = F.col("risk_tier")
    return windows.tumble(classified, "ts", size, ["country", "channel"], {
        "total_txns": F.count("*"), "total_volume": S.rounded(F.sum("amount"), 4), "avg_risk": S.rounded(F.avg("risk"), 8),
        "critical_count": F.count_if(tier == "CRITICAL"), "high_count": F.count_if(tier == "HIGH"),
        "whale_count": F.count_if(F.col("amount_band") == "WHALE"),
        "fraud_rate_pct": S.rounded(F.count_if(tier.isin("CRITICAL", "HIGH")) / F.count("*") * 100.0, 8),
        "breached_count": F.count_if(F.col("sla_tier") == "BREACHED")})


def trade_risk(trades: DataFrame) -> DataFrame:
    """Volume z-score, its percentile proxy, capped score, level, triggers and compliance flags.

    Needs notional, side, order_type and the symbol's vol_mean, vol_stddev, large_threshold.
    """
    z = (F.col("notional") - F.col("vol_mean")) / F.col("vol_stddev")
    t = trades.withColumn("z", z)
    spike = F.abs("z") > 2.0
    spoof = (F.col("order_type") == "LIMIT") & (F.col("notional") > 50000.0)
    large = F.col("notional") >= F.col("large_threshold")
    crash = (F.col("side") == "SELL") & (F.col("notional") > 100000.0)

    def share(test: Column, points: float) -> Column:
        return F.when(test, points).otherwise(0.0)

    score = F.least(F.lit(1.0), share(spike, 0.3) + share(spoof, 0.5) + share(large, 0.2) + share(crash, 0.7)
                    + F.least(F.lit(0.3), F.abs("z") * 0.1))
    triggers = F.concat_ws(",", F.when(spike, "VOLUME_SPIKE"), F.when(spoof, "SPOOFING"), F.when(large, "LARGE_ORDER"),
                           F.when(crash, "FLASH_CRASH_CONTRIBUTOR"))
    flags = F.concat(F.lit("SANCTIONS_CHECK_PASSED,AML_CHECK_PASSED,KYC_VERIFIED"),
                     F.when(F.col("notional") > 10000.0, ",TAX_REPORTING_REQUIRED").otherwise(""))
    return t.withColumns({
        "volume_percentile": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + F.col("z") * 0.1)),
        "market_impact": F.least(F.lit(1.0), F.col("notional") / 1000000.0),
        "liquidity_use": F.least(F.lit(1.0), F.col("notional") / 500000.0),
        "slippage": F.when(F.col("order_type") == "MARKET", 0.001).otherwise(0.0),
        "risk_score": S.rounded(score, 10), "triggered": triggers, "compliance": flags}).withColumn(
        "risk_level", L.band_from(F.col("risk_score"), TRADE_RISK, "LOW"))


def order_summary(orders: DataFrame, size: str, by=("symbol", "side")) -> DataFrame:
    """Counts per status and values per window."""
    status = F.col("status")
    return windows.tumble(orders, "ts", size, list(by), {
        "total_orders": F.count("*"), "filled_count": F.count_if(status == "FILLED"),
        "partial_count": F.count_if(status == "PARTIALLY_FILLED"), "new_count": F.count_if(status == "NEW"),
        "rejected_count": F.count_if(status == "REJECTED"),
        "total_value": S.rounded(F.sum("value"), 4), "avg_price": S.rounded(F.avg("price"), 7),
        "min_price": S.rounded(F.min("price"), 9), "max_price": S.rounded(F.max("price"), 9)})


def slippage_bps(paid: Column, limit: Column, digits: int = 4) -> Column:
    """Deviation of the paid price from the limit in basis points; 0 without a positive limit."""
    known = limit.isNotNull() & (limit > 0) & paid.isNotNull()
    return F.when(known, S.rounded((paid - limit) / limit * 10000, digits)).otherwise(0.0)


def latency_p99(df: DataFrame, size: str, by, latency: str) -> DataFrame:
    """Delay statistics; p99 by the normal approximation mean + 2.3 standard deviations."""
    v = F.col(latency).cast("double")
    return windows.tumble(df, "ts", size, list(by), {
        "message_count": F.count("*"), "avg_delay": S.rounded(F.avg(v), 8), "max_delay": F.max(latency), "min_delay": F.min(latency),
        "p99_estimate": F.floor(F.avg(v) + F.lit(2.3) * F.stddev_pop(v) + F.lit(1e-9))})


def orders_with_quotes(orders: DataFrame, quotes: DataFrame, reach: str) -> DataFrame:
    """Every order with the quotes around it and its distance from the mid price in basis points."""
    pairs = joins.interval_join(orders, quotes, ["symbol"], "order_ts", "quote_ts", f"-{reach}", reach)
    return pairs.withColumn("to_mid_bps", F.when(F.col("mid").isNotNull() & F.col("price").isNotNull(),
                                                 S.rounded((F.col("price") - F.col("mid")) / F.col("mid") * 10000, 4)))


def enrich_trades(trades: DataFrame) -> DataFrame:
    """Value, currency-adjusted notional, level, region, fees and band of a trade."""
    value = F.col("quantity") * F.col("price")
    fee = lookup(F.col("exchange"), FEES, OTHER_FEE)
    return trades.withColumn("trade_value", S.rounded(value, 4)).withColumns({
        "notional_usd": S.rounded(F.col("trade_value") * lookup(F.col("category"), FX, 1.00), 2),
        "risk_level": L.band_from(F.col("trade_value"), NOTIONAL_LEVELS, "MINIMAL"),
        "region": lookup(F.col("exchange"), REGIONS, "GLOBAL"),
        "pnl": F.when(F.col("side") == "BUY", -F.col("trade_value")).when(F.col("side") == "SELL", F.col("trade_value")).otherwise(0.0),
        "fee": S.rounded(F.col("trade_value") * fee, 2), "net_value": S.rounded(F.col("trade_value") * (1 - fee), 2),
        "is_large": F.col("trade_value") >= 50000.0, "value_band": L.band_from(F.col("trade_value"), VALUE_BANDS, "MICRO")})


def trade_alerts(enriched: DataFrame, minimum: float = 100000) -> DataFrame:
    critical = F.col("trade_value") >= 500000
    return enriched.where(F.col("trade_value") >= minimum).select(
        F.concat(F.when(critical, "CRIT-").otherwise("HIGH-"), F.col("trade_id").cast("string")).alias("alert_id"), "trade_id",
        F.when(critical, "CRITICAL").otherwise("HIGH").alias("level"),
        F.concat(F.col("category"), F.lit("-"), F.when(critical, "C1").otherwise("H2")).alias("alert_code"),
        L.band_from(F.col("trade_value"), [(b, str(s)) for b, s in ALERT_SCORES], "4").cast("int").alias("severity_score"),
        F.concat(F.lit("Large "), F.col("side"), F.lit(" of "), F.col("symbol").cast("string"), F.lit(" on "), F.col("exchange")).alias("reason"))


def trade_summary(enriched: DataFrame, size: str, by=("symbol", "side"), high: float = 10000) -> DataFrame:
    return windows.tumble(enriched, "ts", size, list(by), {
        "trade_count": F.count("*"), "volume": S.rounded(F.sum("quantity"), 4), "total_value": S.rounded(F.sum("trade_value"), 4),
        "max_value": F.max("trade_value"), "high_risk_count": F.count_if(F.col("trade_value") >= high)})


def sensor_stats(readings: DataFrame, size: str, by) -> DataFrame:
    return windows.tumble(readings, "ts", size, list(by), {
        "event_count": F.count("*"), "avg_value": S.rounded(F.avg("reading"), 8), "min_value": F.min("reading"), "max_value": F.max("reading"),
        "anomaly_count": F.count_if("is_anomaly"), "low_battery": F.count_if(F.col("battery") < 20),
        "critical_count": F.count_if(F.col("status") == "CRITICAL")})


def anomaly_rate(readings: DataFrame, slide: str, size: str, by) -> DataFrame:
    return windows.hop(readings, "ts", slide, size, list(by), {
        "total_events": F.count("*"), "anomaly_count": F.count_if("is_anomaly"),
        "anomaly_rate": S.rounded(F.avg(F.when(F.col("is_anomaly"), 1.0).otherwise(0.0)) * 100, 8),
        "avg_risk": S.rounded(F.avg(F.col("risk").cast("double")), 8)})


def sensor_health(readings: DataFrame) -> DataFrame:
    """Grade, inverse score and attention flag per reading."""
    return readings.withColumns({
        "health_grade": L.band_from(F.col("risk"), HEALTH_GRADES, "A"), "health_score": (100 - F.col("risk")).cast("int"),
        "needs_attention": (F.col("battery") < 20) | F.col("status").isin("CRITICAL", "DEGRADED")})


def fleet_sessions(readings: DataFrame, gap: str) -> DataFrame:
    return windows.session(readings, "ts", gap, ["device_id"], {
        "event_count": F.count("*"), "avg_value": S.rounded(F.avg("reading"), 8), "max_risk": F.max("risk"), "min_battery": F.min("battery")})


def signal_index(towers: DataFrame, slide: str, size: str) -> DataFrame:
    """Sliding signal quality index per region."""
    return windows.hop(towers, "ts", slide, size, ["region"], {
        "avg_sqi": S.rounded(F.avg(lookup(F.col("quality"), SIGNAL_INDEX, OTHER_SIGNAL)), 8), "min_rssi": F.min("rssi"),
        "poor_count": F.count_if(F.col("quality") == "POOR")})


def capacity(towers: DataFrame, size: str) -> DataFrame:
    cpu = F.avg("cpu")
    return windows.tumble(towers, "ts", size, ["region"], {
        "total_subscribers": F.sum("subscribers"), "peak_subscribers": F.max("subscribers"), "avg_cpu": S.rounded(cpu, 8),
        "capacity_status": F.when(cpu > 85, "OVERLOADED").when(cpu > 65, "HIGH").when(cpu > 40, "NORMAL").otherwise("UNDERUTILIZED")})


def outages(towers: DataFrame, gap: str) -> DataFrame:
    up = F.avg("uptime")
    return windows.session(towers, "ts", gap, ["tower_id"], {
        "event_count": F.count("*"), "avg_uptime": S.rounded(up, 8),
        "outage_risk": F.when(up < 80, "HIGH_RISK").when(up < 90, "MEDIUM_RISK").otherwise("NORMAL")})


def laps(cars: DataFrame, size: str) -> DataFrame:
    """Lap class per driver and window."""
    pits = F.count_if(F.col("pit") != "ON_TRACK")
    return windows.tumble(cars, "ts", size, ["driver"], {
        "lap": F.max("lap"), "avg_speed": S.rounded(F.avg("speed"), 8), "max_speed": F.max("speed"),
        "sectors": F.count_distinct("sector"), "tyre": F.max("tyre"),
        "lap_class": F.when((F.avg("speed") > 250) & (F.max("speed") > 320), "FLYING_LAP").when(pits > 0, "PIT_LAP")
        .when(F.min("speed") < 60, "SLOW_LAP").otherwise("NORMAL_LAP")})


def tyre_state(cars: DataFrame, slide: str, size: str) -> DataFrame:
    temp, wear = F.avg("tyre_temp"), F.avg("tyre_wear")
    return windows.hop(cars, "ts", slide, size, ["driver"], {
        "avg_temp": S.rounded(temp, 8), "temp_delta": S.rounded(F.max("tyre_temp") - F.min("tyre_temp"), 4),
        "thermal_state": F.when((temp > 115) | (wear > 80), "GRAINING").when(temp > 105, "OVERHEATING").when(temp < 75, "COLD")
        .when(wear > 60, "HIGH_WEAR").otherwise("NOMINAL"),
        "overheating_count": F.count_if(F.col("tyre_temp") > 115)})


def incidents(cars: DataFrame) -> DataFrame:
    """Incident type and severity of single readings."""
    lat, lon, speed, brake = F.abs("g_lat"), F.col("g_lon"), F.col("speed"), F.col("brake")
    kind = (F.when((lat > 5.0) & (speed > 100), "SPIN").when((lon < -5.0) & (speed > 150), "HEAVY_BRAKING_EVENT")
            .when((brake > 80) & (lat > 3.0) & (speed > 80), "LOCK-UP").when((lon < -4.0) & (brake < 20), "POSSIBLE_CONTACT")
            .when(F.col("brake_temp") > 1050, "BRAKE_OVERTEMP").otherwise("ANOMALY"))
    severity = (F.when((lat > 5.5) | (lon < -5.5), "CRITICAL").when((lat > 4.5) | (lon < -4.5), "HIGH")
                .when((lat > 3.5) | (lon < -3.5), "MEDIUM").otherwise("LOW"))
    return cars.where((lat > 3.5) | (lon < -4.0) | (F.col("brake_temp") > 1000)).withColumns(
        {"incident": kind, "severity": severity})


def pit_signals(cars: DataFrame, gap: str) -> DataFrame:
    wear = F.avg("tyre_wear")
    return windows.session(cars, "ts", gap, ["driver"], {
        "laps": (F.max("lap") - F.min("lap")).cast("int"), "avg_wear": S.rounded(wear, 8),
        "pit_events": F.count_if(F.col("pit") == "IN_PIT_BOX"),
        "advice": F.when(wear > 75, "STOP_NOW").when(wear > 55, "PREPARE_STOP").when(F.avg("tyre_temp") > 110, "THERMAL_DEGRADATION")
        .when(F.avg("fuel") < 15, "FUEL_CRITICAL").otherwise("CONTINUE")})


def proxy_score(notional: Column, digits: int = 2) -> Column:
    """Risk score 0..100 that rises within each notional tier."""
    return S.rounded(F.when(notional >= 500000, 95.0).when(notional >= 100000, 80.0 + (notional - 100000) / 400000 * 15.0)
                   .when(notional >= 10000, 50.0 + (notional - 10000) / 90000 * 30.0)
                   .when(notional >= 1000, 20.0 + (notional - 1000) / 9000 * 30.0).otherwise(notional / 1000 * 20.0), digits)


def volume_spikes(trades: DataFrame, size: str, count: int, notional: float) -> DataFrame:
    w = windows.tumble(trades, "ts", size, ["user_id"], {"trade_count": F.count("*"), "total": F.sum("notional")})
    return w.where((F.col("trade_count") >= count) & (F.col("total") >= notional))


def flash_crashes(trades: DataFrame, size: str, count: int = 3, drop: float = 0.30) -> DataFrame:
    w = windows.tumble(trades, "ts", size, ["symbol"], {"hi": F.max("price"), "lo": F.min("price"), "trade_count": F.count("*"),
                                                      "total": F.sum("notional")})
    fall = 1.0 - F.col("lo") / F.nullif(F.col("hi"), F.lit(0.0))
    return w.where((F.col("trade_count") >= count) & (fall >= drop)).withColumn("drop_pct", S.rounded(fall * 100, 8))


def watchlist(events: DataFrame, size: str) -> DataFrame:
    """Traders whose asset-weighted risk is HIGH or CRITICAL in a window; needs risk, asset, tx_rate, sanctioned."""
    w = L.weighted_avg(F.col("risk"), F.col("asset"))
    worst = L.enrich_severity(L.classify_risk(F.col("risk")), F.col("asset"), F.col("tx_rate"), F.col("sanctioned"))
    out = windows.tumble(events, "ts", size, ["trader_id"], {
        "tx_count": F.count("*"), "weighted_risk": S.rounded(w, 8), "level": L.classify_risk(w),
        "total_asset": S.rounded(F.sum("asset"), 2), "critical_count": F.count_if(worst == "CRITICAL")})
    return out.where(F.col("level").isin("HIGH", "CRITICAL"))


def spend_alerts(orders: DataFrame, reach: str, limit: float) -> DataFrame:
    """Orders that bring a user's spend over the last ``reach`` above the limit (batch)."""
    spent = over.time_range(orders, ["user_id"], "ts", reach, {"spend": F.sum("total")})
    return spent.where(F.col("spend") > limit)
