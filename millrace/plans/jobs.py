"""More worked jobs: engine risk and race positions, tower indicators, sensor boards and alerts, order rejects, best quotes.

Thresholds and labels in the tables below are fixed values of the worked pipelines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import scalar as S
from millrace.operators import windows

#: Level, hottest engine above, lowest oil pressure below (None: not asked), revolutions above and how many such readings more than.
ENGINE_RISK = (
    ("CRITICAL", 135, 2.5, 14500, 5),
    ("HIGH", 125, 3.0, 14000, 10),
    ("MEDIUM", 115, None, 13500, 20),
)
ENGINE_SCORE = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 50}
LOW_ENGINE_SCORE = 25
#: Mean speed above.
PUSHING, RACING, SLOW_ZONE = 280, 200, 100
#: Handovers in a window above.
HANDOVERS = ((500, "ANOMALY"), (300, "ELEVATED"))
HIGH_LATENCY_MS, LOSS_THRESHOLD = 200, 3.0
#: A reading is an alert above these; and its level by reading or risk above.
ALERT_READING, ALERT_RISK = 80, 70
ALERT_LEVELS = (("CRITICAL", 95, 90), ("HIGH", 85, 70))
LOW_BATTERY = 20


def chain(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """First label whose condition holds."""
    first, *rest = cases
    return reduce(lambda made, case: made.when(*case), rest, F.when(*first)).otherwise(otherwise)


def engine_risk(cars: DataFrame, size: str, by=("driver",)) -> DataFrame:
    """Means and extremes of the power unit per window, counts of dangerous readings, risk level and score."""
    hottest, thinnest = F.max("engine_temp"), F.min("oil_pressure")

    def physical(hot, thin):
        return hottest > hot if thin is None else (hottest > hot) | (thinnest < thin)

    levels = [(physical(hot, thin) | (F.count_if(F.col("rpm") > revs) > times), name) for name, hot, thin, revs, times in ENGINE_RISK]
    scores = [(physical(hot, thin), ENGINE_SCORE[name]) for name, hot, thin, _, _ in ENGINE_RISK]
    _, hot, thin, revs, _ = ENGINE_RISK[0]
    return windows.tumble(cars, "ts", size, list(by), {
        "avg_rpm": S.rounded(F.avg("rpm"), 6), "max_rpm": F.max("rpm"), "avg_engine_temp": S.rounded(F.avg("engine_temp"), 8),
        "max_engine_temp": hottest, "avg_oil_pressure": S.rounded(F.avg("oil_pressure"), 8), "min_oil_pressure": thinnest,
        "avg_energy": S.rounded(F.avg("energy"), 8), "total_energy": S.rounded(F.sum("energy"), 4),
        "overrev_events": F.count_if(F.col("rpm") > revs), "oil_low_events": F.count_if(F.col("oil_pressure") < thin),
        "overheat_events": F.count_if(F.col("engine_temp") > hot),
        "risk_level": chain(levels, "LOW"), "risk_score": chain(scores, LOW_ENGINE_SCORE).cast("int")})


def race_positions(cars: DataFrame, size: str, by=("driver",)) -> DataFrame:
    """Snapshot of each car per window; texts are the greatest of the window."""
    speed = F.avg("speed")
    pitted = F.max(F.when(F.col("pit") != "ON_TRACK", 1).otherwise(0)) == 1
    return windows.tumble(cars, "ts", size, list(by), {
        "current_lap": F.max("lap"), "avg_speed": S.rounded(speed, 8), "avg_fuel": S.rounded(F.avg("fuel"), 8), "avg_wear": S.rounded(F.avg("tyre_wear"), 8),
        "tyre": F.max("tyre"), "pit_status": F.max("pit"), "events_count": F.count("*"),
        "position_class": chain([(speed > PUSHING, "PUSHING"), (speed > RACING, "RACING"), (pitted, "PIT"), (speed < SLOW_ZONE, "SLOW_ZONE")], "CRUISING")})


def tower_kpi(towers: DataFrame, size: str, by=("region", "tower_type")) -> DataFrame:
    return windows.tumble(towers, "ts", size, list(by), {
        "tower_count": F.count("*"), **{f"avg_{c}": S.rounded(F.avg(c), 8) for c in ("rssi", "sinr", "latency", "loss", "uptime", "cpu")},
        "total_subscribers": F.sum("subscribers"), "total_handovers": F.sum("handovers"),
        "degraded_towers": F.count_if(F.col("quality") == "POOR"), "critical_alerts": F.count_if(F.col("alert_level") == "CRITICAL")})


def tower_alerts(towers: DataFrame) -> DataFrame:
    """One alert for each reading of a grave level."""
    kind = chain([(F.col("alert_level") == "CRITICAL", "PACKET_LOSS_CRITICAL"), (F.col("latency") > HIGH_LATENCY_MS, "HIGH_LATENCY")], "PACKET_LOSS_HIGH")
    return towers.where(F.col("alert_level").isin("CRITICAL", "HIGH")).select(
        F.concat(F.lit("ALT-"), F.col("event_id").cast("string")).alias("alert_id"), "tower_id", "region", kind.alias("alert_type"),
        F.col("alert_level").alias("severity"), F.col("loss").alias("metric_val"), F.lit(LOSS_THRESHOLD).alias("threshold"), F.col("ts").alias("alert_ts"))


def handover_anomalies(towers: DataFrame, slide: str, size: str, by=("tower_id", "region")) -> DataFrame:
    total = F.sum("handovers")
    return windows.hop(towers, "ts", slide, size, list(by), {
        "total_handovers": total, "avg_handovers": S.rounded(F.avg("handovers"), 8),
        "anomaly_flag": chain([(total > least, name) for least, name in HANDOVERS], "NORMAL")})


def leaderboard(readings: DataFrame, slide: str, size: str, by=("region",)) -> DataFrame:
    """Sliding health of each region, shares in percent."""
    percent = lambda condition: S.rounded(F.avg(F.when(condition, 100.0).otherwise(0.0)), 8)
    return windows.hop(readings, "ts", slide, size, list(by), {
        "device_count": F.count_distinct("device_id"), "total_events": F.count("*"), "avg_risk": S.rounded(F.avg(F.col("risk").cast("double")), 8),
        "critical_pct": percent(F.col("status") == "CRITICAL"), "low_battery_pct": percent(F.col("battery") < LOW_BATTERY)})


def sensor_alerts(readings: DataFrame) -> DataFrame:
    grave = F.col("status") == "CRITICAL"
    levels = [((F.col("reading") > reading) | (F.col("risk") > risk), name) for name, reading, risk in ALERT_LEVELS]
    return readings.where((F.col("reading") > ALERT_READING) | grave | (F.col("risk") > ALERT_RISK)).withColumns({
        "alert_id": F.concat(F.lit("ALT-"), F.col("event_id").cast("string")), "alert_level": chain([*levels, (grave, "HIGH")], "MEDIUM")})


def order_rejects(orders: DataFrame, size: str, by=("symbol", "ord_type", "error_code")) -> DataFrame:
    """Rejected orders per window and error; the reason is that of the earliest one (ties: least text)."""
    return windows.tumble(orders.where(F.col("status") == "REJECTED"), "ts", size, list(by), {
        "reject_reason": F.min_by("reason", F.struct("ts", "reason")), "reject_count": F.count("*"), "total_blocked": S.rounded(F.sum("value"), 4)})


def best_quotes(quotes: DataFrame, size: str, by=("symbol",)) -> DataFrame:
    """Best bid and offer of whole snapshots per window."""
    full = quotes.where((F.col("kind") == "W") & F.col("bid").isNotNull() & F.col("ask").isNotNull()).withColumns(
        {"spread": F.col("ask") - F.col("bid"), "mid": (F.col("ask") + F.col("bid")) / 2})
    return windows.tumble(full, "ts", size, list(by), {
        **{f"avg_{c}": S.rounded(F.avg(c), 7) for c in ("bid", "ask", "spread", "mid", "bid_size", "ask_size")},
        "min_spread": S.rounded(F.min("spread"), 7), "max_spread": S.rounded(F.max("spread"), 7), "snapshot_count": F.count("*")})
