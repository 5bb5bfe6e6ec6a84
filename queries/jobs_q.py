"""More worked jobs on the given tables."""

from pyspark.sql import functions as F

from millrace.plans import jobs as P
from queries.flows_q import CAR, ORDER, SENSOR, TOWER, bucket, sliding
from queries.registry import query

ENGINE = f"SELECT c.*, 12000 + speed * 20 AS rpm, 90 + tyre_wear / 2 AS engine_temp, 4 - g_lat / 2 AS oil_pressure, brake * 2 AS energy FROM ({CAR}) c"
ENGINES = ENGINE.replace("{events}", "events").replace("event_id div 100", "event_id // 100")
CARS = CAR.replace("{events}", "events").replace("event_id div 100", "event_id // 100")
TOWER2 = f"""SELECT w.*, CASE WHEN event_id % 2 = 0 THEN 'MACRO' ELSE 'MICRO' END AS tower_type, rssi + 90 AS sinr, event_id % 300 AS latency, cpu / 20 AS loss, event_id % 250 AS handovers,
  CASE WHEN cpu > 90 THEN 'CRITICAL' WHEN cpu > 60 THEN 'HIGH' ELSE 'LOW' END AS alert_level FROM ({TOWER}) w"""
TOWERS2 = TOWER2.replace("{events}", "events").replace("{customer}", "customer").replace("{nation}", "nation")
SENSOR2 = f"SELECT s.*, device_id % 7 AS region FROM ({SENSOR}) s"
SENSORS2 = SENSOR2.replace("{events}", "events")
ORDER2 = f"""SELECT x.ts, symbol % 10 AS symbol, side AS ord_type, value, price, paid, l_suppkey % 4 AS error_code, concat('limit ', l_suppkey % 9) AS reason,
  CASE WHEN l_linenumber > 5 THEN 'REJECTED' ELSE status END AS status, CASE WHEN l_linenumber = 1 THEN 'X' ELSE 'W' END AS kind, paid * 0.997301 AS bid,
  CASE WHEN l_suppkey % 5 > 0 THEN price * 1.013703 END AS ask, l_suppkey * 1.0E0 AS bid_size, l_orderkey % 9 * 1.0E0 AS ask_size FROM ({ORDER}) x"""
ORDERS2 = ORDER2.replace("{lineitem}", "lineitem").replace("{orders}", "orders")


@query("flow_race_engine", f"""WITH s AS ({ENGINES}), g AS (SELECT {bucket('1 DAY')}, driver, avg(rpm) AS r, max(rpm) AS max_rpm, avg(engine_temp) AS t, max(engine_temp) AS max_engine_temp,
 avg(oil_pressure) AS o, min(oil_pressure) AS min_oil_pressure, avg(energy) AS e, sum(energy) AS te, count(*) FILTER (WHERE rpm > 14500) AS overrev_events,
 count(*) FILTER (WHERE oil_pressure < 2.5) AS oil_low_events, count(*) FILTER (WHERE engine_temp > 135) AS overheat_events, count(*) FILTER (WHERE rpm > 14000) AS c2,
 count(*) FILTER (WHERE rpm > 13500) AS c3 FROM s GROUP BY 1, 2, 3)
SELECT window_start, window_end, driver, round(r, 6) AS avg_rpm, max_rpm, round(t, 8) AS avg_engine_temp, max_engine_temp, round(o, 8) AS avg_oil_pressure, min_oil_pressure,
 round(e, 8) AS avg_energy, round(te, 4) AS total_energy, overrev_events, oil_low_events, overheat_events,
 CASE WHEN max_engine_temp > 135 OR min_oil_pressure < 2.5 OR overrev_events > 5 THEN 'CRITICAL' WHEN max_engine_temp > 125 OR min_oil_pressure < 3.0 OR c2 > 10 THEN 'HIGH'
  WHEN max_engine_temp > 115 OR c3 > 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CAST(CASE WHEN max_engine_temp > 135 OR min_oil_pressure < 2.5 THEN 100 WHEN max_engine_temp > 125 OR min_oil_pressure < 3.0 THEN 75 WHEN max_engine_temp > 115 THEN 50 ELSE 25 END AS INTEGER) AS risk_score
FROM g""")
def flow_race_engine(t):
    return P.engine_risk(t.sql(ENGINE, "events"), "1 day")


@query("flow_race_positions", f"""WITH s AS ({CARS}) SELECT {bucket('1 DAY')}, driver, max(lap) AS current_lap, round(avg(speed), 8) AS avg_speed, round(avg(fuel), 8) AS avg_fuel,
 round(avg(tyre_wear), 8) AS avg_wear, max(tyre) AS tyre, max(pit) AS pit_status, count(*) AS events_count, CASE WHEN avg(speed) > 280 THEN 'PUSHING' WHEN avg(speed) > 200 THEN 'RACING'
 WHEN count(*) FILTER (WHERE pit <> 'ON_TRACK') > 0 THEN 'PIT' WHEN avg(speed) < 100 THEN 'SLOW_ZONE' ELSE 'CRUISING' END AS position_class FROM s GROUP BY 1, 2, 3""")
def flow_race_positions(t):
    return P.race_positions(t.sql(CAR, "events"), "1 day")


@query("flow_telecom_kpi", f"""WITH s AS ({TOWERS2}) SELECT {bucket('1 DAY')}, region, tower_type, count(*) AS tower_count, round(avg(rssi), 8) AS avg_rssi, round(avg(sinr), 8) AS avg_sinr,
 round(avg(latency), 8) AS avg_latency, round(avg(loss), 8) AS avg_loss, round(avg(uptime), 8) AS avg_uptime, round(avg(cpu), 8) AS avg_cpu, CAST(sum(subscribers) AS BIGINT) AS total_subscribers,
 CAST(sum(handovers) AS BIGINT) AS total_handovers, count(*) FILTER (WHERE quality = 'POOR') AS degraded_towers, count(*) FILTER (WHERE alert_level = 'CRITICAL') AS critical_alerts FROM s GROUP BY 1, 2, 3, 4""")
def flow_telecom_kpi(t):
    return P.tower_kpi(t.sql(TOWER2, "events", "customer", "nation"), "1 day")


@query("flow_telecom_alerts", f"""WITH s AS ({TOWERS2}) SELECT 'ALT-' || event_id AS alert_id, tower_id, region, CASE WHEN alert_level = 'CRITICAL' THEN 'PACKET_LOSS_CRITICAL'
 WHEN latency > 200 THEN 'HIGH_LATENCY' ELSE 'PACKET_LOSS_HIGH' END AS alert_type, alert_level AS severity, loss AS metric_val, 3.0::DOUBLE AS threshold, ts AS alert_ts
FROM s WHERE alert_level IN ('CRITICAL', 'HIGH')""")
def flow_telecom_alerts(t):
    return P.tower_alerts(t.sql(TOWER2, "events", "customer", "nation"))


@query("flow_telecom_handover", f"""WITH s AS ({TOWERS2}) SELECT window_start, window_end, tower_id, region, CAST(sum(handovers) AS BIGINT) AS total_handovers, round(avg(handovers), 8) AS avg_handovers,
 CASE WHEN sum(handovers) > 500 THEN 'ANOMALY' WHEN sum(handovers) > 300 THEN 'ELEVATED' ELSE 'NORMAL' END AS anomaly_flag FROM {sliding('s', 'ts', 12, 72)} GROUP BY 1, 2, 3, 4""")
def flow_telecom_handover(t):
    return P.handover_anomalies(t.sql(TOWER2, "events", "customer", "nation"), "12 hours", "72 hours")


@query("flow_sensor_leaderboard", f"""WITH s AS ({SENSORS2}) SELECT window_start, window_end, region, count(DISTINCT device_id) AS device_count, count(*) AS total_events, round(avg(risk), 8) AS avg_risk,
 round(avg(CASE WHEN status = 'CRITICAL' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS critical_pct, round(avg(CASE WHEN battery < 20 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS low_battery_pct
FROM {sliding('s', 'ts', 2, 12)} GROUP BY 1, 2, 3""")
def flow_sensor_leaderboard(t):
    return P.leaderboard(t.sql(SENSOR2, "events"), "2 hours", "12 hours")


@query("flow_sensor_alerts", f"""WITH s AS ({SENSORS2}) SELECT 'ALT-' || event_id AS alert_id, device_id, region, reading, risk, CASE WHEN reading > 95 OR risk > 90 THEN 'CRITICAL'
 WHEN reading > 85 OR risk > 70 OR status = 'CRITICAL' THEN 'HIGH' ELSE 'MEDIUM' END AS alert_level FROM s WHERE reading > 80 OR status = 'CRITICAL' OR risk > 70""")
def flow_sensor_alerts(t):
    return P.sensor_alerts(t.sql(SENSOR2, "events")).select("alert_id", "device_id", "region", "reading", "risk", "alert_level")


@query("flow_order_rejects", f"""WITH x AS ({ORDERS2}) SELECT {bucket('7 DAY')}, symbol, ord_type, error_code, arg_min(reason, CAST(epoch_us(ts) AS VARCHAR) || reason) AS reject_reason,
 count(*) AS reject_count, round(sum(value), 4) AS total_blocked FROM x WHERE status = 'REJECTED' GROUP BY 1, 2, 3, 4, 5""")
def flow_order_rejects(t):
    return P.order_rejects(t.sql(ORDER2, "lineitem", "orders"), "7 days")


@query("flow_bbo", f"""WITH x AS (SELECT *, ask - bid AS spread, (ask + bid) / 2 AS mid FROM ({ORDERS2}) WHERE kind = 'W' AND bid IS NOT NULL AND ask IS NOT NULL)
SELECT {bucket('30 DAY')}, symbol, round(avg(bid), 7) AS avg_bid, round(avg(ask), 7) AS avg_ask, round(avg(spread), 7) AS avg_spread, round(avg(mid), 7) AS avg_mid, round(avg(bid_size), 7) AS avg_bid_size,
 round(avg(ask_size), 7) AS avg_ask_size, round(min(spread), 7) AS min_spread, round(max(spread), 7) AS max_spread, count(*) AS snapshot_count FROM x GROUP BY 1, 2, 3""")
def flow_bbo(t):
    return P.best_quotes(t.sql(ORDER2, "lineitem", "orders"), "30 days")
