"""Named SQL functions: registration, banding rules and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# Thresholds and labels of the banding functions, highest or lowest band first.
RISK_BANDS = ((0.80, "CRITICAL"), (0.55, "HIGH"), (0.30, "MEDIUM"))
AMOUNT_BANDS = ((10000, "WHALE"), (2500, "LARGE"), (500, "MEDIUM"), (50, "SMALL"))
VELOCITY_BANDS = ((50, "INSTANT"), (150, "FAST"), (400, "NORMAL"))
SLA_BANDS = ((100, 0.3, "PLATINUM"), (200, 0.55, "GOLD"), (400, 0.80, "SILVER"))
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def band_from(c: Column, bands, default: str) -> Column:
    """First band whose lower bound is reached."""
    chain = None
    for bound, label in bands:
        chain = (F if chain is None else chain).when(c >= bound, F.lit(label))
    return chain.otherwise(F.lit(default))


def band_below(c: Column, bands, default: str) -> Column:
    """First band whose upper bound is not reached."""
    chain = None
    for bound, label in bands:
        chain = (F if chain is None else chain).when(c < bound, F.lit(label))
    return chain.otherwise(F.lit(default))


def classify_risk(score: Column) -> Column:
    return band_from(score, RISK_BANDS, "LOW")


def amount_band(amount: Column) -> Column:
    return band_from(amount, AMOUNT_BANDS, "MICRO")


def velocity_flag(latency_ms: Column) -> Column:
    return band_below(latency_ms, VELOCITY_BANDS, "SLOW")


def sla_tier(latency_ms: Column, score: Column) -> Column:
    chain = None
    for latency, risk, label in SLA_BANDS:
        chain = (F if chain is None else chain).when((latency_ms < latency) & (score < risk), F.lit(label))
    return chain.otherwise(F.lit("BREACHED"))


def enrich_severity(level: Column, asset_usd: Column, tx_per_minute: Column, sanctioned: Column) -> Column:
    """Move a risk level up for large assets and fast trading, down for small and slow ones."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    up = F.when(asset_usd >= 50000, 1).otherwise(0) + F.when(tx_per_minute >= 20, 1).otherwise(0)
    down = F.when((asset_usd < 100) & (tx_per_minute < 3), 1).otherwise(0)
    place = F.array_position(names, level) + up - down
    moved = F.element_at(names, F.least(F.greatest(place, F.lit(1)), F.lit(len(SEVERITIES))).cast("int"))
    return F.when(sanctioned == 1, F.lit("CRITICAL")).otherwise(moved)


def weighted_avg(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def create_sql_function(spark: SparkSession, name: str, params: str, returns: str, body: str,
                        if_not_exists: bool = False) -> None:
    """A temporary SQL function; it is inlined by Catalyst and so costs no more than its body."""
    if if_not_exists and function_exists(spark, name):
        return
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")


def function_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.functionExists(name)


def list_functions(spark: SparkSession, temporary: bool = True) -> list[str]:
    return sorted(f.name for f in spark.catalog.listFunctions() if f.isTemporary or not temporary)


def drop_function(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def register_band_functions(spark: SparkSession) -> None:
    """The banding rules above as SQL functions."""
    def bands(pairs, test: str, default: str) -> str:
        cases = " ".join(f"WHEN x {test} {b} THEN '{label}'" for b, label in pairs)
        return f"CASE {cases} ELSE '{default}' END"

    create_sql_function(spark, "classify_risk", "x DOUBLE", "STRING", bands(RISK_BANDS, ">=", "LOW"))
    create_sql_function(spark, "amount_band", "x DOUBLE", "STRING", bands(AMOUNT_BANDS, ">=", "MICRO"))
    create_sql_function(spark, "velocity_flag", "x INT", "STRING", bands(VELOCITY_BANDS, "<", "SLOW"))
    tiers = " ".join(f"WHEN ms < {m} AND risk < {r} THEN '{t}'" for m, r, t in SLA_BANDS)
    create_sql_function(spark, "sla_tier", "ms INT, risk DOUBLE", "STRING", f"CASE {tiers} ELSE 'BREACHED' END")
    create_sql_function(spark, "fmt_duration", "s BIGINT", "STRING",
                        "concat(s div 3600, 'h ', (s % 3600) div 60, 'm')")
