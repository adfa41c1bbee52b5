"""Ensemble, rules, explanation and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.expr import clamp, rfc3339, uuid5
from pulsegrid.operators.sequence import feature_names_of

# Detector weights, rule tiers and the alert id namespace.
BASE_WEIGHTS = {
    "zscore_score": 0.15,
    "ewma_score": 0.20,
    "cusum_score": 0.20,
    "isolation_forest": 0.20,
    "autoencoder": 0.25,
}
SUPERVISED_WEIGHT = 0.35
ALERT_NAMESPACE = "7c6f1a9e-2b3d-4f5c-8a1e-9d6b4c2f0e7a"


@dataclass(frozen=True)
class Tier:
    """One rule: scores from ``min_score`` up get this severity and action."""

    min_score: float
    severity: str
    action: str


RULES = {
    "default": [Tier(0.90, "critical", "block"), Tier(0.75, "alert", "alert"), Tier(0.55, "watch", "watch")],
    "payments": [Tier(0.85, "critical", "block"), Tier(0.70, "alert", "alert"), Tier(0.50, "watch", "watch")],
    "market": [Tier(0.90, "critical", "alert"), Tier(0.75, "alert", "alert"), Tier(0.55, "watch", "watch")],
}

ALERT_KEYS = ["domain", "entity_key", "window_end", "alert_id"]
_SPAN_SALTS = 8


def ensemble(df: DataFrame, name: str = "anomaly_score") -> DataFrame:
    """Weighted average of the detector scores, blended with the supervised score if present."""
    base = sum((F.col(c) * w for c, w in BASE_WEIGHTS.items()), F.lit(0.0)) / F.lit(sum(BASE_WEIGHTS.values()))
    supervised = F.col("xgboost")
    blended = supervised * SUPERVISED_WEIGHT + base * (1.0 - SUPERVISED_WEIGHT)
    return df.withColumn(name, clamp(F.when(supervised.isNull(), base).otherwise(blended)))


def rules_from_config(config: dict) -> dict[str, list[Tier]]:
    """Rules from a parsed configuration file: ``default`` and ``domains``, each with ``thresholds``.

    Tiers keep their order; the first one reached wins.
    """
    def tiers(block: dict) -> list[Tier]:
        return [Tier(float(t["min_score"]), t["severity"], t["action"]) for t in block["thresholds"]]

    blocks = {"default": config["default"], **config.get("domains", {})}
    return {name: tiers(block) for name, block in blocks.items()}


def apply_rules(df: DataFrame, rules: dict[str, list[Tier]] | None = None) -> DataFrame:
    """Add ``severity`` and ``action`` of the first tier reached; null when none is.

    Rules are configuration: they become one ``CASE`` expression, so nothing is joined.
    """
    rules = rules or RULES

    def first_tier(tiers: list[Tier]) -> Column:
        hit = F.lit(None).cast("struct<severity:string,action:string>")
        for tier in reversed(tiers):
            found = F.struct(F.lit(tier.severity).alias("severity"), F.lit(tier.action).alias("action"))
            hit = F.when(F.col("anomaly_score") >= tier.min_score, found).otherwise(hit)
        return hit

    hit = first_tier(rules["default"])
    for domain, tiers in rules.items():
        if domain != "default":
            hit = F.when(F.col("domain") == domain, first_tier(tiers)).otherwise(hit)
    return df.withColumn("_tier", hit).withColumns(
        {"severity": F.col("_tier.severity"), "action": F.col("_tier.action")}
    ).drop("_tier")


def top_features(df: DataFrame, k: int = 3, name: str = "top_features") -> DataFrame:
    """The ``k`` inputs that moved most, largest first, ties by feature order.

    Uses signed attributions in ``shap`` where present, else the distance from the
    fit baseline (``base_mean`` / ``base_std``; 0 and 1 before any fit).
    """
    names = feature_names_of(F.col("domain"))
    mean = F.coalesce("base_mean", F.array_repeat(F.lit(0.0), 8))
    std = F.coalesce("base_std", F.array_repeat(F.lit(1.0), 8))
    zipped = F.arrays_zip(
        names.alias("feature"), F.col("vector").alias("value"), mean.alias("baseline"), std.alias("std"),
        F.coalesce("shap", F.array_repeat(F.lit(None).cast("double"), 8)).alias("shap"),
    )

    def entry(x: Column, i: Column) -> Column:
        scale = F.when(x["std"] < 1e-9, 1.0).otherwise(x["std"])
        moved = F.coalesce(x["shap"], F.abs((x["value"] - x["baseline"]) / scale))
        return F.struct(
            (-F.abs(moved)).alias("rank"), i.alias("i"), x["feature"].alias("feature"), x["value"].alias("value"),
            x["baseline"].alias("baseline"), moved.alias("contribution"),
        )

    ranked = F.slice(F.array_sort(F.transform(zipped, entry)), 1, k)
    kept = F.transform(
        ranked,
        lambda t: F.struct(
            t["feature"].alias("feature"), t["value"].alias("value"),
            t["baseline"].alias("baseline"), t["contribution"].alias("contribution"),
        ),
    )
    return df.withColumn(name, kept)


def probable_cause(df: DataFrame, name: str = "probable_cause") -> DataFrame:
    """Legible cause of an alert from its leading feature and detector scores."""
    pay = F.col("domain") == "payments"
    top = F.try_element_at("top_features", F.lit(1))["feature"]
    accounts = F.coalesce(F.when(F.col("distinct_accounts") != 0, F.col("distinct_accounts")), F.lit(999))
    concentrated = (
        (F.coalesce("decline_rate", F.lit(0.0)) > 0.15) & (accounts <= 5)
        & (F.coalesce("mean_amount", F.lit(0.0)) > 0.0)
    )
    sustained = (F.col("cusum_score") > 0.5) & (F.col("cusum_score") > F.col("zscore_score"))
    cause = (
        F.when(pay & concentrated, "fraud_pattern")
        .when(top == "latency_p99_ms", "latency_incident")
        .when(top.isin("throughput_eps", "velocity_count"), "volume_spike")
        .when(top == "error_rate", "data_corruption")
        .when(sustained, "regime_change")
        .when(pay & top.isin("log_mean_amount", "decline_rate", "zscore"), "fraud_pattern")
        .when(~pay & top.isin("realized_vol", "zscore", "spread_bps", "order_imbalance"), "volatility_spike")
        .otherwise("unknown")
    )
    return df.withColumn(name, cause)


def alert_id(domain: Column, entity_key: Column, window_end: Column) -> Column:
    """Same id for the same window, however often it is scored."""
    return uuid5(ALERT_NAMESPACE, F.concat_ws("|", domain, entity_key, rfc3339(window_end)))


def build_alerts(scored: DataFrame, now: Column, model_version: str, drift_flag: Column | None = None) -> DataFrame:
    """Nested alerts of the windows that reached a rule tier."""
    latency = (F.unix_micros(now) - F.unix_micros("window_start")) / 1000.0
    detectors = F.struct(
        F.col("zscore_score").alias("zscore"), F.col("ewma_score").alias("ewma"),
        F.col("cusum_score").alias("cusum"), "isolation_forest", "autoencoder", "xgboost",
    )
    return scored.where(F.col("severity").isNotNull()).select(
        alert_id(F.col("domain"), F.col("entity_key"), F.col("window_end")).alias("alert_id"),
        "entity_key", "domain", now.alias("ts"), "window_end", "anomaly_score", "severity", "action",
        detectors.alias("detectors"),
        F.struct("probable_cause", "top_features").alias("explanation"),
        F.lit(model_version).alias("model_version"),
        (F.lit(False) if drift_flag is None else drift_flag).alias("drift_flag"),
        F.greatest(latency, F.lit(0.0)).alias("latency_ingest_to_alert_ms"),
    )


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """Newest version of each alert by ``ts``.

    ``row_number() = 1`` lets Spark drop older versions before the shuffle, so an
    alert written very often does not pile up in one task.
    """
    w = Window.partitionBy(*ALERT_KEYS).orderBy(F.desc("ts"))
    return alerts.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def drift_spans(checks: DataFrame) -> DataFrame:
    """When a domain is in drift: rows ``domain, since, until`` from its checks (``domain, ts, drift_detected``).

    A check holds from its ``ts`` up to the next one; touching spans are one, and ``until`` is null while drift lasts. Several checks of one
    instant count as drift if any does. Checks are few: one per domain and check interval.
    """
    at = checks.groupBy("domain", "ts").agg(F.bool_or("drift_detected").alias("_flag"))
    line = Window.partitionBy("domain").orderBy("ts")
    turns = at.withColumn("_before", F.coalesce(F.lag("_flag").over(line), F.lit(False))).where("_flag <> _before")
    return turns.withColumn("until", F.lead("ts").over(line)).where("_flag").select(
        "domain", F.col("ts").alias("since"), "until")


def in_drift(rows: DataFrame, spans: DataFrame, ts: str = "ts", slot_seconds: float = 3600.0, salt: str = "alert_id",
             name: str = "drift_flag") -> DataFrame:
    """Set ``name``: whether a row's ``ts`` lies in a span of its domain.

    Rows and closed spans meet on (domain, time slot, salt), so rows are never sorted and a busy domain is spread over
    tasks; spans do not overlap, so a row meets one at most. A domain's open span is one row per domain.
    """
    def slot(c: Column) -> Column:
        return F.floor(F.unix_micros(c) / int(slot_seconds * 1_000_000)).cast("long")

    closed = spans.where("until is not null").select(
        F.col("domain").alias("_domain"), "since", "until",
        F.explode(F.sequence(slot(F.col("since")), slot(F.col("until")))).alias("_slot"),
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SPAN_SALTS - 1))))
    still = spans.where("until is null").groupBy(F.col("domain").alias("_open")).agg(F.min("since").alias("_from"))
    placed = rows.drop(name).withColumns({
        "_at": slot(F.col(ts)), "_part": F.pmod(F.xxhash64(salt), F.lit(_SPAN_SALTS)).cast("int")})
    inside = (
        (F.col("domain") == F.col("_domain")) & (F.col("_at") == F.col("_slot")) & (F.col("_part") == F.col("_salt"))
        & (F.col(ts) >= F.col("since")) & (F.col(ts) < F.col("until"))
    )
    # The open spans are one row per domain, and there are two domains.
    met = placed.join(closed, inside, "left").join(F.broadcast(still), F.col("domain") == F.col("_open"), "left")
    flag = F.col("since").isNotNull() | F.coalesce(F.col(ts) >= F.col("_from"), F.lit(False))
    return met.withColumn(name, flag).select(*[c for c in rows.columns if c != name], name)


def drift_asof(alerts: DataFrame, checks: DataFrame, slot_seconds: float = 3600.0, ts: str = "ts") -> DataFrame:
    """Set ``drift_flag`` to the domain's latest check at or before the alert; false before any."""
    return in_drift(alerts, drift_spans(checks), ts, slot_seconds)
