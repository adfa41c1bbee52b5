"""Event shapes and their checks, as Spark schemas and column predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The wire contract's names, enums and limits.
DOMAINS = ("market", "payments")
SIDES = ("buy", "sell")
CHANNELS = ("card_present", "card_not_present", "wire", "ach")
STATUSES = ("approved", "declined", "error")
SEVERITIES = ("watch", "alert", "critical")
ACTIONS = ("watch", "alert", "block")
CAUSES = (
    "volatility_spike", "latency_incident", "fraud_pattern",
    "data_corruption", "regime_change", "volume_spike", "unknown",
)
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

MARKET_PAYLOAD = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("size", T.DoubleType()),
    T.StructField("side", T.StringType()),
    T.StructField("bid", T.DoubleType()),
    T.StructField("ask", T.DoubleType()),
    T.StructField("exchange_latency_ms", T.DoubleType()),
])
PAYMENTS_PAYLOAD = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("account_id_hash", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("processing_latency_ms", T.DoubleType()),
    T.StructField("status", T.StringType()),
])
_PAYLOAD_UNION = T.StructType(MARKET_PAYLOAD.fields + PAYMENTS_PAYLOAD.fields)
ENVELOPE = [
    T.StructField("event_id", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("entity_key", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts_event", T.TimestampType()),
    T.StructField("ts_ingest", T.TimestampType()),
    T.StructField("corrupted", T.BooleanType()),
    T.StructField("scenario_label", T.StringType()),
]
RAW_EVENT = T.StructType([*ENVELOPE, T.StructField("payload", _PAYLOAD_UNION)])
TOP_FEATURES = T.ArrayType(T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("contribution", T.DoubleType()),
]))
DETECTORS = ("zscore", "ewma", "cusum", "isolation_forest", "autoencoder", "xgboost")


@dataclass(frozen=True)
class Check:
    """One contract rule: ``bad`` is true where the row breaks it."""

    path: str
    rule: str
    bad: Column


@dataclass
class Contract:
    """Column-wise contract; each method adds checks and returns the contract."""

    checks: list[Check] = field(default_factory=list)

    def _add(self, path: str, rule: str, bad: Column, when: Column | None) -> "Contract":
        self.checks.append(Check(path, rule, bad if when is None else (when & bad)))
        return self

    def required(self, *paths: str, when: Column | None = None) -> "Contract":
        for p in paths:
            self._add(p, "required", F.col(p).isNull(), when)
        return self

    def enum(self, path: str, allowed, when: Column | None = None) -> "Contract":
        return self._add(path, "enum", F.col(path).isNotNull() & ~F.col(path).isin(*allowed), when)

    def pattern(self, path: str, regex: str, when: Column | None = None) -> "Contract":
        return self._add(path, "format", F.col(path).isNotNull() & ~F.col(path).rlike(regex), when)

    def between(self, path: str, low=None, high=None, when: Column | None = None) -> "Contract":
        if low is not None:
            self._add(path, "minimum", F.col(path) < low, when)
        if high is not None:
            self._add(path, "maximum", F.col(path) > high, when)
        return self

    def length(self, path: str, low=None, high=None, when: Column | None = None) -> "Contract":
        if low is not None:
            self._add(path, "minLength", F.length(path) < low, when)
        if high is not None:
            self._add(path, "maxLength", F.length(path) > high, when)
        return self


def raw_event_contract(ids_are_uuids: bool = True) -> Contract:
    """Contract of a nested raw event (columns of ``RAW_EVENT``)."""
    c = Contract().required(
        "event_id", "domain", "entity_key", "source", "seq", "ts_event", "corrupted"
    )
    c.enum("domain", DOMAINS).length("entity_key", low=1).between("seq", low=0)
    market = F.col("domain") == "market"
    pay = F.col("domain") == "payments"
    p = "payload."
    c.required(*[p + f.name for f in MARKET_PAYLOAD], when=market)
    c.enum(p + "side", SIDES, when=market)
    c.required(*[p + f.name for f in PAYMENTS_PAYLOAD], when=pay)
    c.length(p + "currency", 3, 3, when=pay).length(p + "country", 2, 2, when=pay)
    c.enum(p + "channel", CHANNELS, when=pay).enum(p + "status", STATUSES, when=pay)
    if ids_are_uuids:
        c.pattern("event_id", UUID_PATTERN).pattern(p + "txn_id", UUID_PATTERN, when=pay)
    return c


def feature_contract() -> Contract:
    c = Contract().required(
        "entity_key", "domain", "window_start", "window_end", "window_size_s", "count", "throughput_eps",
        "latency_p50_ms", "latency_p99_ms", "error_rate", "ewma_mean", "ewma_var", "zscore", "primary_metric",
    )
    return c.enum("domain", DOMAINS).between("count", low=0).between("error_rate", 0, 1)


def alert_contract() -> Contract:
    c = Contract().required(
        "alert_id", "entity_key", "domain", "ts", "window_end", "anomaly_score", "severity", "action",
        "detectors", "explanation", "model_version", "drift_flag", "latency_ingest_to_alert_ms",
        *[f"detectors.{d}" for d in DETECTORS if d != "xgboost"],
        "explanation.probable_cause", "explanation.top_features",
    )
    c.pattern("alert_id", UUID_PATTERN).enum("domain", DOMAINS).between("anomaly_score", 0, 1)
    c.enum("severity", SEVERITIES).enum("action", ACTIONS).enum("explanation.probable_cause", CAUSES)
    def lacks(name: str) -> Column:
        return F.exists("explanation.top_features", lambda t: t[name].isNull())

    for name in ("feature", "value", "baseline", "contribution"):
        c._add(f"explanation.top_features.{name}", "required", lacks(name), None)
    return c


def metrics_contract() -> Contract:
    return Contract().required(
        "model_id", "model_version", "ts", "eval_window_s", "psi_by_feature", "ks_stat_by_feature",
        "drift_detected", "events_scored", "throughput_eps", "p50_inference_ms", "p99_inference_ms",
    ).between("events_scored", low=0)


def validate_contract(df: DataFrame, contract: Contract, keep: list[str]) -> DataFrame:
    """Explode each row's broken rules to ``(keep..., path, rule)``; valid rows vanish."""
    found = F.array(*[
        F.when(F.coalesce(c.bad, F.lit(False)), F.struct(F.lit(c.path).alias("path"), F.lit(c.rule).alias("rule")))
        for c in contract.checks
    ])
    return df.select(*keep, F.explode(F.array_compact(found)).alias("v")).select(*keep, "v.path", "v.rule")
