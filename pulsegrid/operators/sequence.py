"""Per-entity sequence operators: velocity, vectors, gaps, run rules, CUSUM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.expr import squash
from pulsegrid.functions.scan import BLOCK, range_blocks, running
from pulsegrid.operators.windows import entity_order

# Feature order per domain, look-backs and thresholds.
FEATURES = {
    "market": [
        "zscore", "realized_vol", "spread_bps", "order_imbalance",
        "throughput_eps", "latency_p99_ms", "error_rate", "velocity_count",
    ],
    "payments": [
        "zscore", "log_mean_amount", "decline_rate", "distinct_accounts",
        "throughput_eps", "latency_p99_ms", "error_rate", "velocity_count",
    ],
}
VELOCITY_WINDOWS = 20
CUSUM_K = 0.5
CUSUM_H = 5.0
EXTREME_LATENCY_MS = {"market": 5_000.0, "payments": 10_000.0}

_ENTITY = ["domain", "entity_key"]

def velocity(features: DataFrame, n: int = VELOCITY_WINDOWS) -> DataFrame:
    """``velocity_count``: events in the entity's last ``n`` windows, this one included."""
    recent = F.sum("count").over(entity_order().rowsBetween(-(n - 1), 0))
    return features.withColumn("velocity_count", recent.cast("double"))


def feature_value(name: str) -> Column:
    """One model input, null-free."""
    if name == "log_mean_amount":
        return F.log1p(F.greatest(F.coalesce("mean_amount", F.lit(0.0)), F.lit(0.0)))
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def feature_names_of(domain: Column) -> Column:
    pay, market = (F.array(*[F.lit(n) for n in FEATURES[d]]) for d in ("payments", "market"))
    return F.when(domain == "market", market).otherwise(pay)


def feature_vector(features: DataFrame, name: str = "vector") -> DataFrame:
    """Fixed-order array of eight inputs per window."""
    market, pay = (F.array(*[feature_value(n) for n in FEATURES[d]]) for d in ("market", "payments"))
    return features.withColumn(name, F.when(F.col("domain") == "market", market).otherwise(pay))


def seq_gaps(events: DataFrame) -> DataFrame:
    """Events whose ``seq`` is not the successor of the entity's previous event.

    ``kind`` is ``gap`` for skipped numbers and ``reorder`` for repeats or steps back.
    Events are compared in arrival order (``ts_event``, then ``event_id``) through
    range blocks, so one entity may hold most rows.
    """
    slim = events.select(*_ENTITY, "ts_event", "event_id", "seq")
    blocked = range_blocks(slim, _ENTITY, ["ts_event", "event_id"])
    seen = running(
        blocked, _ENTITY, ["ts_event", "event_id"], {"previous_seq": ("previous", F.col("seq"))}
    )
    step = F.col("seq") - F.col("previous_seq")
    return (
        seen.withColumn("step", step).where(F.col("step") != 1).drop(BLOCK)
        .withColumn("kind", F.when(F.col("step") > 1, "gap").otherwise("reorder"))
    )


def corruption_audit(events: DataFrame) -> DataFrame:
    """Add ``reasons``: every implausible trait of an event, empty when plausible."""
    market, pay = F.col("domain") == "market", F.col("domain") == "payments"
    tests = [
        ("negative_price", market & (F.col("m_price") < 0)),
        ("crossed_book", market & (F.col("m_bid") > F.col("m_ask"))),
        ("zero_size", market & (F.col("m_size") == 0)),
        ("extreme_latency", (market & (F.col("m_exchange_latency_ms") >= EXTREME_LATENCY_MS["market"]))
         | (pay & (F.col("p_processing_latency_ms") >= EXTREME_LATENCY_MS["payments"]))),
        ("negative_amount", pay & (F.col("p_amount") < 0)),
        ("bad_currency", pay & (F.col("p_currency") == "XXX")),
        ("empty_hash", pay & (F.col("p_account_id_hash") == "")),
    ]
    return events.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests])))


def run_rules(df: DataFrame, name: str = "ewma_score") -> DataFrame:
    """Control-chart run rules over the entity's last five z-scores."""
    z = F.col("zscore")

    def beyond(limit: float, rows: int) -> Column:
        frame = entity_order().rowsBetween(-(rows - 1), 0)
        up = F.count(F.when(z > limit, 1)).over(frame)
        down = F.count(F.when(z < -limit, 1)).over(frame)
        return F.when(F.count(F.lit(1)).over(frame) == rows, F.greatest(up, down))

    score = (
        F.when(F.abs(z) > 3.0, 1.0)
        .when(beyond(2.0, 3) >= 2, 0.8)
        .when(beyond(1.0, 5) >= 4, 0.6)
        .otherwise(squash(z, 6.0) * 0.5)
    )
    return df.withColumn(name, score)


def cusum(df: DataFrame, k: float = CUSUM_K, h: float = CUSUM_H, name: str = "cusum_score") -> DataFrame:
    """Two-sided tabular CUSUM, never reset.

    The recurrence s = max(0, s + z - k) equals P - min(0, min P) for the running
    sum P of z - k, so two running windows replace the loop.
    """
    upto = entity_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = F.col("zscore")
    sums = df.withColumns({"_up": F.sum(z - k).over(upto), "_down": F.sum(z + k).over(upto)})
    ends = sums.withColumns({"_lowest": F.min("_up").over(upto), "_highest": F.max("_down").over(upto)})
    s_pos = F.col("_up") - F.least(F.lit(0.0), F.col("_lowest"))
    s_neg = F.col("_down") - F.greatest(F.lit(0.0), F.col("_highest"))
    score = F.least(F.greatest(s_pos, -s_neg) / F.lit(float(h)), F.lit(1.0))
    return ends.withColumn(name, score).drop("_up", "_down", "_lowest", "_highest")
