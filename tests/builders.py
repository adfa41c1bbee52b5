"""Small event and window frames for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd

T0 = datetime(2026, 1, 1)
FEATURE_SCHEMA = (
    "domain string, entity_key string, window_start timestamp, window_end timestamp, window_size_s double, "
    "count long, primary_metric double, zscore double"
)
TICK_SCHEMA = (
    "event_id string, domain string, entity_key string, seq long, ts_event timestamp, corrupted boolean, "
    "m_price double, m_size double, m_side string, m_bid double, m_ask double, m_exchange_latency_ms double, "
    "p_amount double, p_account_id_hash string, p_processing_latency_ms double, p_status string"
)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def tick(entity, seq, seconds, price, size=1.0, side="buy", latency=1.0, corrupted=False):
    price = float(price)
    return (f"e{seq:09d}", "market", entity, seq, at(seconds), corrupted, price, size, side, price - 1, price + 1,
            latency, None, None, None, None)


def txn(entity, seq, seconds, amount, status="approved", account="a", latency=1.0, corrupted=False):
    return (f"e{seq:09d}", "payments", entity, seq, at(seconds), corrupted, None, None, None, None, None, None,
            float(amount), account, latency, status)


def events(spark, rows):
    return spark.createDataFrame(rows, TICK_SCHEMA)


def series(spark, values, entity="e1", domain="payments", size=5.0, counts=None, zscores=None):
    """One entity's windows in time with the given primary metric."""
    rows = [
        (domain, entity, at(i * size), at((i + 1) * size), size, int(counts[i]) if counts is not None else 1,
         float(v), float(zscores[i]) if zscores is not None else 0.0)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, FEATURE_SCHEMA)


def rows_by(df, *keys) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys), ignore_index=True)
