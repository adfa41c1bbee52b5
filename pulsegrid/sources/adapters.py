"""Map the star-schema test tables onto the two event domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Windows of hours and days, because the tables are sparse in time.
SIZES = {"market": 7 * 86400.0, "payments": 6 * 3600.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payments_events(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """``events`` as wide payment rows; ``source`` may be a stream of the same table."""
    e = _table(spark, sf_dir, "events") if source is None else source
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "declined")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.lit("payments").alias("domain"),
        F.concat(F.lit("merch_"), (F.col("user_id") % 10).cast("string")).alias("entity_key"),
        F.lit("events").alias("source"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts_event"),
        F.lit(None).cast("timestamp").alias("ts_ingest"),
        (F.col("event_id") % 97 == 0).alias("corrupted"),
        F.when(F.col("event_id") % 500 < 25, F.lit("fraud_pattern")).alias("scenario_label"),
        F.concat(F.lit("txn_"), F.col("event_id").cast("string")).alias("p_txn_id"),
        F.concat(F.lit("merch_"), (F.col("user_id") % 10).cast("string")).alias("p_merchant_id"),
        F.concat(F.lit("acct_"), F.col("user_id").cast("string")).alias("p_account_id_hash"),
        F.col("value").alias("p_amount"),
        F.lit("USD").alias("p_currency"),
        F.element_at(
            F.array(*[F.lit(c) for c in ("card_present", "card_not_present", "wire", "ach")]),
            (F.col("event_id") % 4 + 1).cast("int"),
        ).alias("p_channel"),
        F.lit("US").alias("p_country"),
        F.get_json_object("props", "$.k").cast("double").alias("p_processing_latency_ms"),
        status.otherwise("approved").alias("p_status"),
    )


def market_events(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """``lineitem`` as wide market ticks; (seq, event_id) keeps the row order within a day."""
    li = _table(spark, sf_dir, "lineitem") if source is None else source
    price = F.col("l_extendedprice") / F.col("l_quantity")

    def padded(col, digits):
        # Adding a power of ten fixes the width, so text order is number order.
        return (col.cast("long") + 10**digits).cast("string")

    return li.select(
        F.concat_ws(
            "-", padded(F.col("l_partkey"), 12), padded(F.col("l_suppkey"), 12),
            padded(F.col("l_quantity") * 100 + 0.5, 12), padded(F.col("l_extendedprice") * 100 + 0.5, 15),
        ).alias("event_id"),
        F.lit("market").alias("domain"),
        F.concat(F.lit("SYM-"), (F.col("l_suppkey") % 5).cast("string")).alias("entity_key"),
        F.lit("lineitem").alias("source"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_shipdate").cast("timestamp").alias("ts_event"),
        F.lit(None).cast("timestamp").alias("ts_ingest"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("corrupted"),
        F.lit(None).cast("string").alias("scenario_label"),
        F.concat(F.lit("SYM-"), (F.col("l_suppkey") % 5).cast("string")).alias("m_symbol"),
        price.alias("m_price"),
        F.col("l_quantity").alias("m_size"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("m_side"),
        (price * (1 - F.col("l_discount") / 100)).alias("m_bid"),
        (price * (1 + F.col("l_tax") / 100)).alias("m_ask"),
        (F.lit(1.0) + (F.col("l_partkey") % 100) / F.lit(10.0)).alias("m_exchange_latency_ms"),
    )


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both domains in one wide frame."""
    return payments_events(spark, sf_dir).unionByName(market_events(spark, sf_dir), allowMissingColumns=True)


def market_label() -> Column:
    """Ground truth of a ``lineitem`` row: each symbol has three labelled days in 97, whatever the size of the table."""
    symbol = F.substring("entity_key", 5, 1).cast("int")
    day = (F.datediff("ts_event", F.lit("1970-01-01")) + 53 * symbol) % 97
    return F.when(day == 0, "volatility_spike").when(day == 1, "volume_spike").when(day == 2, "regime_change")


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both domains with ground truth for training and evaluation; detection reads ``all_events``."""
    ticks = market_events(spark, sf_dir).withColumn("scenario_label", market_label())
    return payments_events(spark, sf_dir).unionByName(ticks, allowMissingColumns=True)
