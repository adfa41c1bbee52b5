"""Tumbling-window features per (domain, entity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.quantile import exact_quantiles
from pulsegrid.functions.scratch import materialize

# Window seconds per domain, seconds per year, and the price
# magnitude under which a spread is not formed.
DEFAULT_SIZES = {"market": 2.0, "payments": 5.0}
SECONDS_PER_YEAR = 365.0 * 24.0 * 3600.0
EPSILON = 2.220446049250313e-16

# The most selective number first: sorts then rarely compare text.
WINDOW_KEYS = ["window_start", "entity_key", "domain"]
POSITION = ["ts_event", "seq"]
TICK_ORDER = [*POSITION, "event_id"]
SLICES_PER_WINDOW = 64
_SALTS = 16
_FINER = 4  # least partitions of the tick order per shuffle partition
_TICKS_PER_PARTITION = 1_000_000  # ticks of the order that a partition holds on average, at most

FEATURE_COLUMNS = [
    "entity_key", "domain", "window_start", "window_end", "window_size_s", "count", "throughput_eps",
    "latency_p50_ms", "latency_p99_ms", "error_rate", "vwap", "spread_bps", "realized_vol", "order_imbalance",
    "mean_amount", "sum_amount", "decline_rate", "distinct_accounts", "primary_metric",
]


def size_of(sizes: dict[str, float]) -> Column:
    """Window length in seconds of the row's domain."""
    expr = F.lit(None).cast("double")
    for domain, seconds in sizes.items():
        expr = F.when(F.col("domain") == domain, F.lit(float(seconds))).otherwise(expr)
    return expr


def assign_windows(events: DataFrame, sizes: dict[str, float] | None = None, origin: str = "epoch") -> DataFrame:
    """Add ``window_start`` / ``window_end`` / ``window_size_s``.

    ``origin='epoch'`` aligns windows to 1970; ``'entity'`` to each entity's first
    event. The first-event table has a row per entity; it is replicated over a
    salt so the join also splits an entity that owns most rows.
    """
    sizes = sizes or DEFAULT_SIZES
    size = F.col("window_size_s")
    sized = events.withColumn("window_size_s", size_of(sizes))
    if origin == "epoch":
        start = F.lit(0)
    elif origin == "entity":
        first = events.groupBy("domain", "entity_key").agg(F.unix_micros(F.min("ts_event")).alias("_first"))
        first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = sized.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(_SALTS)).cast("int"))
        sized = salted.join(first, ["domain", "entity_key", "_salt"]).drop("_salt")
        start = F.col("_first")
    else:
        raise ValueError("origin must be 'epoch' or 'entity'")
    micros = (size * 1_000_000).cast("long")
    offset = F.floor((F.unix_micros("ts_event") - start) / micros).cast("long") * micros + start
    return sized.withColumn("window_start", F.timestamp_micros(offset)).withColumn(
        "window_end", F.timestamp_micros(offset + micros)
    ).drop("_first")


def latency_quantiles_by_window(assigned: DataFrame) -> DataFrame:
    """Nearest-rank p50 / p99 of the domain's latency per window."""
    latency = F.coalesce("m_exchange_latency_ms", "p_processing_latency_ms")
    return exact_quantiles(
        assigned.select(*WINDOW_KEYS, latency.alias("_latency")),
        WINDOW_KEYS, "_latency", {"latency_p50_ms": 0.50, "latency_p99_ms": 0.99}, "nearest",
    )


def market_windows(assigned: DataFrame, split: str = "time") -> DataFrame:
    """VWAP, spread, realised volatility and order imbalance per window of ticks.

    Log returns need each entity's previous tick, but no task may hold a busy
    entity or window whole. Ticks are cut into *runs* in tick order, returns are
    formed inside a run, and the returns that cross runs, then windows, are added
    on the aggregated rows. ``split='time'`` cuts a window into slices of its
    length; ``'range'`` range-partitions on the full tick order, for sources that
    stamp very many ticks of one entity with the same instant.
    """
    price, size = F.col("m_price"), F.col("m_size")
    keys = ["window_start", "entity_key"]
    market = assigned.where(F.col("domain") == "market")
    spread = F.when(F.abs(price) > EPSILON, (F.col("m_ask") - F.col("m_bid")) / price * 1e4).otherwise(0.0)
    # Sums need no order: they are formed before the shuffle, and only the price goes into the order.
    sums = market.groupBy(*keys).agg(
        F.max("window_size_s").alias("window_size_s"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("corrupted").cast("long")).alias("_errors"),
        F.sum(price * size).alias("_pq"),
        F.sum(size).alias("_q"),
        F.sum(spread).alias("_spread"),
        F.sum(F.when(F.col("m_side") == "buy", size).otherwise(0.0)).alias("_buy"),
        F.sum(F.when(F.col("m_side") == "sell", size).otherwise(0.0)).alias("_sell"),
    )
    if split == "time":
        slice_us = (F.col("window_size_s") * (1_000_000 / SLICES_PER_WINDOW)).cast("long")
        run = F.floor(F.unix_micros("ts_event") / slice_us).cast("long")
        per_run = _runs_by_position(market.select(run.alias("_run"), *keys, *TICK_ORDER, "m_price"), keys)
    elif split == "range":
        ranged = market.select(*keys, *TICK_ORDER, "m_price").repartitionByRange("entity_key", *TICK_ORDER)
        runs = ranged.withColumns({"_run": F.spark_partition_id().cast("long"), "_open": F.lit(False)})
        pairs = _with_neighbours(runs, ["_run", *keys], TICK_ORDER)
        per_run = pairs.groupBy("_run", *keys).agg(*_pair_sums(~F.col("_open_before"), ~F.col("_open_after")))
    else:
        raise ValueError("split must be 'time' or 'range'")
    # Returns between the runs of a window; a window has few runs.
    run_order = Window.partitionBy(*keys).orderBy("_run")
    edges = per_run.withColumns({
        "_edge": _log_return(F.col("_first_price"), F.lag("_last_price").over(run_order)),
        "_is_first": F.lag(F.lit(1)).over(run_order).isNull(),
        "_is_last": F.lead(F.lit(1)).over(run_order).isNull(),
    })
    # The sums of a window are one more row beside its runs: unlike a join, that keeps windows with a null key.
    per_window = edges.unionByName(sums, allowMissingColumns=True).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in sums.columns if c not in keys],
        (F.coalesce(F.sum("_ssq"), F.lit(0.0)) + F.coalesce(F.sum(F.col("_edge") * F.col("_edge")), F.lit(0.0)))
        .alias("_ssq"),
        F.max(F.when(F.col("_is_first"), F.col("_first_price"))).alias("_first_price"),
        F.max(F.when(F.col("_is_last"), F.col("_last_price"))).alias("_last_price"),
    )
    # Return between windows: one row per window, so an entity's rows are bounded
    # by elapsed time over window length, however many ticks it has.
    edge = _log_return(
        F.col("_first_price"),
        F.lag("_last_price").over(Window.partitionBy("entity_key").orderBy("window_start")),
    )
    volume, imbalance = F.col("_q"), F.col("_buy") + F.col("_sell")
    return per_window.withColumn("_edge", edge).select(
        *keys, F.lit("market").alias("domain"), _window_end(), "window_size_s",
        F.col("_n").alias("count"),
        (F.col("_errors") / F.col("_n")).alias("error_rate"),
        F.when(volume > 0, F.try_divide(F.col("_pq"), volume)).otherwise(F.col("_last_price")).alias("vwap"),
        (F.col("_spread") / F.col("_n")).alias("spread_bps"),
        F.sqrt(
            (F.col("_ssq") + F.coalesce(F.col("_edge") * F.col("_edge"), F.lit(0.0)))
            * (F.lit(SECONDS_PER_YEAR) / F.col("window_size_s"))
        ).alias("realized_vol"),
        F.when(imbalance > 0, F.try_divide(F.col("_buy") - F.col("_sell"), imbalance)).otherwise(0.0)
        .alias("order_imbalance"),
    )


def _runs_by_position(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Squared returns, first and last price of every run, with event ids for the few ticks that need them.

    An id only decides between ticks of one entity with the same instant and ``seq``, and only if their prices differ: such
    a position is *open*. All other pairs of neighbours are known from the order of positions, so the ticks are shuffled
    and sorted without ids, which are most of their bytes. Ticks of open positions are read again with their ids and put
    in order between the positions beside them, which were kept for that. Sums are the same as over the full order.
    """
    run, price = ["_run", *keys], F.col("m_price")
    # The position is part of the key: a frame of peers would be built anew at every tick.
    tied = Window.partitionBy(*run, *POSITION)
    prices, ticks = F.count(price).over(tied), F.count(F.lit(1)).over(tied)
    differ = (F.min(price).over(tied) != F.max(price).over(tied)) | ((prices > 0) & (prices < ticks))
    gathered = _gathered(runs.select(*run, *POSITION, "m_price"), run)
    placed = _with_neighbours(gathered.withColumn("_open", F.coalesce(differ, F.lit(False))), run, POSITION)
    beside = F.col("_open_before") | F.col("_open_after")
    mark = F.when(F.col("_open"), "open").when(beside, "beside")
    known = placed.groupBy(
        *run, mark.alias("_mark"), *[F.when(mark.isNotNull(), F.col(c)).alias(c) for c in POSITION]
    ).agg(
        *_pair_sums(~F.col("_open") & ~F.col("_open_before"), ~F.col("_open") & ~F.col("_open_after")),
        F.max(price).alias("m_price"),
    )
    # One row per run and up to three per open position: stored, as both steps below read it.
    known = materialize(known)
    place = [*run, *POSITION]
    at = known.where("_mark = 'open'").select(*[F.col(c).alias(f"_at_{c}") for c in place])
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in place]
    again = runs.join(at, same, "left_semi").withColumn("_open", F.lit(True)).unionByName(
        known.where("_mark = 'beside'").select(*place, "m_price", F.lit(False).alias("_open")), allowMissingColumns=True)
    settled = _with_neighbours(again, run, TICK_ORDER).groupBy(*run).agg(
        *_pair_sums(F.col("_open") | F.col("_open_before"), F.col("_open") | F.col("_open_after")))
    return known.select(*settled.columns).unionByName(settled).groupBy(*run).agg(
        F.sum("_ssq").alias("_ssq"), F.max("_first_price").alias("_first_price"), F.max("_last_price").alias("_last_price"))


def _gathered(ticks: DataFrame, run: list[str]) -> DataFrame:
    """Ticks of a run side by side in one task, so that sorting them by text and position touches memory that is close.

    The sort by one number is a radix sort. It holds the rows a second time while the windows sort them, so partitions are
    finer than the session's, and there are more of them the more ticks there are: a task then holds the same at any size
    and need not spill. The count that takes reads no column of a Parquet source. Coalesced partitions would spill.
    """
    least = _FINER * int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(least, -(-ticks.count() // _TICKS_PER_PARTITION))
    return ticks.repartition(width, *run).sortWithinPartitions(run[0])


def _with_neighbours(ticks: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    """Price and ``_open`` of the tick before and after inside a run."""
    w = Window.partitionBy(*run).orderBy(*order)
    return ticks.withColumns({
        "_before": F.lag("m_price").over(w), "_after": F.lead("m_price").over(w),
        "_open_before": F.lag("_open", 1, False).over(w), "_open_after": F.lead("_open", 1, False).over(w),
    })


def _pair_sums(before: Column, after: Column) -> list[Column]:
    """What a run adds up, over the neighbours before and after that are asked for.

    A price is never null, so a missing neighbour marks the ends of a run.
    """
    price = F.col("m_price")
    within = _log_return(price, F.col("_before"))
    return [
        F.sum(F.when(before, within * within)).alias("_ssq"),
        F.max(F.when(before & F.col("_before").isNull(), price)).alias("_first_price"),
        F.max(F.when(after & F.col("_after").isNull(), price)).alias("_last_price"),
    ]


def _window_end() -> Column:
    micros = (F.col("window_size_s") * 1_000_000).cast("long")
    return F.timestamp_micros(F.unix_micros("window_start") + micros).alias("window_end")


def _log_return(price: Column, previous: Column) -> Column:
    return F.when((previous > 0) & (price > 0), F.log(price / previous))


def payment_windows(assigned: DataFrame) -> DataFrame:
    """Amounts, decline rate and distinct accounts per window of transactions.

    The distinct count is the only distinct aggregate, so Spark first groups by
    (window, account): a busy merchant is split before it is counted.
    """
    keys, status = ["window_start", "entity_key"], F.col("p_status")
    failed = status.isin("declined", "error") | F.col("corrupted")
    return (
        assigned.where(F.col("domain") == "payments")
        .groupBy(*keys)
        .agg(
            F.max("window_size_s").alias("window_size_s"),
            F.count(F.lit(1)).alias("count"),
            F.sum(failed.cast("long")).alias("_errors"),
            F.sum("p_amount").alias("sum_amount"),
            F.sum((status == "declined").cast("long")).alias("_declines"),
            F.count_distinct("p_account_id_hash").alias("distinct_accounts"),
        )
        .select(
            *keys, F.lit("payments").alias("domain"), _window_end(), "window_size_s", "count",
            (F.col("_errors") / F.col("count")).alias("error_rate"),
            (F.col("sum_amount") / F.col("count")).alias("mean_amount"),
            "sum_amount",
            (F.col("_declines") / F.col("count")).alias("decline_rate"),
            "distinct_accounts",
        )
    )


def window_features(
    events: DataFrame, sizes: dict[str, float] | None = None, origin: str = "epoch",
    domains: tuple[str, ...] = ("market", "payments"), split: str = "time",
) -> DataFrame:
    """Window features of both domains; columns of the other domain are null."""
    assigned = assign_windows(events, sizes, origin)
    parts = []
    if "market" in domains:
        parts.append(market_windows(assigned, split))
    if "payments" in domains:
        parts.append(payment_windows(assigned))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    types = {"vwap": "double", "spread_bps": "double", "realized_vol": "double", "order_imbalance": "double",
             "mean_amount": "double", "sum_amount": "double", "decline_rate": "double", "distinct_accounts": "long"}
    for name, kind in types.items():
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast(kind))
    latencies = latency_quantiles_by_window(assigned.where(F.col("domain").isin(*domains)))
    return (
        both.join(latencies, WINDOW_KEYS, "left")
        .withColumns({
            "latency_p50_ms": F.coalesce("latency_p50_ms", F.lit(0.0)),
            "latency_p99_ms": F.coalesce("latency_p99_ms", F.lit(0.0)),
            "throughput_eps": F.col("count") / F.col("window_size_s"),
            "primary_metric": F.when(F.col("domain") == "market", F.col("realized_vol"))
            .otherwise(F.col("mean_amount")),
        })
        .select(*FEATURE_COLUMNS)
    )


def entity_order() -> Window:
    """Window over one entity's feature rows in time.

    Safe for hot entities: features hold one row per window, so a partition has at
    most (elapsed time / window length) rows no matter how many events they sum up.
    """
    return Window.partitionBy("entity_key", "domain").orderBy("window_end")


def with_sequence(features: DataFrame, name: str = "window_no") -> DataFrame:
    """Number each entity's windows 1, 2, ... by ``window_end``."""
    return features.withColumn(name, F.row_number().over(entity_order()).cast("long"))


def emit_lag(features: DataFrame, now: Column) -> DataFrame:
    """Milliseconds between a window's end and the moment it is emitted, never negative."""
    lag_ms = (F.unix_micros(now) - F.unix_micros("window_end")) / 1000.0
    return features.withColumn("emit_lag_ms", F.greatest(lag_ms, F.lit(0.0)))
