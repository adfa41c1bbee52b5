"""Labels, confusion, episodes and reports against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scan import BLOCK, numbered, running
from pulsegrid.operators.windows import DEFAULT_SIZES, WINDOW_KEYS, size_of

CV_FOLDS = 3
_SALTS = 16


def _label_hits(windows: DataFrame, events: DataFrame, slots: dict[str, float] | None) -> DataFrame:
    """Windows that hold labelled events, with the first label of each window.

    Windows and events meet on (entity, time slot). Slots of one window length
    (``slots``, seconds per domain) are cheapest, as a window then touches at most
    two; any other length gives the same labels. Events are cut down to one row per instant first.
    Labels are rare, so windows without any in their buckets leave early; the rest
    carry a salt, and a busy entity is spread over tasks.
    """
    labelled = (
        events.where(F.coalesce("scenario_label", F.lit("")) != "")
        .groupBy("domain", "entity_key", "ts_event")
        .agg(F.min(F.struct("event_id", "scenario_label")).alias("_e"))
        .withColumn("_salt", F.pmod(F.xxhash64("ts_event"), F.lit(_SALTS)).cast("int"))
    )
    size_us = (size_of(slots or DEFAULT_SIZES) * 1_000_000).cast("long")
    start, end = F.unix_micros("window_start"), F.unix_micros("window_end")
    spans = windows.select(
        *WINDOW_KEYS, "window_end",
        F.explode(F.sequence(F.floor(start / size_us).cast("long"), F.floor((end - 1) / size_us).cast("long")))
        .alias("_slot"),
    )
    slotted = labelled.withColumn("_slot", F.floor(F.unix_micros("ts_event") / size_us).cast("long"))
    slot = ["domain", "entity_key", "_slot"]
    touched = spans.join(slotted.select(*slot).distinct(), slot, "left_semi").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    )
    inside = (F.col("ts_event") >= F.col("window_start")) & (F.col("ts_event") < F.col("window_end"))
    return (
        slotted.join(touched, [*slot, "_salt"])
        .where(inside)
        .groupBy(*WINDOW_KEYS)
        .agg(F.min(F.struct("ts_event", "_e.event_id", "_e.scenario_label")).alias("_first"))
    )


def label_windows_any(
    windows: DataFrame, events: DataFrame, slots: dict[str, float] | None = None
) -> DataFrame:
    """Add ``label``: 1 where any labelled event of the entity lies in [start, end)."""
    hits = _label_hits(windows, events, slots).select(*WINDOW_KEYS, F.lit(1).alias("label"))
    return windows.join(hits, WINDOW_KEYS, "left").na.fill(0, ["label"])


def label_windows_first(
    windows: DataFrame, events: DataFrame, slots: dict[str, float] | None = None
) -> DataFrame:
    """Add ``scenario_label``: the window's earliest label, null where it has none."""
    hits = _label_hits(windows, events, slots).select(*WINDOW_KEYS, F.col("_first.scenario_label").alias("scenario_label"))
    return windows.drop("scenario_label").join(hits, WINDOW_KEYS, "left")


def mark_alerted(windows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Add ``alerted``: the window is in the set of alerted (entity, window end) pairs."""
    keys = ["entity_key", "window_end"]
    seen = alerts.select(*keys).distinct().withColumn("alerted", F.lit(True))
    return windows.join(seen, keys, "left").na.fill(False, ["alerted"])


def ts_folds(df: DataFrame, n: int = CV_FOLDS, order: tuple[str, ...] = ("window_end", "entity_key")) -> DataFrame:
    """Expanding time-series folds per domain: columns ``fold``, ``role``.

    Every fold tests ``floor(rows / (n + 1))`` rows that come after its training
    rows; a row appears once per fold it takes part in.
    """
    ranked = df if "row_no" in df.columns else numbered(df, ["domain"], list(order), "row_no")
    sizes = ranked.groupBy("domain").agg(F.count(F.lit(1)).alias("_rows"))
    test = F.floor(F.col("_rows") / (n + 1))
    fold = F.col("fold")
    train_end = F.col("_rows") - (F.lit(n) - fold) * test
    role = F.when(F.col("row_no") <= train_end, "train").when(F.col("row_no") <= train_end + test, "test")
    return (
        ranked.join(sizes, "domain")
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
        .drop("_rows")
    )


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision over distinct score thresholds, one row.

    Scores in [0, 1] are counted per value and run through score blocks.
    """
    at_score = df.groupBy(F.col(score).alias("_score")).agg(
        F.sum(label).alias("_tp"), F.count(F.lit(1)).alias("_n")
    ).withColumn("_down", -F.col("_score")).withColumn(BLOCK, F.floor(F.col("_down") * 10_000).cast("long"))
    steps = running(at_score, [], ["_down"], {
        "tp": ("sum", F.col("_tp")), "seen": ("sum", F.col("_n")), "positives": ("total", F.col("_tp")),
    })
    gain = F.try_divide(F.col("_tp"), F.col("positives")) * (F.col("tp") / F.col("seen"))
    return steps.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("average_precision"))


def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Mean squared distance between probability and outcome, one row."""
    miss = F.col(score) - F.col(label)
    return df.agg(F.avg(miss * miss).alias("brier_score"))


def _labelled() -> Column:
    return F.coalesce(F.col("scenario_label"), F.lit("")) != ""


def _confusion_columns() -> list[Column]:
    bad, hit = _labelled(), F.col("alerted")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    tp, fp, fn, tn = n(bad & hit), n(~bad & hit), n(bad & ~hit), n(~bad & ~hit)
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        F.try_divide(fp, fp + tn).alias("false_positive_rate"),
    ]


def confusion(df: DataFrame) -> DataFrame:
    """Confusion counts and rates of labelled, alert-marked windows; null on empty denominators."""
    return df.agg(*_confusion_columns())


def confusion_by(df: DataFrame, col: str = "scenario_label") -> DataFrame:
    """Confusion per label; only recall means something, false alarms have no label."""
    return df.where(_labelled()).groupBy(col).agg(*_confusion_columns())


def episodes(df: DataFrame) -> DataFrame:
    """Runs of touching windows of one entity with the same label.

    ``detected_at`` is the end of the first alerted window, null if never alerted.
    One row per window and entity, so an entity's rows are bounded by elapsed time.
    """
    w = Window.partitionBy("entity_key").orderBy("window_start", "window_end")
    label = F.when(_labelled(), F.col("scenario_label"))
    previous_label = F.lag(label).over(w)
    follows = (previous_label == label) & (F.col("window_start") <= F.lag("window_end").over(w))
    opened = F.when(label.isNotNull() & ~F.coalesce(follows, F.lit(False)), 1).otherwise(0)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_opened", opened)
        .withColumn("_episode", F.sum("_opened").over(upto))
        .where(_labelled())
        .groupBy("entity_key", "_episode")
        .agg(
            F.min_by("domain", "window_start").alias("domain"),
            F.min("scenario_label").alias("scenario_label"),
            F.min("window_start").alias("start"),
            F.max("window_end").alias("end"),
            F.min(F.when(F.col("alerted"), F.col("window_end"))).alias("detected_at"),
        )
        .drop("_episode")
    )


def mean_delay(eps: DataFrame) -> DataFrame:
    """Mean seconds from episode start to detection per label; undetected labels are absent."""
    delay = (F.unix_micros("detected_at") - F.unix_micros("start")) / 1e6
    return eps.where(F.col("detected_at").isNotNull()).groupBy("scenario_label").agg(
        F.avg(delay).alias("mean_detection_delay_s")
    )


def evaluation_report(df: DataFrame) -> DataFrame:
    """Per label: episodes, detected, detection rate, window recall and mean delay; ``overall_report`` has the totals."""
    eps = episodes(df)
    counted = eps.groupBy("scenario_label").agg(
        F.count(F.lit(1)).alias("episodes"), F.count("detected_at").alias("episodes_detected")
    )
    recall = confusion_by(df).select("scenario_label", F.col("recall").alias("window_recall"))
    return (
        recall.join(counted, "scenario_label", "left")
        .join(mean_delay(eps), "scenario_label", "left")
        .select(
            "scenario_label", "episodes", "episodes_detected",
            F.try_divide("episodes_detected", "episodes").alias("episode_detection_rate"),
            "window_recall", "mean_detection_delay_s",
        )
    )


def overall_report(df: DataFrame) -> DataFrame:
    """One row: windows evaluated, confusion counts and rates over all of them, episodes and how many were detected."""
    eps = episodes(df).agg(F.count(F.lit(1)).alias("episodes"), F.count("detected_at").alias("episodes_detected"))
    totals = df.agg(F.count(F.lit(1)).alias("windows_evaluated"), *_confusion_columns())
    # Each side is one row.
    return totals.withColumn("_one", F.lit(1)).join(eps.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn(
        "episode_detection_rate", F.try_divide("episodes_detected", "episodes"))
