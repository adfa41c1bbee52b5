"""Refit schedule of the rolling detectors and the order it runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scan import numbered

# Rolling buffer size, first fit and refit cadence (in windows).
BUFFER = 500
FIRST_FIT = 60
REFIT_EVERY = 50


def domain_order(vectors: DataFrame) -> DataFrame:
    """Number the windows of a whole domain by ``(window_end, entity_key)`` as ``vector_no``.

    A domain holds half of all rows, so the order comes from range partitions.
    """
    return numbered(vectors, ["domain"], ["window_end", "entity_key"], "vector_no")


def refit_epochs(
    numbered_vectors: DataFrame, first: int = FIRST_FIT, every: int = REFIT_EVERY, buffer: int = BUFFER
) -> DataFrame:
    """Add the epoch that scores each vector and the vector range that epoch was fitted on.

    Null before the first fit. A vector joins the buffer before it is scored.
    """
    n = F.col("vector_no")
    epoch = F.when(n >= first, F.floor((n - first) / every).cast("long"))
    last = F.lit(first) + F.col("epoch") * every
    return numbered_vectors.withColumn("epoch", epoch).withColumns({
        "train_to": last.cast("long"),
        "train_from": F.when(last.isNotNull(), F.greatest(last - buffer, F.lit(0)) + 1).cast("long"),
    })


def refit_groups(
    numbered_vectors: DataFrame, first: int = FIRST_FIT, every: int = REFIT_EVERY, buffer: int = BUFFER
) -> DataFrame:
    """Rows of every fit: columns ``domain, epoch, role`` plus the vector row.

    A vector trains at most ``buffer / every`` epochs and is scored by one, so a
    ``(domain, epoch)`` group has at most ``buffer + every`` rows at any scale.
    Epochs that score nothing are left out.
    """
    n = F.col("vector_no")
    # Rows marked as not new are there to be trained on only: what a stream keeps of earlier batches.
    fresh = F.col("is_new") if "is_new" in numbered_vectors.columns else F.lit(True)
    newest = numbered_vectors.groupBy("domain").agg(
        F.max("vector_no").alias("_latest"), F.min(F.when(fresh, n)).alias("_oldest")).where("_oldest is not null")
    first_epoch = F.greatest(F.ceil((n - first) / every), F.floor((F.col("_oldest") - first) / every), F.lit(0))
    last_epoch = F.least(
        F.floor((n + (buffer - 1 - first)) / every), F.floor((F.col("_latest") - first) / every)
    )
    training = (
        numbered_vectors.join(newest, "domain")
        .where((last_epoch >= first_epoch) & (F.col("_latest") >= first))
        .withColumn("epoch", F.explode(F.sequence(first_epoch.cast("long"), last_epoch.cast("long"))))
        .drop("_latest", "_oldest")
        .withColumn("role", F.lit("train"))
    )
    scored = (
        numbered_vectors.where(fresh & (n >= first))
        .withColumn("epoch", F.floor((n - first) / every).cast("long"))
        .withColumn("role", F.lit("score"))
    )
    return training.unionByName(scored)
