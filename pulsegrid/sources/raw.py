"""Raw event text to typed rows: frames, parsing, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.contracts import (
    CHANNELS, ENVELOPE, MARKET_PAYLOAD, PAYMENTS_PAYLOAD, RAW_EVENT, SIDES, STATUSES, T, UUID_PATTERN,
)

_ENVELOPE_NAMES = [f.name for f in ENVELOPE]
_CORRUPT = "_corrupt"
# Fixed value: every white space character of Unicode, not only blanks.
SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def split_frames(df: DataFrame, col: str, out: str = "line") -> DataFrame:
    """One row per non-blank line of a newline-delimited text batch."""
    lines = df.select(*[c for c in df.columns if c != col], F.explode(F.split(F.col(col), "\n")).alias(out))
    return lines.withColumn(out, F.regexp_replace(out, f"^{SPACE}+|{SPACE}+$", "")).where(F.col(out) != "")


def _complete(strict_ids: bool) -> Column:
    """True where every field that the event's domain needs is present and legal."""
    p = F.col("event.payload")

    def present(struct, names):
        cond = F.lit(True)
        for n in names:
            cond = cond & struct[n].isNotNull()
        return cond

    e = F.col("event")
    head = present(e, [n for n in _ENVELOPE_NAMES if n not in ("ts_ingest", "scenario_label", "corrupted")])
    market = present(p, [f.name for f in MARKET_PAYLOAD]) & p["side"].isin(*SIDES)
    pay = (
        present(p, [f.name for f in PAYMENTS_PAYLOAD])
        & p["channel"].isin(*CHANNELS) & p["status"].isin(*STATUSES)
    )
    if strict_ids:
        head = head & e["event_id"].rlike(UUID_PATTERN)
        pay = pay & p["txn_id"].rlike(UUID_PATTERN)
    by_domain = F.when(e["domain"] == "market", market).when(e["domain"] == "payments", pay).otherwise(F.lit(False))
    return F.coalesce(head & (e["seq"] >= 0) & by_domain, F.lit(False))


def parse_raw(df: DataFrame, col: str = "line", strict_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Parse JSON lines into ``(good events, bad lines)``; a bad line never fails the job.

    Unknown keys are ignored and a missing ``corrupted`` means false. With
    ``strict_ids`` an event or transaction id that is no UUID makes the line bad.
    """
    schema = T.StructType([*RAW_EVENT.fields, T.StructField(_CORRUPT, T.StringType())])
    event = F.from_json(col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # Without the generator Spark would parse the text again for every field read.
    parsed = df.select("*", F.explode(F.array(event)).alias("event")).withColumn(
        "_ok", F.col(f"event.{_CORRUPT}").isNull() & _complete(strict_ids)
    )
    good = parsed.where("_ok").select(*[F.col(f"event.{f.name}") for f in RAW_EVENT]).na.fill(False, ["corrupted"])
    bad = parsed.where("NOT _ok").drop("event", "_ok")
    return good, bad


def bad_reason(line: Column) -> Column:
    """Why a line is bad: ``not_json``, ``no_domain`` (neither of the two), or ``incomplete`` (a field missing or illegal)."""
    domain = F.get_json_object(line, "$.domain")
    return F.when(F.get_json_object(line, "$").isNull(), "not_json").when(
        ~F.coalesce(domain.isin("market", "payments"), F.lit(False)), "no_domain").otherwise("incomplete")


def stamp_ingest(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Set the receipt time; ``now`` is injectable for tests and replays."""
    return df.withColumn("ts_ingest", F.current_timestamp() if now is None else now)


def flatten_raw(df: DataFrame) -> DataFrame:
    """Nested event to the wide table row: ``m_*`` for market, ``p_*`` for payments.

    Text columns of the other domain are empty strings, numbers and ids null.
    """
    out = [F.col(n) for n in _ENVELOPE_NAMES if n not in ("ts_ingest", "scenario_label")]
    out += [
        F.coalesce("ts_ingest", "ts_event").alias("ts_ingest"),
        F.coalesce("scenario_label", F.lit("")).alias("scenario_label"),
    ]
    for domain, prefix, payload in (("market", "m_", MARKET_PAYLOAD), ("payments", "p_", PAYMENTS_PAYLOAD)):
        for f in payload:
            mine = F.when(F.col("domain") == domain, F.col(f"payload.{f.name}"))
            textual = isinstance(f.dataType, T.StringType) and f.name != "txn_id"
            out.append((F.coalesce(mine, F.lit("")) if textual else mine).alias(prefix + f.name))
    return df.select(*out).withColumn("ingest_date", F.to_date("ts_ingest"))


def unflatten_raw(df: DataFrame) -> DataFrame:
    """Wide table row back to the nested event."""
    fields = []
    for domain, prefix, payload in (("market", "m_", MARKET_PAYLOAD), ("payments", "p_", PAYMENTS_PAYLOAD)):
        fields += [
            F.when(F.col("domain") == domain, F.col(prefix + f.name)).alias(f.name) for f in payload
        ]
    label = F.when(F.col("scenario_label") != "", F.col("scenario_label"))
    return df.select(
        *[n for n in _ENVELOPE_NAMES if n != "scenario_label"],
        label.alias("scenario_label"),
        F.struct(*fields).alias("payload"),
    )
