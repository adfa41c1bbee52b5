"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(z: Column, scale: float = 4.0) -> Column:
    """Map an unbounded score to [0, 1): ``1 - exp(-|z| / scale)``."""
    return F.lit(1.0) - F.exp(-F.abs(z) / F.lit(float(scale)))


def sigmoid(x: Column, slope: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(slope)) * x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rfc3339(ts: Column) -> Column:
    """UTC text with 0, 3 or 6 fractional digits, as short as the value allows."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    base = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    millis = F.lpad((micros / 1000).cast("long").cast("string"), 3, "0")
    full = F.lpad(micros.cast("string"), 6, "0")
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.concat(F.lit("."), millis))
        .otherwise(F.concat(F.lit("."), full))
    )
    return F.concat(base, fraction, F.lit("+00:00"))


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version-5 id of ``name`` in ``namespace``, in SQL functions only."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    marked = F.lower(F.hex((nibble.bitwiseAND(3) + 8).cast("long")))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(marked, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
