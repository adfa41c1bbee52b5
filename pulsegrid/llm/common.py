"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that names a costly column would otherwise have it computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of other than white space, as an array."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that may be learnt from; a null id may not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def hash_sample(df: DataFrame, key: str, bound: int, rows: int | None = None, seed: int = 17) -> DataFrame:
    """About ``bound`` rows of ``df`` chosen by a hash of ``key``, all of them when there are fewer.

    For fitting only. The choice depends on keys alone, so it repeats over any partitioning.
    """
    rows = df.count() if rows is None else rows
    if rows <= bound:
        return df
    cut = int(bound / rows * (1 << 31))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 31)) < cut)


def free_unused() -> None:
    """Return freed memory to the operating system.

    A Python worker serves later tasks too, also of other operators, and lies idle between them; what it holds back counts
    against the executor all that time.
    """
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that leaves no unused memory behind."""
    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        free_unused()

    return wrapped
