"""Column expressions that several operators share. Bad input gives null, also in ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_hash(*tracked: ColumnLike) -> Column:
    """Change hash of the tracked columns; nulls are skipped, so it is never null."""
    return F.md5(F.concat_ws("|", *(_column(c).cast("string") for c in tracked)))


def event_time(text: ColumnLike, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(_column(text), F.lit(pattern))


def day(time: ColumnLike) -> Column:
    return _column(time).cast("date")


def iso_date(text: ColumnLike) -> Column:
    return F.try_to_date(_column(text))


def or_default(value: ColumnLike, default: object) -> Column:
    return F.coalesce(_column(value), F.lit(default))


def natural_id(*natural: ColumnLike) -> Column:
    """An id that depends on the natural columns alone: the same row gets it in every run."""
    parts = [part for c in natural for part in (F.coalesce(_column(c).cast("string"), F.lit("")), _column(c).isNull())]
    return F.xxhash64(*parts)
