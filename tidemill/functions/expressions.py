"""Column expressions that don't depend on the session's ANSI mode, time zone or row order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.contract import TIME_FORMAT


def named(column: str) -> Column:
    """A column by its literal name, whatever characters that has."""
    escaped = column.replace("`", "``")
    return F.col(f"`{escaped}`")


def strict_time(value: Column, kind: T.DataType, form: str = TIME_FORMAT) -> Column:
    """Dates and timestamps as they are; anything else must be text of exactly the given form, else null."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return value.cast("timestamp")
    text = value if isinstance(kind, T.StringType) else value.try_cast("string")
    return F.try_to_timestamp(text, F.lit(form))


def settle(value: Column, kind: T.DataType, target: str) -> Column:
    """The value in the target type, or null where it doesn't fit."""
    return strict_time(value, kind) if target == "timestamp" else value.try_cast(target)


def portable(value: Column, kind: str) -> Column:
    """Text of a value for hashing: times as microseconds since 1970, so no time zone takes part."""
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    return value.cast("string")


def digest_of(values: Iterable[Column], null: str = "NULL") -> Column:
    """SHA-256 of values joined by a bar."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(v, F.lit(null)) for v in values]), 256)


def content_digest(columns: dict[str, tuple[Column, str]]) -> Column:
    """SHA-256 of named values; nulls don't take part, so a new column that is null everywhere changes nothing."""
    cells = [F.concat(F.lit(f"{name}="), portable(value, kind)) for name, (value, kind) in columns.items()]
    return F.sha2(F.concat_ws("\u001f", *cells), 256)


def sample_by_digest(df: DataFrame, percent: float, columns: list[str] | None = None) -> DataFrame:
    """The same rows every time: those whose hash falls in the first `percent` of 10,000 buckets."""
    cells = [named(c) for c in (columns or df.columns)]
    return df.filter(F.pmod(F.xxhash64(*cells), F.lit(10_000)) < int(percent * 100))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
