"""JSON text to rows and back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, NumericType, StringType, StructField, StructType

_BROKEN = "_broken"

# The range of epoch milliseconds that a timestamp can hold: years 1 to 9999.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def solid_text(value: str) -> Column:
    """The string, or something that is surely no JSON where there is none."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("?"))


def in_time(ms: Column | str) -> Column:
    """Whether epoch milliseconds are a time at all; a missing one is no time either."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.coalesce(ms.between(FIRST_MS, LAST_MS), F.lit(False))


class Parsed(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def _as_text(kind: DataType) -> DataType:
    """The type with numbers inside structs read as text, so that quoted ones are numbers too."""
    if isinstance(kind, NumericType):
        return StringType()
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _as_text(f.dataType)) for f in kind.fields])
    return kind


def _numbers(kind: DataType, at: Column) -> Iterator[tuple[Column, DataType]]:
    if isinstance(kind, NumericType):
        yield at, kind
    elif isinstance(kind, StructType):
        for f in kind.fields:
            yield from _numbers(f.dataType, at[f.name])


def _typed(kind: DataType, at: Column) -> Column:
    """The text form of a value back in its type; numbers that do not fit are null."""
    if isinstance(kind, NumericType):
        return at.try_cast(kind)
    if isinstance(kind, StructType):
        return F.when(at.isNotNull(), F.struct(*[_typed(f.dataType, at[f.name]).alias(f.name) for f in kind.fields]))
    return at


def parse_json(
    df: DataFrame, schema: str, value: str = "value", keep: tuple[str, ...] = (), times: tuple[str, ...] = ("ts", "ts_ms"),
    line: str | None = None,
) -> Parsed:
    """Split a column of JSON strings into typed rows and rejected strings.

    A string that is no JSON object (also an empty or missing one), that has text where a
    number is due, or whose epoch milliseconds (`times`) are out of range becomes a reject, with the
    `reason`, and does not stop the job. Numbers may be written as strings. With `line`, rows keep
    their whole text in a column of that name. The parse sits in a generator, so that neither
    filter below can pull a second copy of it into the plan.
    """
    whole = StructType.fromDDL(schema)
    text = StructType([*_as_text(whole).fields, StructField(_BROKEN, StringType())])
    record = F.from_json(solid_text(value), text, {"columnNameOfCorruptRecord": _BROKEN})
    parsed = df.select(*keep, F.col(value).alias("_text"), F.inline(F.array(record)))
    columns = {f.name: F.col(f"`{f.name}`") for f in whole.fields}
    wrong = [at.isNotNull() & at.try_cast(kind).isNull() for f in whole.fields for at, kind in _numbers(f.dataType, columns[f.name])]
    late = [columns[c].isNotNull() & ~in_time(columns[c].try_cast("bigint")) for c in times if c in columns]
    some = lambda tests: reduce(Column.__or__, tests, F.lit(False))
    reason = F.when(F.col(_BROKEN).isNotNull(), "json").when(some(wrong), "number").when(some(late), "time")
    typed = [_typed(f.dataType, columns[f.name]).alias(f.name) for f in whole.fields]
    # A second generator: what follows sees plain columns, not the tests and casts they come from.
    judged = parsed.select(*keep, "_text", F.inline(F.array(F.struct(*typed, reason.alias("_reason")))))
    carried = [F.col("_text").alias(line)] if line else []
    return Parsed(
        rows=judged.filter(F.col("_reason").isNull()).select(*keep, *[F.col(f"`{f.name}`") for f in whole.fields], *carried),
        rejects=judged.filter(F.col("_reason").isNotNull()).select(*keep, F.col("_text").alias(value), F.col("_reason").alias("reason")),
    )


def parse_fields(df: DataFrame, schema: str, value: str = "value", times: tuple[str, ...] = ()) -> Parsed:
    """Like `parse_json` for flat objects whose numbers may be written as strings.

    Change rows pass their columns on as text; each field is cast to its type here. A missing or null
    field is null; text where a number is due makes the row a reject (`number`), as do datetime texts named in
    `times` that cannot be read (`time`) and lines that are no JSON object (`json`).
    """
    from ..functions import to_time

    entries = F.from_json(solid_text(value), "MAP<STRING, STRING>")
    parsed = df.select(F.col(value).alias("_text"), F.explode(F.array(entries)).alias("_map"))
    fields = StructType.fromDDL(schema).fields
    raw = {f.name: F.try_element_at("_map", F.lit(f.name)) for f in fields}
    wrong = [raw[f.name].isNotNull() & raw[f.name].try_cast(f.dataType).isNull() for f in fields if isinstance(f.dataType, NumericType)]
    unread = [to_time(F.try_element_at("_map", F.lit(c))).isNull() for c in times]
    some = lambda tests: reduce(Column.__or__, tests, F.lit(False))
    reason = F.when(F.col("_map").isNull(), "json").when(some(wrong), "number").when(some(unread), "time")
    judged = parsed.select("_text", F.inline(F.array(F.struct("_map", reason.alias("_reason")))))
    return Parsed(
        rows=judged.filter(F.col("_reason").isNull()).select(*[
            raw[f.name].try_cast(f.dataType).alias(f.name) for f in fields
        ]),
        rejects=judged.filter(F.col("_reason").isNotNull()).select(F.col("_text").alias(value), F.col("_reason").alias("reason")),
    )


def to_json_value(df: DataFrame, value: str = "value") -> DataFrame:
    """Every row as one JSON string; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias(value))
