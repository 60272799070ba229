"""Small expressions over JSON text, maps, structs and strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def map_value(entries: Column | str, key: str) -> Column:
    """Map element, null where the key is absent (also in ANSI mode)."""
    return F.try_element_at(_col(entries), F.lit(key))


def json_text(document: Column | str, path: str) -> Column:
    return F.get_json_object(_col(document), path)


def json_long(document: Column | str, path: str) -> Column:
    return json_text(document, path).try_cast("bigint")


def json_decimal(document: Column | str, path: str, kind: str = "decimal(16,2)") -> Column:
    return json_text(document, path).try_cast(kind)


def put_field(record: Column | str, name: str, value: Column) -> Column:
    """A struct with one field set or replaced."""
    return _col(record).withField(name, value)


def is_blank(text: Column | str) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(_col(text), F.lit("")) == ""


def first_non_null(*values: Column | str) -> Column:
    return F.coalesce(*[_col(value) for value in values])


def split_names(names: Column | str) -> Column:
    """A comma list as an array; the parts are taken as they stand."""
    return F.split(_col(names), ",")


def join_names(names: Column | str) -> Column:
    return F.concat_ws(",", _col(names))


def compose_key(*parts: Column | str, separator: str = ":") -> Column:
    return F.concat_ws(separator, *[_col(part) for part in parts])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def add_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each row computes them once.

    Filters and join conditions on a projected column are pushed below it together
    with a copy of its expression. They do not cross a generator, so the values are
    made in one of a single row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
