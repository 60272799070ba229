"""Time expressions. All of them follow `spark.sql.session.timeZone`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed formats of the source data.
DATETIME = "yyyy-MM-dd HH:mm:ss"
DAY = "yyyyMMdd"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def day_text(ms: Column | str) -> Column:
    """Epoch milliseconds to a `yyyyMMdd` day string."""
    return F.date_format(F.timestamp_millis(_col(ms)), DAY)


def day_of(ms: Column | str) -> Column:
    """Epoch milliseconds to a DATE, which aggregates and compares as an int."""
    return F.to_date(F.timestamp_millis(_col(ms)))


def to_time(text: Column | str) -> Column:
    """Datetime string to a timestamp; null where the text is none.

    After the seconds a fraction may follow, and a 'T' may stand for the blank. A cast reads this
    format several times faster than a pattern does. It also takes shorter forms, which the length rules out.
    """
    return F.when(F.length(F.trim(_col(text))) >= len(DATETIME), F.trim(_col(text)).try_cast("timestamp"))


def epoch_ms(text: Column | str) -> Column:
    """Datetime string to epoch milliseconds."""
    return F.unix_millis(to_time(text))


def datetime_text(time: Column | str) -> Column:
    return F.date_format(_col(time), DATETIME)


def from_epoch_text(ms: Column | str) -> Column:
    """Epoch milliseconds to a datetime string, cut to whole seconds."""
    return F.from_unixtime(F.floor(_col(ms) / F.lit(1000)), DATETIME)


def span_text(span: Column | str, start: str = "stt", end: str = "edt") -> list[Column]:
    """Both bounds of a time window as datetime strings."""
    span = _col(span)
    return [datetime_text(span["start"]).alias(start), datetime_text(span["end"]).alias(end)]


def age_years(birthday: Column | str, as_of: Column | str) -> Column:
    """Full 365-day years between two dates, cut towards zero."""
    return (F.date_diff(_col(as_of), _col(birthday)) / F.lit(365)).cast("int")


def epoch_seconds(time: Column | str, kind: str) -> Column:
    """Whole seconds since 1970 of a timestamp column of type `kind`.

    A zone-less timestamp is read field by field, so that no zone shift can make
    the result run backwards.
    """
    time = _col(time)
    if kind == "timestamp":
        return F.unix_seconds(time)
    days = F.unix_date(F.to_date(time)).cast("bigint")
    return days * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
