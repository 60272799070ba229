from .times import (
    age_years, datetime_text, day_of, day_text, epoch_ms, epoch_seconds, from_epoch_text, span_text, to_time,
)
from .values import (
    add_computed, compose_key, first_non_null, is_blank, join_names, json_decimal, json_long, json_text, map_value,
    put_field, split_names,
)

__all__ = [
    "add_computed", "age_years", "compose_key", "datetime_text", "day_of", "day_text", "epoch_ms", "epoch_seconds",
    "first_non_null", "from_epoch_text", "is_blank", "join_names", "json_decimal", "json_long",
    "json_text", "map_value", "put_field", "span_text", "split_names", "to_time",
]
