from .changes import current_table, latest_by_key, normalise_changes, valid_changes
from .intervals import interval_join
from .lookups import by_id, lookup
from .parse import Parsed, parse_fields, parse_json, to_json_value
from .routing import Logs, Routed, current_rules, explode_displays, route_changes, split_logs
from .skew import heavy_keys, spread_join
from .stats import keyword_stats, product_stats, province_stats, stamp, union_measures, visitor_stats
from .visitors import bounces, first_flag_days, first_per_day, is_entry, repair_new_flag
from .wide import (
    Dimensions, enrich_order_wide, enrich_products, merge_wide, order_with_detail, payment_wide, with_rowtime,
)

__all__ = [
    "Dimensions", "Logs", "Parsed", "Routed", "bounces", "by_id", "current_rules", "current_table",
    "enrich_order_wide", "enrich_products", "explode_displays", "first_flag_days", "first_per_day",
    "heavy_keys", "interval_join", "is_entry", "keyword_stats", "latest_by_key", "lookup", "merge_wide",
    "normalise_changes", "order_with_detail", "parse_fields", "parse_json", "payment_wide", "product_stats",
    "province_stats", "repair_new_flag", "route_changes", "split_logs", "spread_join", "stamp",
    "to_json_value", "union_measures", "valid_changes", "visitor_stats", "with_rowtime",
]
