from .changelog import with_snapshot
from .dimensions import DimensionStore, StoredDimension, table_columns
from .landing import land_logs, landed_logs
from .rules import RuleLog, WaitingRows
from .topics import Topics

__all__ = ["DimensionStore", "RuleLog", "StoredDimension", "Topics", "WaitingRows", "land_logs", "landed_logs", "table_columns", "with_snapshot"]
