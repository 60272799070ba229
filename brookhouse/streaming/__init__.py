from .lateness import LateRows
from .mirror import mirrored_stream, weighted_totals
from .sinks import StatsTable, jdbc_writer
from .stateful import bounces_by_timer, repair_new_flag_stream
from .visitors import FlagDays, bounces_stream, first_per_day_stream

__all__ = [
    "FlagDays", "LateRows", "StatsTable", "bounces_by_timer", "bounces_stream", "first_per_day_stream", "jdbc_writer",
    "mirrored_stream", "repair_new_flag_stream", "weighted_totals",
]
