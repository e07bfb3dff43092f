from trailmark.functions.columns import (
    is_toll_free,
    path_length,
    path_nickname,
    step_label,
    toll_free_class,
    whole_days,
    whole_seconds,
)
from trailmark.functions.dates import as_date

__all__ = [
    "as_date",
    "is_toll_free",
    "path_length",
    "path_nickname",
    "step_label",
    "toll_free_class",
    "whole_days",
    "whole_seconds",
]
