"""Date arguments: dates, ISO strings and defaults."""

from __future__ import annotations

import datetime as dt

DEFAULT_START = dt.date(2020, 1, 1)


def as_date(value: dt.date | str | None, default: dt.date | None = None) -> dt.date:
    """A `date` from a date, an ISO string or, for None, the default."""
    if default is not None and type(default) is not dt.date:
        raise TypeError(f"default must be a datetime.date, got {type(default).__name__}")
    if value is None:
        if default is None:
            raise ValueError("a date is required")
        return default
    if isinstance(value, str):
        return dt.date.fromisoformat(value)
    if type(value) is dt.date:
        return value
    raise TypeError(f"expected a date or an ISO string, got {type(value).__name__}")


def as_list(value) -> list:
    """A list from one string or any iterable of them."""
    return [value] if isinstance(value, str) else list(value)
