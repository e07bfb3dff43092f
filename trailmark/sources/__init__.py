from trailmark.sources.store import SequenceStore
from trailmark.sources.tables import (
    TooManyRows,
    bounded_rows,
    materialize,
    read_events,
    read_exit_events,
    read_sequence_csv,
    run_query,
    sample_sessions,
    store_sequence,
    stored_extent,
    stored_sequence,
)

__all__ = [
    "SequenceStore",
    "TooManyRows",
    "bounded_rows",
    "materialize",
    "read_events",
    "read_exit_events",
    "read_sequence_csv",
    "run_query",
    "sample_sessions",
    "store_sequence",
    "stored_extent",
    "stored_sequence",
]
