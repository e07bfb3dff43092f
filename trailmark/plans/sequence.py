"""The enriched sequence: steps with the rank of their session's path and the session's callers."""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trailmark.functions.columns import NOT_TOLL_FREE
from trailmark.functions.dates import as_date
from trailmark.operators.callers import callbacks, caller_counts, caller_sessions
from trailmark.operators.events import filter_events
from trailmark.operators.freeze import (
    BROADCAST_ROWS,
    clustered,
    fits,
    frozen,
    join_attributes,
)
from trailmark.operators.ordered import GROUP_ROWS, Heavy, heavy_keys
from trailmark.operators.paths import (
    keyed_paths,
    name_paths,
    path_frequencies,
    paths_of_parts,
    rank_paths,
)
from trailmark.operators.steps import step_metrics, step_parts

_STEP_COLUMNS = {
    "SessionId": "user_id",
    "ActionId": "event_name",
    "TimeStamp": "time_event",
}


def step_sequence(
    events: DataFrame, flows=None, start=None, end=None, group_rows: int | None = GROUP_ROWS
) -> DataFrame:
    """Steps per session without path and caller: the slim sequence."""
    steps = step_metrics(filter_events(events, flows, start, end), group_rows=group_rows)
    return steps.select(
        *[F.col(name).alias(public) for name, public in _STEP_COLUMNS.items()],
        "rank_event",
        "next_event",
        "FlowName",
        "time_from_start",
        "time_to_next",
    )


@dataclass(frozen=True)
class _Pieces:
    """What the enriched sequence is put together from, each with one row per `SessionId` or more."""

    steps: list[DataFrame]
    names: DataFrame
    calls: DataFrame
    heavy: Heavy | None


def _pieces(events: DataFrame, flows, start, end, group_rows: int | None) -> _Pieces:
    """Steps, path names and callbacks of the sessions of some flows and dates.

    The events are shuffled once, by session, into a clustered table. Steps, paths and callers all
    come from there without another exchange of events: what is joined to a session afterwards has
    one row per session or caller and is brought to the steps. Heavy sessions would not fit a bucket;
    their events are written apart.
    """
    kept = filter_events(events, flows, start, end)
    heavy = heavy_keys(kept, ["SessionId"], group_rows)
    ordinary, large = (kept, None) if heavy is None else heavy.split(kept, ["SessionId"])
    parts = [clustered(ordinary, "SessionId")]
    if heavy is not None:
        parts.append(frozen(large))
    found = paths_of_parts(parts[0], parts[-1], ["SessionId"], heavy).drop("Duration")
    paths = frozen(keyed_paths(found))
    ranks = rank_paths(path_frequencies(paths))
    names = name_paths(paths.select("SessionId", "PathKey"), ranks)
    called = functools.reduce(DataFrame.unionByName, [caller_sessions(part) for part in parts])
    calls = callbacks(frozen(called), group_rows).drop("TimeStamp")
    # Events without a session would drop out at the join with the names.
    named = [part.drop("CallingNumber").filter(F.col("SessionId").isNotNull()) for part in parts]
    steps = step_parts(named[0], None)
    if heavy is not None:
        steps.append(step_parts(named[1], heavy)[1])
    return _Pieces(steps, names, calls, heavy)


def user_sequence(
    events: DataFrame, flows=None, start=None, end=None, group_rows: int | None = GROUP_ROWS
) -> DataFrame:
    """The enriched sequence of 17 columns, one row per step and known number of its session.

    A session whose path is null is left out. The events kept, the session paths and the caller
    sessions are written to the checkpoint folder. Where sessions have many numbers and only
    aggregates are wanted, `factorised_sequence` has the same content without the product.
    """
    made = _pieces(events, flows, start, end, group_rows)
    heavy, names, calls = made.heavy, made.names, made.calls
    # Callers of heavy sessions stay out of the ordinary join, where they would meet in one task.
    ordinary = calls if heavy is None else heavy.split(calls, ["SessionId"])[0]
    parts = [_attributed(made.steps[0], names, ordinary)]
    if heavy is not None:
        parts.append(_heavy_attributed(made.steps[1], names, calls, heavy))
    return public_sequence(functools.reduce(DataFrame.unionByName, parts))


def _attributed(steps: DataFrame, names: DataFrame, calls: DataFrame) -> DataFrame:
    return steps.join(names, "SessionId").join(calls, "SessionId", "left")


def _heavy_attributed(steps, names, calls, heavy: Heavy) -> DataFrame:
    """As `_attributed` for the steps of heavy sessions, which must not meet in one task."""
    names = frozen(heavy.split(names, ["SessionId"])[1])
    calls = frozen(heavy.split(calls, ["SessionId"])[1])
    # One name per heavy session.
    named = join_attributes(steps, names, "SessionId", "inner", fits(names, BROADCAST_ROWS))
    return join_attributes(named, calls, "SessionId", "left", fits(calls, BROADCAST_ROWS))


@dataclass(frozen=True)
class FactorisedSequence:
    """The enriched sequence as two tables instead of their product.

    `steps` has a row per step: the step columns of the sequence, `path_nickname`, `count`, which is
    the number of rows the step has in the sequence, and `ordinary_count`, the number of those with an
    ordinary number. `callers` has a row per session and known number: `user_id` and the caller columns.
    A session of s steps and n numbers has s + n rows here and s * n in the sequence.
    """

    steps: DataFrame
    callers: DataFrame

    def restricted(self, start=None, end=None, include_tollfree: bool = True) -> FactorisedSequence:
        """As `restrict_window` and `restrict_tollfree` of the sequence."""
        steps, callers = restrict_window(self.steps, start, end), self.callers
        if not include_tollfree:
            ordinary = F.col("ordinary_count")
            steps = steps.filter(ordinary > 0).withColumn("count", ordinary)
            callers = callers.filter(F.col("TollFreeNumber") == NOT_TOLL_FREE)
        return FactorisedSequence(steps, callers)

    def written(self) -> FactorisedSequence:
        """Both tables written once, for many readers."""
        return FactorisedSequence(frozen(self.steps), frozen(self.callers))


def factorised_sequence(
    events: DataFrame, flows=None, start=None, end=None, group_rows: int | None = GROUP_ROWS
) -> FactorisedSequence:
    """The content of `user_sequence` with steps and callers side by side.

    Panels read it in place of the sequence: graph and event totals weigh steps by `count`,
    `callback_trend` and `top_path_trend_from_sequence` take the callers as a second argument.
    """
    made = _pieces(events, flows, start, end, group_rows)
    heavy, names, calls = made.heavy, made.names, frozen(made.calls)
    counts = caller_counts(calls)
    parts = [_attributed(made.steps[0], names, counts)]
    if heavy is not None:
        parts.append(_heavy_attributed(made.steps[1], names, counts, heavy))
    rows = functools.reduce(DataFrame.unionByName, parts)
    steps = rows.select(
        *[F.col(name).alias(public) for name, public in _STEP_COLUMNS.items()],
        F.to_date("TimeStamp").alias("date"),
        "rank_event",
        "next_event",
        "FlowName",
        "time_from_start",
        "time_to_next",
        "path_nickname",
        F.coalesce("callers", F.lit(1)).alias("count"),
        F.coalesce("ordinary_callers", F.lit(0)).alias("ordinary_count"),
    )
    # Callers of one session may be many, its name is one row: neither side meets in one task.
    named = names.select("SessionId")
    known = join_attributes(calls, named, "SessionId", "inner", fits(named, BROADCAST_ROWS))
    callers = known.withColumnRenamed("SessionId", "user_id")
    return FactorisedSequence(steps, callers)


def public_sequence(rows: DataFrame) -> DataFrame:
    """The 17 columns of the enriched sequence, of steps joined with path names and callbacks."""
    return rows.select(
        F.col("SessionId").alias("user_id"),
        F.col("ActionId").alias("event_name"),
        F.col("TimeStamp").alias("time_event"),
        F.to_date("TimeStamp").alias("date"),
        "rank_event",
        "next_event",
        "FlowName",
        "time_from_start",
        "time_to_next",
        "path_nickname",
        F.lit(1).cast("long").alias("count"),
        "CallingNumber",
        "callback_instance",
        "days_since_last_call",
        "session_duration",
        "previous_duration",
        "TollFreeNumber",
    )


_CALLER_COLUMNS = [
    "CallingNumber",
    "callback_instance",
    "days_since_last_call",
    "session_duration",
    "previous_duration",
    "TollFreeNumber",
]


def factorised(sequence: DataFrame) -> FactorisedSequence:
    """An enriched sequence of 17 columns, computed or read elsewhere, as steps and callers."""
    step = [name for name in sequence.columns if name not in ("count", *_CALLER_COLUMNS)]
    ordinary = F.when(F.col("TollFreeNumber") == NOT_TOLL_FREE, F.col("count"))
    steps = sequence.groupBy(*step).agg(
        F.sum("count").alias("count"), F.coalesce(F.sum(ordinary), F.lit(0)).alias("ordinary_count")
    )
    called = sequence.filter(F.col("CallingNumber").isNotNull())
    return FactorisedSequence(steps, called.select("user_id", *_CALLER_COLUMNS).distinct())


def restrict_window(sequence: DataFrame, start=None, end=None) -> DataFrame:
    """Steps strictly after midnight of `start` and strictly before midnight of `end`.

    Where there is a `date` column its bounds follow: a stored sequence is partitioned by it.
    """
    day = F.col("date") if "date" in sequence.columns else F.to_date("time_event")
    if start is not None:
        first = F.lit(as_date(start))
        sequence = sequence.filter((F.col("time_event") > first) & (day >= first))
    if end is not None:
        last = F.lit(as_date(end))
        sequence = sequence.filter((F.col("time_event") < last) & (day < last))
    return sequence


def restrict_tollfree(sequence: DataFrame, include: bool = False) -> DataFrame:
    """All steps, or only those of sessions with an ordinary number.

    Leaving toll-free numbers out also leaves out sessions without a known caller.
    """
    if include:
        return sequence
    return sequence.filter(F.col("TollFreeNumber") == NOT_TOLL_FREE)


@dataclass(frozen=True)
class FilterCounts:
    """Rows around the toll-free filter, known once an action has run over the filtered sequence."""

    before: Observation
    after: Observation

    @property
    def rows_before(self) -> int:
        return self.before.get["rows"]

    @property
    def rows_after(self) -> int:
        return self.after.get["rows"]


def restrict_counted(
    sequence: DataFrame, start=None, end=None, include_tollfree: bool = False
) -> tuple[DataFrame, FilterCounts]:
    """`restrict_window` and `restrict_tollfree`, with the rows before and after the latter.

    They are counted while the result is computed, in the same job; the window still reaches the scan.
    """
    counts = FilterCounts(Observation(), Observation())
    rows = F.count(F.lit(1)).alias("rows")
    shown = restrict_window(sequence, start, end).observe(counts.before, rows)
    return restrict_tollfree(shown, include_tollfree).observe(counts.after, rows), counts


def _checked(pct: float) -> float:
    if not 0 <= pct <= 100:
        raise ValueError("percentages must be between 0 and 100")
    return pct


def _date_between(first: Column, last: Column, pct: float) -> Column:
    """The date at `pct` percent of the way from `first` to `last`."""
    return F.to_date(first + (last - first) * F.lit(_checked(pct) / 100))


def _extent(sequence: DataFrame) -> DataFrame:
    known = "time_event" not in sequence.columns
    first, last = ("first", "last") if known else ("time_event", "time_event")
    return sequence.agg(F.min(first).alias("first"), F.max(last).alias("last"))


def date_at_percent(sequence: DataFrame, pct: float) -> DataFrame:
    """One row with the `date` at `pct` percent between the first and the last step.

    `sequence` is anything with `time_event`, or the `extent` that stands for it: one row per day, or
    per stored sequence, with `first` and `last`. Without steps the date is null.
    """
    at = _date_between(F.col("first"), F.col("last"), pct)
    return _extent(sequence).select(at.alias("date"))


def dates_at_percents(
    sequence: DataFrame, low: float, high: float
) -> tuple[dt.date, dt.date] | tuple[None, None]:
    """Both ends of a percentage range as dates, from one pass; (None, None) without steps."""
    first, last = F.col("first"), F.col("last")
    both = [_date_between(first, last, pct).alias(name) for name, pct in (("a", low), ("b", high))]
    return tuple(_extent(sequence).select(*both).first())


def in_order(sequence: DataFrame) -> DataFrame:
    """The sequence sorted by session and time, for presentation."""
    return sequence.orderBy("user_id", "time_event", "rank_event")
