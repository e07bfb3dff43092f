"""Mergeable daily sums of a sequence, from which every dashboard refresh is drawn.

A slider, the toll-free switch, a threshold or a highlight choose among days, classes and links; none
of them changes what a step, a session or a link of one day is. So steps are added up once per day,
path and link, and sessions once per day and path or class, and a refresh merges those rows. Their
number depends on days, paths and labels and not on steps.

Windows are strict, so on the first day shown the steps of exactly midnight are left out, and with them
sessions that have no other step that day. Both are kept apart for every day.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.columns import NOT_TOLL_FREE
from trailmark.functions.dates import as_date
from trailmark.operators.daily import CALLBACK_METRICS
from trailmark.operators.freeze import BROADCAST_ROWS, frozen
from trailmark.plans.dashboard import DashboardFrames
from trailmark.plans.flowgraph import graph_of
from trailmark.plans.sequence import FactorisedSequence, dates_at_percents, factorised
from trailmark.plans.trends import TOP_PATHS, rolled_callbacks, rolled_events, rolled_top_paths

_WEIGHED = ("count", "seconds", "timed")


@dataclass(frozen=True)
class SequenceSummary:
    """Daily sums of one sequence; every table has a `date`.

    `moves`: steps by (at_midnight, path_nickname, event_name, next_event, rank_event) as `count`,
    `seconds` and `timed`, for all rows and, behind `ordinary_`, those with an ordinary number.
    `paths`: sessions by (whole_day, ordinary_only, path_nickname) with the sum and number of their mean
    durations. `callbacks`: the same by (whole_day, TollFreeNumber) for the callback metrics.
    `totals`: rows by FlowName. `extent`: first and last step.
    """

    moves: DataFrame
    paths: DataFrame
    callbacks: DataFrame
    totals: DataFrame
    extent: DataFrame

    def write(self, path: str) -> SequenceSummary:
        """The tables below `path`, partitioned by date, and read back from there."""
        for field in fields(self):
            table = getattr(self, field.name).repartition("date")
            table.write.mode("overwrite").partitionBy("date").parquet(f"{path}/{field.name}")
        return self._read(path)

    def _read(self, path: str) -> SequenceSummary:
        tables = {}
        for field in fields(self):
            table = getattr(self, field.name)
            stored = table.sparkSession.read.schema(table.schema).parquet(f"{path}/{field.name}")
            tables[field.name] = stored.select(table.columns)
        return SequenceSummary(**tables)

    def merged(self, other: SequenceSummary) -> SequenceSummary:
        """Both summaries together, of sequences whose sessions share no day and path names agree."""
        pairs = {f.name: (getattr(self, f.name), getattr(other, f.name)) for f in fields(self)}
        return SequenceSummary(**{name: a.unionByName(b) for name, (a, b) in pairs.items()})


def read_summary(spark: SparkSession, path: str) -> SequenceSummary:
    """A summary that `SequenceSummary.write` has written."""
    return SequenceSummary(
        **{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(SequenceSummary)}
    )


def summarise(sequence: DataFrame | FactorisedSequence) -> SequenceSummary:
    """The daily sums of a sequence, written to the checkpoint folder.

    The steps are read for links, for session days and for totals; a flat sequence is factorised first.
    """
    parts = sequence if isinstance(sequence, FactorisedSequence) else factorised(sequence)
    parts = parts.written()
    steps, callers = parts.steps, parts.callers
    midnight = F.col("time_event") == F.date_trunc("day", "time_event")
    days = frozen(
        steps.groupBy("user_id", "date", "path_nickname").agg(
            F.max(~midnight).alias("_later"), F.max(F.col("ordinary_count") > 0).alias("_ordinary")
        )
    )
    sums = SequenceSummary(
        moves=_moves(steps, midnight),
        paths=_path_days(days, callers),
        callbacks=_callback_days(days, callers),
        totals=steps.groupBy("date", "FlowName").agg(F.sum("count").alias("count")),
        extent=steps.groupBy("date").agg(
            F.min("time_event").alias("first"), F.max("time_event").alias("last")
        ),
    )
    return SequenceSummary(**{f.name: frozen(getattr(sums, f.name)) for f in fields(sums)})


def _moves(steps: DataFrame, midnight: Column) -> DataFrame:
    seconds, timed = F.col("time_from_start"), F.col("time_from_start").isNotNull()
    measures = []
    for front in ("", "ordinary_"):
        weight = F.col(f"{front}count")
        measures += [
            F.sum(weight).alias(f"{front}count"),
            F.sum(seconds * weight).alias(f"{front}seconds"),
            F.coalesce(F.sum(F.when(timed, weight)), F.lit(0)).alias(f"{front}timed"),
        ]
    keys = ["path_nickname", "event_name", "next_event", "rank_event"]
    return steps.groupBy("date", midnight.alias("at_midnight"), *keys).agg(*measures)


def _path_days(days: DataFrame, callers: DataFrame) -> DataFrame:
    ordinary = F.when(F.col("TollFreeNumber") == NOT_TOLL_FREE, F.col("session_duration"))
    means = callers.groupBy("user_id").agg(
        F.avg("session_duration").alias("_all"), F.avg(ordinary).alias("_ordinary_mean")
    )
    shown = [
        F.struct(
            F.lit(whole).alias("whole_day"),
            F.lit(only).alias("ordinary_only"),
            (F.col("_ordinary_mean") if only else F.col("_all")).alias("mean"),
            ((F.lit(whole) | F.col("_later")) & (F.lit(not only) | F.col("_ordinary"))).alias("in"),
        )
        for whole in (True, False)
        for only in (True, False)
    ]
    each = days.join(means, "user_id", "left").select(
        "date", "path_nickname", F.explode(F.filter(F.array(*shown), lambda x: x["in"])).alias("s")
    )
    return each.groupBy("date", "s.whole_day", "s.ordinary_only", "path_nickname").agg(
        F.sum("s.mean").alias("sum_duration"),
        F.count("s.mean").alias("timed"),
        F.count(F.lit(1)).alias("sessions"),
    )


def _callback_days(days: DataFrame, callers: DataFrame) -> DataFrame:
    means = callers.groupBy("user_id", "TollFreeNumber").agg(
        *[F.avg(column).alias(column) for column in CALLBACK_METRICS]
    )
    # A session has one path, so `days` has one row per session and day.
    whole = F.explode(F.when(F.col("_later"), F.array(F.lit(True), F.lit(False))).otherwise(
        F.array(F.lit(True))
    ))
    each = days.join(means, "user_id").withColumn("whole_day", whole)
    sums = [
        column
        for name in CALLBACK_METRICS
        for column in (F.sum(name).alias(f"sum_{name}"), F.count(name).alias(f"n_{name}"))
    ]
    return each.dropna(subset=["TollFreeNumber"]).groupBy(
        "date", "whole_day", "TollFreeNumber"
    ).agg(*sums, F.count(F.lit(1)).alias("sessions"))


def _added_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of all measures of `rows`, which may come from several summaries."""
    measures = [name for name, kind in rows.dtypes if name not in keys and kind in ("bigint", "double")]
    return rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in measures])


def refreshed(
    summary: SequenceSummary,
    start=None,
    end=None,
    include_tollfree: bool = True,
    threshold_pct: float | None = None,
    highlight: str | None = "1-Path_Freq_Rank",
    k: int = TOP_PATHS,
) -> DashboardFrames:
    """The frames of `dashboard_frames` between two midnights, merged from daily sums.

    Without steps between the dates all frames but the totals are empty.
    """
    day, first = F.col("date"), F.lit(None if start is None else as_date(start))
    from_start = F.lit(True) if start is None else day >= first
    within = from_start if end is None else from_start & (day < F.lit(as_date(end)))
    on_first = F.lit(False) if start is None else day == first

    front = "" if include_tollfree else "ordinary_"
    chosen = summary.moves.filter(within & ~(on_first & F.col("at_midnight")))
    moves = frozen(
        chosen.groupBy("path_nickname", "event_name", "next_event", "rank_event")
        .agg(*[F.sum(f"{front}{name}").alias(name) for name in _WEIGHED])
        .filter("count > 0")
    )
    nodes, links = graph_of(moves, pct=threshold_pct, highlight=highlight)

    whole = F.col("whole_day") == ~on_first
    counts = moves.groupBy("path_nickname").agg(F.sum("count").alias("_rows"))
    top = counts.orderBy(F.col("_rows").desc(), "path_nickname").limit(k).select("path_nickname")
    days = summary.paths.filter(within & whole & (F.col("ordinary_only") != include_tollfree))
    days = days.join(F.broadcast(top) if k <= BROADCAST_ROWS else top, "path_nickname", "left_semi")
    days = _added_up(days, ["path_nickname", "date"]).select(
        "path_nickname",
        "date",
        F.try_divide("sum_duration", "timed").alias("avg_duration"),
        F.col("sessions").alias("count"),
    )

    callers = summary.callbacks.filter(within & whole)
    if not include_tollfree:
        callers = callers.filter(F.col("TollFreeNumber") == NOT_TOLL_FREE)
    callers = _added_up(callers, ["TollFreeNumber", "date"]).select(
        "TollFreeNumber",
        "date",
        *[
            F.try_divide(f"sum_{column}", f"n_{column}").alias(name)
            for column, name in CALLBACK_METRICS.items()
        ],
        F.col("sessions").alias("count"),
    )
    totals = _added_up(summary.totals, ["date", "FlowName"])
    return DashboardFrames(
        nodes=nodes,
        links=links,
        totals=rolled_events(totals),
        top_paths=rolled_top_paths(days),
        callbacks=rolled_callbacks(callers),
    )


def refreshed_at(
    summary: SequenceSummary, dates_pct: tuple[float, float] = (0, 100), **options
) -> DashboardFrames:
    """`refreshed` for a slider between 0 and 100 percent of the sequence's time."""
    return refreshed(summary, *dates_at_percents(summary.extent, *dates_pct), **options)


def merge_summaries(summaries: list[SequenceSummary]) -> SequenceSummary:
    return functools.reduce(SequenceSummary.merged, summaries)
