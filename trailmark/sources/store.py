"""A sequence that grows by days: only the days that new events touch are written again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.callers import callbacks, caller_sessions
from trailmark.operators.events import filter_events
from trailmark.operators.freeze import frozen
from trailmark.operators.ordered import GROUP_ROWS
from trailmark.operators.paths import (
    keyed_paths,
    name_paths,
    path_frequencies,
    rank_paths,
    session_paths,
)
from trailmark.operators.steps import step_metrics
from trailmark.plans.sequence import public_sequence

# Tasks that write the rows of one day, and the files it has at most.
FILES_OF_DAY = 8


class SequenceStore:
    """The enriched sequence of some flows in tables below `path`, extended by `add`.

    `steps` and `calls` are partitioned by the day of the step and of a session's first call,
    `sessions`, with their paths, by the day they start. `ranks` has one version of the path ranks per
    addition, since a new day may change them all; the newest complete one counts, and the `keep`
    newest are kept, so that readers of an earlier one can finish. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, flows=None, keep: int = 2) -> None:
        if keep < 1:
            raise ValueError("keep at least one version of the ranks")
        self.spark, self.path, self.flows, self.keep = spark, path, flows, keep

    def add(self, events: DataFrame, group_rows: int | None = GROUP_ROWS) -> list[dt.date]:
        """Add a unified log of new events; returns the days whose steps were written.

        Sessions that reach from stored days into the new events are sequenced anew with their stored
        steps, and the days they touch are written again. An event added twice is there twice.
        """
        new = frozen(filter_events(events, self.flows).filter(F.col("SessionId").isNotNull()))
        ids = new.select("SessionId").distinct()
        sessions = self._table("sessions")
        if sessions is None:
            touched, rows = ids, new
        else:
            known = sessions.join(ids, "SessionId", "left_semi")
            spans = known.select("SessionId", "date", F.to_date("End").alias("last"))
            days = F.explode(F.sequence("date", "last", F.expr("interval 1 day")))
            # One row per day that a continued session may have steps on.
            old_days = [row[0] for row in spans.select(days.alias("day")).distinct().collect()]
            steps = self._table("steps").filter(F.col("date").isin(old_days))
            continued = steps.join(spans.select("SessionId"), "SessionId", "left_semi")
            rows = frozen(new.unionByName(continued.select(new.columns)))
            touched = frozen(ids)
        steps = step_metrics(rows, group_rows=group_rows).withColumn("date", F.to_date("TimeStamp"))
        paths = keyed_paths(session_paths(rows, group_rows=group_rows, with_end=True))
        written = self._replace("steps", steps, touched)
        self._replace("sessions", paths.withColumn("date", F.to_date("TimeStamp")), touched)
        calls = caller_sessions(rows).withColumn("date", F.to_date("TimeStamp"))
        self._replace("calls", calls, touched)
        self._rank()
        return written

    def sequence(self, group_rows: int | None = GROUP_ROWS) -> DataFrame:
        """The enriched sequence of all events added, as `user_sequence` makes it."""
        ranks = self._table(f"ranks/{self._versions()[-1]}")
        sessions = self._table("sessions").select("SessionId", "PathKey")
        names = name_paths(sessions, ranks).select("SessionId", "path_nickname")
        calls = callbacks(self._table("calls").drop("date"), group_rows).drop("TimeStamp")
        steps = self._table("steps").drop("CallingNumber", "date")
        return public_sequence(steps.join(names, "SessionId").join(calls, "SessionId", "left"))

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _replace(self, name: str, rows: DataFrame, touched: DataFrame) -> list[dt.date]:
        """Write the days of `rows`, and those on which `touched` sessions were stored before."""
        stored, rows = self._table(name), frozen(rows)
        left = {row[0] for row in rows.select("date").distinct().collect()}
        days = set(left)
        if stored is not None:
            before = stored.join(touched, "SessionId", "left_semi").select("date").distinct()
            days |= {row[0] for row in before.collect()}
            others = stored.filter(F.col("date").isin(list(days)))
            others = others.join(touched, "SessionId", "left_anti")
            # The files below are replaced: what is kept of them is written elsewhere first.
            others = frozen(others.select(rows.columns))
            left |= {row[0] for row in others.select("date").distinct().collect()}
            rows = rows.unionByName(others)
        # A day is written by several tasks, however large it is.
        part = F.pmod(F.xxhash64("SessionId"), F.lit(FILES_OF_DAY))
        writer = rows.repartition("date", part).write.mode("overwrite").partitionBy("date")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")
        for day in days - left:
            self._delete(f"{name}/date={day}")
        return sorted(days)

    def _rank(self) -> None:
        ranks = rank_paths(path_frequencies(self._table("sessions")))
        versions = self._versions()
        number = int(versions[-1].split("=")[1]) + 1 if versions else 1
        ranks.write.parquet(f"{self.path}/ranks/version={number}")
        for name in self._versions()[: -self.keep]:
            self._delete(f"ranks/{name}")

    def _versions(self) -> list[str]:
        """Complete versions of the ranks, oldest first."""
        found = self._files(lambda fs, at: [entry.getPath() for entry in fs.listStatus(at)], "ranks")
        done = [p for p in found if self._files(lambda fs, at: fs.exists(at), f"ranks/{p.getName()}/_SUCCESS")]
        return sorted((p.getName() for p in done), key=lambda name: int(name.split("=")[1]))

    def _delete(self, name: str) -> None:
        self._files(lambda fs, at: fs.delete(at, True), name)

    def _files(self, action: Callable, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return action(fs, at) if fs.exists(at) else []
