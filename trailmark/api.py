"""One flow over one date range: the panels of the dashboard as DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from trailmark.functions.dates import DEFAULT_START, as_date
from trailmark.operators.graph import highlight_path, threshold_links
from trailmark.plans.dashboard import DashboardFrames
from trailmark.plans.flowgraph import flow_graph
from trailmark.plans.sequence import (
    dates_at_percents,
    restrict_tollfree,
    restrict_window,
    user_sequence,
)
from trailmark.plans.summary import SequenceSummary, refreshed_at, summarise
from trailmark.plans.trends import (
    callback_trend,
    daily_event_trend,
    top_path_trend_from_sequence,
)
from trailmark.sources.tables import store_sequence, stored_extent, stored_sequence


class Flow:
    """The sequence of a flow and the frames drawn from it.

    `events` is a unified log. The sequence is computed once, on first use: written into the
    folder `store` when one is given, persisted in the session otherwise. A store holds sequences
    of many flows; one of the same flow and dates is read from it instead of being computed again,
    unless `refresh` asks for a new one.
    """

    def __init__(
        self,
        events: DataFrame,
        flow_name: str,
        start_date: dt.date | str | None = None,
        end_date: dt.date | str | None = None,
        include_tollfree: bool = False,
        store: str | None = None,
        refresh: bool = False,
    ) -> None:
        self.flow_name = flow_name
        self.start_date = as_date(start_date, DEFAULT_START)
        self.end_date = as_date(end_date, dt.date.today())
        self.include_tollfree = include_tollfree
        self.path_highlight: str | None = "1-Path_Freq_Rank"
        self._events = events
        self._store = store
        self._refresh = refresh
        self._sequence: DataFrame | None = None
        self._summary: SequenceSummary | None = None
        self._graph: tuple[DataFrame, DataFrame] | None = None
        self._dates: tuple[dt.date, dt.date] | None = None
        self._threshold: dict[str, float] = {}

    @classmethod
    def from_sequence(cls, sequence: DataFrame, flow_name: str = "", **options) -> Flow:
        """A flow over a sequence computed or read elsewhere."""
        flow = cls(sequence, flow_name, **options)
        flow._sequence = sequence
        return flow

    @property
    def spark(self) -> SparkSession:
        return self._events.sparkSession

    @property
    def sequence(self) -> DataFrame:
        """The enriched sequence of the flow and its dates, both ends included."""
        if self._sequence is None:
            self._sequence = self._kept()
        return self._sequence

    def _kept(self) -> DataFrame:
        chosen = self.flow_name, self.start_date, self.end_date
        if self._store and not self._refresh:
            found = stored_sequence(self.spark, self._store, *chosen)
            if found is not None:
                return found
        made = user_sequence(self._events, *chosen)
        return store_sequence(made, self._store, *chosen) if self._store else made.persist()

    def user_sequence(self, start_date=None, end_date=None) -> DataFrame:
        """The sequence strictly between midnights, without toll-free callers unless included."""
        narrowed = restrict_window(self.sequence, start_date, end_date)
        return restrict_tollfree(narrowed, self.include_tollfree)

    def set_tollfree_toggle(self, value: bool) -> None:
        self.include_tollfree = value
        self._forget_graph()

    def date_at_percent(self, percentage: float) -> dt.date | None:
        """The date that far between the first and the last step; None without steps.

        With a store the two are in its index, and no step is read.
        """
        extent, sequence = None, self.sequence
        if self._store:
            chosen = self.flow_name, self.start_date, self.end_date
            extent = stored_extent(self.spark, self._store, *chosen)
        return dates_at_percents(sequence if extent is None else extent, percentage, percentage)[0]

    @property
    def summary(self) -> SequenceSummary:
        """The daily sums of the sequence, made once, on first use."""
        if self._summary is None:
            self._summary = summarise(self.sequence)
        return self._summary

    def refresh(
        self, dates_pct: tuple[float, float] = (0, 100), threshold_pct: float | None = None
    ) -> DashboardFrames:
        """All frames for a date slider, the toll-free switch and the highlight, from daily sums."""
        return refreshed_at(
            self.summary,
            dates_pct,
            include_tollfree=self.include_tollfree,
            threshold_pct=threshold_pct,
            highlight=self.path_highlight,
        )

    def flow_graph(self, start_date=None, end_date=None) -> tuple[DataFrame, DataFrame]:
        """(nodes, links) of the steps between the dates; the flow's own by default.

        The other panels follow these dates from then on.

        The links are kept, so a new threshold or highlight only filters and colours them.
        """
        self._dates = as_date(start_date, self.start_date), as_date(end_date, self.end_date)
        self._threshold = {}
        self._forget_graph()
        nodes, links = self._built()
        return nodes, self._coloured(links)

    def _built(self) -> tuple[DataFrame, DataFrame]:
        if self._graph is None:
            nodes, links = flow_graph(self.user_sequence(*self._shown_dates()))
            self._graph = nodes.persist(), links.persist()
        return self._graph

    def _forget_graph(self) -> None:
        for frame in self._graph or ():
            frame.unpersist()
        self._graph = None

    def _shown_dates(self) -> tuple[dt.date, dt.date]:
        return self._dates or (self.start_date, self.end_date)

    def links_over(self, threshold: int) -> DataFrame:
        """Links with at least `threshold` transitions, also after another highlight."""
        self._threshold = {"min_count": threshold}
        return self._coloured(self._links())

    def links_over_percent(self, pct: float) -> DataFrame:
        """Links with at least `pct` percent of the transitions of the largest, as `links_over`."""
        self._threshold = {"pct": pct}
        return self._coloured(self._links())

    def highlight(self, path_nickname: str | None) -> DataFrame:
        """Links with another path set apart, over the threshold last asked for."""
        self.path_highlight = path_nickname
        return self._coloured(self._links())

    def _links(self) -> DataFrame:
        links = self._built()[1]
        return threshold_links(links, **self._threshold) if self._threshold else links

    def _coloured(self, links: DataFrame) -> DataFrame:
        return highlight_path(links, self.path_highlight)

    def callback_analysis(self) -> DataFrame:
        return callback_trend(self.user_sequence(*self._shown_dates()))

    def top_paths(self, k: int = 10) -> DataFrame:
        shown = self.user_sequence(*self._shown_dates())
        return top_path_trend_from_sequence(shown, k)

    def daily_events(self) -> DataFrame:
        """Steps per day of the whole sequence, whatever the toll-free switch."""
        return daily_event_trend(self.sequence)
