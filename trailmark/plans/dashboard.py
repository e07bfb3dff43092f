"""The frames of one dashboard refresh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from trailmark.plans.flowgraph import flow_graph
from trailmark.plans.sequence import dates_at_percents, restrict_tollfree, restrict_window
from trailmark.plans.trends import (
    callback_trend,
    daily_event_trend,
    top_path_trend_from_sequence,
)


@dataclass(frozen=True)
class DashboardFrames:
    nodes: DataFrame
    links: DataFrame
    totals: DataFrame
    top_paths: DataFrame
    callbacks: DataFrame


def dashboard_frames(
    sequence: DataFrame,
    dates_pct: tuple[float, float] = (0, 100),
    include_tollfree: bool = True,
    threshold_pct: float | None = None,
    highlight: str | None = "1-Path_Freq_Rank",
) -> DashboardFrames:
    """Graph, totals, top paths and callbacks of one materialised sequence.

    The date range and the toll-free switch narrow all frames but the totals, which always show the
    whole sequence. Of an empty sequence all frames are empty. To draw many refreshes, `summarise` the
    sequence once and use `refreshed_at`, which gives the same frames without reading it.
    """
    start, end = dates_at_percents(sequence, *dates_pct)
    shown = restrict_tollfree(restrict_window(sequence, start, end), include_tollfree)
    nodes, links = flow_graph(shown, pct=threshold_pct, highlight=highlight)
    return DashboardFrames(
        nodes=nodes,
        links=links,
        totals=daily_event_trend(sequence),
        top_paths=top_path_trend_from_sequence(shown),
        callbacks=callback_trend(shown),
    )
