"""Weighted links and ordered nodes of a flow graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.freeze import BROADCAST_ROWS, fits, frozen, join_attributes
from trailmark.operators.ordered import number_rows

# Link colours.
HIGHLIGHT_COLOR = "#ed7953"
LINK_COLOR = "#d3d3d3"


def _weight(sequence: DataFrame) -> Column:
    """How often a step counts: its `count`, or once where there is none."""
    return F.col("count") if "count" in sequence.columns else F.lit(1).cast("long")


def flow_moves(sequence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Steps added up by (event_name, next_event, rank_event, *by): all a graph needs of them.

    A step counts as often as its `count` says, 1 in a flat sequence.
    """
    weight = _weight(sequence)
    timed = F.when(F.col("time_from_start").isNotNull(), weight)
    return sequence.groupBy("event_name", "next_event", "rank_event", *by).agg(
        F.sum(weight).alias("count"),
        F.sum(F.col("time_from_start") * weight).alias("seconds"),
        F.coalesce(F.sum(timed), F.lit(0)).alias("timed"),
    )


def flow_links(
    sequence: DataFrame, by: Sequence[str] = ("path_nickname",), sessions: bool = False
) -> DataFrame:
    """Links (source, target, *by) with `count` and the mean `time_from_start` at the source.

    Steps without a next event, or with a null in any key, make no link. `count` is transitions;
    `sessions` adds the distinct sessions beside it, at the price of a shuffle by session.
    """
    extra = [F.count_distinct("user_id").alias("sessions")] if sessions else []
    timed = F.when(F.col("time_from_start").isNotNull(), F.col("count"))
    seconds = F.sum(F.col("time_from_start") * F.col("count"))
    return _links(sequence, by, F.try_divide(seconds, F.sum(timed)), extra)


def links_of(moves: DataFrame, by: Sequence[str] = ("path_nickname",)) -> DataFrame:
    """The links of steps added up by `flow_moves` with the same `by`."""
    return _links(moves, by, F.try_divide(F.sum("seconds"), F.sum("timed")))


def _links(rows: DataFrame, by: Sequence[str], seconds: Column, extra=()) -> DataFrame:
    keys = ["source", "target", *by]
    ends = rows.withColumnsRenamed({"event_name": "source", "next_event": "target"})
    return (
        ends.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.sum("count").alias("count"), seconds.alias("time_from_start"), *extra)
    )


def flow_nodes(sequence: DataFrame) -> DataFrame:
    """Nodes (node_id, label, position): where in a session a label mostly stands.

    `position` is the most frequent `rank_event` of the label's steps, the lowest on ties. Labels
    that occur only as a next event follow after all others; their position is that of the step
    before. `node_id` numbers the nodes from 0 in this order.
    """
    # One pass over the sequence; the two ends are told apart on its few distinct moves.
    steps = F.sum(_weight(sequence)).alias("count")
    return nodes_of(sequence.groupBy("event_name", "next_event", "rank_event").agg(steps))


def nodes_of(moves: DataFrame) -> DataFrame:
    """The nodes of steps added up by `flow_moves`."""
    ends = F.explode(
        F.array(
            F.struct(F.lit(0).alias("_role"), F.col("event_name").alias("label")),
            F.struct(F.lit(1).alias("_role"), F.col("next_event").alias("label")),
        )
    )
    ranks = (
        moves.select(ends.alias("_end"), "rank_event", "count")
        .select("_end.*", "rank_event", "count")
        .filter(F.col("label").isNotNull())
        .groupBy("_role", "label", "rank_event")
        .agg(F.sum("count").alias("_n"))
    )
    modes = ranks.groupBy("_role", "label").agg(
        F.max(F.struct("_n", (-F.col("rank_event")).alias("_rank"))).alias("_mode")
    )
    best = F.min(F.struct("_role", (-F.col("_mode._rank")).alias("position"))).alias("_best")
    labels = modes.groupBy("label").agg(best).select("label", "_best.*")
    order = [F.col("_role"), F.col("position"), F.col("label")]
    numbered = number_rows(labels, order, "_at")
    return numbered.select((F.col("_at") - 1).alias("node_id"), "label", "position")


def link_ids(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the node ids of both ends as sourceID and targetID."""
    ids = nodes.select("node_id", "label")
    small = fits(ids, BROADCAST_ROWS)
    source = ids.toDF("sourceID", "source")
    target = ids.toDF("targetID", "target")
    # Many links share an end, so neither join may shuffle by label alone.
    with_source = join_attributes(links, source, "source", "inner", small)
    return join_attributes(with_source, target, "target", "inner", small)


def threshold_links(
    links: DataFrame, min_count: int | None = None, pct: float | None = None
) -> DataFrame:
    """Links with at least `min_count` transitions, or at least `pct` percent of the largest.

    For the largest the links are needed twice, so with `pct` they are frozen first.
    """
    if (min_count is None) == (pct is None):
        raise ValueError("give either min_count or pct")
    if min_count is not None:
        return links.filter(F.col("count") >= min_count)
    links = frozen(links)
    largest = links.agg(F.floor(F.max("count") * F.lit(pct / 100))).scalar()
    return links.filter(F.col("count") >= largest)


def highlight_path(links: DataFrame, nickname: str | None = "1-Path_Freq_Rank") -> DataFrame:
    """Links with a `color` that sets one path apart."""
    chosen = F.col("path_nickname").eqNullSafe(F.lit(nickname)) & F.lit(nickname is not None)
    return links.withColumn(
        "color", F.when(chosen, F.lit(HIGHLIGHT_COLOR)).otherwise(F.lit(LINK_COLOR))
    )
