"""Session paths, their frequencies and frequency ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import PATH_SEPARATOR, path_key, path_nickname, whole_seconds
from trailmark.operators.events import event_order, tie_break
from trailmark.operators.ordered import (
    GROUP_ROWS,
    Heavy,
    heavy_keys,
    number_rows,
    numbered,
    ordered_metrics,
)

# Labels per piece of a heavy session's path.
PIECE_STEPS = 100_000

# Paths joined by broadcast because many sessions share them: at most this many keys.
FREQUENT_PATHS = 1_000
# Top paths that one task numbers; more are numbered by a range sort.
TOP_IN_ONE_TASK = 10_000


def session_paths(
    events: DataFrame,
    keys: Sequence[str] = ("SessionId",),
    group_rows: int | None = GROUP_ROWS,
    with_end: bool = False,
) -> DataFrame:
    """One row per session: its start, duration in seconds and path of labels in time order.

    Null labels are left out of the path; a session with no label at all has a null path.
    `with_end` adds the time of the last event as `End`.

    A heavy session's path is joined from pieces. A path is the text of all its labels for every
    session, however large, so equal paths are equal; like any value of a row it ends at 2 GB, and
    `path_pieces` gives longer ones.
    """
    return paths_of(events, keys, heavy_keys(events, keys, group_rows), with_end=with_end)


def paths_of(
    events: DataFrame,
    keys: Sequence[str],
    heavy: Heavy | None,
    piece_steps: int = PIECE_STEPS,
    with_end: bool = False,
) -> DataFrame:
    if heavy is None:
        return paths_of_parts(events, None, keys, None, piece_steps, with_end)
    return paths_of_parts(*heavy.split(events, keys), keys, heavy, piece_steps, with_end)


def paths_of_parts(
    ordinary: DataFrame,
    large: DataFrame | None,
    keys: Sequence[str],
    heavy: Heavy | None,
    piece_steps: int = PIECE_STEPS,
    with_end: bool = False,
) -> DataFrame:
    """The paths of ordinary and of heavy sessions whose events have been told apart."""
    paths = _short_paths(ordinary, keys, with_end)
    if heavy is None:
        return paths
    return paths.unionByName(_long_paths(large, keys, heavy, piece_steps, with_end))


def _span(with_end: bool):
    start, end = F.min("TimeStamp"), F.max("TimeStamp")
    span = [start.alias("TimeStamp"), whole_seconds(start, end).alias("Duration")]
    return span + [end.alias("End")] if with_end else span


def _short_paths(events: DataFrame, keys, with_end: bool) -> DataFrame:
    # One aggregate per session, in place of a running string per event and a rank filter.
    tie = tie_break(events)
    path = F.expr(f"listagg(ActionId, '{PATH_SEPARATOR}') WITHIN GROUP (ORDER BY TimeStamp, {tie})")
    return events.groupBy(*keys).agg(*_span(with_end), path.alias("Path"))


def path_pieces(
    events: DataFrame,
    keys: Sequence[str] = ("SessionId",),
    heavy: Heavy | None = None,
    piece_steps: int = PIECE_STEPS,
) -> DataFrame:
    """The path text of each session in pieces of `piece_steps` labels, numbered from 0."""
    labelled = events.filter(F.col("ActionId").isNotNull())
    steps = ordered_metrics(
        labelled, keys, event_order(events), {"_step": numbered()}, heavy
    ).withColumn("piece", F.floor((F.col("_step") - 1) / piece_steps))
    text = F.expr(f"listagg(ActionId, '{PATH_SEPARATOR}') WITHIN GROUP (ORDER BY _step)")
    return steps.groupBy(*keys, "piece").agg(text.alias("text"))


def _long_paths(events, keys, heavy: Heavy, piece_steps: int, with_end: bool) -> DataFrame:
    pieces = path_pieces(events, keys, heavy, piece_steps)
    text = F.expr(f"listagg(text, '{PATH_SEPARATOR}') WITHIN GROUP (ORDER BY piece)")
    paths = pieces.groupBy(*keys).agg(text.alias("Path"))
    spans = events.groupBy(*keys).agg(*_span(with_end))
    renamed = paths.toDF(*[f"_{key}" for key in keys], "Path")
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    return spans.join(renamed, same, "left").select(*spans.columns, "Path")


def keyed_paths(paths: DataFrame) -> DataFrame:
    """`paths` with `PathKey`: 32 bytes that stand for the path's text, null for the null path.

    Written beside the text, it lets joins read and shuffle the key alone.
    """
    return paths.withColumn("PathKey", path_key(F.col("Path")))


def _with_key(paths: DataFrame) -> DataFrame:
    return paths if "PathKey" in paths.columns else keyed_paths(paths)


def path_frequencies(paths: DataFrame) -> DataFrame:
    """Sessions per path; the null path is a group of its own."""
    return paths.groupBy("Path").agg(F.count("TimeStamp").alias("count"))


def _frequency_order():
    return [F.col("count").desc(), F.col("Path").asc_nulls_last()]


def rank_paths(frequencies: DataFrame, top_k: int | None = None) -> DataFrame:
    """Paths with `rank` and `nickname`, most frequent first and ties by path.

    With a small `top_k` only that many are sorted and numbered; otherwise paths are ranked by a
    range sort, with no single task seeing them all.
    """
    if top_k is None or top_k > TOP_IN_ONE_TASK:
        ranked = number_rows(frequencies, _frequency_order(), "rank")
        if top_k is not None:
            ranked = ranked.filter(F.col("rank") <= top_k)
    else:
        top = frequencies.orderBy(*_frequency_order()).limit(top_k)
        numbers = F.row_number().over(Window.orderBy(*_frequency_order())).cast("long")
        ranked = top.withColumn("rank", numbers)
    return ranked.withColumn("nickname", path_nickname(F.col("rank")))


def name_paths(paths: DataFrame, ranks: DataFrame) -> DataFrame:
    """Sessions with the nickname of their path; those with a null path drop out.

    Sessions meet the ranks by the fixed-width key of their path, so neither side shuffles text and a
    path's length does not matter. The most frequent paths, at most FREQUENT_PATHS keys, are joined by
    broadcast; their sessions pass the shuffle that follows under keys of their own, and so spread. A
    path ranked below them holds less than a FREQUENT_PATHS-th of the sessions.
    """
    names = ranks.select(path_key(F.col("Path")).alias("_key"), "rank", "nickname")
    often = names.filter(F.col("rank") <= FREQUENT_PATHS).select(
        "_key", F.col("nickname").alias("_often")
    )
    seldom = names.filter(F.col("rank") > FREQUENT_PATHS).select(
        F.col("_key").alias("_other_key"), F.col("nickname").alias("_seldom")
    )
    keyed = _with_key(paths).filter(F.col("PathKey").isNotNull())
    marked = keyed.join(F.broadcast(often), F.col("PathKey") == F.col("_key"), "left")
    own = F.concat(F.lit("session "), F.coalesce("SessionId", F.lit(""))).cast("binary")
    met = F.when(F.col("_often").isNull(), F.col("PathKey")).otherwise(own)
    named = marked.join(seldom, met == F.col("_other_key"), "left")
    columns = [name for name in paths.columns if name != "PathKey"]
    return named.select(
        *columns, F.coalesce("_often", "_seldom").alias("path_nickname")
    ).filter(F.col("path_nickname").isNotNull())


def sessions_on(paths: DataFrame, top: DataFrame, nickname: str) -> DataFrame:
    """Distinct sessions whose path is the one with `nickname` among the `top` ranked paths."""
    # A nickname is one path's: one key.
    chosen = top.filter(F.col("nickname") == nickname).select(path_key(F.col("Path")).alias("PathKey"))
    keyed = _with_key(paths.drop("Duration"))
    return keyed.join(F.broadcast(chosen), "PathKey", "left_semi").select("SessionId").distinct()
