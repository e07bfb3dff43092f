"""Path keys, one-pass sequences, factorised sequences, daily sums, sketches and growing stores."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from contract.mapping import END, FLOWS, START, events_log, exit_events
from contract.queries import rounded
from tests.conftest import plan_of, rows
from trailmark.operators.freeze import clustered, fits, frozen
from trailmark.operators.paths import paths_of_parts
from trailmark.operators.sketches import relative_error
from trailmark.operators.steps import step_parts

LOG = """SessionId string, TimeStamp timestamp_ntz, ActionId string, CallingNumber string,
    CustomerId string, FlowName string, EventId long"""
MIDNIGHT = dt.datetime(2024, 1, 10)


@pytest.fixture(scope="module")
def events(spark, small):
    return frozen(events_log(spark, small))


@pytest.fixture(scope="module")
def kept(events):
    return frozen(tm.filter_events(events, FLOWS, START, END))


def log_of(spark, entries):
    """Events from (session, minutes after MIDNIGHT, label[, number])."""
    made = [
        (e[0], MIDNIGHT + dt.timedelta(minutes=e[1]), e[2], e[3] if len(e) > 3 else None, "1", "f", i)
        for i, e in enumerate(entries)
    ]
    return spark.createDataFrame(made, LOG)


def same(left, right):
    assert left.columns == right.columns or sorted(left.columns) == sorted(right.columns)
    assert rows(rounded(left.select(sorted(left.columns)))) == rows(
        rounded(right.select(sorted(right.columns)))
    )


def same_frames(left, right):
    for name in vars(left):
        same(getattr(left, name), getattr(right, name))


# Paths by key.


def test_long_path_of_half_the_sessions(spark):
    long = ";".join(f"label{i}" for i in range(2_500))
    assert len(long) > 20_000
    sessions = spark.range(4_000).select(
        F.col("id").cast("string").alias("SessionId"),
        F.lit(MIDNIGHT).alias("TimeStamp"),
        F.when(F.col("id") % 2 == 0, F.lit(long))
        .when(F.col("id") % 4 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("p"), F.col("id")))
        .alias("Path"),
    )
    paths = frozen(tm.keyed_paths(sessions))
    ranks = frozen(tm.rank_paths(tm.path_frequencies(paths)))
    named = tm.name_paths(paths.select("SessionId", "PathKey"), ranks)
    plan = plan_of(named)
    assert "Union" not in plan and "Path:string" not in plan.split("PathKey:binary")[1][:200]
    found = dict(named.groupBy("path_nickname").count().collect())
    assert found["1-Path_Freq_Rank"] == 2_000 and len(found) == 1_001
    assert named.filter("SessionId % 4 = 1").count() == 0
    # Sessions of the frequent path do not pile up behind the join.
    sizes = [row["count"] for row in named.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2_000 or len(sizes) == 1


def test_paths_are_equal_whatever_their_way(spark, monkeypatch):
    """A path beyond the broadcast limit and one within it, with and without a stored key."""
    monkeypatch.setattr("trailmark.operators.paths.FREQUENT_PATHS", 2)
    sessions = spark.createDataFrame(
        [(str(i), MIDNIGHT, f"p{i % 5}" if i % 7 else None) for i in range(60)],
        "SessionId string, TimeStamp timestamp_ntz, Path string",
    )
    ranks = tm.rank_paths(tm.path_frequencies(sessions))
    want = sessions.join(ranks.withColumnRenamed("nickname", "path_nickname"), "Path")
    want = rows(want.select("SessionId", "path_nickname"))
    assert rows(tm.name_paths(sessions, ranks).select("SessionId", "path_nickname")) == want
    keyed = tm.keyed_paths(sessions)
    assert rows(tm.name_paths(keyed, ranks).select("SessionId", "path_nickname")) == want


# One pass.


def test_steps_paths_and_callers_from_one_exchange(kept):
    events = clustered(kept, "SessionId")
    for frame in (
        step_parts(events, None)[0],
        paths_of_parts(events, None, ["SessionId"], None),
        tm.caller_sessions(events),
    ):
        assert "Exchange" not in plan_of(frame)
    assert rows(events) == rows(kept)


def test_one_exchange_by_session_in_the_sequence(events):
    plan = plan_of(tm.user_sequence(events, FLOWS, START, END))
    # Steps come from the clustered table: one window, no exchange below it.
    steps = plan.split("Window", 1)[1]
    assert "clustered_" in plan and plan.count("clustered_") <= 3
    assert "EventId" not in "".join(
        line for line in steps.splitlines() if "hashpartitioning" in line
    )


# Factorised.


def crowded(spark):
    entries = [("s", 3 * i, f"a{i % 3}") for i in range(40)]
    entries += [("s", 1, "call", f"+1{800 if i % 4 else 212}555{i:04}") for i in range(40)]
    entries += [("t", 5, "a1"), ("t", 6, "call", "+12125550000"), ("u", 7, "a1"), ("u", 1500, "a2")]
    return log_of(spark, entries)


def test_forty_steps_and_forty_numbers(spark):
    log = crowded(spark)
    parts = tm.factorised_sequence(log)
    of_s = [table.filter("user_id = 's'").count() for table in (parts.steps, parts.callers)]
    assert of_s == [80, 40]
    flat = frozen(tm.user_sequence(log))
    assert flat.filter("user_id = 's'").count() == 80 * 40
    for start, end, include in ((None, None, True), (None, None, False), ("2024-01-10", "2024-01-11", False)):
        shown = tm.restrict_tollfree(tm.restrict_window(flat, start, end), include)
        part = parts.restricted(start, end, include)
        same(tm.flow_links(shown), tm.flow_links(part.steps))
        same(tm.flow_nodes(shown), tm.flow_nodes(part.steps))
        same(tm.flow_graph(shown, pct=10)[1], tm.flow_graph(part.steps, pct=10)[1])
        same(tm.callback_trend(shown), tm.callback_trend(part.steps, part.callers))
        trends = (
            tm.top_path_trend_from_sequence(shown),
            tm.top_path_trend_from_sequence(part.steps, callers=part.callers),
        )
        same(*trends)
        same(tm.daily_event_trend(shown), tm.daily_event_trend(part.steps))
    again = tm.factorised(flat)
    same(again.steps, parts.steps)
    same(again.callers, parts.callers)


def test_factorised_heavy_sessions(spark):
    log = crowded(spark)
    usual, split = tm.factorised_sequence(log), tm.factorised_sequence(log, group_rows=10)
    same(usual.steps, split.steps)
    same(usual.callers, split.callers)


# Daily sums.


def around_midnight(spark):
    entries = []
    for day in range(6):
        for i in range(5):
            at = 1440 * day + (0 if i < 2 else 30 * i)
            number = [None, "+18005550001", "+12125550002", "Restricted", "+12125550003"][i]
            entries += [(f"{day}-{i}", at, f"a{i % 2}", number), (f"{day}-{i}", at + 90 * (i % 3), "b")]
        entries.append((f"m{day}", 1440 * day, "only at midnight", "+12125550004"))
    entries += [("over", 1400, "x", "+12125550005"), ("over", 1440, "y"), ("over", 2880, "z")]
    return log_of(spark, entries)


@pytest.mark.parametrize("include", [True, False])
def test_refreshes_without_the_sequence(spark, include):
    sequence = frozen(tm.user_sequence(around_midnight(spark)))
    summary = tm.summarise(sequence)
    place = sequence.inputFiles()[0].rsplit("/", 1)[0].split("table-")[1]
    for dates in ((0, 100), (10, 90), (30, 60), (17, 100), (50, 50)):
        want = tm.dashboard_frames(sequence, dates, include_tollfree=include, threshold_pct=20)
        got = tm.refreshed_at(summary, dates, include_tollfree=include, threshold_pct=20)
        same_frames(want, got)
        for name in vars(got):
            assert place not in plan_of(getattr(got, name))


def test_refresh_of_the_log(spark, kept, tmp_path):
    sequence = frozen(tm.user_sequence(kept))
    summary = tm.summarise(sequence).write(str(tmp_path / "sums"))
    again = tm.read_summary(spark, str(tmp_path / "sums"))
    for dates in ((0, 100), (25, 75)):
        want = tm.dashboard_frames(sequence, dates, include_tollfree=False)
        same_frames(want, tm.refreshed_at(summary, dates, include_tollfree=False))
        same_frames(want, tm.refreshed_at(again, dates, include_tollfree=False))


def test_summaries_merge(kept):
    sequence = frozen(tm.user_sequence(kept))
    day = F.col("date") < "2024-01-15"
    parts = [tm.summarise(sequence.filter(day)), tm.summarise(sequence.filter(~day))]
    merged = tm.merge_summaries(parts)
    same_frames(tm.dashboard_frames(sequence, (10, 80)), tm.refreshed_at(merged, (10, 80)))


def test_flow_refresh(events):
    flow = tm.Flow(events, "flow-0", START, END)
    flow.highlight("3-Path_Freq_Rank")
    want = tm.dashboard_frames(flow.sequence, (20, 70), False, 10, "3-Path_Freq_Rank")
    same_frames(want, flow.refresh((20, 70), threshold_pct=10))


def test_summary_of_nothing(events):
    sequence = tm.user_sequence(events, "no such flow", START, END)
    frames = tm.refreshed_at(tm.summarise(sequence))
    assert [getattr(frames, name).count() for name in vars(frames)] == [0] * 5


# Sketches.


def test_sketches_of_days_merge(spark, small):
    exits = exit_events(spark, small)
    exits = exits.unionByName(exits.withColumn("TimeStamp", F.expr("TimeStamp + interval 1 day")))
    sketches = frozen(tm.daily_session_sketches(exits))
    week = (dt.date(2024, 1, 8), dt.date(2024, 1, 14))
    within = exits.filter(F.to_date("TimeStamp").between(*week))
    exact = dict(within.groupBy("FlowName").agg(F.count_distinct("SessionId")).collect())
    found = tm.sketched_sessions(sketches, *week).collect()
    assert len(found) == len(exact) == 3
    for row in found:
        assert abs(row["sessions"] - exact[row["FlowName"]]) <= 3 * relative_error() * exact[row["FlowName"]]
        assert row["low"] <= exact[row["FlowName"]] <= row["high"]
    # Sessions of two days count once.
    added = tm.daily_sessions(within).groupBy("FlowName").agg(F.sum("count")).collect()
    assert all(total > exact[flow] for flow, total in added)


# A store that grows.


def modified(path):
    found = {}
    for folder, _, files in os.walk(path):
        for file in files:
            if file.endswith(".parquet"):
                found[os.path.join(folder, file)] = os.path.getmtime(os.path.join(folder, file))
    return found


def test_store_writes_the_new_days_only(spark, events, tmp_path):
    path = str(tmp_path / "store")
    store = tm.SequenceStore(spark, path, FLOWS)
    day = F.to_date("TimeStamp")
    store.add(events.filter(day < "2024-01-20"))
    before = {name: modified(f"{path}/{name}") for name in ("steps", "sessions", "calls")}
    first_ranks = modified(f"{path}/ranks")
    new = (dt.date(2024, 1, 20), dt.date(2024, 1, 21))
    assert store.add(events.filter(day.between(*new))) == list(new)
    for name, files in before.items():
        after = modified(f"{path}/{name}")
        assert files.items() <= after.items()
        folders = {os.path.basename(os.path.dirname(file)) for file in after.keys() - files.keys()}
        assert folders == {f"date={date}" for date in new}
    assert first_ranks.items() <= modified(f"{path}/ranks").items()
    same(store.sequence(), tm.user_sequence(events.filter(day <= "2024-01-21"), FLOWS))
    store.add(events.filter(day == "2024-01-22"))
    assert sorted(os.listdir(f"{path}/ranks")) == ["version=2", "version=3"]


def test_store_sessions_over_midnight(spark, tmp_path):
    log = around_midnight(spark)
    store = tm.SequenceStore(spark, str(tmp_path / "store"), keep=1)
    # Later events come first: a session's start moves to an earlier day, whose rows move with it.
    parts = [F.col("EventId") % 3 == 2, F.col("EventId") % 3 == 0, F.col("EventId") % 3 == 1]
    for part in parts:
        store.add(log.filter(part))
    same(store.sequence(), tm.user_sequence(log))
    store.add(log.filter("false"))
    same(store.sequence(), tm.user_sequence(log))
    assert os.listdir(tmp_path / "store" / "ranks") == ["version=4"]
    with pytest.raises(ValueError):
        tm.SequenceStore(spark, "x", keep=0)


# Dates, counts, sinks, sizes.


def test_dates_from_the_index(spark, events, tmp_path):
    store = str(tmp_path / "store")
    flow = tm.Flow(events, "flow-0", START, END, store=store)
    sequence = flow.sequence
    extent = tm.stored_extent(spark, store, "flow-0", START, END)
    summary = tm.summarise(sequence)
    plan = plan_of(tm.date_at_percent(extent, 30))
    assert "parquet" not in plan.lower()
    for pct in range(101):
        low, high = tm.dates_at_percents(extent, pct, 100 - pct)
        assert low == tm.date_at_percent(extent, pct).first()["date"]
        if pct % 20 == 0:
            assert low == tm.date_at_percent(sequence, pct).first()["date"] == flow.date_at_percent(pct)
            assert (low, high) == tm.dates_at_percents(sequence, pct, 100 - pct)
            assert (low, high) == tm.dates_at_percents(summary.extent, pct, 100 - pct)
    for wrong in (-1, 101):
        with pytest.raises(ValueError):
            tm.date_at_percent(extent, wrong)
        with pytest.raises(ValueError):
            tm.dates_at_percents(extent, 0, wrong)
    assert tm.stored_extent(spark, store, "flow-1", START, END) is None
    empty = tm.Flow(events, "none", START, END, store=store)
    assert empty.date_at_percent(50) is None


def test_counts_around_the_filter(kept):
    sequence = frozen(tm.user_sequence(kept))
    shown, counts = tm.restrict_counted(sequence, "2024-01-05", "2024-01-20", include_tollfree=False)
    window = tm.restrict_window(sequence, "2024-01-05", "2024-01-20")
    assert shown.count() == tm.restrict_tollfree(window).count() == counts.rows_after
    assert counts.rows_before == window.count() > counts.rows_after
    assert re_pushed(plan_of(shown))


def re_pushed(plan):
    return any("GreaterThanOrEqual(date" in line for line in plan.splitlines() if "PushedFilters" in line)


def test_bounded_rows(spark):
    assert [row["id"] for row in tm.bounded_rows(spark.range(5), 5)] == list(range(5))
    seen = []
    with pytest.raises(tm.TooManyRows, match="more than 5 rows"):
        for row in tm.bounded_rows(spark.range(6), 5):
            seen.append(row["id"])
    assert len(seen) == 5
    assert list(tm.bounded_rows(spark.range(0), 0)) == []
    with pytest.raises(tm.TooManyRows):
        list(tm.bounded_rows(spark.range(1), 0))
    with pytest.raises(ValueError):
        list(tm.bounded_rows(spark.range(1), -1))


def test_nested_columns_weigh(spark):
    long = F.repeat(F.lit("x"), 10_000_000)
    for column in (F.array(long), F.struct(long.alias("a")), F.create_map(F.lit("k"), long), long.cast("binary")):
        assert not fits(spark.range(10).select(column.alias("v")), 100)
    assert fits(spark.range(10).select(F.array("id").alias("v"), "id"), 100)
    assert not fits(spark.range(11), 10)


def test_days_of_a_store_are_written_by_several_tasks(spark, small, tmp_path):
    """A day's rows do not all go to one task, and stay the same rows."""
    events = events_log(spark, small)
    store = tm.SequenceStore(spark, str(tmp_path / "store"))
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.add(events)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    files = [len(list(day.glob("*.parquet"))) for day in (tmp_path / "store" / "steps").glob("date=*")]
    assert max(files) > 1
    assert store.sequence().count() == tm.user_sequence(events).count()
