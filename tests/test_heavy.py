"""Heavy groups: cut into ranges they give the rows that windows and plain Python give."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from contract.mapping import END, FLOWS, START, events_log
from tests.conftest import plan_of, rows
from trailmark.functions import path_length
from trailmark.operators import freeze, ordered, paths
from trailmark.plans import sequence as sequence_plan

START_TIME = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 300 events in one session, a third without a session id, many tied times."""
    random.seed(5)
    data = []
    for number in range(300):
        session = ("hot", None, f"s{random.randrange(30)}")[number % 3]
        time = START_TIME + dt.timedelta(seconds=random.randrange(130))
        label = random.choice(["a", "b", "c", None])
        data.append((session, time, label, number, random.randrange(10)))
    schema = "SessionId string, TimeStamp timestamp, ActionId string, EventId long, weight long"
    return spark.createDataFrame(data, schema).repartition(6).persist()


ALL_METRICS = {
    "number": ordered.numbered(),
    "rank": ordered.ranked(),
    "first_id": ordered.first_of("EventId"),
    "last_id": ordered.last_of("EventId"),
    "next_label": ordered.next_of("ActionId"),
    "previous_time": ordered.previous_of("TimeStamp"),
    "before": ordered.total_before("weight"),
}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("limit", [20, 99])
def test_metrics(skewed, limit, descending):
    columns = [F.col("TimeStamp"), F.col("EventId")]
    order = [c.desc() for c in columns] if descending else columns
    heavy = ordered.heavy_keys(skewed, ["SessionId"], limit)
    assert heavy is not None and heavy.rows >= 200
    split = ordered.ordered_metrics(skewed, ["SessionId"], order, ALL_METRICS, heavy, ["TimeStamp"])
    whole = ordered.ordered_metrics(skewed, ["SessionId"], order, ALL_METRICS, None, ["TimeStamp"])
    assert rows(split.select(whole.columns)) == rows(whole)


@pytest.mark.parametrize("instants", [1, 2, 3, 60])
def test_many_rows_of_one_instant_are_split(spark, instants):
    """Ranks of equal times hold across the ranges that these times are cut into."""
    time = F.timestamp_seconds(F.lit(1709251200) + F.floor(F.col("id") * instants / 400))
    calls = spark.range(400).select(
        F.when(F.col("id") % 5 > 0, "hot").alias("SessionId"),
        F.when(F.col("id") >= 30, time).alias("TimeStamp"),
        F.lit("a").alias("ActionId"),
        F.col("id").alias("EventId"),
        F.col("id").alias("weight"),
    )
    order = [F.col("TimeStamp"), F.col("EventId")]
    heavy = ordered.heavy_keys(calls, ["SessionId"], 20)
    split = ordered.ordered_metrics(calls, ["SessionId"], order, ALL_METRICS, heavy, ["TimeStamp"])
    whole = ordered.ordered_metrics(calls, ["SessionId"], order, ALL_METRICS, None, ["TimeStamp"])
    assert rows(split.select(whole.columns)) == rows(whole)
    ranges = ordered.placed_in_ranges(calls, ["SessionId"], order, heavy).groupBy("_range").count()
    assert ranges.count() > 4 and ranges.agg(F.max("count")).first()[0] < 100


def test_no_heavy_keys(skewed):
    assert ordered.heavy_keys(skewed, ["SessionId"], 100) is None
    assert ordered.heavy_keys(skewed.limit(0), ["SessionId"], 100) is None


@pytest.mark.parametrize("limit", [20, 99])
def test_many_heavy_keys(skewed, monkeypatch, limit):
    """Beyond HEAVY_KEYS the same groups are split, by shuffle."""
    monkeypatch.setattr(ordered, "HEAVY_KEYS", 1)
    heavy = ordered.heavy_keys(skewed, ["SessionId"], limit)
    assert not heavy.small and heavy.keys.count() == 2
    order = [F.col("TimeStamp"), F.col("EventId")]
    split = ordered.ordered_metrics(skewed, ["SessionId"], order, ALL_METRICS, heavy, ["TimeStamp"])
    whole = ordered.ordered_metrics(skewed, ["SessionId"], order, ALL_METRICS, None, ["TimeStamp"])
    assert rows(split.select(whole.columns)) == rows(whole)
    assert rows(tm.session_paths(skewed, group_rows=limit)) == rows(tm.session_paths(skewed))


@pytest.mark.parametrize("limit", [20, 99])
def test_paths(skewed, limit):
    assert rows(tm.session_paths(skewed, group_rows=limit)) == rows(tm.session_paths(skewed))


@pytest.mark.parametrize("piece_steps", [10, 64])
def test_pieces_make_the_path(skewed, piece_steps):
    heavy = ordered.heavy_keys(skewed, ["SessionId"], 20)
    made = paths.paths_of(skewed, ["SessionId"], heavy, piece_steps=piece_steps)
    assert rows(made) == rows(tm.session_paths(skewed))
    pieces = tm.path_pieces(skewed, ["SessionId"], heavy, piece_steps).orderBy("piece").collect()
    text = ";".join(p.text for p in pieces if p.SessionId == "hot")
    path = tm.session_paths(skewed).filter("SessionId = 'hot'").first().Path
    assert text == path


def test_equal_paths_on_both_sides_of_the_limit(spark):
    """Null labels make one of two equal paths heavy; they stay one path of the right length."""
    data = [("a", START_TIME + dt.timedelta(seconds=n), f"l{n}" if n < 9 else None, n) for n in range(14)]
    data += [("b", START_TIME + dt.timedelta(seconds=n), f"l{n}", 20 + n) for n in range(9)]
    schema = "SessionId string, TimeStamp timestamp, ActionId string, EventId long"
    events = spark.createDataFrame(data, schema)
    made = tm.session_paths(events, group_rows=10)
    counts = tm.rank_paths(tm.path_frequencies(made)).collect()
    assert [r["count"] for r in counts] == [2]
    assert made.select(path_length(F.col("Path"))).distinct().first()[0] == 8


@pytest.mark.parametrize("callers", [100_000, 2])
def test_sequence(spark, small, monkeypatch, callers):
    monkeypatch.setattr(sequence_plan, "BROADCAST_ROWS", callers)
    events = events_log(spark, small)
    plain = tm.user_sequence(events, FLOWS, START, END)
    split = tm.user_sequence(events, FLOWS, START, END, group_rows=4)
    assert rows(split) == rows(plain)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_attribute_join(skewed, small, how):
    attributes = skewed.filter("ActionId = 'a'").select("SessionId", F.col("weight").alias("w"))
    steps = skewed.select("SessionId", "EventId")
    expected = steps.join(attributes, "SessionId", how)
    joined = freeze.join_attributes(steps, attributes, "SessionId", how, small)
    assert rows(joined) == rows(expected)


@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_copies_of_attributes_are_not_broadcast(spark, how):
    """Spark takes a table copied per salt for no larger than it was, and would broadcast it."""
    attributes = freeze.frozen(spark.range(50).withColumnRenamed("id", "key"))
    events = spark.range(200).selectExpr("id % 70 AS key", "id AS n")
    joined = freeze.join_attributes(events, attributes, "key", how, False)
    assert "BroadcastHashJoin" not in plan_of(joined)
    assert rows(joined) == rows(events.join(attributes, "key", how))


def test_intermediate_tables_are_deleted(spark, small):
    events = events_log(spark, small)
    kept = freeze.frozen(spark.range(3))
    with freeze.intermediate_tables(spark):
        made = tm.user_sequence(events, FLOWS, START, END, group_rows=4)
        written = list(freeze._written.get())
        expected = rows(tm.user_sequence(events, FLOWS, START, END))
        assert written and rows(made) == expected
    folder = spark.sparkContext.getCheckpointDir()
    assert all(path.startswith(folder) for path in written)
    fs = spark._jvm.org.apache.hadoop.fs
    for path in written:
        where = fs.Path(path)
        assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    assert kept.count() == 3


def test_fits(spark, monkeypatch):
    texts = spark.createDataFrame([("abcd",), (None,), ("ef",)], "t string")
    assert freeze.fits(texts, 3) and not freeze.fits(texts, 2)
    monkeypatch.setattr(freeze, "BROADCAST_CHARS", 5)
    assert not freeze.fits(texts, 3)


def test_names_of_frequent_and_rare_paths(spark, monkeypatch):
    sessions = spark.createDataFrame(
        [(f"s{n}", None if n % 7 == 0 else f"path-{n % 5}") for n in range(60)],
        "SessionId string, Path string",
    ).withColumn("TimeStamp", F.lit(START_TIME))
    ranks = tm.rank_paths(tm.path_frequencies(sessions))
    expected = sessions.join(ranks, "Path").select("SessionId", F.col("nickname"))
    for top in (0, 2, 1000):
        monkeypatch.setattr(paths, "FREQUENT_PATHS", top)
        named = tm.name_paths(sessions, ranks).select("SessionId", "path_nickname")
        assert rows(named) == rows(expected)


def test_ranks_number_every_path(spark):
    frequencies = spark.range(5000).selectExpr(
        "CASE WHEN id = 77 THEN NULL ELSE concat('p', id) END AS Path", "id % 9 AS count"
    )
    ranked = tm.rank_paths(frequencies.repartition(7)).collect()
    order = sorted(ranked, key=lambda r: (-r["count"], r.Path is None, r.Path))
    assert [r["rank"] for r in order] == list(range(1, 5001))


@pytest.mark.parametrize("limit", [1, 10_000])
def test_top_paths_by_either_way(spark, monkeypatch, limit):
    monkeypatch.setattr(paths, "TOP_IN_ONE_TASK", limit)
    frequencies = spark.range(50).selectExpr("concat('p', id) AS Path", "id % 9 AS count")
    top = tm.rank_paths(frequencies, 7)
    assert rows(top) == rows(tm.rank_paths(frequencies).filter("rank <= 7"))


def _brute_force(calls):
    """Statistics over explicit pairs."""
    groups = {}
    unique = {c for c in calls if c[0] is not None and c[1] is not None}
    for a, b in itertools.permutations(unique, 2):
        if a[0] == b[0] and a[1] != b[1] and a[2] < b[2]:
            groups.setdefault(a[2].date(), []).append(((b[2] - a[2]).days, a[4], b[4]))
    result = {}
    for date, pairs in groups.items():
        row = [len(pairs)]
        for values in zip(*pairs):
            known = [v for v in values if v is not None]
            row.append(statistics.fmean(known) if known else None)
            row.append(statistics.stdev(known) if len(known) > 1 else None)
        result[date] = row
    return result


@pytest.mark.parametrize("limit", [1_000_000, 12])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeat_calls_against_pairs(spark, seed, limit):
    random.seed(seed)
    calls = []
    for number in range(160):
        caller = "+18005550000" if number % 3 == 0 else f"+1212555{random.randrange(12):04d}"
        hour = random.choice([0, 6, 6, 12, 23])
        time = START_TIME + dt.timedelta(days=random.randrange(9), hours=hour)
        session = random.choice([None, *"abcdefgh"])
        duration = random.choice([None, 5.5, 120.25, 300000.75])
        calls.append((caller, session, time, "ANSWER", duration))
    calls += calls[:20]
    schema = (
        "CallingNumber string, SessionId string, TimeStamp timestamp, "
        "CallAnswerIndicator string, CallDuration double"
    )
    df = spark.createDataFrame(calls, schema)
    stats = tm.repeat_call_stats(df, by_toll_free=False, group_rows=limit)
    found = {r.date: list(r)[1:] for r in stats.collect()}
    expected = _brute_force(calls)
    assert found.keys() == expected.keys()
    for date, row in expected.items():
        for got, want in zip(found[date], row):
            assert got == want if want is None else got == pytest.approx(want, rel=1e-9, abs=1e-6)


def _long_calls(spark, durations):
    """One call a minute of one number, each in a session of its own, half of them twice."""
    rows = [
        ("+12125550000", f"s{n}", START_TIME + dt.timedelta(minutes=n), "ANSWER", float(d))
        for n, d in enumerate(durations)
    ]
    schema = (
        "CallingNumber string, SessionId string, TimeStamp timestamp, "
        "CallAnswerIndicator string, CallDuration double"
    )
    return spark.createDataFrame(rows + rows[::2], schema)


@pytest.mark.parametrize("limit", [1_000_000, 100])
@pytest.mark.parametrize("low, high", [(1e11, 1e11), (1e11, 2e11), (0.0, 9e12)])
def test_repeat_calls_of_very_long_durations(spark, limit, low, high):
    """Pairs times squared durations need more than 38 digits."""
    durations = [(low, high)[n % 2] for n in range(600)]
    found = tm.repeat_call_stats(_long_calls(spark, durations), False, group_rows=limit).first()
    first = [d for n, d in enumerate(durations) for _ in range(599 - n)]
    second = [d for n, d in enumerate(durations) for _ in range(n)]
    assert found["count"] == len(first) == 600 * 599 // 2
    for which, values in (("first", first), ("second", second)):
        mean, deviation = statistics.fmean(values), statistics.stdev(values)
        assert found[f"mean_{which}_call_duration"] == pytest.approx(mean, rel=1e-12)
        assert found[f"std_{which}_call_duration"] == pytest.approx(deviation, rel=1e-9)


def test_repeat_calls_across_the_parts_of_a_duration(spark):
    """Durations a microsecond apart, on both sides of a multiple of the low part."""
    edge = 1 << 30
    durations = [(edge + n % 3 - 1) / 1e6 for n in range(60)]
    found = tm.repeat_call_stats(_long_calls(spark, durations), False).first()
    first = [n % 3 - 1 for n in range(60) for _ in range(59 - n)]
    deviation = statistics.stdev(first) / 1e6
    assert found["std_first_call_duration"] == pytest.approx(deviation, rel=1e-9)
