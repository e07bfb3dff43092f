import datetime as dt
import importlib

import pytest

import trailmark as tm
from tests.conftest import rows

module = importlib.import_module("trailmark.operators.rolling")


@pytest.fixture(scope="module")
def toy(spark):
    kinds = [False] * 3 + [True] * 3 + [False] * 4
    data = [(n, "z", kind) for n, kind in enumerate(kinds, 1)]
    return spark.createDataFrame(
        data, "session_duration long, date string, TollFreeNumber boolean"
    )


def test_rolling_sum_of_three(toy):
    rolled = tm.rolling(
        toy,
        {"total": "session_duration"},
        by=["date", "TollFreeNumber"],
        order=["session_duration"],
        rows=3,
        min_rows=3,
        fn="sum",
    )
    found = [r.total for r in rolled.orderBy("session_duration").collect()]
    assert found == [None, None, 6, None, None, 15, 12, 18, 24, 27]


def test_partial_frames(toy):
    rolled = tm.rolling(
        toy, {"mean": "session_duration"}, by=["date"], order=["session_duration"], rows=15
    )
    found = [r["mean"] for r in rolled.orderBy("session_duration").collect()]
    assert found == [(n + 1) / 2 for n in range(1, 11)]


def test_null_inside_a_full_frame(spark):
    data = [(n, None if n == 3 else float(n)) for n in range(1, 8)]
    df = spark.createDataFrame(data, "day long, value double").selectExpr("'s' AS series", "*")
    rolled = tm.rolling(df, {"mean": "value"}, ["series"], ["day"], rows=2, min_rows=2)
    found = [r["mean"] for r in rolled.orderBy("day").collect()]
    assert found == [None, 1.5, None, None, 4.5, 5.5, 6.5]


@pytest.mark.parametrize("block", [3, 10, 10_000])
def test_whole_frame_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_ROWS", block)
    day = dt.date(2024, 1, 1)
    data = [(s, day + dt.timedelta(n), float(n * s)) for s in (1, 2, 3) for n in range(9)]
    df = spark.createDataFrame(data, "series long, date date, value double").repartition(3)
    rolled = tm.rolling(df, {"mean": "value"}, (), ["series", "date"], rows=3, min_rows=3)
    values = [row[2] for row in data]
    means = [None, None] + [sum(values[i - 2 : i + 1]) / 3 for i in range(2, len(values))]
    assert rows(rolled) == sorted((a + (m,) for a, m in zip(data, means)), key=repr)


@pytest.mark.parametrize("frame", [2, 4, 8])
def test_frames_longer_than_a_block(spark, monkeypatch, frame):
    monkeypatch.setattr(module, "BLOCK_ROWS", 3)
    day = dt.date(2024, 1, 1)
    data = [(day + dt.timedelta(n), float(n * n)) for n in range(20)]
    df = spark.createDataFrame(data, "date date, value double").repartition(3)
    rolled = tm.rolling(df, {"total": "value"}, (), ["date"], rows=frame, min_rows=1, fn="sum")
    values = [value for _, value in data]
    totals = [sum(values[max(0, i + 1 - frame) : i + 1]) for i in range(len(values))]
    assert rows(rolled) == sorted(((*row, total) for row, total in zip(data, totals)), key=repr)
