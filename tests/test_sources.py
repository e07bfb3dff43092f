import datetime as dt

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from contract.mapping import END, FLOWS, START, events_log, exit_events, families
from tests.conftest import rows
from tests.edge import FLOW, edge_families
from trailmark import schemas
from trailmark.operators import freeze


@pytest.fixture(scope="module")
def sequence(spark, small):
    return tm.user_sequence(events_log(spark, small), FLOWS, START, END).persist()


def test_events_from_paths_and_tables(spark, tmp_path):
    expected = tm.unify_events(edge_families(spark))
    catalog = {}
    for family, events in edge_families(spark).items():
        if family in ("api", "call"):
            catalog[family] = str(tmp_path / family)
            events.withColumn("Unused", F.lit(1)).write.parquet(catalog[family])
        else:
            catalog[family] = f"{family}_event"
            events.createOrReplaceTempView(catalog[family])
    read = tm.read_events(spark, catalog)
    assert "Unused" not in read["api"].columns
    assert rows(tm.unify_events(read)) == rows(expected)


def test_missing_family(spark):
    with pytest.raises(ValueError, match="call, dtmf, msg, nlp"):
        tm.read_events(spark, {"api": "api_event"})


def test_exit_events(spark, small, tmp_path):
    exits = exit_events(spark, small)
    exits.write.parquet(str(tmp_path / "exits"))
    read = tm.read_exit_events(spark, str(tmp_path / "exits"))
    assert read.columns == schemas.EXIT_EVENT.fieldNames()
    assert rows(tm.available_flows(read)) == [("flow-0",), ("flow-1",), ("flow-2",)]


def test_types_of_a_table(spark, tmp_path):
    path = str(tmp_path / "exits")
    columns = "'s' AS SessionId, {} AS TimeStamp, 'f' AS FlowName, 'a;b' AS Path"
    spark.range(2).selectExpr(*columns.format("'2024-01-05'").split(", ")).write.parquet(path)
    with pytest.raises(TypeError, match="TimeStamp is string, not timestamp"):
        tm.read_exit_events(spark, path)


def test_whole_numbers_of_a_csv_are_exact(spark, tmp_path):
    path = str(tmp_path / "sequence")
    names = schemas.SEQUENCE.fieldNames()
    values = {"time_from_start": str(2**53 + 1), "time_to_next": "12.0", "count": ""}
    spark.createDataFrame(
        [tuple(values.get(name) for name in names)], ", ".join(f"`{n}` string" for n in names)
    ).write.csv(path, header=True)
    row = tm.read_sequence_csv(spark, path).first()
    assert (row.time_from_start, row.time_to_next, row["count"]) == (2**53 + 1, 12, None)


def test_sequence_csv(spark, sequence, tmp_path):
    path = str(tmp_path / "sequence")
    zoned = sequence.withColumn("time_event", F.col("time_event").cast("timestamp"))
    floats = zoned.withColumn("time_to_next", F.col("time_to_next").cast("double"))
    floats.write.csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    read = tm.read_sequence_csv(spark, path)
    assert read.schema.simpleString() == schemas.SEQUENCE.simpleString()
    assert rows(read) == rows(zoned)


def test_materialize(spark, sequence, tmp_path):
    path = str(tmp_path / "stored")
    stored = tm.materialize(sequence, path)
    assert stored.columns == sequence.columns
    assert rows(stored) == rows(sequence)
    assert (tmp_path / "stored" / "date=2024-01-03").exists()
    plan = stored.filter(F.col("date") == dt.date(2024, 1, 5))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    window = tm.restrict_window(stored, "2024-01-05", "2024-01-09")
    assert rows(window) == rows(tm.restrict_window(sequence, "2024-01-05", "2024-01-09"))
    bounds = window._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 2024-01-05" in bounds and "< 2024-01-09" in bounds


def test_query_arguments(spark, small):
    events_log(spark, small).createOrReplaceTempView("unified")
    query = """
        SELECT SessionId FROM unified
        WHERE array_contains(:flows, FlowName) AND to_date(TimeStamp) BETWEEN :start AND :end
    """
    kept = tm.filter_events(events_log(spark, small), FLOWS, START, END).select("SessionId")
    assert rows(tm.run_query(spark, query, FLOWS, START, END)) == rows(kept)
    assert tm.run_query(spark, query, "x') OR 1=1 --", START, END).count() == 0


def test_sample_keeps_sessions_whole(spark, small):
    events = events_log(spark, small)
    sample = tm.sample_sessions(events, 25, seed="3").persist()
    assert sample.select("SessionId").distinct().count() == 25
    ids = [r[0] for r in sample.select("SessionId").distinct().collect()]
    assert events.filter(F.col("SessionId").isin(ids)).count() == sample.count()
    again = tm.sample_sessions(events.repartition(5), 25, seed="3")
    assert rows(again) == rows(sample)
    other = tm.sample_sessions(events, 25, seed="4")
    assert rows(other) != rows(sample)


def test_families_have_the_documented_columns(spark, small):
    for family, events in families(spark, small).items():
        expected = schemas.FAMILY_SCHEMAS[family].fieldNames()
        assert [c for c in events.columns if c != "EventId"] == expected


def test_customer_and_exclusive_start(spark):
    events = tm.unify_events(edge_families(spark))
    assert tm.filter_events(events, customers="7").count() == 10
    assert tm.filter_events(events, customers=["8"]).count() == 0
    after = tm.filter_events(events, FLOW, start="2020-07-02", start_exclusive=True)
    assert {r.SessionId for r in after.collect()} == {"S5", "S6"}


def test_frozen_tables_go_where_the_session_says(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    table = freeze.frozen(spark.range(5).filter("id > 9"))
    assert table.count() == 0 and table.columns == ["id"]
    table = freeze.frozen(spark.range(5))
    assert all(folder in file for file in table.inputFiles())
    assert rows(table) == [(n,) for n in range(5)]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        freeze.ensure_checkpoint_dir(Session())
