"""The driver's tables read as call-flow events (rules in FIXTURES.md)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark import session_paths, unify_events
from trailmark.operators.freeze import ensure_checkpoint_dir

FLOWS = ["flow-0", "flow-1"]
START, END = "2024-01-03", "2024-01-28"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def families(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five event families of the `events` table."""
    events = table(spark, sf_dir, "events")

    def family(event_type: str, action: str, *extra: str) -> DataFrame:
        return events.filter(F.col("event_type") == event_type).selectExpr(
            "user_id || '-' || to_date(ts) AS SessionId",
            "ts AS TimeStamp",
            f"{action} AS ActionId",
            "cast(1000 + user_id % 5 AS string) AS CustomerId",
            "'flow-' || user_id % 3 AS FlowName",
            "event_id AS EventId",
            *extra,
        )

    number = "cast(regexp_extract(props, '([0-9]+)', 1) AS bigint)"
    caller = """
        CASE WHEN user_id % 10 = 0 THEN 'Restricted'
             WHEN user_id % 10 = 1 THEN NULL
             WHEN user_id % 10 IN (2, 3) THEN '+1800555' || lpad(user_id, 4, '0')
             WHEN user_id % 10 = 4 THEN '+1877555' || lpad(user_id, 4, '0')
             ELSE '+1212555' || lpad(user_id, 4, '0') END"""
    indicator = f"""
        CASE WHEN {number} % 10 = 7 THEN NULL WHEN value < 10 THEN 'HANGUP' ELSE 'ANSWER' END"""
    call_action = f"""
        CASE WHEN {number} % 33 = 0 THEN 'TRANSFER_33' ELSE 'ICALL_' || {number} % 2 END"""
    return {
        "api": family("click", "'EXTCALL_51'"),
        "call": family(
            "error",
            call_action,
            f"{indicator} AS CallAnswerIndicator",
            f"{caller} AS CallingNumber",
            "value AS CallDuration",
        ),
        "dtmf": family("signup", f"'MENU_TREE_' || {number} % 2", f"{number} % 3 AS DtmfInput"),
        "msg": family("view", "'MSG_1'"),
        "nlp": family("purchase", "'NLP_1'"),
    }


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_events(families(spark, sf_dir))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4()}"


def family_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The five event families written to files of their own, as a catalog for `read_events`."""
    folder = scratch(spark)
    for family, events in families(spark, sf_dir).items():
        events.write.parquet(f"{folder}/{family}")
    return {family: f"{folder}/{family}" for family in families(spark, sf_dir)}


def exit_file(spark: SparkSession, sf_dir: str) -> str:
    """The exit events written to a file, for `read_exit_events`."""
    folder = scratch(spark)
    exit_events(spark, sf_dir).write.parquet(f"{folder}/exits")
    return f"{folder}/exits"


def exit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session its last event time, flow and finished path."""
    log = events_log(spark, sf_dir)
    paths = session_paths(log, ["SessionId", "FlowName"], with_end=True)
    # Rows here are sessions by flow: the events themselves are read and shuffled once.
    last = F.max("End").over(Window.partitionBy("SessionId"))
    return paths.select("SessionId", last.alias("TimeStamp"), "FlowName", "Path").filter(
        F.col("SessionId").isNotNull()
    )


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` read as calls: the customer is the number, the order the session."""
    return table(spark, sf_dir, "orders").selectExpr(
        "'+1212' || o_custkey AS CallingNumber",
        "cast(o_orderkey AS string) AS SessionId",
        "o_orderdate AS TimeStamp",
        "o_orderstatus AS CallAnswerIndicator",
        "o_totalprice AS CallDuration",
    )


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` read as events: the turn, in minutes, is the time, the role the action."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id AS string) AS SessionId",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(turn AS int)) AS TimeStamp",
        "role AS ActionId",
        "turn AS EventId",
        "'chat' AS FlowName",
    )


def shipment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` read as a three-column log: an order passes through its shipped lines."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey AS string) AS user_id",
        "l_returnflag || '-' || l_linestatus AS event_name",
        "l_shipdate AS time_event",
    )
