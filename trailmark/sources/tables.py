"""Sources and sinks: event tables, exit events, sequence files, parameterised queries."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark import schemas
from trailmark.functions.dates import as_date, as_list
from trailmark.operators.events import EVENT_ID


def read_table(spark: SparkSession, location: str, schema: T.StructType) -> DataFrame:
    """The columns of `schema` from a Parquet path or a catalog table.

    An `EventId` column, where the table has one, is kept to order events of equal time. Numbers
    are cast to the declared type and times may lack a zone; any other difference is an error.
    """
    table = spark.read.parquet(location) if "/" in location else spark.table(location)
    tie = [EVENT_ID] if EVENT_ID in table.columns else []
    columns = [_typed(table.schema[field.name], field) for field in schema]
    return table.select(*columns, *tie)


def _typed(found: T.StructField, declared: T.StructField) -> Column:
    column, kinds = F.col(found.name), (found.dataType, declared.dataType)
    times = (T.TimestampType, T.TimestampNTZType)
    if kinds[0] == kinds[1] or all(isinstance(kind, times) for kind in kinds):
        return column
    if all(isinstance(kind, T.NumericType) for kind in kinds):
        return column.cast(declared.dataType).alias(found.name)
    raise TypeError(
        f"{found.name} is {found.dataType.simpleString()}, not {declared.dataType.simpleString()}"
    )


def read_events(spark: SparkSession, catalog: Mapping[str, str]) -> dict[str, DataFrame]:
    """The five event families from a mapping of family to path or table name."""
    missing = schemas.FAMILY_SCHEMAS.keys() - catalog.keys()
    if missing:
        raise ValueError(f"no location for: {', '.join(sorted(missing))}")
    return {
        family: read_table(spark, catalog[family], schema)
        for family, schema in schemas.FAMILY_SCHEMAS.items()
    }


def read_exit_events(spark: SparkSession, location: str) -> DataFrame:
    return read_table(spark, location, schemas.EXIT_EVENT)


def read_sequence_csv(spark: SparkSession, path: str) -> DataFrame:
    """An enriched sequence from CSV with a header; times are UTC, the date follows from them.

    Numbers may be written as floats, as frames with missing values are; whole ones are read
    exactly. Only the columns of the enriched sequence are kept.
    """
    rows = spark.read.csv(path, header=True)
    columns = []
    for field in schemas.SEQUENCE:
        if field.name == "date":
            columns.append(F.to_date(F.to_timestamp("time_event")).alias("date"))
        elif isinstance(field.dataType, T.LongType):
            whole, fraction = F.col(field.name).try_cast("long"), F.col(field.name).cast("double")
            columns.append(F.coalesce(whole, fraction.cast("long")).alias(field.name))
        else:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def materialize(sequence: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write a sequence partitioned by date and return it read back from there.

    Every panel then reads the files instead of computing the sequence. The rebalance hint lets
    Spark merge small and split large dates into files of even size.
    """
    balanced = sequence.hint("rebalance", "date")
    balanced.write.mode(mode).partitionBy("date").parquet(path)
    return sequence.sparkSession.read.schema(sequence.schema).parquet(path).select(sequence.columns)


_STORED = "flow string, start date, end date, folder string, schema string, first string, last string"


def _last_stored(spark: SparkSession, store: str, flow, start, end) -> Row | None:
    """What the index of `store` says of the sequence last stored for these arguments."""
    try:
        index = spark.read.schema(f"{_STORED}, written timestamp").parquet(f"{store}/index")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    same = (F.col("flow") == flow) & (F.col("start") == as_date(start)) & (F.col("end") == as_date(end))
    entry = F.struct("folder", "schema", "first", "last")
    return index.filter(same).agg(F.max_by(entry, "written")).first()[0]


def stored_extent(spark: SparkSession, store: str, flow, start, end) -> DataFrame | None:
    """One row with the `first` and `last` time of a stored sequence, from the index alone.

    `date_at_percent` takes it in place of the sequence. None where the index does not know them.
    """
    found = _last_stored(spark, store, flow, start, end)
    if found is None or found["first"] is None:
        return None
    kind = T.StructType.fromJson(json.loads(found["schema"]))["time_event"].dataType
    times = [F.lit(found[name]).cast(kind).alias(name) for name in ("first", "last")]
    return spark.range(1).select(*times)


def stored_sequence(spark: SparkSession, store: str, flow, start, end) -> DataFrame | None:
    """The sequence last stored for these arguments; None where there is none."""
    last = _last_stored(spark, store, flow, start, end)
    if last is None:
        return None
    schema = T.StructType.fromJson(json.loads(last["schema"]))
    return spark.read.schema(schema).parquet(f"{store}/{last['folder']}").select(*schema.fieldNames())


def store_sequence(sequence: DataFrame, store: str, flow, start, end) -> DataFrame:
    """Write a sequence into `store` for these arguments and return it read back.

    It goes into a folder of its own; a row in the index names it once it is complete, with the first
    and the last time of its steps, which are observed while it is written.
    """
    spark, folder, seen = sequence.sparkSession, f"sequence-{uuid.uuid4()}", Observation()
    ends = [f("time_event").cast("string").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    stored = materialize(sequence.observe(seen, *ends), f"{store}/{folder}")
    times = seen.get
    values = [flow, as_date(start), as_date(end), folder, sequence.schema.json()]
    values += [times["first"], times["last"]]
    names = [part.split()[0] for part in _STORED.split(", ")]
    kinds = [part.split()[1] for part in _STORED.split(", ")]
    entry = spark.range(1).select(
        *[F.lit(value).cast(kind).alias(name) for name, kind, value in zip(names, kinds, values)]
    )
    entry = entry.withColumn("written", F.current_timestamp())
    entry.write.mode("append").parquet(f"{store}/index")
    return stored


class TooManyRows(ValueError):
    """A result has more rows than its reader has room for."""


def bounded_rows(df: DataFrame, max_rows: int) -> Iterator[Row]:
    """At most `max_rows` rows of `df`, one after another, and an error if there are more.

    The sink for small results: the driver holds a partition of the limited result at a time and never
    asks for more than one row beyond the limit. The error comes after the last row that has room.
    """
    if max_rows < 0:
        raise ValueError("max_rows must not be negative")
    for number, row in enumerate(df.limit(max_rows + 1).toLocalIterator(), 1):
        if number > max_rows:
            raise TooManyRows(f"more than {max_rows} rows")
        yield row


def run_query(spark: SparkSession, query: str, flows, start, end) -> DataFrame:
    """A SQL query with the named arguments :flows (an array), :start and :end (dates).

    Write `array_contains(:flows, FlowName)`. Values are bound, never put into the text.
    """
    names = F.array(*[F.lit(flow) for flow in as_list(flows)])
    return spark.sql(query, args={"flows": names, "start": as_date(start), "end": as_date(end)})


def sample_sessions(
    events: DataFrame, sessions: int, seed: str = "0", session: str = "SessionId"
) -> DataFrame:
    """All events of `sessions` sessions, chosen by a hash of the session id: the same every time,
    and no session is cut."""
    order = F.md5(F.concat(F.lit(seed), F.col(session)))
    ids = events.select(session).filter(F.col(session).isNotNull()).distinct()
    chosen = ids.orderBy(order, session).limit(sessions)
    if sessions <= 100_000:
        chosen = F.broadcast(chosen)
    return events.join(chosen, session, "left_semi")
