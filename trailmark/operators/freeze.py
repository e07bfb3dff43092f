"""Results written once, and joins whose strategy depends on a measured size."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Rows and text that a broadcast table may hold, and the ways a key is spread beyond that.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 50_000_000
SALTS = 64


_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, the tables that operators called inside have written for themselves.

    DataFrames built inside read these tables: write or collect what is wanted before leaving.
    """
    written: list[str] = []
    token = _written.set(written)
    try:
        yield
    finally:
        _written.reset(token)
        for name in written:
            table = name.rsplit("/", 1)[-1]
            if table.startswith("clustered_"):
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; a scratch folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="trailmark-")
    context.setCheckpointDir(folder)


def frozen(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder as Parquet and read back, with its lineage cut.

    Written files outlive the executors that made them, so a lost executor cannot make two readers
    see differently split partitions. Unlike a checkpoint of rows they are compressed, and a reader
    of two columns reads two columns.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_attributes(
    rows: DataFrame, attributes: DataFrame, key: str, how: str, small: bool
) -> DataFrame:
    """`rows` joined with the `attributes` of their `key`, where one key may hold most of `rows`.

    `small` attributes, as `fits` found them, are broadcast. Others are copied once per salt, and
    the rows of a key are spread over the salts by a hash of their other columns. Spark does not see
    that the copies are more than the table they come from, so it is told not to broadcast them.
    """
    if small:
        return rows.join(F.broadcast(attributes), key, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    others = F.xxhash64(*[name for name in rows.columns if name != key])
    salted = rows.withColumn("_salt", F.pmod(others, F.lit(SALTS)).cast("int"))
    copies = attributes.withColumn("_salt", salts).hint("merge")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def fits(df: DataFrame, limit: int) -> bool:
    """Whether `df` has at most `limit` rows and BROADCAST_CHARS characters of text.

    Arrays, maps and structs count as their JSON text, so nested values weigh what they hold.
    """
    chars = sum((_chars(field) for field in df.schema), F.lit(0))
    measured = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(chars))
    rows, text = measured.first()
    return rows <= limit and (text or 0) <= BROADCAST_CHARS


def _chars(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.length(column)
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        size = F.length(F.to_json(F.struct(column)))
    else:
        return F.lit(0)
    return F.coalesce(size, F.lit(0)).cast("long")


def clustered(df: DataFrame, key: str) -> DataFrame:
    """`df` written once as a table in buckets of `key` and read back from it.

    Windows, aggregates and joins on `key` then need no further exchange of these rows: whoever
    joins is brought to them. The rows of a key share a task, so keys that are too large for one
    must have been taken out before.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"clustered_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    if (written := _written.get()) is not None:
        written.append(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key)
    writer.option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
