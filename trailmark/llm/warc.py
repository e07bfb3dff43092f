"""WARC: Merkle trees over records and offset ranges, and the audit of a replica with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.freeze import frozen
from trailmark.operators.ordered import number_rows

FILE_RECORDS = 1000
LEAF_BYTES = 65_536
FANOUT = 8


def record_text(url: Column, body: Column) -> Column:
    """A WARC record as text; nulls count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def record_index(
    records: DataFrame, order: list[Column], length: str, file_records: int = FILE_RECORDS
) -> DataFrame:
    """`records` with `file` and `offset`: packed into files of `file_records` in the given order.

    Numbered by a parallel range sort, so that a file is bounded whatever keys repeat. Null lengths
    count as 0. Columns named `file`, `offset` or `record` are replaced.
    """
    numbered = number_rows(records.drop("file", "offset", "record"), order, "record")
    file = F.floor((F.col("record") - 1) / file_records)
    earlier = (
        Window.partitionBy("file")
        .orderBy("record")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return numbered.withColumn("file", file).withColumn(
        "offset", F.coalesce(F.sum(length).over(earlier), F.lit(0)).cast("long")
    )


def _level(children: DataFrame, width: int) -> DataFrame:
    """One level up: ranges of `width` positions, each the hash of what lies in it, in order."""
    inside = F.array_sort(F.collect_list(F.struct("at", "hash")))
    text = F.array_join(
        F.transform(inside, lambda x: F.concat_ws(":", x["at"].cast("string"), x["hash"])), ";"
    )
    return (
        children.groupBy("file", F.floor(F.col("at") / width).alias("at"))
        .agg(text.alias("_text"))
        .select("file", "at", F.sha2("_text", 256).alias("hash"))
    )


def tree_height(records: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the records that a single root per file needs."""
    last = records.agg(F.max("offset")).first()[0] or 0
    height, ranges = 1, last // leaf_bytes + 1
    while ranges > 1:
        ranges, height = -(-ranges // fanout), height + 1
    return height


def fixity_tree(
    records: DataFrame, height: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT
) -> list[DataFrame]:
    """The tree's levels from records to roots, each a written table of `file`, `at`, `hash`.

    Level 0 has the `digest` of each record at its `offset`; `at` of level 1 counts ranges of
    `leaf_bytes`, and above ranges of `fanout` ranges. A record belongs to the range where it begins.
    A null digest hashes as an empty text. Groups hold the records that begin in one range, or
    `fanout` hashes. Records of equal file and offset, repeated rows too, enter in digest order.
    Other columns are ignored.
    """
    digest = F.coalesce(F.col("digest"), F.lit(""))
    levels = [frozen(records.select("file", F.col("offset").alias("at"), digest.alias("hash")))]
    for level in range(height):
        levels.append(frozen(_level(levels[-1], leaf_bytes if level == 0 else fanout)))
    return levels


def damaged(
    mine: list[DataFrame], theirs: list[DataFrame], leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT
) -> DataFrame:
    """Records that differ between two trees of equal height: `file`, `offset`, `digest`, `replica_digest`.

    Roots are compared first; each level below reads only the children of ranges that differ. A
    digest is null where a side lacks the record. Files and records of either side count. Equal
    trees give an empty result. Several records at one offset are compared as their sorted list.
    """
    if len(mine) != len(theirs):
        raise ValueError("trees differ in height")

    def one(level: DataFrame, name: str) -> DataFrame:
        return level.groupBy("file", "at").agg(
            F.array_join(F.array_sort(F.collect_list("hash")), ",").alias(name)
        )

    found = None
    for level in reversed(range(len(mine))):
        sides = [mine[level], theirs[level]]
        if found is not None:
            width = leaf_bytes if level == 0 else fanout
            parents = found.select("file", F.col("at").alias("_parent"))
            sides = [
                side.withColumn("_parent", F.floor(F.col("at") / width))
                .join(parents, ["file", "_parent"], "left_semi")
                .drop("_parent")
                for side in sides
            ]
        both = one(sides[0], "digest").join(one(sides[1], "replica_digest"), ["file", "at"], "full")
        found = frozen(both.filter(~F.col("digest").eqNullSafe(F.col("replica_digest"))))
    return found.withColumnRenamed("at", "offset")


def audit(
    records: DataFrame, replica: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT
) -> tuple[DataFrame, DataFrame]:
    """Two tables of records (`file`, `offset`, `digest`) compared: (files, damaged records).

    Files: `file`, `root`, `replica_root` (null where a side lacks the file), `intact`. Damaged
    records: see `damaged`. Nulls: a null file or offset is left out of the trees, as no place in a
    file is known for it. Empty tables give empty results.
    """
    placed = [t.filter("file is not null and offset is not null") for t in (records, replica)]
    height = max(tree_height(t, leaf_bytes, fanout) for t in placed)
    mine, theirs = (fixity_tree(t, height, leaf_bytes, fanout) for t in placed)
    roots = (
        mine[-1]
        .select("file", F.col("hash").alias("root"))
        .join(theirs[-1].select("file", F.col("hash").alias("replica_root")), "file", "full")
        .withColumn("intact", F.col("root").eqNullSafe(F.col("replica_root")))
    )
    return roots, damaged(mine, theirs, leaf_bytes, fanout)
