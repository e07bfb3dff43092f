"""Names of fixed width for contents, and lookups that stay even when one key is used very often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.freeze import frozen

NAME_BYTES = 16
# A key with more uses than its share of this many is looked up by broadcast, so at most as many are.
HOT_KEYS = 50_000
LEAST_HOT_USES = 1_000


def name_of(*parts: Column) -> Column:
    """The first 16 bytes of the SHA-256 of the joined `parts` (binary or text)."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, NAME_BYTES)


def framed(text: Column) -> Column:
    """`text` behind its length in bytes, so that joined texts cannot be mistaken for others."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` with the columns that `table`, unique by the fixed-width `key`, has for theirs.

    The uses of each key are counted, pre-aggregated per task. Keys with more uses than a
    HOT_KEYS-th of all rows, which are fewer than HOT_KEYS whatever the data, are broadcast with
    their few columns; every other key is too small a share of the rows to burden a task.
    Both arguments are read several times: pass written tables.
    """
    least = max(LEAST_HOT_USES, rows.count() // HOT_KEYS)
    uses = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"))
    hot = frozen(uses.filter(F.col("_uses") > least).select(key))
    if hot.isEmpty():
        return rows.join(table, key, how)
    marked = F.broadcast(hot)
    often = rows.join(marked, key, "left_semi")
    seldom = rows.join(marked, key, "left_anti")
    values = F.broadcast(table.join(marked, key, "left_semi"))
    return often.join(values, key, how).unionByName(seldom.join(table, key, how))
