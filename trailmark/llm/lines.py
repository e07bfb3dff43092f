"""Line dedup: lines that many pages of one site share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.freeze import BROADCAST_ROWS, fits, frozen, join_attributes

MAX_RATIO = 0.1
MIN_PAGES = 3


def _site(column: str) -> Column:
    """The site as a key that is never null: null and the empty string stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _worded(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate_lines(
    docs: DataFrame,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    text_column: str = "text",
    site_column: str = "source",
) -> DataFrame:
    """For each site with any, the keys of its boilerplate lines: `_site`, `_drop` (array of long).

    A line, without spaces around it, is boilerplate on a site if the pages of the site that contain
    it are `min_pages` at least and more than `max_ratio` of all its pages. A page counts once per
    line however often it repeats it; pages without text count as pages. Lines are counted by a
    64-bit hash, pre-aggregated per task. An array has at most (lines per page) / `max_ratio`
    entries, since each uses up that share of a site's lines.
    """
    sites = docs.select(_site(site_column).alias("_site"), F.col(text_column).alias("_text"))
    keys = F.array_distinct(
        F.transform(F.filter(F.split("_text", "\n", -1), _worded), _line_key)
    )
    counts = (
        sites.select("_site", F.explode(keys).alias("_line"))
        .groupBy("_site", "_line")
        .agg(F.count(F.lit(1)).alias("_pages"))
        .filter(F.col("_pages") >= min_pages)
    )
    totals = frozen(sites.groupBy("_site").agg(F.count(F.lit(1)).alias("_total")))
    rated = join_attributes(counts, totals, "_site", "inner", fits(totals, BROADCAST_ROWS))
    return (
        rated.filter(F.col("_pages") > F.col("_total") * F.lit(max_ratio))
        .groupBy("_site")
        .agg(F.collect_set("_line").alias("_drop"))
    )


def _split(docs: DataFrame, text_column: str, site_column: str, **limits) -> DataFrame:
    """`docs` packed into `_row`, with `_lines` and `_kept` arrays."""
    drops = frozen(
        boilerplate_lines(docs, text_column=text_column, site_column=site_column, **limits)
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"),
        F.split(text_column, "\n", -1).alias("_lines"),
        _site(site_column).alias("_site"),
    )
    joined = join_attributes(keyed, drops, "_site", "left", fits(drops, BROADCAST_ROWS // 10))
    return joined.select(
        "_row",
        "_lines",
        F.when(F.col("_drop").isNull(), F.col("_lines"))
        .otherwise(
            F.filter("_lines", lambda x: ~(_worded(x) & F.array_contains("_drop", _line_key(x))))
        )
        .alias("_kept"),
    )


def drop_boilerplate(
    docs: DataFrame,
    text_column: str = "text",
    site_column: str = "source",
    length_column: str | None = "n_chars",
    **limits,
) -> DataFrame:
    """`docs` without their sites' boilerplate lines (see `boilerplate_lines`).

    Same rows and columns; only `text_column` changes, and `length_column`, where present, holds the
    code points of a changed text. All occurrences of a line go. A null text stays null, an empty
    one empty; a null site is a site of its own; repeated rows are pages like others.
    """
    split = _split(docs, text_column, site_column, **limits)
    text = F.array_join("_kept", "\n")
    changed = F.size("_kept") < F.size("_lines")
    out = {name: F.col("_row")[name] for name in docs.columns}
    if length_column in out:
        kind = docs.schema[length_column].dataType
        out[length_column] = F.when(changed, F.length(text).cast(kind)).otherwise(
            out[length_column]
        )
    out[text_column] = F.when(changed, text).otherwise(out[text_column])
    return split.select(*[column.alias(name) for name, column in out.items()])


def line_report(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
    **limits,
) -> DataFrame:
    """Per row the id, `n_lines`, `n_dropped` and the kept `text`, as `drop_boilerplate` leaves it.

    A null text has no lines and stays null.
    """
    split = _split(docs.select(id_column, text_column, site_column), text_column, site_column, **limits)
    lines = F.coalesce(F.size("_lines"), F.lit(0))
    lines = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(lines)
    return split.select(
        F.col("_row")[id_column].alias(id_column),
        lines.cast("long").alias("n_lines"),
        F.when(F.col("_lines").isNull(), F.lit(0))
        .otherwise(F.size("_lines") - F.size("_kept"))
        .cast("long")
        .alias("n_dropped"),
        F.array_join("_kept", "\n").alias("text"),
    )
