"""Newest-first ranks and files without sorting a group in one task.

``newest_rank`` numbers the rows of a group from the newest on.  A window over
the group would put all rows of a hot app into one task; here rows are numbered
inside (group, hour) cells, and each cell starts after the rows of the newer
cells, a running sum over the counts of cells.

``newest_first`` deals rows by ranges of (group, newest, id) and sorts inside
the ranges, so files written from it are in order by their part numbers, and a
hot app is cut over as many files as its rows fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.operators.recent import keyed, unkeyed
from reviewlens.operators.topk import newest

NO_DATE = "0001-01-01"


def newest_rank(df: DataFrame, by: Sequence[str] = ("app_id",), out: str = "rank") -> DataFrame:
    """Add ``out``: 1 for the newest row of its group (date desc, review_id; rows without a date last).
    Rows equal in date and id get consecutive ranks in any order."""
    d, keys = keyed(df, by)
    cell = F.coalesce(F.date_trunc("hour", "date"), F.lit(NO_DATE).cast("timestamp")).alias("_cell")
    safe = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    counts = d.select(*safe, cell).groupBy(*names, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*names).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*names, "_cell", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    rows = d.select("*", *safe, cell).join(starts, [*names, "_cell"])
    inside = Window.partitionBy(*names, "_cell").orderBy(*newest())
    ranked = rows.withColumn(out, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
    return unkeyed(ranked.drop(*names, "_cell", "_before"), by)


def newest_first(df: DataFrame, by: Sequence[str] = ("app_id",), files: int | None = None) -> DataFrame:
    """Rows in order of (group, newest, id) over range partitions."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k) for k in by] + newest()
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)
