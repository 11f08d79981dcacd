"""CSV sinks (A8 full export, A9 filtered explorer export), newest first.

Distributed write in order: rows are dealt by ranges of (app, newest, id) and
sorted inside, so the numbered part files of an app's folder, read one after
the other, are its reviews from the newest on; a hot app fills several parts.
``header`` plus ``escape='"'`` and ``emptyValue=''`` make the bytes of each row
match pandas ``to_csv`` (doubled quotes, quoted embedded newlines, empty strings
unquoted).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.ordered import newest_first
from reviewlens.plans import reports as RP

CSV_OPTIONS = {"header": "true", "escape": '"', "emptyValue": "", "encoding": "UTF-8", "lineSep": "\n"}


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Rows as they come."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).partitionBy(*partition_by).csv(path)


def write_newest_first(df: DataFrame, path: str, columns: Sequence[Column], files: int | None = None) -> None:
    """``columns`` of ``df``, newest first, one folder per app (``app_id=...``)."""
    write_csv(newest_first(df, files=files).select("app_id", *columns), path, partition_by=("app_id",))


def export_all(enriched: DataFrame, path: str, files: int | None = None) -> None:
    """date, rating, sentiment_label, complaint_categories, review_text."""
    write_newest_first(enriched, path, RP.export_columns(), files)


def export_filtered(enriched: DataFrame, path: str, primary: str = "All Reviews", chips=(), query=None, files: int | None = None) -> None:
    rows = RP.explorer_rows(enriched, primary, chips, query)
    write_newest_first(rows, path, [F.col("Day").alias("Date"), *map(F.col, RP.EXPLORER[1:])], files)
