"""Newest-k rows per group without ranking a whole group in one task.

``row_number().over(partitionBy(app).orderBy(date desc))`` puts every row
of an app into one task — fatal when one app holds a third of the data, and
Spark plans no WindowGroupLimit for a per-group (non-literal) k.  Instead we
find, per group, the k-th newest row by histogram refinement (a distributed
radix select) in the total order date descending, review_id ascending (null as
the empty string), then a hash over all other columns:

1. ``day_counts``: rows per (group, day), a scan of two columns.  The counts
   of two tables add up (``merge_day_counts``), so a stored table keeps them
   beside its rows and an append only counts the new ones.  The running sum
   from the newest day finds the boundary day and how many of its rows are
   still needed (the same histogram gives the group's size);
2. only rows of boundary days are read again: while some boundary bucket is
   larger than ``exact_rows``, refine inside it: hour, minute, second,
   microsecond, growing prefixes of the id, the id;
3. rank the final boundary bucket by (date, id);
4. only where a group keeps some of several rows of one date and id, those
   rows are hashed over their other columns and refined by leading bits of the
   hash; what still ties is equal in every column and any of it will do.

Rows before the threshold are in.  Rows equal to it are counted: as many as are
needed stay, so k == min(need(n), n) always holds, with repeated rows as well.
Group keys are compared null-safely.  All histogram tables are tiny (groups x
buckets).  The per-group tables are broadcast only after their row count
(collected with the per-level check) is under ``BROADCAST_GROUPS``; above it
the join stays a shuffle join, where AQE splits a hot app's partition.

Rows without a date are never among the newest and are not counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.session import write_table

LEVELS = ("day", "hour", "minute", "second")
PREFIXES = (2, 4, 8, 16, 32)
EXACT_ROWS = 2_000_000
# per-group threshold rows are ~60 bytes: 1M groups ~ 60 MB, safe to broadcast
BROADCAST_GROUPS = 1_000_000
ALL = "__all"


def keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group keys; ``by=()`` becomes one constant key so joins stay equi-joins."""
    if by:
        return df, list(by)
    return df.withColumn(ALL, F.lit(0)), [ALL]


def unkeyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df if by else df.drop(ALL)


def recent_need(pct: float = tx.RECENT_PCT, floor_rows: int = tx.RECENT_MIN_ROWS) -> Callable[[Column], Column]:
    """k = max(floor_rows, int(n * pct)) as in the recent-slice rule."""
    return lambda n: F.greatest(F.lit(floor_rows), F.floor(n * F.lit(pct)).cast("bigint"))


def cap_need(n_cap: int) -> Callable[[Column], Column]:
    return lambda n: F.lit(n_cap).cast("bigint")


def _small(df: DataFrame, n_rows: int | None, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """Broadcast a per-group table only when its counted size is bounded;
    otherwise leave a shuffle join (AQE splits skewed partitions)."""
    return F.broadcast(df) if n_rows is not None and n_rows <= limit else df


def _safe(c: str) -> Column:
    """A group key as a string that is never null ("" is null, "=x" is x)."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _tie(df: DataFrame, keys: Sequence[str]) -> Column:
    rest = sorted(set(df.columns) - {*keys, "date", "review_id"})
    return F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in rest]) if rest else F.lit(0).cast("long")


def _rid() -> Column:
    return F.coalesce(F.col("review_id"), F.lit(""))


#: (bucket, descending) from coarse to exact; the first one is the day of the histogram.
def _by_time_and_id() -> list[tuple[Column, bool]]:
    rid = F.col("_rid")
    return ([(F.date_trunc(level, "date"), True) for level in LEVELS] + [(F.col("date"), True)]
            + [(F.left(rid, F.lit(n)), False) for n in PREFIXES] + [(rid, False)])


def _by_hash() -> list[tuple[Column, bool]]:
    return [(F.shiftright("_tie", n), False) for n in (48, 32, 16)] + [(F.col("_tie"), False)]


# ── mergeable day histograms ────────────────────────────────────────────────
def day_counts(df: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """(group, day, n): rows with a date of each group and day."""
    return df.where(F.col("date").isNotNull()).groupBy(*by, F.to_date("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def merge_day_counts(*tables: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """Counts of all tables together: what ``day_counts`` of their rows would give."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy(*by, "day").agg(F.sum("n").alias("n"))


def _boundary(hist: DataFrame, keys: Sequence[str], newest_first: bool) -> DataFrame:
    """The bucket of each group in which its count is reached (stored: one row per group)."""
    order = F.col("_b").desc() if newest_first else F.col("_b").asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_cum", F.sum("_c").over(w))
    return write_table(
        hist.where((F.col("_need") > 0) & (F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_c") < F.col("_need")))
        .select(*keys, "_b", "_c", (F.col("_need") - (F.col("_cum") - F.col("_c"))).alias("_need")))


def _refine(cand: DataFrame, keys: Sequence[str], levels: Sequence[tuple[Column, bool]], bnd: DataFrame, groups: int, biggest: int | None,
            exact_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the boundary buckets, cut down level by level, and how many of them each group needs."""
    for bucket, newest_first in levels:
        if biggest is None or biggest <= exact_rows:
            break
        state = _small(bnd.select(*keys, "_need"), groups)
        hist = cand.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c")).join(state, keys)
        bnd = _boundary(hist, keys, newest_first)
        biggest = bnd.agg(F.max("_c")).first()[0]
        cand = cand.withColumn("_b", bucket).join(_small(bnd.select(*keys, "_b"), groups), [*keys, "_b"]).drop("_b")
    return cand, bnd.select(*keys, "_need")


def _edge(cand: DataFrame, keys: Sequence[str], order: Sequence[Column], at: Sequence[str], state: DataFrame) -> DataFrame:
    """The k-th row of each group: its ``at`` columns, how many rows equal in them are in, how many there are."""
    equal = cand.groupBy(*keys, *at).agg(F.count(F.lit(1)).alias("t_equal"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = equal.withColumn("_cum", F.sum("t_equal").over(w)).join(state, keys)
    edge = edge.where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("t_equal") < F.col("_need")))
    return edge.select(*keys, *at, (F.col("_need") - F.col("_cum") + F.col("t_equal")).alias("t_keep"), "t_equal")


def newest_threshold(
    df: DataFrame,
    keys: Sequence[str],
    need: Callable[[Column], Column],
    exact_rows: int = EXACT_ROWS,
    stats: dict | None = None,
    histogram: DataFrame | None = None,
) -> DataFrame:
    """Per key (stored): t_date, t_rid, t_tie of the k-th newest row, k = min(need(n), n),
    t_keep and t_equal: how many of the rows equal to it are in, and how many there are
    (t_tie is null where date and id decide).

    ``keys`` hold no nulls.  ``histogram`` may give the day counts (keys, day,
    n) of the same rows.  ``stats`` (optional dict) receives ``groups``, the
    number of groups (to size-check later broadcasts), ``partial``, the number
    of groups that keep only some of the rows equal to their threshold, and
    ``first_day``, the earliest boundary day.
    """
    keys = list(keys)
    dated = df.where(F.col("date").isNotNull())
    hist = day_counts(df, keys) if histogram is None else histogram
    n = F.sum("_c").over(Window.partitionBy(*keys))
    hist = hist.select(*keys, F.col("day").alias("_b"), F.col("n").alias("_c"))
    hist = hist.withColumn("_need", F.least(need(n), n))
    bnd = _boundary(hist, keys, True)
    biggest, groups, first_day = bnd.agg(F.max("_c"), F.count(F.lit(1)), F.min("_b")).first()
    rows = dated.select(*keys, "date", _rid().alias("_rid"))
    cand = rows.withColumn("_b", F.to_date("date")).join(_small(bnd.select(*keys, "_b"), groups), [*keys, "_b"]).drop("_b")
    cand, state = _refine(cand, keys, _by_time_and_id()[1:], bnd, groups, biggest, exact_rows)
    edge = _edge(cand, keys, [F.col("date").desc(), F.col("_rid")], ["date", "_rid"], _small(state, groups))
    out = write_table(edge.select(*keys, F.col("date").alias("t_date"), F.col("_rid").alias("t_rid"), "t_keep", "t_equal"))
    partial = out.where("t_keep < t_equal").count()
    tied = partial > 0
    if tied:
        out = _break_ties(dated, keys, out, groups, exact_rows)
        partial = out.where("t_keep < t_equal").count()
    else:
        out = out.withColumn("t_tie", F.lit(None).cast("long"))
    if stats is not None:
        stats |= {"groups": groups, "partial": partial, "tied": tied, "first_day": first_day}
    return out


def _break_ties(dated: DataFrame, keys: Sequence[str], found: DataFrame, groups: int, exact_rows: int) -> DataFrame:
    """Thresholds with t_tie for the groups that keep some of several rows of one date and id."""
    some = found.where("t_keep < t_equal")
    tied = dated.join(_small(some.select(*keys, "t_date", "t_rid"), groups), keys).where(
        (F.col("date") == F.col("t_date")) & (_rid() == F.col("t_rid"))).drop("t_date", "t_rid")
    cand = tied.select(*keys, _tie(dated, keys).alias("_tie"))
    bnd = some.select(*keys, F.col("t_equal").alias("_c"), F.col("t_keep").alias("_need"))
    biggest = bnd.agg(F.max("_c")).first()[0]
    cand, state = _refine(cand, keys, _by_hash(), bnd, groups, biggest, exact_rows)
    edge = _edge(cand, keys, [F.col("_tie")], ["_tie"], _small(state, groups)).withColumnRenamed("_tie", "t_tie")
    parts = some.select(*keys, "t_date", "t_rid").join(_small(edge, groups), keys)
    rest = found.where("t_keep = t_equal").withColumn("t_tie", F.lit(None).cast("long"))
    return write_table(rest.unionByName(parts))


def flag_newest(df: DataFrame, by: Sequence[str], need: Callable[[Column], Column], out: str = "is_recent",
                exact_rows: int = EXACT_ROWS, histogram: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
    """Add boolean ``out``: row is among the newest need(n) rows of its group.

    ``histogram``: the day counts of ``df`` by the same groups, if they are
    stored (``day_counts`` columns).  The rows' other columns are hashed only
    on the threshold of a group that keeps a part of it.
    """
    safe = [f"_k{i}" for i in range(len(by))] or [ALL]
    keyed_by = lambda t: t.withColumns({k: _safe(c) for k, c in zip(safe, by)}) if by else t.withColumn(ALL, F.lit("="))
    d = keyed_by(df)
    stats = {} if stats is None else stats
    th = newest_threshold(d.drop(*by), safe, need, exact_rows, stats,
                          None if histogram is None else keyed_by(histogram).drop(*by))
    joined = d.join(_small(th, stats.get("groups")), safe, "left")
    rid = _rid()
    on_date = F.col("date") == F.col("t_date")
    before = (F.col("date") > F.col("t_date")) | (on_date & (rid < F.col("t_rid")))
    edge = on_date & (rid == F.col("t_rid"))
    if not stats["tied"]:
        flagged = joined.withColumn(out, F.coalesce(before | edge, F.lit(False)))
    else:
        tie = F.when(edge & F.col("t_tie").isNotNull(), _tie(d.drop(*by), safe))
        joined = joined.withColumn("_t", tie)
        whole = edge & F.coalesce(F.col("_t") == F.col("t_tie"), F.lit(True))
        inside = before | (edge & F.coalesce(F.col("_t") < F.col("t_tie"), F.lit(False)))
        # some group may keep only a part of rows that are equal in every column: number just those
        some = F.coalesce(whole & (F.col("t_keep") < F.col("t_equal")), F.lit(False))
        w = Window.partitionBy(*safe).orderBy(F.lit(1))
        flagged = joined.where(~some).withColumn(out, F.coalesce(inside | whole, F.lit(False))).unionByName(
            joined.where(some).withColumn("_i", F.row_number().over(w)).withColumn(out, F.col("_i") <= F.col("t_keep")).drop("_i"))
    return flagged.select(*df.columns, out)


def flag_recent(df: DataFrame, by: Sequence[str] = ("app_id",), pct: float = tx.RECENT_PCT, floor_rows: int = tx.RECENT_MIN_ROWS,
                exact_rows: int = EXACT_ROWS, histogram: DataFrame | None = None, stats: dict | None = None) -> DataFrame:
    return flag_newest(df, by, recent_need(pct, floor_rows), "is_recent", exact_rows, histogram, stats)


def recent_slice(df: DataFrame, by: Sequence[str] = ("app_id",), pct: float = tx.RECENT_PCT, floor_rows: int = tx.RECENT_MIN_ROWS,
                 exact_rows: int = EXACT_ROWS, histogram: DataFrame | None = None) -> DataFrame:
    """Rows of the recent slice.  All are dated at or after the earliest boundary day, a literal
    that reaches the scan: of a table whose row groups are sorted by date only the newest are read."""
    stats: dict = {}
    flagged = flag_recent(df, by, pct, floor_rows, exact_rows, histogram, stats)
    if stats.get("first_day") is not None:
        flagged = flagged.where(F.col("date") >= F.lit(str(stats["first_day"])).cast("timestamp_ntz"))
    return flagged.where("is_recent").drop("is_recent")


def newest_n(df: DataFrame, n: int, by: Sequence[str] = ("app_id",), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Exactly the newest n rows per group (all when fewer), ties and nulls included."""
    return flag_newest(df, by, cap_need(n), "_in", exact_rows).where("_in").drop("_in")
