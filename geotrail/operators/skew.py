"""Ordered work over keys of any size.

Any key (user, country, fold, also null) may hold a large share of all rows.
Work that needs the rows of a key in order (running totals, ranks, medians,
lags) goes through ``in_ranges``: the rows are range partitioned on (key,
order), so a large key spans as many partitions as its rows need, and are
written once with their partition number. What crosses from one partition to
the next is carried by a table with at most one row per partition. There is
one path for all keys; no row count switches the method.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.session import store

PART = "_pid"


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` range partitioned on (keys, order), with the partition number.

    Range bounds come from a sample, so two evaluations of the same plan may
    cut differently. The rows are therefore stored with the number they got,
    and everything derived from it reads the stored table."""
    return store(df.repartitionByRange(*[F.col(k) for k in keys], *_cols(order))
                 .withColumn(PART, F.spark_partition_id()), "ranges")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the input: joined by a shuffle.

    Spark would broadcast it, through the driver, while its size seems small; of stored
    tables it knows the compressed size only, and work in rounds does so many times."""
    return df.hint("merge")


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys of which some may be null (null meets null).

    Returns the columns of ``a`` and, unless the join is semi or anti, the other columns of ``b``."""
    b = b.withColumnsRenamed({k: "_r_" + k for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col("_r_" + k))
        on = same if on is None else on & same
    out = a.join(b, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*["_r_" + k for k in keys])


def cumulative_weight(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                      weight: Column | str | None = None) -> DataFrame:
    """Running total of ``weight`` within ``keys`` in ``order`` order.

    Adds ``_w``, ``_cum`` (inclusive running total) and ``_tot`` (group
    total). With weight 1 ``_cum`` is the 1-based row number. A null key is a
    key like any other. Groups that cross partitions have at most two rows
    per partition in the carried table, which is what makes it safe to
    broadcast."""
    w = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    r = in_ranges(df.withColumn("_w", w), keys, order)
    chunk = Window.partitionBy(PART, *keys)
    here = chunk.orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = r.withColumn("_lcum", F.sum("_w").over(here)).withColumn("_ltot", F.sum("_w").over(chunk))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_key.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = (r.groupBy(PART, *keys).agg(F.sum("_w").alias("_ptot"))
               .withColumn("_parts", F.count(F.lit(1)).over(by_key))
               .withColumn("_carry", F.coalesce(F.sum("_ptot").over(before), F.lit(0)))
               .withColumn("_ktot", F.sum("_ptot").over(by_key))
               .filter(F.col("_parts") > 1).select(PART, *keys, "_carry", "_ktot"))
    out = join_null_safe(rows, F.broadcast(carried), [PART, *keys], "left")
    return out.select(*df.columns, "_w",
                      (F.col("_lcum") + F.coalesce("_carry", F.lit(0))).alias("_cum"),
                      F.coalesce("_ktot", "_ltot").alias("_tot"))


def group_median(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Exact median of ``value`` per key; ``weight`` gives a multiplicity.

    Equal to numpy's median of the multiset (mean of the middle pair for an
    even count). Rows with null value or non-positive weight are ignored; keys
    with nothing left are absent. No task holds a whole key."""
    src = df.filter(F.col(value).isNotNull())
    if weight is not None:
        src = src.filter(F.col(weight) > 0)
    # equal values of a key become one row first: a value that most rows share
    # would otherwise fill one range
    copies = F.sum(F.lit(1) if weight is None else F.col(weight))
    ranked = cumulative_weight(src.groupBy(*keys, value).agg(copies.alias("_copies")), keys, [F.col(value)], "_copies")
    lo = F.floor((F.col("_tot") - 1) / 2)    # 0-based ranks of the middle pair
    hi = F.floor(F.col("_tot") / 2)
    start = F.col("_cum") - F.col("_w")       # 0-based rank of the row's first copy
    covers_lo = (start <= lo) & (lo < F.col("_cum"))
    covers_hi = (start <= hi) & (hi < F.col("_cum"))
    picked = ranked.filter(covers_lo | covers_hi).select(
        *keys, F.when(covers_lo, F.col(value)).alias("_vlo"), F.when(covers_hi, F.col(value)).alias("_vhi"))
    return picked.groupBy(*keys).agg(((F.max("_vlo") + F.max("_vhi")) / 2).alias(value))


def lag_in_order(df: DataFrame, key: str, order: Sequence[Column | str], cols: Sequence[str],
                 prefix: str) -> DataFrame:
    """``cols`` of the previous row of the same ``key``, as prefix + name.

    Like ``lag`` over a window on the key (nulls first, a null key is a key),
    but a key's rows may lie in many partitions: the first row of a partition
    takes the last row that the key has in an earlier one. At most one key
    crosses each partition border, so the carried table has at most one row
    per partition and is safe to broadcast."""
    r = in_ranges(df, [key], order)
    w = Window.partitionBy(PART, key).orderBy(*_cols(order))
    rows = r.select("*", *[F.lag(c, 1).over(w).alias("_lag_" + c) for c in cols],
                    (F.row_number().over(w) == 1).alias("_first"))
    last = r.select(PART, key, F.struct(*cols).alias("_end"),
                    F.lead(F.lit(1), 1).over(w).isNull().alias("_last")).filter("_last")
    carried = (last.withColumn("_carry", F.lag("_end", 1).over(Window.partitionBy(key).orderBy(PART)))
               .filter(F.col("_carry").isNotNull()).select(PART, key, "_carry"))
    out = join_null_safe(rows, F.broadcast(carried), [PART, key], "left")
    return out.select(*df.columns,
                      *[F.when(F.col("_first"), F.col("_carry." + c)).otherwise(F.col("_lag_" + c)).alias(prefix + c)
                        for c in cols])
