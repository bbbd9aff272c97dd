"""Crawl bookkeeping as Spark jobs: frontiers of ids not yet fetched, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(df: DataFrame, item: str, order: list[str]) -> DataFrame:
    """Distinct items keeping the first occurrence (by ``order``):
    (item, first_<order[0]>). Declarative min: combined map-side."""
    out = df.filter(F.col(item).isNotNull()).groupBy(item).agg(
        F.min(F.struct(*[F.col(c) for c in order])).alias("_f"))
    return out.select(item, F.col("_f." + order[0]).alias("first_" + order[0]))


def not_seen(items: DataFrame, seen: DataFrame, item: str) -> DataFrame:
    """Items absent from ``seen`` (anti join on non-null keys)."""
    return items.join(seen.select(item).filter(F.col(item).isNotNull()), item, "left_anti")


def frontier(df: DataFrame, seen: DataFrame, item: str, order: list[str]) -> DataFrame:
    return not_seen(first_seen(df, item, order), seen, item)


def user_audit(users: DataFrame, media: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user: posts fetched and posts with a location; null when none."""
    agg = media.groupBy(user).agg(F.count(F.lit(1)).alias("sample_status_count"),
                                  F.count("location_id").alias("status_with_location_count"))
    return users.join(agg, user, "left")


def with_request_suffix(df: DataFrame, url: str, contains: str = "media.example", suffix: str = "?__a=1") -> DataFrame:
    """URLs containing ``contains`` with the request suffix appended."""
    return df.filter(F.col(url).contains(contains)).withColumn("request_url", F.concat(F.col(url), F.lit(suffix)))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Fixed-size pseudo-random sample without replacement: the ``n`` rows of
    smallest md5(key || seed) (top-k per task, then merged)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)).limit(n)


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(key)).limit(n)


def in_period(df: DataFrame, epoch_col: str, lo_epoch: int, hi_epoch: int) -> DataFrame:
    """Rows with lo < time < hi (both ends open), times as epoch seconds."""
    c = F.col(epoch_col)
    return df.filter((c > lo_epoch) & (c < hi_epoch))
