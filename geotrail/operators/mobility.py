"""Country and language statistics of posting users (mobility report)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.operators.skew import cumulative_weight


def top_n(df: DataFrame, measure: str, key: str, n: int | None) -> DataFrame:
    """``n`` rows with the largest ``measure`` (all for None); ties broken by
    ``key`` (TakeOrderedAndProject: each task keeps its local top n)."""
    if n is None:
        return df
    return df.orderBy(F.col(measure).desc(), F.col(key).asc()).limit(n)


def posts_by_language(posts: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct posts per detected language (null excluded), the top ``n`` or all."""
    agg = (posts.filter(F.col("lang").isNotNull()).groupBy("lang")
           .agg(F.count_distinct("media_id").alias("posts")))
    return top_n(agg, "posts", "lang", n)


def user_country_counts(posts: DataFrame, user: str = "user_id", country: str = "country_code") -> DataFrame:
    """Distinct posts per (user, country); null countries excluded."""
    return (posts.filter(F.col(country).isNotNull()).groupBy(user, country)
            .agg(F.count_distinct("media_id").alias("count")))


def residence(counts: DataFrame, user: str = "user_id", country: str = "country_code",
              maxima_from: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """Country (or countries, ties kept) where a user posted most.

    Default: per-user maximum. The window is over the (user, country) count
    table, so a partition holds at most one row per country of that user.
    ``parity=True`` reproduces the reference's uncorrelated ``IN``: a row
    qualifies when its count equals *any* user's maximum, taken from
    ``maxima_from`` (default ``counts``; the reference used source A's counts
    for source B).
    """
    if not parity:
        w = Window.partitionBy(user)
        return (counts.withColumn("_max", F.max("count").over(w))
                .filter(F.col("count") == F.col("_max")).select(user, country))
    src = counts if maxima_from is None else maxima_from
    maxima = src.groupBy(src.columns[0]).agg(F.max("count").alias("count")).select("count").distinct()
    return counts.join(maxima, "count", "left_semi").select(user, country).distinct()


def users_by_country(res: DataFrame, user: str = "user_id", country: str = "country_code",
                     name: str = "users", n: int | None = None) -> DataFrame:
    agg = res.groupBy(country).agg(F.count_distinct(user).alias(name))
    return top_n(agg, name, country, n)


def mobile_users(posts: DataFrame, user: str = "user_id", country: str = "country_code") -> DataFrame:
    """Users seen in more than one country."""
    return (posts.filter(F.col(country).isNotNull()).groupBy(user)
            .agg(F.count_distinct(country).alias("_c")).filter(F.col("_c") > 1).select(user))


def mobile_from_counts(counts: DataFrame, user: str = "user_id") -> DataFrame:
    """``mobile_users`` from the (user, country) table, without another scan."""
    return counts.groupBy(user).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 1).select(user)


def mobile_users_by_country(res: DataFrame, mobile: DataFrame, user: str = "user_id",
                            country: str = "country_code", n: int | None = None) -> DataFrame:
    agg = (res.join(mobile, user, "inner").groupBy(country)
           .agg(F.count_distinct(user).alias("mobile_users")))
    return top_n(agg, "mobile_users", country, n)


def mobile_share_by_country(res: DataFrame, mobile: DataFrame, user: str = "user_id",
                            country: str = "country_code", n: int | None = None, parity: bool = False,
                            digits: int = 3, name: str = "mobile_share") -> DataFrame:
    """Mobile users / resident users per country, rounded to ``digits``.

    Default: the share is computed over all countries, then the top ``n`` (or
    all) kept. ``parity=True`` first cuts both lists to their top ``n`` as the
    reference did.
    """
    cut = n if parity else None
    m = mobile_users_by_country(res, mobile, user, country, cut)
    u = users_by_country(res, user, country, "users", cut)
    share = (m.join(u, country, "inner")
             .select(country, F.round(F.try_divide(F.col("mobile_users").cast("double"),
                                                   F.col("users").cast("double")), digits).alias(name)))
    return top_n(share, name, country, n)


def countries_per_user(posts: DataFrame, user: str = "user_id", country: str = "country_code") -> DataFrame:
    """Distinct countries per user (0 when the user has none)."""
    return posts.groupBy(user).agg(F.count_distinct(country).alias("countries"))


def density_histogram(values: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width density histogram (numpy ``density=True``): the last bin is
    closed; empty bins are present. Output (bin, lo, hi, count, density).

    Range and count come from one merged scalar subquery (no join).
    """
    v = values.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    vmin, vmax = v.agg(F.min("_v")).scalar(), v.agg(F.max("_v")).scalar()
    n = v.agg(F.count(F.lit(1))).scalar()
    # equal min and max: numpy widens the range to [v-0.5, v+0.5]
    lo = F.when(vmin == vmax, vmin - 0.5).otherwise(vmin)
    hi = F.when(vmin == vmax, vmax + 0.5).otherwise(vmax)
    width = (hi - lo) / bins
    counted = (v.select(F.least(F.floor((F.col("_v") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"))
               .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = v.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counted, "bin", "left")
    return out.select(
        "bin",
        (lo + F.col("bin") * width).alias("lo"),
        (lo + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        (F.coalesce(F.col("count"), F.lit(0)) / (n * width)).alias("density"))


def rank_desc(df: DataFrame, measure: str, key: str, name: str = "position") -> DataFrame:
    """1-based position in (measure desc, key asc) order over the whole frame,
    without a single-partition window (range partitioning, see skew.py)."""
    ranked = cumulative_weight(df, [], [F.col(measure).desc(), F.col(key).asc()])
    return ranked.withColumnRenamed("_cum", name).drop("_w", "_tot")


def stage_counts(stages: Sequence[tuple[str, DataFrame]], post: str = "media_id",
                 user: str = "user_id", approx: bool = False) -> DataFrame:
    """Distinct posts and users at each named stage, one row per stage.
    ``approx=True`` uses HyperLogLog++ (fixed memory, ~1 % error) for monitoring."""
    cd = (lambda c: F.approx_count_distinct(c, 0.01)) if approx else F.count_distinct
    out = None
    for name, df in stages:
        row = df.agg(cd(post).alias("posts"), cd(user).alias("users")) \
                .select(F.lit(name).alias("stage"), "posts", "users")
        out = row if out is None else out.unionByName(row)
    return out


def geotagged_share(posts: DataFrame, lat: str = "lat") -> DataFrame:
    """Geo-tagged posts, all posts and their ratio in one pass."""
    return posts.agg(F.count(F.lit(1)).alias("total"),
                     F.count(F.col(lat)).alias("tagged")).select(
        "tagged", "total", F.round(F.try_divide(F.col("tagged").cast("double"), F.col("total").cast("double")), 6)
        .alias("share"))
