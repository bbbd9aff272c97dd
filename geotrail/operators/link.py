"""Cross-source account linking: a source-B post URL shared in a source-A post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions.text import place_label
from geotrail.operators.skew import shuffled


def normalise_url(c) -> F.Column:
    """Exact match by default; strip a trailing query string and slash case-insensitively."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\?.*$", ""), r"/+$", ""))


def link_accounts(posts_b: DataFrame, posts_a: DataFrame, normalise: bool = False) -> DataFrame:
    """Distinct (user_id of B, user_name of A, user_location of A) pairs whose
    B post URL equals the A post's expanded URL."""
    b = posts_b.select("user_id", F.col("url").alias("_u")).filter(F.col("_u").isNotNull())
    a = posts_a.select("user_name", "user_location", F.col("expanded_url").alias("_u")).filter(F.col("_u").isNotNull())
    if normalise:
        b, a = b.withColumn("_u", normalise_url(F.col("_u"))), a.withColumn("_u", normalise_url(F.col("_u")))
    # a URL posted many times on either side joins once per account
    return b.distinct().join(shuffled(a.distinct()), "_u").select("user_id", "user_name", "user_location").distinct()


def cross_source_posts(posts_b: DataFrame, links: DataFrame) -> DataFrame:
    """All B posts of linked B users in source-A shape (renamed to the A
    user's name), whole-row distinct."""
    l = links.select("user_id", "user_name").distinct()
    x = posts_b.drop("user_name").join(shuffled(l), "user_id", "inner")
    return x.select("user_name", "media_id", "followers_count", "lat", "lon",
                    F.col("city_name").alias("place_name"), F.col("country_id").alias("country_code")).distinct()


def home_candidates_both(cands_a: DataFrame, cross: DataFrame, min_posts: int = 3) -> DataFrame:
    """Source-A home candidates plus the B posts of linked users with at least
    ``min_posts`` distinct posts (no upper bound for B)."""
    users = cross.groupBy("user_name").agg(F.count_distinct("media_id").alias("_n")) \
        .filter(F.col("_n") >= min_posts).select("user_name")
    b = cross.join(shuffled(users), "user_name", "left_semi").select(
        "user_name", "media_id", "followers_count", "lat", "lon",
        place_label(F.col("place_name"), F.col("country_code")).alias("place_location"))
    return cands_a.select("user_name", "media_id", "followers_count", "lat", "lon", "place_location").unionByName(b)
