"""Mention graph: @names -> weighted directed edges -> reciprocal edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions.text import extract_mentions
from geotrail.operators.skew import shuffled


def with_mentions(posts: DataFrame, text: str = "text") -> DataFrame:
    """Posts whose text contains '@', with ``mentions`` array (in order,
    repeats kept) and ``mention`` as the comma-joined string."""
    x = posts.filter(F.col(text).contains("@"))
    x = x.withColumn("mentions", extract_mentions(F.col(text)))
    return x.withColumn("mention", F.concat_ws(",", F.col("mentions")))


def explode_mentions(posts_with_mentions: DataFrame, user: str = "user_name",
                     media: str = "media_id", parity: bool = False) -> DataFrame:
    """One row per (post, mention). ``parity=True`` keeps the empty target
    that a text with '@' but no name produced in the reference."""
    x = posts_with_mentions
    if parity:
        arr = F.when(F.size("mentions") == 0, F.array(F.lit(""))).otherwise(F.col("mentions"))
    else:
        arr = F.col("mentions")
    return x.select(F.col(user), F.col(media), F.explode(arr).alias("mention"))


def mention_edges(posts: DataFrame, user: str = "user_name", media: str = "media_id",
                  text: str = "text", parity: bool = False) -> DataFrame:
    """Directed edges (source, target, weight = mentions of target by source);
    a name repeated in one post counts twice. Partial aggregation keeps a
    prolific author from reaching one task as raw rows."""
    rows = explode_mentions(with_mentions(posts, text), user, media, parity)
    return (rows.groupBy(F.col(user).alias("source"), F.col("mention").alias("target"))
            .agg(F.count(media).alias("weight")))


def reciprocal_edges(edges: DataFrame) -> DataFrame:
    """Edges present in both directions, weight = min of the two; self loops
    dropped. Output both directions (source, target, weight).

    Instead of joining the edge table with itself on two keys, each edge is
    keyed by its unordered pair (least, greatest) and one aggregation
    finds pairs seen from both ends.
    """
    e = edges.filter(F.col("source") != F.col("target"))
    lo, hi = F.least("source", "target"), F.greatest("source", "target")
    pairs = (e.groupBy(lo.alias("_a"), hi.alias("_b"))
             .agg(F.count(F.lit(1)).alias("_dirs"), F.min("weight").alias("weight"))
             .filter(F.col("_dirs") == 2))
    return pairs.select(
        F.explode(F.array(F.struct(F.col("_a").alias("source"), F.col("_b").alias("target")),
                          F.struct(F.col("_b").alias("source"), F.col("_a").alias("target")))).alias("_e"),
        "weight").select("_e.source", "_e.target", F.col("weight").cast("long").alias("weight"))


def network_posts(posts: DataFrame, rec_edges: DataFrame, user: str = "user_name") -> DataFrame:
    """Posts of users that have at least one reciprocal edge."""
    members = rec_edges.select(F.col("source").alias(user)).distinct()
    return posts.join(shuffled(members), user, "left_semi")
