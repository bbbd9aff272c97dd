"""Queries that work from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.operators import frontier, increment
from geotrail.plans.cleaning_queries import CLEAN_COLS_SQL, SQL_COPIES, _clean_cols
from geotrail.plans.link_queries import SQL_FRONTIER
from geotrail.plans.oracle_prelude import with_prelude
from geotrail.plans.registry import query
from geotrail.session import scratch_path, store
from geotrail.sources import derived
from geotrail.sources.ingest import read_batches, write_batch

RUNS = 3


def _in_turn(df: DataFrame, epoch) -> list[tuple[str, DataFrame]]:
    """``df`` as RUNS batches that follow each other in time: (stamp, rows)."""
    x = store(df.withColumn("_e", epoch), "timed")
    lo, hi = x.agg(F.min("_e"), F.max("_e")).first()
    lo, step = lo or 0, ((hi or 0) - (lo or 0)) // RUNS + 1
    number = F.floor((F.col("_e") - lo) / step)
    return [(f"run{i}", x.filter(number == i).drop("_e")) for i in range(RUNS)]


@query("clean_posts_incremental", with_prelude(SQL_COPIES, f"SELECT {CLEAN_COLS_SQL} FROM clean"))
def q_clean_posts_incremental(spark, sf):
    """Three batches cleaned in turn, the second one twice (as after a failure)."""
    root = scratch_path(spark, "incremental")
    posts = derived.posts_a_with_copies(spark, sf).select(
        "media_id", "user_id", "country_code", "create_time", "place_lat", "place_lon", "batch")
    epoch = F.unix_timestamp(F.to_timestamp(F.substring("create_time", 5, 64), "MMM dd HH:mm:ss Z yyyy"))
    first, second, third = _in_turn(posts, epoch)
    for stamp, rows in (first, second, second, third):
        increment.clean_batch(rows, root, stamp)
    return _clean_cols(increment.cleaned_posts(spark, root))


@query("frontier_seen_runs", with_prelude(SQL_FRONTIER, """
SELECT user_name, min(create_time_stamp) AS first_create_time_stamp FROM seen_b
WHERE user_name NOT IN (SELECT user_name FROM users_b WHERE uid % 4 = 0) GROUP BY user_name"""))
def q_frontier_seen_runs(spark, sf):
    """The user frontier over three captures: each reads its own media and the seen set,
    which starts with the users already queried."""
    users = store(derived.users_b(spark, sf).select("user_id", "user_name"), "users")
    media = derived.media_b(spark, sf).join(users, "user_id").select("user_name", "create_time_stamp", "media_id")
    seen, out = scratch_path(spark, "seen"), scratch_path(spark, "frontier")
    increment.remember(users.filter(F.substring("user_id", 2, 20).cast("long") % 4 == 0), "user_name", seen, "run")
    for stamp, rows in _in_turn(media, F.col("create_time_stamp")):
        new = increment.unseen(frontier.first_seen(rows, "user_name", ["create_time_stamp", "media_id"]), "user_name",
                               seen, stamp)
        write_batch(new, out, stamp)
        increment.remember(rows.select("user_name"), "user_name", seen, stamp)
    return read_batches(spark, out).select("user_name", "first_create_time_stamp")


@query("sketched_countries", with_prelude("", """
SELECT country_code, count(*) AS posts, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close
FROM posts_a GROUP BY country_code"""))
def q_sketched_countries(spark, sf):
    """Users and median post time per country from sketches of three batches, next to the
    exact numbers: users within 5 %, the median's rank within 2 % of the posts."""
    root = scratch_path(spark, "sketches")
    posts = derived.posts_a(spark, sf).select(
        "country_code", "user_id", F.unix_timestamp(F.to_timestamp(F.substring("create_time", 5, 64), "MMM dd HH:mm:ss Z yyyy"))
        .alias("t"))
    posts = store(posts, "posts")
    for stamp, rows in _in_turn(posts, F.col("t")):
        write_batch(increment.sketch_batch(rows, ["country_code"], "user_id", "t"), root, stamp)
    merged = increment.merge_sketches(read_batches(spark, root), ["country_code"])
    sketched = store(increment.sketch_estimates(merged, ["country_code"]), "estimates")
    exact = posts.groupBy("country_code").agg(F.count("*").alias("posts"), F.count_distinct("user_id").alias("users"))
    below = posts.join(sketched.select("country_code", "q50"), "country_code").groupBy("country_code").agg(
        F.count_if(F.col("t") < F.col("q50")).alias("lt"), F.count_if(F.col("t") <= F.col("q50")).alias("le"))
    x = exact.join(sketched.select("country_code", "items", "rows"), "country_code").join(below, "country_code")
    margin = F.col("posts") * 0.02 + 1
    return x.filter(F.col("rows") == F.col("posts")).select(
        "country_code", "posts", "users", (F.abs(F.col("items") - F.col("users")) <= F.col("users") * 0.05 + 1).alias("users_close"),
        ((F.col("lt") <= F.col("posts") / 2 + margin) & (F.col("le") >= F.col("posts") / 2 - margin)).alias("median_close"))
