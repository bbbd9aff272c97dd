"""Queries that run Structured Streaming jobs to their end.

Each writes the derived input into a drop folder as several batches of files, drains it
one batch per micro-batch into a table in the shared folder and returns that table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.plans.ingest_queries import FLAT, SQL_FLAT
from geotrail.plans.oracle_prelude import hav, with_prelude
from geotrail.plans.registry import query
from geotrail.session import scratch_path, store
from geotrail.sources import derived, ingest, payloads
from geotrail.streaming import capture

BATCHES = 3


def _drop(df: DataFrame, folder: str, batches: int = BATCHES, by: str = "value") -> None:
    """``df`` as ``batches`` of text or parquet files, dealt by a hash: in no order of time.

    Batches are written one after the other, each by all tasks that read ``df``, which is
    evaluated once for each batch: callers store what is costly to derive."""
    x = df.withColumn("_batch", F.pmod(F.xxhash64(by), F.lit(batches)))
    for i in range(batches):
        part = x.filter(F.col("_batch") == i).drop("_batch").write.mode("append")
        part.text(folder) if df.columns == ["value"] else part.parquet(folder)


def _files_a_batch(spark, folder: str, batches: int = BATCHES) -> int:
    """How many files of a drop folder, oldest first, are one of its batches."""
    return math.ceil(len(spark.read.text(folder).inputFiles()) / batches)


def _payload_stream(spark, payload: DataFrame, folder: str) -> DataFrame:
    """Payloads dropped into ``folder``, as a stream of one batch per micro-batch."""
    _drop(payload, folder)
    return capture.read_payload_stream(spark, folder, max_files=_files_a_batch(spark, folder))


def _parquet_stream(spark, like: DataFrame, folder: str) -> DataFrame:
    """The two batches of parquet files in ``folder``, and what comes later, one per micro-batch."""
    return spark.readStream.schema(like.schema).option(
        "maxFilesPerTrigger", _files_a_batch(spark, folder, 2)).parquet(folder)


def _drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    q = capture.write_parquet_stream(stream, out, checkpoint)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


@query("stream_flatten", with_prelude("", SQL_FLAT))
def q_stream_flatten(spark, sf):
    """The posts of a drop folder, flattened batch by batch."""
    drop, out, checkpoint = (scratch_path(spark, n) for n in ("drop", "out", "checkpoint"))
    stream = capture.flatten_post_stream(
        _payload_stream(spark, store(payloads.post_payloads(spark, sf), "payloads"), drop))
    return _drain(stream.select(*FLAT), out, checkpoint)


BOX = (-10.0, 40.0, 20.0, 60.0)


@query("stream_bbox", with_prelude("", f"""
SELECT media_id, lat, lon FROM posts_a
WHERE (lon IS NOT NULL AND lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]})
   OR (lon IS NULL AND eid % 11 != 0 AND eid % 19 != 0
       AND place_lon BETWEEN {BOX[0]} AND {BOX[2]} AND place_lat BETWEEN {BOX[1]} AND {BOX[3]})
   OR (lon IS NULL AND eid % 11 != 0 AND eid % 19 = 0
       AND place_lon - 0.01 BETWEEN {BOX[0]} AND {BOX[2]} AND place_lat - 0.01 BETWEEN {BOX[1]} AND {BOX[3]})"""))
def q_stream_bbox(spark, sf):
    """The posts of a drop folder inside a box, by their point or their place."""
    drop, out, checkpoint = (scratch_path(spark, n) for n in ("drop", "out", "checkpoint"))
    stream = capture.flatten_post_stream(
        _payload_stream(spark, store(payloads.post_payloads(spark, sf), "payloads"), drop))
    return _drain(capture.bbox_stream(stream, BOX).select("media_id", "lat", "lon"), out, checkpoint)


@query("stream_dedup", with_prelude("", "SELECT media_id, user_id FROM posts_a"))
def q_stream_dedup(spark, sf):
    """Posts captured twice (every 17th), in different files, leave once."""
    drop, out, checkpoint = (scratch_path(spark, n) for n in ("drop", "out", "checkpoint"))
    posts = derived.posts_a_with_copies(spark, sf).select("media_id", "user_id", "create_time", "batch")
    _drop(posts, drop, 2, "batch")
    raw = _parquet_stream(spark, posts, drop)
    return _drain(capture.dedup_stream(raw, "36500 days").select("media_id", "user_id"), out, checkpoint)


SQL_SPEED = """
mv AS (SELECT *, lag(place_lat) OVER w AS p_lat, lag(place_lon) OVER w AS p_lon, lag(create_epoch) OVER w AS p_t
       FROM posts_a WINDOW w AS (PARTITION BY user_id ORDER BY create_epoch, media_id)),
mv2 AS (SELECT *, {dist} AS dist, create_epoch - p_t AS interarrivaltime FROM mv),
checked AS (SELECT *, dist * 3600 / interarrivaltime AS speed FROM mv2
            WHERE interarrivaltime != 0 OR interarrivaltime IS NULL)""".format(
    dist=hav("place_lon", "place_lat", "p_lon", "p_lat"))
SPEED_COLS = ["user_id", "media_id", "create_time", "place_lat", "place_lon"]
CLOSING = "end of stream"


def _closing(spark, day: int) -> DataFrame:
    """A post of nobody in the far future: moves the watermark past all others."""
    return spark.createDataFrame([(CLOSING, f"z{day}", f"Sat Jan {day:02d} 10:00:00 +0000 2890", 0.0, 0.0)],
                                 "user_id string, media_id string, create_time string, place_lat double, place_lon double")


@query("stream_speed_check", with_prelude(SQL_SPEED, """
SELECT user_id, media_id, create_epoch AS t, round(dist, 3) AS dist,
       CAST(interarrivaltime AS BIGINT) AS interarrivaltime, round(speed, 3) AS speed
FROM checked WHERE speed <= 1000 OR speed IS NULL"""))
def q_stream_speed_check(spark, sf):
    """T4: the speed check over out-of-order files. The stream is stopped after some of
    them and goes on from its checkpoint; closing posts then release what still waits."""
    drop, out, checkpoint = (scratch_path(spark, n) for n in ("drop", "out", "checkpoint"))
    posts = store(derived.posts_a(spark, sf).select(*SPEED_COLS), "posts")
    first = F.pmod(F.xxhash64("media_id"), F.lit(5)) < 3
    _drop(posts.filter(first), drop, 2, "media_id")
    raw = _parquet_stream(spark, posts, drop)
    stream = capture.speed_check_stream(raw, "36500 days").filter(F.col("user_id") != CLOSING)
    _drain(stream, out, checkpoint)
    _drop(posts.filter(~first), drop, 2, "media_id")
    _drain(stream, out, checkpoint)
    for day in (1, 2):
        _closing(spark, day).coalesce(1).write.mode("append").parquet(drop)
        done = _drain(stream, out, checkpoint)
    return done.select("user_id", "media_id", "t", F.round("dist", 3).alias("dist"),
                       F.col("interarrivaltime").cast("long").alias("interarrivaltime"),
                       F.round("speed", 3).alias("speed"))


@query("stream_dead_letters", with_prelude("", """
SELECT media_id, CASE WHEN eid % 13 = 6 THEN 'dead' ELSE 'good' END AS kind FROM posts_a"""))
def q_stream_dead_letters(spark, sf):
    """T1 with F26: every 13th payload is cut short. Its first letters are whole, so
    both tables together must name every post once."""
    drop, good, dead, checkpoint = (scratch_path(spark, n) for n in ("drop", "good", "dead", "checkpoint"))
    p = payloads.post_payloads(spark, sf).withColumn("id", F.get_json_object("value", "$.id_str"))
    cut = F.col("id").cast("long") % 13 == 6
    p = store(p.select(F.when(cut, F.substring("value", 1, 60)).otherwise(F.col("value")).alias("value")), "payloads")
    capture.write_with_dead_letters(_payload_stream(spark, p, drop), good, dead, checkpoint).awaitTermination()
    fine = ingest.read_batches(spark, good).select("media_id", F.lit("good").alias("kind"))
    broken = ingest.read_batches(spark, dead).select(
        F.regexp_extract("value", r'"id_str":"(\d+)"', 1).alias("media_id"), F.lit("dead").alias("kind"))
    return fine.unionByName(broken)


@query("batch_sink_rerun", with_prelude("", "SELECT media_id, user_id, 'b' || CAST(eid % 3 AS VARCHAR) AS batch_ts FROM posts_a"))
def q_batch_sink_rerun(spark, sf):
    """One batch is written twice, one only by its rerun after a first try with
    other rows, and one was opened by a writer that never finished."""
    root = scratch_path(spark, "batches")
    posts = derived.posts_a(spark, sf).select("media_id", "user_id", (F.col("media_id").cast("long") % 3).alias("_b"))
    part = {i: posts.filter(F.col("_b") == i).drop("_b") for i in range(3)}
    ingest.write_batch(part[0], root, "b0")
    ingest.write_batch(part[2], root, "b1")
    ingest.write_batch(part[1], root, "b1")
    ingest.write_batch(part[2], root, "b2")
    ingest.write_batch(part[0], root, "b0")
    part[1].write.parquet(f"{root}/{ingest.STAMP}=b3")
    return ingest.read_batches(spark, root).select("media_id", "user_id", "batch_ts")
