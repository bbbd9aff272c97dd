"""Structured Streaming versions of the capture and cleaning steps.

T1 incremental flatten: JSON drop folder -> flat parquet, checkpointed.
T2 bounding box on the stream.
T3 duplicate posts across captures: watermark + dropDuplicatesWithinWatermark.
T4 per-user speed check on arrival: a stateful processor (transformWithState)
   keyed by user; arrivals wait in map state until an event-time timer finds that
   the watermark has passed them, then leave in event-time order next to the
   user's previous post; the checks are the batch ones.
Dead letters: good posts and broken payloads of a stream, each batch exactly once.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from geotrail.functions.geo import haversine_km, in_bbox
from geotrail.functions.text import parse_post_time
from geotrail.operators.clean import drop_impossible
from geotrail.sources import ingest

WORLD_BOX = (-180.0, -85.0, 180.0, 85.0)


def read_payload_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New JSON-lines files of a drop folder as a stream of raw text."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def flatten_post_stream(raw: DataFrame) -> DataFrame:
    """The batch flattener applied to a stream (same code path)."""
    return ingest.flatten_posts(raw)


def bbox_stream(posts: DataFrame, box=WORLD_BOX) -> DataFrame:
    """Keep posts whose exact point (or place centroid) lies in the box."""
    lon = F.coalesce(F.col("lon"), F.col("place_lon"))
    lat = F.coalesce(F.col("lat"), F.col("place_lat"))
    return posts.filter(in_bbox(lon, lat, *box))


def dedup_stream(posts: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Drop repeated media_id among posts within the watermark delay."""
    x = posts.withColumn("event_time", parse_post_time(F.col("create_time")))
    return x.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["media_id"])


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which transformWithState needs.

    A stream takes the setting when it starts (and from its checkpoint when it starts
    again), so the session gets back what it had."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _trigger(writer, available_now: bool, every: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


def write_parquet_stream(df: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                         every: str = "1 hour"):
    """File sink with its own checkpoint (exactly-once across restarts)."""
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    with rocksdb_state(df.sparkSession):
        return _trigger(w, available_now, every).outputMode("append").start()


def write_with_dead_letters(raw: DataFrame, good: str, dead: str, checkpoint: str, available_now: bool = True,
                            every: str = "1 hour"):
    """Post payloads of a stream: flattened posts to ``good``, payloads that do not
    parse to ``dead``, whole.

    Both are batch tables (ingest.write_batch) with one folder per micro-batch. A
    micro-batch that is run again after a failure replaces its own folders, so every
    payload is in exactly one of the tables once; readers see committed batches only
    (ingest.read_batches). The batch's payloads are parsed once for each table."""
    def write(batch: DataFrame, number: int) -> None:
        stamp = f"b{number:012d}"
        ingest.write_batch(ingest.flatten_posts(batch), good, stamp)
        ingest.write_batch(ingest.quarantine(batch, ingest.POST_PAYLOAD), dead, stamp)

    w = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, every).start()


PREV_OUT = ("user_id string, media_id string, t long, place_lat double, place_lon double, "
            "prev_t long, prev_lat double, prev_lon double")
PREV = ["prev_t", "prev_lat", "prev_lon"]
Post = tuple[int, str | None, float | None, float | None]   # second, media_id, latitude, longitude
CHUNK = 10_000


def _nulls_first(post: Post) -> tuple:
    return post[0], post[1] is not None, post[1] or ""


class PreviousPost(StatefulProcessor):
    """Every post of a user with the post before it, in (time, media_id) order.

    Arrivals wait in ``held`` (number -> chunk of at most CHUNK posts, as they came), so
    the state is called a few times for a user's posts of one batch, not once for every
    second. One event-time timer per user stands at the earliest post held; when the
    watermark reaches it, all posts up to the watermark leave (nothing older can come any
    more), the others wait on and the timer moves. A timer needs no further post of the
    user, and none of anybody else in the same batch, so a user whose posts all came before
    the first watermark is released too. The last post that left stays in ``last`` for
    good: a user who returns after months is compared with it. ``held`` is bounded by the
    watermark delay."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, lat double, lon double")
        self.due = handle.getValueState("due", "ms long, chunks long")
        self.held = handle.getMapState(
            "held", "chunk long", "t array<long>, media array<string>, lat array<double>, lon array<double>")

    def _hold(self, posts: list[Post], due: tuple[int, int] | None) -> None:
        """Keep ``posts``; the user's one timer stands at the earliest unless it stands earlier."""
        chunks = due[1] if due else 0
        for i in range(0, len(posts), CHUNK):
            self.held.updateValue((chunks,), tuple(list(x) for x in zip(*posts[i:i + CHUNK])))
            chunks += 1
        ms = min(p[0] for p in posts) * 1000
        if due and due[0] <= ms:
            ms = due[0]
        else:
            if due:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(ms)
        self.due.update((ms, chunks))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if new := [(r["t"], r["media_id"], r["place_lat"], r["place_lon"]) for r in rows]:
            self._hold(new, self.due.get())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting: list[Post] = []
        for n in range(self.due.get()[1]):
            waiting += zip(*self.held.getValue((n,)))
            self.held.removeKey((n,))
        self.due.clear()
        last = self.last.get() or (None, None, None)
        out = []
        for t, media, lat, lon in sorted((p for p in waiting if p[0] * 1000 <= watermark), key=_nulls_first):
            out.append(Row(user_id=key[0], media_id=media, t=t, place_lat=lat, place_lon=lon,
                           prev_t=last[0], prev_lat=last[1], prev_lon=last[2]))
            last = (t, lat, lon)
        if out:
            self.last.update(last)
        if rest := [p for p in waiting if p[0] * 1000 > watermark]:
            self._hold(rest, None)
        return iter(out)


def speed_check_stream(posts: DataFrame, delay: str = "2 hours", max_speed: float = 1000.0) -> DataFrame:
    """T4: per-user impossible-speed filter on a stream of posts
    (needs user_id, media_id, create_time text, place_lat, place_lon).

    The processor only finds each post's predecessor; distance, interval, speed and
    the filters are the columns of the batch cleaning. Posts that come later than
    ``delay`` are dropped by the watermark, posts without a readable time at once. A
    post leaves when the watermark has passed it, whoever's posts moved it. Start the
    stream inside ``rocksdb_state`` (``write_parquet_stream`` does)."""
    x = posts.withColumn("event_time", parse_post_time(F.col("create_time")))
    x = x.select("user_id", "media_id", "event_time", F.unix_timestamp("event_time").alias("t"),
                 "place_lat", "place_lon").filter("event_time is not null").withWatermark("event_time", delay)
    x = x.groupBy("user_id").transformWithState(PreviousPost(), PREV_OUT, "append", "eventTime")
    x = x.withColumn("dist", haversine_km("place_lon", "place_lat", "prev_lon", "prev_lat"))
    x = x.withColumn("interarrivaltime", F.col("t") - F.col("prev_t")).drop(*PREV)
    return drop_impossible(x, "later", max_speed)
