import os
import tempfile

from pyspark.sql import functions as F

from geotrail.operators import clean
from geotrail.plans import stream_queries
from geotrail.sources import ingest, payloads
from geotrail.streaming import capture
from tests.conftest import rows


def _drop_folder(spark, sf, parts=3):
    d = tempfile.mkdtemp(prefix="geotrail-drop-")
    p = payloads.post_payloads(spark, sf)
    for i in range(parts):
        p.filter(F.pmod(F.xxhash64("value"), F.lit(parts)) == i).coalesce(1).write.text(os.path.join(d, f"batch{i}"))
    return d


def test_flatten_stream_drains_to_batch(spark, sf_small):
    d = _drop_folder(spark, sf_small)
    out, ck = tempfile.mkdtemp(prefix="geotrail-out-"), tempfile.mkdtemp(prefix="geotrail-ck-")
    stream = capture.flatten_post_stream(capture.read_payload_stream(spark, os.path.join(d, "*"), max_files=1))
    q = capture.write_parquet_stream(stream.select("media_id", "user_id", "place_lat", "lat"), out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    exp = ingest.flatten_posts(payloads.post_payloads(spark, sf_small)).select("media_id", "user_id", "place_lat", "lat")
    assert rows(got) == rows(exp)


def test_bbox_and_dedup_stream(spark, sf_small):
    d = _drop_folder(spark, sf_small, parts=2)
    dup = tempfile.mkdtemp(prefix="geotrail-dup-")
    payloads.post_payloads(spark, sf_small).limit(50).coalesce(1).write.text(os.path.join(dup, "again"))
    src = capture.read_payload_stream(spark, os.path.join(d, "*")).unionByName(
        capture.read_payload_stream(spark, os.path.join(dup, "*")))
    s = capture.dedup_stream(capture.bbox_stream(capture.flatten_post_stream(src)), "3650 days")
    q = s.select("media_id").writeStream.format("memory").queryName("dedup_out").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.sql("select media_id from dedup_out")
    exp = capture.bbox_stream(ingest.flatten_posts(payloads.post_payloads(spark, sf_small))).select("media_id")
    assert got.count() == got.distinct().count()
    assert rows(got) == rows(exp)


def _speed_drain(spark, posts, folder, delay, name):
    """Drain one file per micro-batch through the speed check."""
    src = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "*"))
    s = capture.speed_check_stream(src, delay=delay)
    with capture.rocksdb_state(spark):
        q = s.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.sql(f"select * from {name} where user_id != 'end'")


def _batch_check(posts):
    b = posts.withColumn("create_time", F.to_timestamp(F.substring("create_time", 5, 64), "MMM dd HH:mm:ss Z yyyy"))
    return clean.drop_impossible(clean.with_movement(b))


def test_speed_stream_equals_batch_over_many_unordered_batches(spark, sf_small):
    from geotrail.sources import derived
    posts = derived.posts_a(spark, sf_small).select("user_id", "media_id", "create_time", "place_lat", "place_lon")
    d = tempfile.mkdtemp(prefix="geotrail-speed-")
    n = 6
    # every file holds posts of the whole period: nothing is later than the delay, nothing in order
    for i in range(n):
        part = posts.filter(F.pmod(F.xxhash64("media_id"), F.lit(n)) == i)
        part.coalesce(1).write.parquet(os.path.join(d, f"a{i}"))
    for i, year in enumerate((2090, 2095, 2099)):         # moves the watermark past everything
        end = spark.createDataFrame([("end", f"e{i}", f"Sat Jan 01 10:00:00 +0000 {year}", 1.0, 1.0)], posts.schema)
        end.coalesce(1).write.parquet(os.path.join(d, f"z{i}"))
    got = _speed_drain(spark, posts, d, "3650 days", "speed_out")
    want = _batch_check(posts)
    cols = ["media_id", "interarrivaltime", F.round("dist", 6), F.round("speed", 6)]
    assert rows(got.select(*cols)) == rows(want.select(*cols))


def test_speed_stream_releases_a_user_of_the_first_file_only(spark):
    schema = "user_id string, media_id string, create_time string, place_lat double, place_lon double"
    d, before = tempfile.mkdtemp(prefix="geotrail-solo-"), spark.conf.get(capture.PROVIDER, None)
    files = [[("solo", "1", "Mon Jan 01 10:00:00 +0000 2024", 48.85, 2.35)],
             [("end", "e", "Wed Jan 01 10:00:00 +0000 2090", 1.0, 1.0)],
             [("end", "f", "Sun Jan 01 10:00:00 +0000 2095", 1.0, 1.0)]]
    for i, f in enumerate(files):
        df = spark.createDataFrame(f, schema)
        df.coalesce(1).write.parquet(os.path.join(d, f"f{i}"))
    got = _speed_drain(spark, df, d, "1 hour", "solo_out")
    assert [(r.media_id, r.dist, r.interarrivaltime) for r in got.filter("user_id = 'solo'").collect()] == [("1", None, None)]
    assert spark.conf.get(capture.PROVIDER, None) == before


def test_dead_letters_are_exactly_once_when_a_batch_runs_again(spark, sf_small):
    d = _drop_folder(spark, sf_small, parts=2)
    broken = tempfile.mkdtemp(prefix="geotrail-broken-")
    spark.createDataFrame([('{"id_str": "x', ), ("not json",), ('{"id_str": "x7"}',)], "value string").coalesce(1).write.text(
        os.path.join(broken, "b"))
    good, dead, ck = (tempfile.mkdtemp(prefix="geotrail-dl-") + "/t" for _ in range(3))

    def drain():
        raw = capture.read_payload_stream(spark, os.path.join(d, "*"), max_files=1).unionByName(
            capture.read_payload_stream(spark, os.path.join(broken, "*")))
        capture.write_with_dead_letters(raw, good, dead, ck).awaitTermination(300)
        return (rows(ingest.read_batches(spark, good).select("media_id", "user_id")),
                rows(ingest.read_batches(spark, dead).select("value")))
    first = drain()
    commits = sorted(f for f in os.listdir(os.path.join(ck, "commits")) if f.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):           # as if the driver died after writing, before the commit
        if os.path.exists(os.path.join(ck, "commits", name)):
            os.remove(os.path.join(ck, "commits", name))
    assert drain() == first
    want = ingest.flatten_posts(payloads.post_payloads(spark, sf_small)).select("media_id", "user_id")
    assert [r for r in first[0] if r[0] != "x7"] == rows(want)
    assert ("not json",) in first[1] and len(first[1]) + len(first[0]) == want.count() + 3


def test_speed_stream_returns_after_a_long_break(spark):
    schema = "user_id string, media_id string, create_time string, place_lat double, place_lon double"
    d = tempfile.mkdtemp(prefix="geotrail-break-")
    files = [[("u", "1", "Mon Jan 01 10:00:00 +0000 2024", 48.85, 2.35)],
             [("x", "9", "Tue Jan 02 10:00:00 +0000 2024", 1.0, 1.0)],
             [("x", "8", "Wed Jan 03 10:00:00 +0000 2024", 1.0, 1.0)],
             [("u", "2", "Wed Jan 03 10:30:00 +0000 2024", 48.86, 2.35)],
             [("u", "3", "Wed Jan 03 11:30:00 +0000 2024", 35.68, 139.69)],      # Tokyo one hour later: impossible
             [("end", "e", "Wed Jan 01 10:00:00 +0000 2090", 1.0, 1.0)],
             [("end", "f", "Sun Jan 01 10:00:00 +0000 2095", 1.0, 1.0)]]
    for i, f in enumerate(files):
        df = spark.createDataFrame(f, schema)
        df.coalesce(1).write.parquet(os.path.join(d, f"f{i}"))
    got = _speed_drain(spark, df, d, "1 hour", "break_out")
    assert {r.media_id: r.interarrivaltime for r in got.filter("user_id = 'u'").collect()} == {
        "1": None, "2": 2 * 86_400 + 1800}


def test_drop_folder_is_written_by_all_tasks_and_read_batch_by_batch(spark):
    folder, out, ck = (tempfile.mkdtemp(prefix=f"geotrail-{n}-") + "/t" for n in ("drop", "out", "ck"))
    payload = spark.range(3000).repartition(4).select(
        F.to_json(F.struct(F.col("id").cast("string").alias("id_str"))).alias("value"))
    raw = stream_queries._payload_stream(spark, payload, folder)
    files = spark.read.text(folder).groupBy(F.input_file_name()).agg(
        F.count_distinct(F.pmod(F.xxhash64("value"), F.lit(stream_queries.BATCHES))).alias("n")).collect()
    assert len(files) == 4 * stream_queries.BATCHES and {f.n for f in files} == {1}
    got = stream_queries._drain(capture.flatten_post_stream(raw).select("media_id"), out, ck)
    assert sorted(int(r.media_id) for r in got.collect()) == list(range(3000))
    assert sum(f.isdigit() for f in os.listdir(os.path.join(ck, "commits"))) == stream_queries.BATCHES
