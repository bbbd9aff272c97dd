import math

from pyspark.sql import functions as F

from geotrail.functions import geo, text


def test_haversine_properties(spark):
    df = spark.createDataFrame(
        [(2.35, 48.85, 13.40, 52.52), (0.0, 0.0, 180.0, 0.0), (10.0, 10.0, 10.0, 10.0), (None, 1.0, 2.0, 3.0)],
        "lon1 double, lat1 double, lon2 double, lat2 double")
    r = df.select(geo.haversine_km("lon1", "lat1", "lon2", "lat2").alias("d"),
                  geo.haversine_km("lon2", "lat2", "lon1", "lat1").alias("back"),
                  geo.cosine_distance_km("lon1", "lat1", "lon2", "lat2").alias("cos")).collect()
    assert r[0]["d"] == r[0]["back"] and abs(r[0]["d"] - 877.5) < 2
    assert abs(r[1]["d"] - math.pi * 6371.0) < 1e-6          # antipodes: no NaN
    assert r[2]["d"] == 0.0 and r[2]["cos"] == 0.0            # equal points
    assert r[3]["d"] is None and r[3]["cos"] is None          # null in, null out
    assert abs(r[0]["cos"] - r[0]["d"]) < 1e-3


def test_bbox_centroid_missing_vertex(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None), (None, None)], "a double, b double")
    r = [x[0] for x in df.select(geo.bbox_centroid("a", "b")).collect()]
    assert r == [2.0, 1.0, None]


def test_mentions_unicode_email_and_repeats(spark):
    df = spark.createDataFrame([("@  bob",), ("@élan,",), ("x@y",), ("@!",), ("@a @a",), (None,)], "t string")
    r = [x[0] for x in df.select(text.extract_mentions("t")).collect()]
    assert r == [["bob"], ["élan"], ["y"], [], ["a", "a"], None]


def test_parse_post_time_offsets_and_garbage(spark):
    df = spark.createDataFrame([("Sat Dec 23 10:26:01 +0000 2017",), ("Sat Dec 23 10:26:01 +0100 2017",), ("nope",)],
                               "t string")
    r = [x[0] for x in df.select(F.unix_timestamp(text.parse_post_time("t"))).collect()]
    assert r == [1514024761, 1514024761 - 3600, None]


def test_profile_coordinates(spark):
    df = spark.createDataFrame([("48.8566, 2.3522",), ("Paris, France",), ("-33.8688,151.2093 home",)], "t string")
    r = df.select(text.profile_coordinates("t").alias("c")).collect()
    assert (r[0]["c"]["lat"], r[0]["c"]["lon"]) == (48.8566, 2.3522)
    assert r[1]["c"]["match"] is None
    assert (r[2]["c"]["lat"], r[2]["c"]["lon"]) == (-33.8688, 151.2093)
