from pyspark.sql import functions as F

from geotrail.operators import clean
from tests.conftest import rows

SCHEMA = "user_id string, media_id string, create_time timestamp, place_lat double, place_lon double"


def _posts(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_same_second_ties_broken_by_media_id(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 10, 0, 0)
    df = _posts(spark, [("u", "b", t, 48.85, 2.35), ("u", "a", t, 52.52, 13.40)])
    r = rows(clean.with_movement(df), "media_id", "interarrivaltime")
    assert r == [("a", None), ("b", 0)]
    out = clean.drop_impossible(clean.with_movement(df))
    assert rows(out, "media_id") == [("a",)]          # zero interval dropped, first kept


def _jump(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    h = dt.timedelta(hours=1)
    # A (Paris) -> B (Tokyo, one hour later) -> A (Paris, one hour later)
    return _posts(spark, [("u", "1", t0, 48.85, 2.35), ("u", "2", t0 + h, 35.68, 139.69),
                          ("u", "3", t0 + 2 * h, 48.85, 2.35), ("v", "9", t0, 1.0, 1.0)])


def test_jump_modes(spark):
    later = clean.drop_impossible(clean.with_movement(_jump(spark)), "later")
    assert rows(later, "media_id") == [("1",), ("9",)]      # no re-lag: the return hop goes too
    both = clean.drop_impossible(clean.with_movement(_jump(spark), keep_prev_id=True), "both")
    assert rows(both, "media_id") == [("9",)]
    user = clean.drop_impossible(clean.with_movement(_jump(spark)), "user")
    assert rows(user, "media_id") == [("9",)]


def test_hot_user_lag_equals_plain_window(spark):
    from pyspark.sql.window import Window
    df = spark.range(0, 3000).select(
        (F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string"))).alias("user_id"),
        F.format_string("%05d", "id").alias("media_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 100_000).alias("create_time"),
        (F.col("id") % 89 / 10.0).alias("place_lat"), (F.col("id") % 97 / 10.0).alias("place_lon"))
    got = clean.lag_within_user(df, "user_id", "create_time", "media_id", ["place_lat", "media_id"])
    w = Window.partitionBy("user_id").orderBy("create_time", "media_id")
    exp = df.select("media_id", F.lag("place_lat").over(w).alias("prev_place_lat"),
                    F.lag("media_id").over(w).alias("prev_media_id"))
    assert rows(got, "media_id", "prev_place_lat", "prev_media_id") == rows(exp)


def test_dedup_keeps_first_batch(spark):
    df = spark.createDataFrame([("m1", 2, "late"), ("m1", 1, "early"), ("m2", 1, "only")],
                               "media_id string, batch int, v string")
    assert rows(clean.dedup_first(df, "media_id", ["batch"]), "media_id", "v") == [("m1", "early"), ("m2", "only")]


def test_users_ever_in(spark):
    df = spark.createDataFrame([("a", "FR"), ("a", "US"), ("b", "US"), ("c", "UK")], "user_id string, country_code string")
    assert rows(clean.users_ever_in(df), "user_id", "country_code") == [("a", "FR"), ("a", "US"), ("c", "UK")]


def test_hot_user_lag_with_shuffle_joins(spark):
    """Same result when every join is a sort-merge join (no broadcast)."""
    from pyspark.sql.window import Window
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(0, 2000).select(
            (F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 30).cast("string"))).alias("user_id"),
            F.format_string("%05d", "id").alias("media_id"),
            F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 50_000).alias("create_time"),
            (F.col("id") % 89 / 10.0).alias("place_lat"), (F.col("id") % 97 / 10.0).alias("place_lon"),
            F.when(F.col("id") % 5 == 0, F.lit("FR")).otherwise(F.lit("US")).alias("country_code"))
        x = clean.users_ever_in(df)
        got = clean.lag_within_user(x, "user_id", "create_time", "media_id", ["place_lat"])
        w = Window.partitionBy("user_id").orderBy("create_time", "media_id")
        exp = x.select("media_id", F.lag("place_lat").over(w).alias("prev_place_lat"))
        assert rows(got, "media_id", "prev_place_lat") == rows(exp)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
