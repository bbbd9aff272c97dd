"""Tables of the mobility data model derived from the driver's ``events``.

The driver ships TPC-H-like tables plus an ``events`` stream; the reference
consumes geo-tagged posts of two sources. These functions derive the
reference's tables from ``events`` by deterministic integer formulas
(FIXTURES.md §2) so that every query grows with the given data. All work is
column expressions over one scan of ``events``; the 12-row place list is a
literal array lookup (no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the test-data derivation (FIXTURES.md §2), in key order:
# (k, country code, city, country, lat0, lon0)
GEO_ROWS = [
    (0, "FR", "Paris", "France", 48.85, 2.35),
    (1, "DE", "Berlin", "Germany", 52.52, 13.40),
    (2, "IT", "Rome", "Italy", 41.90, 12.50),
    (3, "ES", "Madrid", "Spain", 40.42, -3.70),
    (4, "PL", "Warsaw", "Poland", 52.23, 21.01),
    (5, "SE", "Stockholm", "Sweden", 59.33, 18.07),
    (6, "AT", "Vienna", "Austria", 48.21, 16.37),
    (7, "RO", "Bucharest", "Romania", 44.43, 26.10),
    (8, "GB", "London", "United Kingdom", 51.51, -0.13),
    (9, "US", "New York", "United States", 40.71, -74.01),
    (10, "JP", "Tokyo", "Japan", 35.68, 139.69),
    (11, "NO", "Oslo", "Norway", 59.91, 10.75),
]
GEO_SCHEMA = "k int, code string, city string, country string, lat0 double, lon0 double"


def _lookup(k: Column, field: int) -> Column:
    """Literal-array lookup of one attribute of GEO_ROWS by key (0-based)."""
    return F.element_at(F.array(*[F.lit(r[field]) for r in GEO_ROWS]), k.cast("int") + 1)


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")


def geo(spark: SparkSession) -> DataFrame:
    """The 12-place dimension (size fixed by construction)."""
    return spark.createDataFrame(GEO_ROWS, GEO_SCHEMA)


def _home_key(uid: Column) -> Column:
    """Users in blocks of seven live in one city, so most friends (ids at most
    three apart) are near and some are far."""
    return (_div(uid, 7) * 5) % 12


def _place_key(eid: Column, uid: Column) -> Column:
    return (F.when((uid % 7 == 2) & (eid % 2 == 0), (uid + _div(eid, 2)) % 12)
            .when(uid % 3 == 0, _home_key(uid))
            .when(eid % 10 == 0, (uid + _div(eid, 10)) % 12)
            .otherwise(_home_key(uid)))


def post_time_text(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "),
                    F.date_format(ts, "yyyy"))


def posts_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-A posts, raw (create_time as text), one row per event."""
    e = events(spark, sf_dir)
    eid, uid = F.col("event_id"), F.col("user_id")
    e = e.select("event_id", "user_id", "ts", _place_key(eid, uid).alias("_k"), (_home_key(uid)).alias("_home"))
    k, home = F.col("_k"), F.col("_home")
    place_lat = _lookup(k, 4) + ((eid * 37) % 200 - 100).cast("double") / 1000
    place_lon = _lookup(k, 5) + ((eid * 53) % 200 - 100).cast("double") / 1000
    tagged = eid % 3 == 0
    expanded = (F.when(eid % 22 == 0, F.concat(F.lit("https://media.example/p/m"), eid.cast("string"), F.lit("/")))
                .when(eid % 13 == 0, F.concat(F.lit("https://other.example/"), eid.cast("string"))))
    return e.select(
        uid.cast("string").alias("user_id"),
        F.concat(F.lit("u"), uid.cast("string")).alias("user_name"),
        F.concat(F.lit("User "), uid.cast("string")).alias("full_name"),
        F.lit(None).cast("string").alias("user_description"),
        F.when(uid % 5 == 0, F.lit(None).cast("string"))
         .when(uid % 5 == 1, F.lit("48.8566, 2.3522"))
         .otherwise(F.concat(_lookup(home, 2), F.lit(", "), _lookup(home, 3))).alias("user_location"),
        (uid * 10 + 5).cast("long").alias("followers_count"),
        (uid * 3).cast("long").alias("follows_count"),
        (uid * 2 + 1).cast("long").alias("status_all_count"),
        (uid % 4).cast("long").alias("listed_count"),
        eid.cast("string").alias("media_id"),
        F.when(eid % 5 == 0, F.lit("plain text"))
         .otherwise(F.concat(F.lit("hi @u"), F.abs(uid + eid % 7 - 3).cast("string"))).alias("text"),
        post_time_text(F.col("ts")).alias("create_time"),
        F.when(eid % 6 == 0, F.lit(None).cast("string")).when(eid % 6 == 1, F.lit("fr"))
         .when(eid % 6 == 2, F.lit("de")).otherwise(F.lit("en")).alias("lang"),
        _lookup(k, 1).alias("country_code"),
        _lookup(k, 3).alias("country"),
        F.when(eid % 4 == 3, F.lit("admin")).otherwise(F.lit("city")).alias("place_type"),
        F.concat(_lookup(k, 2), F.lit(", "), _lookup(k, 3)).alias("place_full_name"),
        _lookup(k, 2).alias("place_name"),
        F.concat(F.lit("P"), k.cast("string")).alias("place_id"),
        place_lat.alias("place_lat"),
        place_lon.alias("place_lon"),
        F.when(tagged, place_lat).alias("lat"),
        F.when(tagged, place_lon).alias("lon"),
        expanded.alias("expanded_url"),
        F.when(expanded.isNotNull(), F.concat(F.lit("https://t.example/"), eid.cast("string"))).alias("url"),
    )


def posts_a_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posts_a captured twice for event_id % 17 = 0 (batch 1 and 2)."""
    p = posts_a(spark, sf_dir).withColumn("batch", F.lit(1))
    again = p.filter(F.col("media_id").cast("long") % 17 == 0).withColumn("batch", F.lit(2))
    return p.unionByName(again)


def media_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-B media: even events."""
    e = events(spark, sf_dir).filter(F.col("event_id") % 2 == 0)
    eid, uid = F.col("event_id"), F.col("user_id")
    e = e.withColumn("_kb", F.when(eid % 8 == 0, (uid + _div(eid, 8)) % 12).otherwise(_home_key(uid)))
    kb = F.col("_kb")
    return e.select(
        F.concat(F.lit("m"), eid.cast("string")).alias("media_id"),
        F.concat(F.lit("b"), uid.cast("string")).alias("user_id"),
        F.when(eid % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("L"), kb.cast("string"))).alias("location_id"),
        F.when(eid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("pic "), eid.cast("string"))).alias("text"),
        F.unix_timestamp(F.col("ts")).alias("create_time_stamp"),
        F.concat(F.lit("https://media.example/p/m"), eid.cast("string"), F.lit("/")).alias("url"),
    )


def users_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-B users: distinct event users except user_id % 10 = 7."""
    u = (events(spark, sf_dir).select("user_id").filter(F.col("user_id") % 10 != 7).distinct())
    uid = F.col("user_id")
    return u.select(
        F.concat(F.lit("b"), uid.cast("string")).alias("user_id"),
        F.concat(F.lit("ig"), uid.cast("string")).alias("user_name"),
        F.concat(F.lit("Insta "), uid.cast("string")).alias("full_name"),
        F.lit(None).cast("string").alias("user_description"),
        (uid * 10 + 5).cast("long").alias("followers_count"),
        (uid * 3).cast("long").alias("follows_count"),
        (uid * 2 + 1).cast("long").alias("status_all_count"),
    )


def locations_b_for(df_with_location_id: DataFrame) -> DataFrame:
    """Location dimension rows for the location ids present in a frame."""
    k = F.substring(F.col("location_id"), 2, 8).cast("int")
    return (df_with_location_id.select("location_id").filter(F.col("location_id").isNotNull()).distinct()
            .select(
                F.col("location_id"),
                _lookup(k, 2).alias("location_name"),
                _lookup(k, 4).alias("lat"),
                _lookup(k, 5).alias("lon"),
                _lookup(k, 1).alias("country_id"),
                _lookup(k, 3).alias("country_name"),
                F.concat(F.lit("C"), k.cast("string")).alias("city_id"),
                _lookup(k, 2).alias("city_name"),
            ))


def locations_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations_b_for(media_b(spark, sf_dir))


def profile_truth_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile ground truth as read from its CSV: every column a string."""
    u = events(spark, sf_dir).select("user_id").distinct().filter((F.col("user_id") % 5).isin(2, 3, 4))
    uid = F.col("user_id")
    home = _home_key(uid)
    return u.select(
        F.concat(F.lit("u"), uid.cast("string")).alias("user_name"),
        _lookup(home, 4).cast("string").alias("lat"),
        _lookup(home, 5).cast("string").alias("lon"),
        _lookup(home, 2).alias("user_city"),
        _lookup(home, 3).alias("user_country"),
    )


def gazetteer(spark: SparkSession) -> DataFrame:
    """Place name -> point table keyed by lower('city, country')."""
    return geo(spark).select(
        F.lower(F.concat(F.col("city"), F.lit(", "), F.col("country"))).alias("key"),
        F.col("city"), F.col("country"), F.col("code"),
        F.col("lat0").alias("lat"), F.col("lon0").alias("lon"))


def unclean_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text home of every event user: by user_id % 10 exact, without country, words
    turned round, one letter missing, doubled or swapped, with other words, with the
    country code, elsewhere, or null; the letter by floor(user_id / 10)."""
    u = events(spark, sf_dir).select("user_id").distinct()
    uid = F.col("user_id")
    u = u.select(uid, _lookup(_home_key(uid), 2).alias("c"), _lookup(_home_key(uid), 3).alias("n"),
                 _lookup(_home_key(uid), 1).alias("cc"))
    c, n = F.col("c"), F.col("n")
    at = (_div(uid, 10) % (F.length(c) - 2) + 2).cast("int")         # 2 .. length - 1
    letter, head, tail = F.substring(c, at, F.lit(1)), F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.lit(99))
    texts = {0: F.concat(c, F.lit(", "), n), 1: c, 2: F.upper(F.concat(n, F.lit(" - "), c)),
             3: F.concat(head, tail, F.lit(", "), n), 4: F.concat(head, letter, letter, tail),
             5: F.concat(F.lit(" near "), c, F.lit("!! ")),
             6: F.concat(head, F.substring(tail, 1, 1), letter, F.substring(tail, 2, 99), F.lit(" ("), n, F.lit(")")),
             8: F.lit("somewhere over the rainbow"), 9: F.concat(c, F.lit(" "), F.col("cc"))}
    text = F.lit(None).cast("string")
    for k, v in texts.items():
        text = F.when(uid % 10 == k, v).otherwise(text)
    return u.select(F.concat(F.lit("u"), uid.cast("string")).alias("user_name"), text.alias("user_location"))


def gazetteer_with_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cities, and the given nations as places of their regions (points by nation key)."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    k = F.col("n_nationkey").cast("double")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.lower(F.concat_ws(", ", "n_name", "r_name")).alias("key"), F.col("n_name").alias("city"),
        F.col("r_name").alias("country"), F.lit(None).cast("string").alias("code"),
        (k * 3.5 - 40).alias("lat"), (k * 7 - 80).alias("lon"))
    return gazetteer(spark).unionByName(places)
