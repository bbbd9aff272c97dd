import random
import tempfile

from pyspark.sql import functions as F

from geotrail.operators import clean, home, increment
from geotrail.operators.skew import group_median
from geotrail.sources.ingest import read_batches
from tests.conftest import rows

POST = "media_id string, user_id string, country_code string, create_time string, place_lat double, place_lon double"


def _cols(df):
    return df.select("media_id", "user_id", "interarrivaltime", F.round("dist", 6), F.round("speed", 6))


def _root(name):
    return tempfile.mkdtemp(prefix=f"geotrail-{name}-") + "/t"


def _post(i, user, minute, lat=48.0, lon=2.0, code="FR"):
    return (str(i), user, code, f"Mon Jan {1 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00 +0000 2024", lat, lon)


def test_batches_in_turn_equal_one_cleaning(spark):
    r = random.Random(6)
    posts = [_post(i, f"u{r.randrange(6)}", i * 7, 48 + r.random() * 8, 2 + r.random() * 8,
                   "FR" if r.random() < .1 else "US") for i in range(300)]
    posts[10] = (*posts[10][:4], None, None)
    root = _root("clean")
    for k in range(4):
        part = posts[k * 75:(k + 1) * 75] + posts[k * 75:k * 75 + 5] + (posts[:3] if k else [])    # copies in and across
        for _ in range(1 + (k == 2)):                                                          # one batch again
            increment.clean_batch(spark.createDataFrame(part, POST), root, f"b{k}")
    want = clean.clean_posts_a(spark.createDataFrame(posts, POST))
    assert rows(_cols(increment.cleaned_posts(spark, root))) == rows(_cols(want))
    assert read_batches(spark, f"{root}/late").count() == 0


def test_late_posts_are_kept_apart(spark):
    root = _root("late")
    increment.clean_batch(spark.createDataFrame([_post(1, "a", 100), _post(2, "b", 100)], POST), root, "b1")
    second = [_post(3, "a", 50), _post(4, "a", 200), _post(5, "b", 100), ("6", "a", "FR", "no time", 1.0, 1.0), _post(7, "c", 1)]
    increment.clean_batch(spark.createDataFrame(second, POST), root, "b2")
    got = {r.media_id: r.interarrivaltime for r in increment.cleaned_posts(spark, root).collect()}
    assert got == {"1": None, "2": None, "4": 6000, "7": None}          # 5: no time since 2
    assert rows(read_batches(spark, f"{root}/late"), "media_id") == [("3",), ("6",)]


def test_seen_ids_with_shared_positions(spark, monkeypatch):
    monkeypatch.setattr(increment, "SEEN_BITS", 15)         # one bucket: thousands of ids share a position
    root = _root("seen")
    ids = lambda lo, hi: spark.range(lo, hi).select(F.col("id").cast("string").alias("id"))
    assert increment.unseen(ids(0, 10), "id", root, "a").count() == 10
    increment.remember(ids(0, 40_000), "id", root, "a")
    increment.remember(ids(40_000, 50_000).unionByName(spark.createDataFrame([(None,)], "id string")), "id", root, "b")
    new = ids(30_000, 60_000).unionByName(spark.createDataFrame([(None,), (None,)], "id string"))
    assert increment.unseen(new, "id", root, "c").count() == 10_002
    assert increment.unseen(new, "id", root, "b").count() == 20_002         # a rerun of b does not see b
    increment.remember(ids(0, 5), "id", root, "b")
    assert increment.unseen(new, "id", root, "c").count() == 20_002


def test_bitmap_probe_has_no_false_negative_and_few_false_positives(spark):
    x = spark.range(0, 3000).select(F.col("id").cast("string").alias("id"))
    bits = x.filter("id % 2 = 0").groupBy(increment._bucket("id")).agg(
        F.bitmap_construct_agg(increment._bit("id")).alias("bitmap"))
    probe = x.join(bits, increment._bucket("id") == bits["bucket"], "left").select(
        "id", F.coalesce(increment._is_set(F.col("bitmap"), increment._bit("id")), F.lit(False)).alias("hit"))
    got = {int(r.id): r.hit for r in probe.collect()}
    assert all(got[i] for i in range(0, 3000, 2)) and sum(got[i] for i in range(1, 3000, 2)) < 5


def test_sketches_merge_like_one(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 9000).cast("string").alias("u"),
                                    F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("v"))
    parts = [increment.sketch_batch(df.filter(F.col("v").isNull() == (i == 0)), ["k"], "u", "v") for i in (0, 1)]
    merged = increment.merge_sketches(parts[0].unionByName(parts[1]), ["k"])
    got = increment.sketch_estimates(merged, ["k"], (0.1, 0.5)).collect()
    for r in got:
        exact = df.filter(F.col("k") == r.k)
        users = exact.select("u").distinct().count()
        n = exact.filter("v is not null").count()
        assert r.rows == 10_000 and abs(r["items"] - users) <= 0.05 * users
        for q, name in ((0.1, "q10"), (0.5, "q50")):
            assert abs(exact.filter(F.col("v") <= r[name]).count() / n - q) < 0.01


def test_median_of_one_value_that_most_rows_share(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.lit("k")).alias("k"),
                                    F.when(F.col("id") % 5 > 0, F.lit(1.5)).otherwise(F.col("id").cast("double")).alias("v"))
    assert rows(group_median(df, ["k"], "v")) == [("k", 1.5), (None, 1.5)]


def test_medoid_by_bounds_on_a_circle_and_beside_outliers(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    n = 6000
    a = rng.uniform(0, 2 * np.pi, n)
    sets = {"circle": (40 + 10 * np.sin(a), 10 + 10 * np.cos(a)),
            "dense": (40 + rng.normal(0, .001, n), 10 + rng.normal(0, .001, n)),
            "line": (np.zeros(n), np.linspace(-179, 179, n)),
            "sphere": (np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n))}
    sets["dense"][0][:3], sets["dense"][1][:3] = [-40, 80, 41], [-170, 5, 10]
    frames, want = [], {}
    for k, (lat, lon) in sets.items():
        w = rng.integers(1, 4, n)
        frames.append(pd.DataFrame({"k": k, "lat": lat, "lon": lon, "w": w, "label": "x"}))
        p = home._radians(lat, lon)
        cost = np.concatenate([home._across(tuple(x[i:i + 256] for x in p), p) @ w for i in range(0, n, 256)])
        best = np.flatnonzero(np.round(cost, 6) == np.round(cost, 6).min())
        want[k] = min((lat[i], lon[i]) for i in best)
    df = spark.createDataFrame(pd.concat(frames))
    x, clusters = home.clustered(df, ["k"])
    open_ = {r.k: r["count"] for r in home.possible_medoids(x, clusters, ["k"]).groupBy("k").count().collect()}
    assert open_["circle"] < 300 and open_["dense"] < 600
    got = {r.k: (r._med.lat, r._med.lon) for r in home.large_medoids(df, ["k"]).collect()}
    assert got == want
