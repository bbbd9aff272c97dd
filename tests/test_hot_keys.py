"""Large keys, null keys, ties and bursts against plain windows and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.operators import clean, evaluate, home, mobility
from geotrail.operators.skew import cumulative_weight, group_median
from tests.conftest import rows


@pytest.fixture()
def no_reuse(spark):
    """Joins by shuffle, exchanges never reused, many partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.exchange.reuse": "false",
            "spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rank_of_a_wide_frame(spark, no_reuse):
    n = 400_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("user_id"), (F.col("id") % 1000).alias("countries"),
                               F.concat(F.lit("x"), "id").alias("extra"))
    got = mobility.rank_desc(df, "countries", "user_id")
    w = Window.orderBy(F.col("countries").desc(), "user_id")
    wrong = got.withColumn("want", F.row_number().over(w)).filter("want != position").count()
    assert wrong == 0 and got.columns == ["user_id", "countries", "extra", "position"]


def test_running_totals_with_null_keys(spark, no_reuse):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 7).alias("k"),
                                    "id", (F.col("id") % 5).alias("w"), F.lit("e").alias("e"))
    got = cumulative_weight(df, ["k"], ["id"], "w")
    by = Window.partitionBy("k")
    want = df.select("id", F.sum("w").over(by.orderBy("id")).alias("c"), F.sum("w").over(by).alias("t"))
    assert rows(got, "id", "_cum", "_tot") == rows(want)


def test_median_and_ecdf_with_extra_columns(spark, no_reuse):
    import numpy as np
    df = spark.range(30_000).select(F.when(F.col("id") % 2 > 0, F.lit(None)).otherwise(F.col("id") % 3).alias("k"),
                                    (F.col("id") * 37 % 1013).cast("double").alias("v"), F.lit("e").alias("e"))
    got = {r["k"]: r["v"] for r in group_median(df, ["k"], "v").collect()}
    for k in (None, 0, 1, 2):
        vals = [i * 37 % 1013 for i in range(30_000) if (None if i % 2 else i % 3) == k]
        assert got[k] == float(np.median(vals))
    e = sorted((r.x, r.y) for r in evaluate.ecdf(df, "v").collect())
    values = sorted(i * 37 % 1013 for i in range(30_000))
    assert len(e) == 1013 and e[-1][1] == 1.0
    assert all(abs(y - np.searchsorted(values, x, side="right") / 30_000) < 1e-12 for x, y in e[::97])


def test_lag_with_null_times_bursts_and_null_users(spark, no_reuse):
    i = F.col("id")
    df = spark.range(12_000).select(
        F.when(i % 3 == 0, F.lit("hot")).when(i % 3 == 1, F.lit(None)).otherwise((i % 40).cast("string")).alias("user_id"),
        F.format_string("%06d", i * 7919 % 12_000).alias("media_id"),
        F.when(i % 11 == 0, F.lit(None)).when(i % 4 > 0, F.timestamp_seconds(F.lit(1_700_000_000)))
        .otherwise(F.timestamp_seconds(F.lit(1_600_000_000) + i * 31 % 5000)).alias("create_time"),
        (i % 89 / 10.0).alias("place_lat"))
    got = clean.lag_within_user(df, "user_id", "create_time", "media_id", ["place_lat", "create_time"])
    w = Window.partitionBy("user_id").orderBy("create_time", "media_id")
    want = df.select("media_id", F.lag("place_lat").over(w).alias("a"), F.lag("create_time").over(w).alias("b"))
    assert rows(got.select("media_id", "prev_place_lat", F.col("prev_create_time").cast("string"))) == \
        rows(want.select("media_id", "a", F.col("b").cast("string")))


def _d(a, b):
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 12742.0 * math.asin(min(1.0, math.sqrt(h)))


def _points(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        c = rng.choice([(48.85, 2.35), (52.5, 13.4), (40.7, -74.0)] if seed else [(48.85, 2.35)])
        out.append((c[0] + rng.gauss(0, 0.3), c[1] + rng.gauss(0, 0.4)))
    return out


def test_medoid_of_large_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(home, "COST_TILE", 100)
    groups = {"a": _points(700, 1), None: _points(600, 0), "tiny": [(1.0, 2.0)], "two": [(1.0, 2.0), (1.0, 2.0)]}
    data = [(k, y, x, "p", 5) for k, ps in groups.items() for y, x in ps]
    df = spark.createDataFrame(data, "k string, lat double, lon double, label string, n int")
    got = {r.k: r for r in home.medoid_and_dispersion(home.collapse_points(df, ["k"]), ["k"], tile=50).collect()}
    assert set(got) == set(groups)
    for k, ps in groups.items():
        best = min(ps, key=lambda c: (round(sum(_d(c, p) for p in ps), 6), c))
        assert (got[k].lat, got[k].lon) == best
        rest = sorted(_d(best, p) for i, p in enumerate(ps) if i != ps.index(best)) or [0.0]
        m = len(rest)
        assert abs(got[k].dispersion - (rest[(m - 1) // 2] + rest[m // 2]) / 2) < 1e-6


def test_medoid_of_a_key_with_100_000_points(spark):
    n = 100_000
    df = spark.range(n).select(
        F.lit("k").alias("k"), (F.lit(48.0) + F.randn(1) / 3).alias("lat"), (F.lit(2.0) + F.randn(2) / 2).alias("lon"),
        F.lit("p").alias("label"))
    pts = home.collapse_points(df, ["k"])
    r = home.medoid_and_dispersion(pts, ["k"]).collect()
    assert len(r) == 1 and abs(r[0].lat - 48.0) < 0.02 and abs(r[0].lon - 2.0) < 0.03 and r[0].inferred


def test_candidates_keep_the_most_active_users(spark):
    df = spark.range(1300).select(
        F.when(F.col("id") < 1200, F.lit("busy")).otherwise(F.lit("calm")).alias("user_id"),
        F.lit("n").alias("user_name"), F.col("id").cast("string").alias("media_id"), F.lit(1).alias("followers_count"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("city").alias("place_type"),
        F.lit("P").alias("place_name"), F.lit("FR").alias("country_code"))
    assert home.home_candidates(df).count() == 1300
    assert home.home_candidates(df, max_posts=500).count() == 100


@pytest.mark.parametrize("keys", [[], ["fold"]])
def test_estimates_do_not_depend_on_the_tile(spark, keys):
    """Known and unknown sources, weighted, with and without folds: small and large path agree."""
    rng = random.Random(4)
    users = [f"u{i}" for i in range(40)]
    edges = [(a, b, rng.randint(1, 4)) for a in users for b in users if a != b and rng.random() < 0.5]
    known = [(f, u, 45 + rng.random() * 5, rng.random() * 9, "L")
             for f in (1, 2) for u in users if rng.random() < 0.7]
    e = spark.createDataFrame(edges, "source string, target string, weight long")
    t = spark.createDataFrame(known, "fold int, user_name string, lat double, lon double, user_location string")
    t = t if keys else t.filter("fold = 1").drop("fold")
    cols = [*keys, "user_name", "lat", "lon", "user_location", F.round("dispersion", 6), "inferred"]
    small = home.estimate(e, t, keys, True).select(*cols)
    large = home.estimate(e, t, keys, True, tile=5).select(*cols)
    assert rows(small) == rows(large) and small.filter("inferred").count() > 5 and small.filter("!inferred").count() > 5
