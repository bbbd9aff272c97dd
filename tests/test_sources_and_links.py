from pyspark.sql import functions as F

from geotrail.operators import frontier, gazetteer, graph, link
from geotrail.sources import ingest
from tests.conftest import rows


def _gaz(spark, data):
    return spark.createDataFrame(data, "key string, city string, country string, code string, lat double, lon double")


def test_reverse_geocode_wraps_date_line_and_poles(spark):
    gaz = _gaz(spark, [("a", "East", "X", "X", 0.0, 179.9), ("b", "Pole", "Y", "Y", 89.9, 0.0),
                       ("c", "Paris", "France", "FR", 48.85, 2.35), ("d", "Far", "Z", "Z", 10.0, 10.0)])
    pts = spark.createDataFrame([("p1", 0.0, -179.9), ("p2", 89.95, 120.0), ("p3", 48.9, 2.4), ("p4", -40.0, -40.0),
                                 ("p3", 48.9, 2.4), ("p5", None, 2.0), ("p6", 0.0, 179.95), (None, 48.85, 2.35)],
                                "media_id string, lat double, lon double")
    got = rows(gazetteer.reverse_geocode(pts, gaz, 100.0), "media_id", "place_label")
    assert got == [("p1", "East,X"), ("p2", "Pole,Y"), ("p3", "Paris,France"), ("p3", "Paris,France"), ("p4", None),
                   ("p5", None), ("p6", "East,X"), (None, "Paris,France")]


def test_reverse_geocode_against_all_places(spark):
    import random
    from geotrail.functions.geo import haversine_km
    rng = random.Random(8)
    gaz = _gaz(spark, [(f"k{i}", f"c{i}", "X", "X", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)])
    pts = spark.createDataFrame([(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)],
                                "media_id long, lat double, lon double")
    got = gazetteer.reverse_geocode(pts, gaz, 900.0).select("media_id", "place_label", F.round("dist_km", 6))
    d = haversine_km("lon", "lat", "g_lon", "g_lat")
    near = (pts.crossJoin(gaz.select(F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), "city"))
            .withColumn("d", d).filter("d <= 900").groupBy("media_id")
            .agg(F.min(F.struct("d", F.concat("city", F.lit(",X")).alias("l"))).alias("b")))
    want = pts.select("media_id").join(near, "media_id", "left").select("media_id", "b.l", F.round("b.d", 6))
    assert rows(got) == rows(want) and 50 < got.filter("place_label is null").count() < 250


def test_geocode_normalises_text(spark):
    gaz = _gaz(spark, [("paris, france", "Paris", "France", "FR", 48.85, 2.35)])
    s = spark.createDataFrame([("u1", "  Paris,   France "), ("u2", "48.8566, 2.3522"), ("u3", None)], "source string, user_location string")
    twice = gaz.unionByName(_gaz(spark, [("paris, france", "Paris", "Texas", "US", 33.6, -95.5)]))
    assert rows(gazetteer.geocode(s, twice), "source", "g_label") == [("u1", "Paris,France"), ("u2", None), ("u3", None)]


def test_reciprocal_edges_weights_and_self_loops(spark):
    posts = spark.createDataFrame(
        [("a", "1", "@b @b @c"), ("b", "2", "@a"), ("c", "3", "@d"), ("a", "4", "@a"), ("d", "5", "hello")],
        "user_name string, media_id string, text string")
    e = graph.mention_edges(posts)
    assert rows(e.filter(F.col("source") == "a"), "target", "weight") == [("a", 1), ("b", 2), ("c", 1)]
    assert rows(graph.reciprocal_edges(e)) == [("a", "b", 1), ("b", "a", 1)]


def test_link_is_distinct_and_normalisable(spark):
    b = spark.createDataFrame([("b1", "https://x/p/1/"), ("b1", "https://x/p/1/"), ("b2", "https://x/p/2/")],
                              "user_id string, url string")
    a = spark.createDataFrame([("u1", "P", "https://x/p/1/"), ("u2", "Q", "HTTPS://X/p/2?utm=1")],
                              "user_name string, user_location string, expanded_url string")
    assert rows(link.link_accounts(b, a)) == [("b1", "u1", "P")]
    assert len(rows(link.link_accounts(b, a, normalise=True))) == 2


def test_frontier_first_seen_and_not_seen(spark):
    seen = spark.createDataFrame([("x", 3), ("y", 1), ("x", 2), ("z", 5)], "name string, pos long")
    done = spark.createDataFrame([("z",), (None,)], "name string")
    assert rows(frontier.frontier(seen, done, "name", ["pos"])) == [("x", 2), ("y", 1)]


def test_quarantine_and_pages(spark):
    raw = spark.createDataFrame([('{"id": "1", "username": "a", "is_private": false}',), ('{"id": "2", "user',),
                                 ('{"id": "", "username": "c"}',), ('{"id": "4", "username": "d", "is_private": true}',)],
                                "value string")
    assert rows(ingest.flatten_users(raw), "user_id") == [("1",)]
    assert ingest.quarantine(raw, ingest.USER_PAYLOAD).count() == 1
    page = ('{"status": "%s", "data": {"user": {"edge_owner_to_timeline_media": {"count": 2, "page_info": '
            '{"end_cursor": "c"}, "edges": [{"node": {"taken_at_timestamp": 10, "shortcode": "s1"}}, '
            '{"node": {"taken_at_timestamp": 30, "shortcode": "s2"}}]}}}}')
    pages = spark.createDataFrame([(page % "ok",), (page % "fail",)], "value string")
    assert rows(ingest.paged_post_codes(pages, 5, 20), "shortcode") == [("s1",)]


def test_sample_n_is_deterministic_and_sized(spark):
    df = spark.range(0, 500).select(F.col("id").cast("string").alias("k"))
    a = rows(frontier.sample_n(df, "k", 20, seed=1))
    assert a == rows(frontier.sample_n(df, "k", 20, seed=1)) and len(a) == 20
    assert a != rows(frontier.sample_n(df, "k", 20, seed=2))


def _sphere(rng, n):
    """Points all over the sphere, many at the poles and on both sides of 180 degrees."""
    out = []
    for i in range(n):
        kind = i % 4
        lat = rng.choice([90.0, -90.0, rng.uniform(89, 90), rng.uniform(-90, -89)]) if kind == 0 else rng.uniform(-90, 90)
        lon = rng.choice([180.0, -180.0, rng.uniform(178, 180), rng.uniform(-180, -178)]) if kind == 1 else rng.uniform(-180, 180)
        out.append((round(lat, 3), round(lon, 3)))
    return out


def test_reverse_geocode_over_the_whole_sphere(spark):
    import random
    from geotrail.functions.geo import haversine_km
    rng = random.Random(11)
    gaz = _gaz(spark, [(f"k{i}", f"c{i}", "X", "X", *p) for i, p in enumerate(_sphere(rng, 500))])
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(_sphere(rng, 500))], "media_id long, lat double, lon double")
    d = haversine_km("lon", "lat", "g_lon", "g_lat")
    every = (pts.crossJoin(gaz.select(F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), "city"))
             .withColumn("d", d).cache())
    for km in (100.0, 700.0, 25_000.0):
        got = gazetteer.reverse_geocode(pts, gaz, km, rings=2).select("media_id", "place_label", F.round("dist_km", 6))
        near = every.filter(F.col("d") <= km).groupBy("media_id").agg(
            F.min(F.struct("d", F.concat("city", F.lit(",X")).alias("l"))).alias("b"))
        want = pts.select("media_id").join(near, "media_id", "left").select("media_id", "b.l", F.round("b.d", 6))
        assert rows(got) == rows(want), km


def test_reverse_geocode_across_the_date_line(spark):
    gaz = _gaz(spark, [("a", "East", "X", "X", 0.0, -179.95), ("b", "None", "X", "X", None, 1.0)])
    pts = spark.createDataFrame([(1, 0.0, 179.5), (2, 0.0, 539.5), (3, 0.0, 178.0)], "media_id long, lat double, lon double")
    got = gazetteer.reverse_geocode(pts, gaz, 100.0).orderBy("media_id").collect()
    assert [r.place_label for r in got] == ["East,X", "East,X", None] and abs(got[0].dist_km - 61.2) < 0.1


TOWNS = [("", "Paris", "France", "FR", 48.85, 2.35), ("", "Paris", "Texas", "US", 33.6, -95.5),
         ("", "Lyon", "France", "FR", 45.76, 4.84), ("", "San Francisco", "United States", "US", 37.77, -122.42),
         ("", "San Fernando", "Philippines", "PH", 15.03, 120.69), ("", "München", "Germany", "DE", 48.14, 11.58),
         ("", None, "Nowhere", "NW", 0.0, 0.0), ("", "Lyon", "France", "FR", 45.0, 4.0)]


def _geocoded(spark, texts, **kw):
    s = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, user_location string, place string")
    out = gazetteer.geocode_text(s, _gaz(spark, TOWNS), **kw)
    assert out.columns == ["i", "user_location", "place", "g_lat", "g_lon", "g_label", "g_score"]
    return [(r.g_label, r.g_score) for r in out.orderBy("i").collect()]


def test_geocode_text_typos_order_and_missing_parts(spark):
    texts = ["Paris, FR", "paris", "FRANCE paris", "Pariss, France", "san francisco!!", "Francisco San (United States)",
             "san fransisco", "MÜNCHEN", "Müncen, Germany", "texas, paris", "the moon", "", None, " ,;- ", "paris", "fr",
             "France", "United States", "Texas", "Pariss", "near Paris!"]
    got = _geocoded(spark, texts)
    names = [g[0] for g in got]
    assert names == ["Paris,France", "Paris,France", "Paris,France", "Paris,France", "San Francisco,United States",
                     "San Francisco,United States", "San Francisco,United States", "München,Germany", "München,Germany",
                     "Paris,Texas", None, None, None, None, "Paris,France", None, None, None, None, "Paris,France",
                     "Paris,France"]
    assert got[1][1] == got[14][1] == 1_000_000 and got[2][1] == 1_000_000 and 300_000 <= got[6][1] < 1_000_000
    assert all((g[0] is None) == (g[1] is None) for g in got)


def _score(text, names):
    """Brute force over all names: (-score, place) of the best, by the documented formula;
    place: (label, lat, lon, city)."""
    import math
    import re

    def features(t):
        words = set(re.findall(r"[^\W_]+", t.lower()))
        return {"=" + w for w in words} | {f"^{w}$"[i:i + 3] for w in words for i in range(len(w))}
    sets = {}
    for name, place in names:
        key = frozenset(re.findall(r"[^\W_]+", name.lower()))
        sets[key] = min(sets.get(key, place), place)
    n, df = len(sets), {}
    feats = {k: features(" ".join(k)) for k in sets}
    for fs in feats.values():
        for f in fs:
            df[f] = df.get(f, 0) + 1
    w = lambda f: round(1e6 * math.log(1 + n / df.get(f, 1)))
    mine, best = features(text), None
    for k, place in sets.items():
        shared = sum(map(w, mine & feats[k]))
        score = shared * 1_000_000 // (sum(map(w, mine)) + sum(map(w, feats[k])) - shared) if mine else 0
        city = features(place[3])
        if 2 * sum(map(w, mine & city)) >= sum(map(w, city)):
            best = min(best, (-score, place)) if best else (-score, place)
    return best or (0, None)


def test_geocode_text_equals_brute_force(spark):
    import random
    rng = random.Random(2)
    texts = ["".join(rng.choice(["san ", "paris ", "lyon", "fr", "united ", "states ", "fran", "cisco ", "x", "texas ", "de "])
                     for _ in range(rng.randint(1, 5))) for _ in range(150)]
    names = [(n, (f"{c},{k}", la, lo, c)) for _, c, k, code, la, lo in TOWNS if c for n in (c, f"{c} {k}", f"{c} {code}")]
    for min_score in (1, 300_000, 800_000):
        want = [(b[1][0], -b[0]) if -b[0] >= min_score else (None, None) for b in (_score(t, names) for t in texts)]
        assert _geocoded(spark, texts, min_score=min_score) == want


def test_batches_are_replaced_and_half_written_ones_are_not_read(spark):
    import tempfile
    import pytest
    root = tempfile.mkdtemp(prefix="geotrail-batches-") + "/t"
    part = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    read = lambda: rows(ingest.read_batches(spark, root), "batch_ts", "id")
    ingest.write_batch(part(1, 2), root, "2024_01")
    ingest.write_batch(part(3), root, "2024_02")
    ingest.write_batch(part(2, 4), root, "2024_01")
    assert read() == [("2024_01", 2), ("2024_01", 4), ("2024_02", 3)]
    ingest.write_batch(part(), root, "2024_02")                 # an empty rerun empties its batch
    assert read() == [("2024_01", 2), ("2024_01", 4)]
    ingest._enter(spark, root, "2024_01", "open")               # a rerun that died half-way
    part(9).write.parquet(root + "/batch_ts=2024_03")           # a first run that died before its entry
    assert read() == []
    ingest.write_batch(part(5), root, "2024_01")
    assert read() == [("2024_01", 5)]
    for bad in ("a b", "a/b", "007", ""):
        with pytest.raises(ValueError):
            ingest.write_batch(part(1), root, bad)


def test_csv_with_and_without_line_breaks(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="geotrail-csv-") + "/x.csv"
    with open(path, "w") as f:
        f.write('a,b\n1,"x ""y"", z"\n2,"two\nlines"\n')
    assert rows(ingest.read_csv(spark, path, line_breaks=True), "a", "b") == [("1", 'x "y", z'), ("2", "two\nlines")]
    assert ingest.read_csv(spark, path).filter("a = 1").first().b == 'x "y", z'
