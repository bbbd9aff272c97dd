import math
import random

from geotrail.operators import home
from tests.conftest import rows


def _hav(lon1, lat1, lon2, lat2):
    dlat, dlon = math.radians(lat2 - lat1), math.radians(lon2 - lon1)
    a = math.sin(dlat / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dlon / 2) ** 2
    a = min(max(a, 0.0), 1.0)
    return 6371.0 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def model(points, weighted=False):
    """Plain-Python model: points = [(lat, lon, label, w)] (lat None = unlocated).
    Returns (lat, lon, label, dispersion) with the library's tie rule."""
    loc = [p for p in points if p[0] is not None and p[1] is not None]
    if not loc:
        return (None, None, None, 0.0)
    best = None
    for c in loc:
        cost = round(sum((q[3] if weighted else 1) * _hav(q[1], q[0], c[1], c[0]) for q in loc), 6)
        key = (cost, c[0], c[1], c[2])
        best = key if best is None or key < best else best
    _, hlat, hlon, _ = best
    labels = sorted(p[2] for p in loc if (p[0], p[1]) == (hlat, hlon))
    ds, skipped = [], False
    for q in loc:
        if not skipped and (q[0], q[1]) == (hlat, hlon):
            skipped = True
            continue
        ds.append(_hav(q[1], q[0], hlon, hlat))
    ds.sort()
    if not ds:
        med = 0.0
    else:
        n = len(ds)
        med = (ds[(n - 1) // 2] + ds[n // 2]) / 2
    return (hlat, hlon, labels[0], med)


def _frame(spark, groups):
    data = [(k, lat, lon, lab, w) for k, pts in groups.items() for (lat, lon, lab, w) in pts]
    return spark.createDataFrame(data, "k string, lat double, lon double, label string, w long")


def _run(spark, groups, weighted=False, tile=home.TILE_POINTS):
    df = _frame(spark, groups)
    pts = home.collapse_points(df, ["k"], weight="w" if weighted else None)
    r = home.medoid_and_dispersion(pts, ["k"], tile=tile)
    return {x["k"]: (x["lat"], x["lon"], x["label"], x["dispersion"]) for x in r.collect()}


def _close(a, b):
    return a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6


def test_hand_fixtures(spark):
    groups = {
        "one": [(48.0, 2.0, "p", 1)],
        "two": [(48.0, 2.0, "p", 1), (52.0, 13.0, "b", 1)],          # equal costs: lower lat wins
        "three": [(48.0, 2.0, "p", 1), (48.1, 2.1, "q", 1), (52.0, 13.0, "b", 1)],
        "same": [(48.0, 2.0, "z", 1), (48.0, 2.0, "a", 1), (52.0, 13.0, "b", 1)],
        "none": [(None, None, "x", 1), (None, 5.0, "y", 1)],
    }
    got = _run(spark, groups)
    for k, pts in groups.items():
        assert _close(got[k], model(pts)), k
    assert got["two"][:2] == (48.0, 2.0)
    assert got["one"][3] == 0.0 and got["none"] == (None, None, None, 0.0)


def test_random_groups_match_model_and_tile_path(spark):
    rnd = random.Random(5)
    groups = {}
    for g in range(25):
        n = rnd.randint(1, 30)
        pts = []
        for _ in range(n):
            lat = round(rnd.uniform(40, 60), 1)
            lon = round(rnd.uniform(-5, 25), 1)
            pts.append((lat, lon, rnd.choice("abc"), rnd.randint(1, 4)))
        groups[f"g{g}"] = pts
    for weighted in (False, True):
        cold = _run(spark, groups, weighted)
        hot = _run(spark, groups, weighted, tile=4)          # forces the tile-pair path
        for k, pts in groups.items():
            exp = model(pts, weighted)
            assert _close(cold[k], exp), (k, cold[k], exp)
            assert _close(hot[k], exp), (k, hot[k], exp)


def test_known_home_and_propagation_chain(spark):
    edges = spark.createDataFrame(
        [(a, b, 1) for a, b in [("u1", "u2"), ("u2", "u1"), ("u2", "u3"), ("u3", "u2"), ("u3", "u4"), ("u4", "u3")]],
        "source string, target string, weight long")
    known = spark.createDataFrame([("u1", 48.85, 2.35, "Paris,FR")], "user_name string, lat double, lon double, user_location string")
    r1 = home.propagate_once(edges, known)
    assert rows(r1, "user_name") == [("u1",), ("u2",)]          # u1 keeps its point, u2 inferred
    r3 = home.propagate(edges, known, rounds=3)
    got = {x["user_name"]: (x["lat"], x["lon"]) for x in r3.collect()}
    assert got["u4"] == (48.85, 2.35) and set(got) == {"u1", "u2", "u3", "u4"}


def test_far_friends_drop_known_user(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "source string, target string, weight long")
    known = spark.createDataFrame([("a", 48.85, 2.35, "P"), ("b", 35.68, 139.69, "T")],
                                  "user_name string, lat double, lon double, user_location string")
    assert home.propagate_once(edges, known).count() == 0       # both dispersions >= 100 km


def test_merge_truth_ignores_null_names(spark):
    prof = spark.createDataFrame([("a", 1.0, 1.0, "x"), ("b", 2.0, 2.0, "y")], "user_name string, lat double, lon double, user_location string")
    post = spark.createDataFrame([("b", 3.0, 3.0, "z"), (None, 4.0, 4.0, "w")], "user_name string, lat double, lon double, user_location string")
    got = rows(home.merge_ground_truth(prof, post), "user_name", "lat")
    assert got == [("a", 1.0), ("b", 3.0), (None, 4.0)]


def test_profile_truth_bad_numbers_and_duplicates(spark):
    raw = spark.createDataFrame([("a", "1.5", "2.5", "C", "K"), ("a", "1.5", "2.5", "C", "K"), ("b", "n/a", "1", "C", "K"),
                                 ("c", "9", "9", "X", "Y"), ("c", "1", "1", "X", "Y")],
                                "user_name string, lat string, lon string, user_city string, user_country string")
    got = rows(home.profile_ground_truth(raw))
    assert got == [("a", 1.5, 2.5, "C,K"), ("c", 1.0, 1.0, "X,Y")]


def _full_rounds(edges, known, rounds, keys=(), **kw):
    for _ in range(rounds):
        known = home.propagate_once(edges, known, keys, **kw)
    return known


def _network(spark, seed, users=60, folds=0):
    rnd = random.Random(seed)
    pairs = {(a, b) for a in range(users) for b in (rnd.randrange(users), (a + 1) % users) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    edges = [(f"u{a}", f"u{b}", 1 + (a * b) % 4) for a, b in sorted(pairs)]
    spots = [(48.85, 2.35, "Paris,FR"), (48.9, 2.4, "Saint-Denis,FR"), (52.52, 13.4, "Berlin,DE"), (45.76, 4.84, "Lyon,FR")]
    known = [(f"u{i}", *spots[rnd.randrange(4) if rnd.random() < .3 else 0]) for i in range(0, users, 3)] + [("outside", 1.0, 1.0, "x")]
    cols = "user_name string, lat double, lon double, user_location string"
    if folds:
        known = [(f, *k) for f in range(folds) for k in known if (f * 7 + len(k[0]) + int(k[0][1:] or 0 if k[0][1:].isdigit() else 0)) % 4]
        cols = "fold int, " + cols
    return spark.createDataFrame(edges, "source string, target string, weight long"), spark.createDataFrame(known, cols)


def test_delta_rounds_equal_full_rounds(spark):
    cols = ["user_name", "lat", "lon", "user_location"]
    for seed, extra in ((1, {}), (2, {"keep_unlocated": True}), (3, {"weighted": False, "max_dispersion_km": 300.0})):
        edges, known = _network(spark, seed)
        work, sizes = [], []
        got = home.propagate(edges, known, rounds=4, work=work, sizes=sizes, **extra)
        assert rows(got, *cols) == rows(_full_rounds(edges, known, 4, **extra), *cols)
        costed = [w.first()["costed"] for w in work]
        assert len(costed) == 3 and len(sizes) == 4 and costed[-1] <= costed[0] <= 60


def test_delta_rounds_per_fold_equal_full_rounds(spark):
    cols = ["fold", "user_name", "lat", "lon", "user_location"]
    edges, known = _network(spark, 7, users=40, folds=3)
    got = home.propagate(edges, known, rounds=3, keys=["fold"])
    assert rows(got, *cols) == rows(_full_rounds(edges, known, 3, keys=["fold"]), *cols)


def test_rounds_end_when_nothing_changes(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "source string, target string, weight long")
    known = spark.createDataFrame([("a", 48.85, 2.35, "P"), ("b", 48.85, 2.35, "P")],
                                  "user_name string, lat double, lon double, user_location string")
    work, sizes = [], []
    got = home.propagate(edges, known, rounds=5, work=work, sizes=sizes)
    assert rows(got, "user_name") == [("a",), ("b",)] and len(sizes) == 5
    assert [w.first()["costed"] for w in work] == [0] * 4
