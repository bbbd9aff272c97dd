"""Place-name geocoding and reverse geocoding against a gazetteer table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.functions.geo import EARTH_RADIUS_KM, haversine_km
from geotrail.functions.text import place_label
from geotrail.session import store


def profile_strings(posts: DataFrame) -> DataFrame:
    """Distinct (source, user_location) work list."""
    return posts.select(F.col("user_name").alias("source"), "user_location").distinct()


def normalise_place(c) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def geocode(strings: DataFrame, gazetteer: DataFrame, text: str = "user_location") -> DataFrame:
    """Free-text place -> (lat, lon, 'city,country') by exact normalised key.

    Every string stays, with nulls where it is null or has no match. Of several
    places with one key the first by (label, lat, lon) counts. The join is
    planned by AQE (a full world gazetteer is not assumed to be small)."""
    place = F.struct(place_label(F.col("city"), F.col("country")).alias("g_label"), F.col("lat").alias("g_lat"),
                     F.col("lon").alias("g_lon"))
    g = gazetteer.groupBy(F.col("key").alias("_k")).agg(F.min(place).alias("_g"))
    s = strings.withColumn("_k", normalise_place(F.col(text))).join(g, "_k", "left")
    return s.select(*strings.columns, "_g.g_lat", "_g.g_lon", "_g.g_label")


def _unit_vector(lat, lon) -> dict[str, F.Column]:
    """Point of the unit sphere; neither poles nor the date line are special there."""
    rlat, rlon = F.radians(lat), F.radians(lon)
    return {"x": F.cos(rlat) * F.cos(rlon), "y": F.cos(rlat) * F.sin(rlon), "z": F.sin(rlat)}


def _nearest(points: DataFrame, gazetteer: DataFrame, km: float) -> DataFrame:
    """(lat, lon, place_label, dist_km) of the nearest place within ``km``.

    Points and places are compared on the unit sphere in space: two points at most
    ``km`` apart are at most one chord apart along each axis. Cells are cubes with sides
    of two chords, so the cube around a place meets at most two cells along each axis:
    a place is copied to at most eight cells, anywhere on earth. Points keep their one
    cell and are never copied."""
    chord = 2.0 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2)) * (1 + 1e-9) + 1e-12
    cell = F.lit(2 * chord)
    axes = ("x", "y", "z")
    at = _unit_vector(F.col("lat"), F.col("lon"))
    p = points.select("lat", "lon", *[F.floor(at[c] / cell).alias("_" + c) for c in axes])
    near = _unit_vector(F.col("g_lat"), F.col("g_lon"))
    g = gazetteer.filter("g_lat is not null and g_lon is not null")
    for c in axes:
        g = g.select("*", F.explode(F.sequence(F.floor((near[c] - chord) / cell), F.floor((near[c] + chord) / cell)))
                     .alias("_" + c))
    d = haversine_km(F.col("lon"), F.col("lat"), F.col("g_lon"), F.col("g_lat"))
    best = (p.join(g, ["_" + c for c in axes]).withColumn("dist_km", d).filter(F.col("dist_km") <= km)
            .groupBy("lat", "lon").agg(F.min(F.struct("dist_km", "place_label")).alias("_b")))
    return best.select("lat", "lon", "_b.place_label", "_b.dist_km")


def reverse_geocode(points: DataFrame, gazetteer: DataFrame, max_km: float = 100.0,
                    lat: str = "lat", lon: str = "lon", rings: int = 4) -> DataFrame:
    """Nearest gazetteer place within ``max_km`` of each point (exact).

    Adds place_label and dist_km to every row, null where the point is null or
    has no place in range; ties go to the smaller label. Longitudes may be written
    beyond 180 degrees. Distinct points are looked up, in rings that double up to ``max_km``: what is found within a
    ring's radius is certainly the nearest, only the other points go on, so a
    point in a dense region is compared with the places of a few small cells."""
    g = store(gazetteer.select(F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"),
                               place_label(F.col("city"), F.col("country")).alias("place_label")), "places")
    todo = store(points.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
                 .filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct(), "points")
    found = None
    for ring in range(rings - 1, -1, -1):
        here = store(_nearest(todo, g, max_km / 2 ** ring), "nearest")
        found = here if found is None else found.unionByName(here)
        todo = todo.join(here, ["lat", "lon"], "left_anti")
        if ring:
            todo = store(todo, "points")
    found = found.withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    on = (F.col(lat) == F.col("_lat")) & (F.col(lon) == F.col("_lon"))
    return points.join(found, on, "left").drop("_lat", "_lon")


# --- free text ---------------------------------------------------------------

MICRO = 1_000_000           # weights and scores are whole millionths: the same on every engine
MIN_SCORE = 300_000
MIN_CITY = 500_000          # a country alone names no city


def _word_list(text: F.Column) -> F.Column:
    """Distinct lower-case words (letters, marks and digits) of a text, in no order."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _key(words: F.Column) -> F.Column:
    """A set of words as text: equal sets have equal keys."""
    return F.array_join(F.array_sort(words), " ")


def _features(words: F.Column) -> F.Column:
    """A feature for each word and for each three characters of a word with its ends marked."""
    def grams(w):
        marked = F.concat(F.lit("^"), w, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, F.lit(3)))
    whole = F.transform(words, lambda w: F.concat(F.lit("="), w))
    return F.array_distinct(F.concat(whole, F.flatten(F.transform(words, grams))))


def place_names(gazetteer: DataFrame) -> DataFrame:
    """(place, name): the names under which a place (label, lat, lon, city) is looked up.

    A place answers to its city alone, with its country and with its country's code."""
    label = place_label(F.col("city"), F.col("country")).alias("label")
    names = F.array_distinct(F.array(*[F.concat_ws(" ", *[F.col(c) for c in cols]) for cols in
                                       (["city"], ["city", "country"], ["city", "code"])]))
    city = _key(_word_list(F.col("city"))).alias("city")
    g = gazetteer.filter("city is not null").select(F.struct(label, "lat", "lon", city).alias("place"), names.alias("n"))
    return g.select("place", F.explode("n").alias("name"))


def name_index(gazetteer: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Inverted index of a gazetteer's names: (names, weights, number of names).

    names: (id, place, f); weights: (f, w), the rarity of each feature, ln(1 + names /
    names with it), in millionths. Names with the same words are one, with the first
    place by (label, lat, lon)."""
    names = (place_names(gazetteer).select("place", _word_list(F.col("name")).alias("words"))
             .filter(F.size("words") > 0).withColumn("id", _key(F.col("words")))
             .groupBy("id").agg(F.min("place").alias("place")))
    names = store(names.withColumn("f", _features(F.split("id", " "))), "names")
    n = names.count()
    weights = names.select(F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("df"))
    weights = weights.select("f", F.round(MICRO * F.log(1 + F.lit(float(n)) / F.col("df"))).cast("long").alias("w"))
    return names, store(weights, "weights"), n


def _weighed(items: DataFrame, weights: DataFrame, rarest: int) -> DataFrame:
    """(id, fs, total): each item's features, rarest first, and their weight.

    Features that no name has weigh as much as the rarest."""
    rows = items.select("id", F.explode("f").alias("f")).join(weights, "f", "left")
    pairs = F.collect_list(F.struct((-F.coalesce("w", F.lit(rarest))).alias("minus"), "f"))
    x = rows.groupBy("id").agg(F.array_sort(pairs).alias("fs"))
    return x.withColumn("total", F.aggregate("fs", F.lit(0).cast("long"), lambda a, f: a - f["minus"]))


def _leading(x: DataFrame, min_score: int) -> DataFrame:
    """(id, total, f) of the leading features: two items that reach ``min_score`` share one.

    Shared weight is at least min_score of either total, and all of it lies in the first
    shared feature and those after it in the common order; a feature with too little
    weight left cannot be that one."""
    each = x.select("id", "total", F.posexplode("fs").alias("i", "s")).select("id", "total", "i", "s.*")
    up_to = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("total") + F.sum("minus").over(up_to) - F.col("minus")
    return each.withColumn("left", left).filter(F.col("left") * MICRO >= min_score * F.col("total")).select(
        "id", "total", "f")


def geocode_text(strings: DataFrame, gazetteer: DataFrame, text: str = "user_location",
                 min_score: int = MIN_SCORE, min_city: int = MIN_CITY) -> DataFrame:
    """Free-text place -> the most similar place name of the gazetteer, if similar enough.

    A name and a text are sets of features: whole words and their character trigrams,
    weighted by rarity among the names. The score is the weight of the shared features
    over the weight of all features of both (in millionths), so word order does not
    matter, a missing country or a typo costs a little, and frequent words such as a
    country weigh little. Of the features of the city's own words the text must have
    ``min_city`` by weight: a country alone gives no place. Adds g_lat, g_lon, g_label,
    g_score to every row; null where the text is null, has no word, or reaches
    ``min_score`` with no name. Ties go to the smaller (label, lat, lon).

    Distinct texts meet names on their leading features only (rarest first, as far as a
    match needs), so a word that half of all texts or names share is not joined; pairs of
    too different weight are dropped before they are scored. Nothing is capped."""
    names, weights, n = name_index(gazetteer)
    rarest = round(MICRO * math.log(1 + n))
    s = strings.withColumn("_id", F.nullif(_key(_word_list(F.col(text))), F.lit("")))
    texts = store(s.select(F.col("_id").alias("id")).filter("id is not null").distinct()
                  .withColumn("f", _features(F.split("id", " "))), "texts")
    t = store(_weighed(texts, weights, rarest), "weighed-texts")
    g = store(_weighed(names, weights, rarest), "weighed-names")
    a = _leading(t, min_score).withColumnsRenamed({"id": "text", "total": "text_total"})
    b = _leading(g, min_score).withColumnsRenamed({"id": "name", "total": "name_total"})
    fits = F.least("text_total", "name_total") * MICRO >= min_score * F.greatest("text_total", "name_total")
    pairs = store(a.join(b, "f").filter(fits).select("text", "name").distinct(), "name-pairs")
    places = g.join(names.select("id", "place"), "id").withColumn("cf", _features(F.split("place.city", " ")))
    x = pairs.join(t.withColumnsRenamed({"id": "text", "fs": "tf", "total": "tt"}), "text")
    x = x.join(store(places, "places").withColumnsRenamed({"id": "name", "fs": "nf", "total": "nt"}), "name")
    x = x.withColumn("both", F.array_intersect("tf", "nf"))

    def weight(features):
        return F.aggregate(features, F.lit(0).cast("long"), lambda w, f: w - f["minus"])

    def city(features):
        return weight(F.filter(features, lambda f: F.array_contains("cf", f["f"])))
    x = x.select("text", "place", "tt", "nt", weight("both").alias("w"), city("both").alias("cw"), city("nf").alias("ct"))
    x = x.filter(F.col("cw") * MICRO >= min_city * F.col("ct"))
    x = x.select("text", "place", F.expr(f"(w * {MICRO}L) div (tt + nt - w)").alias("score"))
    x = x.filter(F.col("score") >= min_score)
    best = x.groupBy(F.col("text").alias("_id")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "place")).alias("_b"))
    out = s.join(best, "_id", "left")
    return out.select(*strings.columns, F.col("_b.place.lat").alias("g_lat"), F.col("_b.place.lon").alias("g_lon"),
                      F.col("_b.place.label").alias("g_label"), (-F.col("_b.minus")).cast("long").alias("g_score"))
