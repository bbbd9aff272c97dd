from pyspark.sql import functions as F

from geotrail import session
from geotrail.operators import evaluate, mobility
from geotrail.operators.skew import group_median

# The paired sample published with the reference's t-test cell.
SAMPLE_A = [8.0967557805918613, 8.275997135357489, 7.8061025797261703, 9.3117782856156328, 7.3946106686716337,
            13.055172685735103, 9.3063331261043167, 8.0967557805918613, 8.3194758270834814, 10.839153443304374]
SAMPLE_B = [8.5933784708059999, 6.0943795008453998, 7.9597584399428065, 10.839153443304374, 8.1383529608792688,
            12.598511525170732, 7.6112657884080805, 8.0240204067354206, 8.9559577611689818, 8.7141425134524655]


def test_paired_t_test_reference_sample(spark):
    df = spark.createDataFrame(list(zip(SAMPLE_A, SAMPLE_B)), "a double, b double")
    r = evaluate.paired_t_test(df).collect()[0]
    assert r["n"] == 10 and r["df"] == 9
    assert abs(r["t"] - 0.727327) < 1e-6 and abs(r["p"] - 0.485514) < 1e-6


def test_t_test_even_df_and_zero_variance(spark):
    # df = 4, t = 2.0 -> two-sided p = 0.116117 (tables)
    d = [1.0, 2.0, 3.0, 4.0, 5.0]
    import statistics
    m, s = statistics.mean(d), statistics.stdev(d)
    shift = 2.0 * s / 5 ** 0.5 - m
    df = spark.createDataFrame([(x + shift, 0.0) for x in d], "a double, b double")
    r = evaluate.paired_t_test(df).collect()[0]
    assert abs(r["t"] - 2.0) < 1e-9 and abs(r["p"] - 0.116117) < 1e-5
    z = evaluate.paired_t_test(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")).collect()[0]
    assert z["t"] is None and z["p"] is None


def test_ecdf_ends_at_one(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 2.0, 2.0, 5.0]], "v double")
    got = sorted((r["x"], r["y"]) for r in evaluate.ecdf(df, "v").collect())
    assert got == [(1.0, 0.2), (2.0, 0.6), (3.0, 0.8), (5.0, 1.0)]


def test_histogram_closed_last_bin_integrates_to_one(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 0.0, 1.0, 10.0]], "v double")
    h = sorted(mobility.density_histogram(df, "v", 10).collect(), key=lambda r: r["bin"])
    assert [r["count"] for r in h] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert abs(sum(r["density"] * (r["hi"] - r["lo"]) for r in h) - 1.0) < 1e-12


def test_group_median_matches_numpy(spark):
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("v"),
                                     (F.col("id") % 4 + 1).alias("w"))
    cold = {r["k"]: r["v"] for r in group_median(df, ["k"], "v", "w").collect()}
    import numpy as np
    for k in range(3):
        vals = [((i * 37) % 101) for i in range(2000) if i % 3 == k for _ in range(i % 4 + 1)]
        assert cold[k] == float(np.median(vals))


def test_fold_bucket_is_deterministic(spark):
    df = spark.createDataFrame([("u1",), ("u2",)], "u string")
    a = [r[0] for r in df.select(evaluate.fold_bucket(F.col("u"), F.lit(3))).collect()]
    b = [r[0] for r in df.select(evaluate.fold_bucket(F.col("u"), F.lit(3))).collect()]
    assert a == b and all(0 <= x < 10 for x in a)


def test_rank_without_single_partition(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3), ("c", 2), ("d", 1)], "user_id string, countries long")
    got = sorted((r["user_id"], r["position"]) for r in mobility.rank_desc(df, "countries", "user_id").collect())
    assert got == [("a", 2), ("b", 1), ("c", 3), ("d", 4)]


def test_residence_parity_uncorrelated_in(spark):
    counts = spark.createDataFrame([("u1", "FR", 5), ("u1", "DE", 2), ("u2", "IT", 2)],
                                   "user_id string, country_code string, count long")
    default = sorted(tuple(r) for r in mobility.residence(counts).collect())
    parity = sorted(tuple(r) for r in mobility.residence(counts, parity=True).collect())
    assert default == [("u1", "FR"), ("u2", "IT")]
    assert parity == [("u1", "DE"), ("u1", "FR"), ("u2", "IT")]


def test_stage_counts_exact_and_approx(spark):
    df = spark.range(0, 1000).select((F.col("id") % 100).cast("string").alias("user_id"),
                                     F.col("id").cast("string").alias("media_id"))
    exact = mobility.stage_counts([("all", df)]).collect()[0]
    approx = mobility.stage_counts([("all", df)], approx=True).collect()[0]
    assert (exact["posts"], exact["users"]) == (1000, 100)
    assert abs(approx["posts"] - 1000) <= 30 and abs(approx["users"] - 100) <= 3


def test_holdout_joins_do_not_pass_tables_through_the_driver(spark):
    users = [f"u{i}" for i in range(40)]
    edges = spark.createDataFrame([(a, b, 1) for i, a in enumerate(users) for b in users[max(i - 2, 0):i] + users[i + 1:i + 3]],
                                  "source string, target string, weight long")
    truth = spark.createDataFrame([(u, 48.0 + i / 100, 2.0, "p") for i, u in enumerate(users)],
                                  "user_name string, lat double, lon double, user_location string")
    plans = []
    session.STORE_LISTENERS.append(note := lambda df, name: plans.append((name, df._jdf.queryExecution().toString())))
    try:
        sample, final = evaluate.holdout_run(session.store(edges), session.store(truth), truth, 3, 3)
        errors = evaluate.holdout_errors(sample, final)
        assert errors.count() > 0
        plans.append(("errors", errors._jdf.queryExecution().toString()))
    finally:
        session.STORE_LISTENERS.remove(note)
    assert {"affected", "known", "points", "errors"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan] == []
