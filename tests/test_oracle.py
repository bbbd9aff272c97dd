"""A sample of registered queries against their DuckDB oracle at sf0.001."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from geotrail.plans import catalog

KEYS = ["clean_posts", "reciprocal_edges", "l1_median", "activity_radius", "mobile_share_by_country",
        "mobility_rank", "flatten_posts", "reverse_geocode", "paged_post_codes", "dispersion", "mobile_share_both",
        "setting_comparison", "scan_csv_profiles", "propagate_once"]


def _canon(df):
    def norm(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else v
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)),
                        key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_small}/events.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_small, con, key):
    sdf = E.queries()[key](spark, sf_small)
    got = pd.DataFrame([r.asDict() for r in sdf.collect()], columns=sdf.columns)
    exp = con.execute(E.oracle_sql()[key]).df()
    assert _canon(got) == _canon(exp)


def test_every_key_has_a_callable_and_most_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 79 and set(o) <= set(q)
    assert all(k in o for k in catalog.QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "speed" in df.columns
