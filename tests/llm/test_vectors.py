import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from geotrail import session
from geotrail.llm import embed_dedup, topk
from geotrail.llm.embed_dedup import link_vectors
from geotrail.llm.topk import exact_top_k


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def cosine(a, b):
    if len(a) != len(b):
        return -2
    return (math.fsum(x * y for x, y in zip(a, b))
            / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(y * y for y in b)))


def brute_links(rows, threshold):
    n, comp, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    ok = [usable(v) and any(v) for _, v in rows]
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and cosine(rows[i][1], rows[j][1]) >= threshold:
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            comp[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        named = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((links[i], min(named) if named else None))
    return out


def vectors(seed=0, n=160, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.2])
        rows.append((2 * i + 1, [float(np.float32(x)) for x in v * rng.choice([1, 10, 1e-3])]))
    rows += [(7, None), (8, []), (9, [0.0] * d), (10, [float("nan")] * d), (12, [None] + [1.0] * (d - 1)),
             (14, [float("inf")] * d), (None, rows[0][1]), (16, rows[0][1]), (16, rows[0][1]), (18, [1.0, 2.0]),
             (20, [2.0, 4.0]), (22, [-0.0] * (d - 1) + [1.0]), (24, [0.0] * (d - 1) + [3.0])]
    return rows


@pytest.mark.parametrize("threshold,block", [(0.95, 2048), (0.95, 16), (0.5, 16), (0.99, 40)])
def test_links_against_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "LEAF", 5)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 4) for i, v in rows],
                               "vec_id long, embedding array<float>, kept string, component int")
    got = link_vectors(df, threshold).collect()
    want = sorted(((i, l, c) for (i, _), (l, c) in zip(rows, brute_links(rows, threshold))), key=str)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert got[0].component == 4


def test_dense_clusters_link_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 50)
    monkeypatch.setattr(embed_dedup, "LEAF", 20)
    leaves = []
    monkeypatch.setattr(embed_dedup.PairJoin, "leaf", lambda self, *a: leaves.append(a))
    rng = np.random.default_rng(2)
    x = np.ones(8) + rng.normal(size=(60, 8)) * 0.01
    side = lambda x: {"x": embed_dedup.unit(x), "p": embed_dedup._project(embed_dedup.unit(x), {}),
                      "n": np.full(len(x), 2)}
    j = embed_dedup.PairJoin(side(x[:40]), side(x[40:]), 0.95)
    assert not leaves and j.links.tolist() == [40.0] * 40 + [80.0] * 20 and not j.parent.any()
    j = embed_dedup.PairJoin(side(x), None, 0.95)
    assert not leaves and j.links.tolist() == [118.0] * 60 and not j.parent.any()


def test_tiles_of_any_side_give_the_same_links(spark, monkeypatch):
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embed_dedup, "BLOCK", 9)
    found = []
    for side in (1, 3, 50):
        monkeypatch.setattr(embed_dedup, "_tile_side", lambda *a: side)
        found.append(sorted((str(r.vec_id), r.n_links, r.component_id) for r in embed_dedup.link_vectors(df).collect()))
    assert found[0] == found[1] == found[2] and any(r[1] for r in found[0])


def test_tile_sides():
    assert embed_dedup._tile_side(0, 8, 64) == 1 and embed_dedup._tile_side(496, 12, 64) == 3
    assert embed_dedup._tile_side(10 ** 9, 8, 64) == embed_dedup.TILE_BYTES // (2 * embed_dedup.BLOCK * 8 * 64)
    assert embed_dedup._tile_side(10 ** 9, 8, 10 ** 6) == 1


def test_links_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert link_vectors(df).collect() == []


def brute_top(rows, k, step):
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and usable(v)))
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = []
    for q, a in ints:
        if q % step:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,rows_block,slices", [(5, 4096, 2), (20, 16, 2), (3, 7, 5), (1, 30, 1)])
def test_top_k_against_brute_force(spark, monkeypatch, k, rows_block, slices):
    monkeypatch.setattr(topk, "ROWS", rows_block)
    monkeypatch.setattr(topk, "QUERIES", 9)
    rows = vectors(3)
    rows += [(1000 + i, rows[5][1]) for i in range(30)]             # ties
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = exact_top_k(df.filter("vec_id % 5 = 0"), df, k, slices=slices).collect()
    want = brute_top(rows, k, 5)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


@pytest.mark.parametrize("scale", [1e3, 1e7])
def test_top_k_of_large_components_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "ROWS", 10)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) * scale]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_top_k(df.filter("vec_id % 10 = 0"), df, 6).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 6, 10)


def test_top_k_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_top_k(df.filter("vec_id = 0"), df, 20).collect()] == [(0, 1, 1, 64 * 128)]
    assert exact_top_k(df.limit(0), df, 20).collect() == []
    assert exact_top_k(df, df.limit(0), 20).collect() == []


def test_phases_score_only_what_is_open(monkeypatch):
    """Phase 1 scores HEAD rows of a block; phase 2 every list once, and none for queries it cannot serve."""
    rng = np.random.default_rng(3)
    d, rows, made = 16, 1000, []
    near, far = rng.integers(-9, 10, (rows, d)), rng.integers(-1, 2, (rows, d))
    q = rng.integers(-9, 10, (20, d))

    class Spied(topk.Lists):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)
    monkeypatch.setattr(topk, "Lists", Spied)

    def pair(r, first, cutoffs=None):
        return pa.RecordBatch.from_pylist([{
            "d": d, "qb": 0, "q_n": 20, "q_ids": np.arange(20).astype("<i8").tobytes(), "q_small": True,
            "q_values": q.astype("<i2").tobytes(), "r_n": rows, "r_ids": (first + np.arange(rows)).astype("<i8").tobytes(),
            "r_small": True, "r_values": r.astype("<i2").tobytes(), "cutoffs": cutoffs}])

    k = 5
    gathered = [pa.Table.from_batches(list(topk._gather(2, k)(iter([pair(r, f)])))) for r, f in ((near, 100), (far, 5000))]
    assert [x.scored for x in made] == [20 * topk.HEAD * d] * 2
    sums = {}
    for t in gathered:
        for i, score in zip(t["q"].to_pylist(), t["score"].to_pylist()):
            sums.setdefault(i, []).append(score)
    cutoffs = [{"q": i, "cutoff": sorted(x)[-k]} for i, x in sums.items()]
    made.clear()
    found = [pa.Table.from_batches(list(topk._collect(2, k)(iter([pair(r, f, cutoffs)])))) for r, f in ((near, 100), (far, 5000))]
    every = 20 * rows * d
    assert made[0].scored < 1.6 * every and made[1].scored < 0.5 * every        # both lists once, open pairs again
    best = {}
    for t in found:
        for i, vec, score in zip(t["query_id"].to_pylist(), t["vec_id"].to_pylist(), t["score"].to_pylist()):
            best.setdefault(i, []).append((-score, vec))
    for i in range(20):
        want = sorted([(-int(q[i] @ near[j]), 100 + j) for j in range(rows)] + [(-int(q[i] @ far[j]), 5000 + j) for j in range(rows)])
        assert sorted(best[i])[:k] == want[:k]


def test_blocks_do_not_pass_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES", 9)
    df = spark.createDataFrame(vectors(3), "vec_id long, embedding array<float>")
    plans = []
    session.STORE_LISTENERS.append(note := lambda df, name: plans.append((name, df._jdf.queryExecution().toString())))
    try:
        got = exact_top_k(df.filter("vec_id % 5 = 0"), df, 5)
        assert got.count() > 0
        plans.append(("found", got._jdf.queryExecution().toString()))
    finally:
        session.STORE_LISTENERS.remove(note)
    assert {"blocks", "queries", "found"} == {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan] == []


@pytest.mark.parametrize("size,held", [(1, 1 << 20), (30_000, 1), (1 << 26, 1)])
def test_top_k_over_tiles_of_any_size(spark, monkeypatch, size, held):
    for name, value in (("ROWS", 11), ("QUERIES", 9), ("TILE_BYTES", size), ("HELD", held), ("HEAD", 3)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(5)
    rows += [(1000 + i, rows[5][1]) for i in range(30)]             # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_top_k(df.filter("vec_id % 5 = 0"), df, 7).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 7, 5)


def test_tiles_send_a_block_few_times():
    # query blocks, row blocks, their bytes, tasks: blocks sent stay far below one of each for every pair
    side_q, side_r = topk._sides(31, 151, 950_000, 524_288, 6)
    by_q, by_r = math.ceil(31 / side_q), math.ceil(151 / side_r)
    assert 12 <= by_q * by_r <= 48 and 31 * by_r + 151 * by_q < 1000
    side_q, side_r = topk._sides(752, 3755, 950_000, 524_288, 6)      # more rows: bounded by the bytes of a tile
    assert side_q * 950_000 <= topk.TILE_BYTES and side_r * 524_288 <= topk.TILE_BYTES
    assert topk._sides(1, 1, 10 ** 9, 10 ** 9, 100) == (1, 1)
    assert topk._sides(3, 5, 10 ** 9, 10 ** 9, 1) == (1, 1)


def test_best_entries_of_a_query():
    least, most = topk.LONG
    t = pa.table({"q": pa.array([1, 0, 1, 1, 0], pa.int32()), "score": pa.array([least, 5, most, most, 5], pa.int64()),
                  "vec_id": pa.array([3, 9, 8, 2, 4], pa.int64())})
    assert [tuple(r.values()) for r in topk._best_entries(t, 2).to_pylist()] == [(0, 5, 4), (0, 5, 9), (1, most, 2), (1, most, 8)]
    assert topk._best_entries(t.drop(["vec_id"]), 1)["score"].to_pylist() == [5, most]
    assert topk._best_entries(t.slice(0, 0), 3).num_rows == 0
