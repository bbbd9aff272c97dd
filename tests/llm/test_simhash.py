import itertools
import random

import numpy as np
import pytest
import xxhash

from geotrail.llm import simhash
from geotrail.llm.simhash import bucket_links, covering_masks, fingerprint, shingle_hashes, simhash_groups


def brute_fp(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                w.append(cur)
            cur = ""
        else:
            cur += c
    if not w:
        return 0
    sh = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(ids, fps, radius):
    n, comp = len(ids), list(range(len(ids)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, j in itertools.combinations(range(n), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            comp[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        named = [ids[j] for j in range(n) if find(j) == find(i) and ids[j] is not None]
        out.append(min(named) if named else None)
    return out


def texts(seed=0, groups=12):
    rng = random.Random(seed)
    out = ["", None, " \n", "one", "One two", "a b c d", "A b\tc  d", "É é", "x" * 50_000]
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(5000)}"
            out.append(" ".join(copy))
    return out


def test_fingerprint_by_bits():
    for t in texts():
        assert fingerprint(shingle_hashes(t, 4)) % (1 << 64) == brute_fp(t)


@pytest.mark.parametrize("radius,turn", [(1, 0), (2, 0), (4, 0), (4, 1)])
def test_every_close_pair_shares_a_masked_value(radius, turn):
    masks = [m % (1 << 64) for m in covering_masks(radius, turn=turn)]
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(diff & m == 0 for m in masks)
    assert min(m.bit_count() for m in masks) > 20


def test_bucket_links_span_the_links():
    rng = np.random.default_rng(0)
    base = rng.integers(-2**62, 2**62, 4)
    fps = np.unique(np.concatenate([b ^ (1 << rng.integers(0, 40, 60).astype(np.int64)) for b in base]))
    u, v = bucket_links(fps, 2)
    order = {int(f): i for i, f in enumerate(fps)}
    ids = [order[int(f)] for f in fps]
    want = brute_groups(ids, [int(f) % (1 << 64) for f in fps], 2)
    comp = list(range(len(fps)))
    for a, b in zip(u, v):
        x, y = comp[order[int(a)]], comp[order[int(b)]]
        comp = [min(x, y) if c in (x, y) else c for c in comp]
    assert comp == want and len(u) <= len(fps) - 1


@pytest.mark.parametrize("bucket", [2000, 1])
def test_groups_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)      # 1: every shared bucket goes on to the last family
    monkeypatch.setattr(simhash, "FAMILIES", 2)
    ts = texts()
    ids = [3 * i + 5 for i in range(len(ts))]
    ids[1], ids[3] = None, None
    rows = [(i, t, "c", 1) for i, t in zip(ids, ts)] + [(ids[-1], ts[-1], "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string, component_id int")
    got = simhash_groups(df).collect()
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute_groups([r[0] for r in rows], fps, 4)), key=str)
    assert sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got), key=str) == want
    assert got[0].component in ("c", "again")
    lead = [r for r in got if r.leads]
    assert {r.component_id for r in lead} == {w[2] for w in want}
    assert all(r.doc_id == r.component_id for r in lead)


@pytest.mark.parametrize("families", [2, 3, 4])
def test_a_pair_meets_in_every_family(families):
    rng = random.Random(families)
    masks = [[m % (1 << 64) for m in covering_masks(4, turn=t)] for t in range(families)]
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert all(any(diff & m == 0 for m in family) for family in masks)


def test_dense_families_are_split_into_small_buckets(spark, monkeypatch):
    """4096 fingerprints that differ in 12 bits: most buckets of one family hold hundreds."""
    rng = random.Random(1)
    bits = rng.sample(range(63), 12)
    fps = [sum(1 << b for j, b in enumerate(bits) if i >> j & 1) for i in range(4096)]
    fps += [rng.getrandbits(63) for _ in range(200)]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    monkeypatch.setattr(simhash, "BUCKET", 100)
    links = {(r.u, r.v) for r in simhash.fingerprint_links(df, 1).collect()}
    parent = {f: f for f in set(fps)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in links:
        assert (u ^ v).bit_count() <= 1
        parent[find(u)] = find(v)
    assert len({find(f) for f in fps[:4096]}) == 1
    assert len({find(f) for f in set(fps)}) == 1 + len(set(fps[4096:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(df).collect() == []
