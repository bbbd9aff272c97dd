import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geotrail.llm import line_dedup
from geotrail.llm.line_dedup import PerfectHash, dedup_lines

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(texts, min_docs):
    df = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or df[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


TEXTS = ["a\nb\nc", "A \n\tb\x0b\nz", " a\n\na\nÄ", None, "", "\n", "ä\nb", "b", "b", "b\nb\r\n", "x \nb ", "É\né",
         "word " * 5000 + "\nb\n" + "long\n" * 300, "c\x1c\nc"]


def check(spark, texts, min_docs):
    df = spark.createDataFrame([(i, t, f"extra{i % 3}", 7, 8) for i, t in enumerate(texts)],
                               "doc_id long, text string, n_x string, n_lines int, shard int")
    got = {r.doc_id: r for r in dedup_lines(df, min_docs).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, min_docs)):
        r = got[i]
        assert (r.n_lines, r.n_dropped, r.text) == want
        assert r["n_x"] == f"extra{i % 3}" and r.shard == 8


@pytest.mark.parametrize("min_docs", [1, 2, 5, 300])
def test_against_brute_force(spark, min_docs):
    check(spark, TEXTS, min_docs)


def test_hot_line_served_in_slices(spark, monkeypatch):
    texts = [f"common\nown {i}\nshared {i % 50}" for i in range(4000)]
    check(spark, texts, 10)


def test_copies_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "same\nline")] * 12 + [(1, "same\nother")], "doc_id long, text string")
    rows = dedup_lines(df, 10).collect()
    assert sorted(r.text for r in rows) == [""] * 12 + ["other"]
    empty = dedup_lines(df.limit(0), 10)
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_lines", "n_dropped"]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300))
def test_perfect_hash_is_minimal(keys):
    h1 = np.array([k[0] for k in keys], np.uint64)
    h2 = np.array([k[1] for k in keys], np.uint64)
    slot = PerfectHash.build(h1, h2).slot(h1, h2)
    assert sorted(slot.tolist()) == list(range(len(keys)))


def test_perfect_hash_size_and_equal_keys():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, (2, 100_000)).astype(np.uint64)
    ph = PerfectHash.build(*h)
    assert len(ph.words) * 64 / 100_000 < 4.5           # bits a key
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64), np.array([6, 6], np.uint64))


def test_query_digest(spark, sf_small):
    from geotrail.llm.queries import QUERIES
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op1_line_dedup"](spark, sf_small).collect()}
    for d, (n, gone, text) in zip(docs, brute([d.text for d in docs], 10)):
        r = got[d.doc_id]
        assert (r.n_lines, r.n_dropped) == (n, gone)
        assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_shards_follow_the_keys():
    assert line_dedup.KEYS_PER_SHARD >= 100_000
