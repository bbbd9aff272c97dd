from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_mixing import shares
from test_packing import brute_bins
from test_simhash import brute_fp, brute_groups

import corpus_pipeline
from geotrail.llm.packing import ByteBpe
from geotrail.llm.text_queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after every stage; the input has nulls and repeated rows too."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame(
        [(None, None, None, None, None), (None, "the same few words here", "en", None, 3), (90_003, "a b c d e f", "en", "src1", 1),
         (90_003, "a b c d e f", "en", "src1", 1), (90_001, "", "en", "src2", 0), (90_002, "w " * 40_000, "en", "src2", 0)],
        docs.schema)
    docs = docs.limit(300).unionByName(extra)
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(out[-1], docs.schema)
        docs = stage(spark, docs, sf)
        out.append(docs.collect())
        if stage is not corpus_pipeline.packing:
            assert docs.columns == COLUMNS
    return out


def test_toxic_documents_go_and_others_stay(stages, spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = Counter((r.doc_id, r.text) for r in stages[1])
    gone = Counter((r.doc_id, r.text) for r in stages[0]) - kept
    assert not kept - Counter((r.doc_id, r.text) for r in stages[0])
    assert gone and all(labels.get(i) != 0 for i, _ in gone)


def test_lines(stages):
    want = Counter((r.doc_id, t, len(t)) for r, (_, _, t) in zip(stages[1], brute_lines([r.text for r in stages[1]], 10)))
    assert Counter((r.doc_id, r.text, r.n_chars) for r in stages[2]) == want


def test_one_document_of_each_group(stages):
    rows = stages[2]
    groups = brute_groups([r.doc_id for r in rows], [brute_fp(r.text) for r in rows], 4)
    named = {g for g in groups if g is not None}
    assert Counter(r.doc_id for r in stages[3] if r.doc_id is not None) == Counter(named)
    assert len([r for r in stages[3] if r.doc_id is None]) == len(
        {brute_fp(r.text) for r, g in zip(rows, groups) if g is None})


def test_mix(stages):
    size = lambda r: len((r.text or "").split())
    before, after = Counter((r.doc_id, r.text) for r in stages[3]), Counter((r.doc_id, r.text) for r in stages[4])
    assert all(n <= 2 * before[k] for k, n in after.items())
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in stages[3]:
        sizes[r.source] += size(r)
        longest[r.source] = max(longest[r.source], size(r))
    for r in stages[4]:
        taken[r.source] += size(r)
    for s, t in shares(sizes, (3, 1, 2), 1.5, 2).items():
        assert abs(taken[s] - t) <= longest[s]


def test_packing(stages):
    bpe = ByteBpe(tokenizer_path())
    want = Counter()
    for r in stages[4]:
        want[r.doc_id] += len(bpe.encode(r.text or "")) + 1
    got, bins = Counter(), defaultdict(list)
    for p in stages[5]:
        got[p.doc_id] += p.length
        bins[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(b[-1]) <= 2048
    assert len(bins) == brute_bins([p.length for p in stages[5]], 2048)


def test_run_and_empty_documents(spark, sf_small):
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.run(spark, sf_small).count() > 0
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.collect() == []


def test_other_columns_never_clash(spark, sf_small):
    """Columns named like a stage's own results are dropped and change nothing."""
    names = ["score", "predicted", "spans", "n_lines", "n_dropped", "fingerprint", "component_id", "leads", "size", "copies",
             "taken", "copy", "target", "piece", "length", "_sh_fp", "_mx_words"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    more = docs.select("*", *[F.lit(9).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, sf_small)
        assert got.columns == COLUMNS
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, stage(spark, docs, sf_small).collect()))
    assert corpus_pipeline.packing(spark, more, sf_small).count() == corpus_pipeline.packing(spark, docs, sf_small).count()
