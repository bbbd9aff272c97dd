import itertools
import zlib

import numpy as np
import pytest

from geotrail.llm.toxicity import TOKEN, Chains, fit_model, held_out, indicators_of, score_toxicity, train


def brute_chain(e, a):
    """Marginals, log Z and expected transition counts by enumeration."""
    n, total = len(e), 0.0
    p, counts = np.zeros(n), np.zeros(3)
    for y in itertools.product((0, 1), repeat=n):
        full = (0, *y, 0)
        moves = [(x, z) for x, z in zip(full, full[1:])]
        c = np.array([moves.count((0, 1)), moves.count((1, 0)), moves.count((1, 1))], float)
        w = np.exp(sum(e[i] for i in range(n) if y[i]) + c @ a)
        total += w
        p += w * np.array(y)
        counts += w * c
    return p / total, np.log(total), counts / total


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    chains = [[[int(f) for f in rng.integers(0, 4, rng.integers(0, 3))] for _ in range(n)] for n in (1, 2, 5, 8, 3)]
    batch, w, a = Chains(chains), rng.normal(size=4), rng.normal(size=3)
    p, log_z, counts = batch.marginals(batch.emission(w, -0.3), a, pairs=True)
    want = np.zeros(3)
    for i, c in enumerate(chains):
        bp, bz, bc = brute_chain([-0.3 + sum(w[f] for f in fs) for fs in c], a)
        assert np.allclose(p[i, :len(c)], bp) and not p[i, len(c):].any() and np.isclose(log_z[i], bz)
        want += bc
    assert np.allclose(counts, want)


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    clean = [f"{a}{b}" for a in ("ra", "to", "mi", "so") for b in ("ne", "lu", "ka", "di", "po")]
    bad = ["zorg", "zorgly", "Vuxa", "vuxen"]
    docs, y = [], []
    for i in range(n):
        words = [str(x) for x in rng.choice(clean, int(rng.integers(5, 60)))]
        toxic = i % 4 == 0
        for _ in range(int(rng.integers(2, 5)) if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)) + str(rng.choice(["", ",", "!"])))
        docs.append(" ".join(words))
        y.append(int(toxic))
    return docs, y


def test_model_finds_the_words_and_separates_documents():
    docs, y = corpus()
    toxic, clean = ([d for d, t in zip(docs, y) if t == k] for k in (1, 0))
    assert {"zorg", "vux*"} <= set(indicators_of(toxic, clean))
    m = fit_model(toxic, clean, 0.25)
    new, ny = corpus(seed=1)
    words = [TOKEN.findall(d) for d in [*new, "", "mine zorgish tolu"]]
    s = m.scores(np.array([m.summary(p, len(w)) for p, w in zip(m.token_marginals(words), words)]))
    assert all((s[i] >= 0.7) == bool(t) for i, t in enumerate(ny))
    assert 0 < s[-2] < 0.2 < s[-1]


def test_long_stretch_is_one_chain():
    docs, y = corpus()
    m = fit_model(*([d for d, t in zip(docs, y) if t == k] for k in (1, 0)), 0.25)
    words = ["zorg", "vuxa", "rane"] * 400
    (at, chain), = m.chains(words)
    assert at == 0 and len(chain) == len(words)
    e = np.array([m.bias + m.weights[fs].sum() for fs in chain])
    a, (fo, ft) = m.moves, (0.0, -np.inf)
    forward, back = [], [(0.0, a[1])]
    for x in e:
        fo, ft = np.logaddexp(fo, ft + a[1]), x + np.logaddexp(fo + a[0], ft + a[2])
        forward.append((fo, ft))
    for x in e[:0:-1]:
        bo, bt = back[-1]
        back.append((np.logaddexp(bo, a[0] + x + bt), np.logaddexp(a[1] + bo, a[2] + x + bt)))
    z = np.logaddexp(fo, ft + a[1])
    want = [np.exp(f[1] + b[1] - z) for f, b in zip(forward, reversed(back))]
    got, = m.token_marginals([words])
    assert [i for i, _ in got] == list(range(len(words))) and np.allclose([p for _, p in got], want)


def test_model_without_evidence():
    m = fit_model([], [], 0.5)
    assert m.indicators == {} and 0 < m.scores(np.array([m.summary([], 0)]))[0] < 1
    assert fit_model(["a b"], ["a b"], 0.5).indicators == {}


def test_operator(spark):
    docs, y = corpus()
    rows = [(i, d, "x") for i, d in enumerate(docs)] + [(None, None, "n"), (901, "", "e"), (0, docs[0], "again"),
                                                       (902, "rane " * 30_000 + "zorg vuxa zorgly", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)] + [(5, None), (None, 1), (7777, 1)],
                                   "doc_id long, toxic int")
    model = train(df, labels)
    got = score_toxicity(df, model).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text, r.score) == r.score
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        for s in r.spans:
            assert r.text[s.start:s.end].lower()[:3] in ("zor", "vux") and s.p >= 0.5
        if r.doc_id is not None and r.doc_id < len(y):
            assert r.predicted == y[r.doc_id]
    long = next(r for r in got if r.doc_id == 902)
    assert [long.text[s.start:s.end] for s in long.spans] == ["zorg", "vuxa", "zorgly"]
    assert by_text[None] == by_text[""] < 0.5
    assert score_toxicity(df.limit(0), model).collect() == []
    assert train(df, labels.limit(0)).indicators == {}


def test_held_out_labels_are_never_learned(spark):
    docs, y = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = {r.doc_id for r in df.filter(held_out(df.doc_id)).collect()}
    assert out == {i for i in range(len(docs)) if zlib.crc32(str(i).encode()) % 3 == 1}
    true = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    lies = spark.createDataFrame([(i, 1 - t if i in out else t) for i, t in enumerate(y)], "doc_id long, toxic int")
    a, b = train(df, true), train(df, lies)
    assert a.indicators == b.indicators and np.array_equal(a.weights, b.weights)
    assert np.array_equal(a.calibration, b.calibration)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    from geotrail.llm.queries import QUERIES
    scored = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [(scored[i], t) for i, t in labels.items() if i in scored and scored[i].held_out]
    hits = sum(1 for r, t in test if r.predicted and t)
    assert sum(r.predicted for r, _ in test) - hits <= 0.02 * len(test)
    assert hits >= 0.7 * sum(t for _, t in test)
    pos, neg = [r.score for r, t in test if t], [r.score for r, t in test if not t]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) > 0.9
