"""Toxic spans and document scores from a linear-chain conditional random field.

Document labels become token labels: words and word beginnings that stand out
in toxic documents (a likelihood-ratio test on document frequencies) are the
indicators; in toxic documents the tokens that have one are labelled toxic, all
other tokens are labelled clean, also the same words in clean documents. A
two-state linear-chain CRF over the tokens, with indicators as features and
learned transitions, is fitted to them. Tokens with no indicator within REACH
positions carry no evidence and are clean; the chains are the stretches in
between.

Scoring runs forward-backward on a document's chains. Marginals are summed up
to the expected number of toxic tokens, their peak and their density, and a
logistic model turns these into a probability; tokens with a marginal of 1/2
and more give the offending offsets. Labels, language, source and id are never
inputs of a score.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REACH = 5               # tokens around an indicator that a chain covers
CELLS = 1 << 19         # tokens of a batch of chains, padded (one longer chain is a batch of its own)
PREFIXES = (3, 4, 5, 6)
MIN_DOCS = 3            # toxic sample documents that must hold an indicator
MIN_G2 = 16.0           # likelihood ratio (chi square, one degree of freedom)
MIN_ODDS = 8.0
TOKEN = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """crc32(id as text) mod 3 = 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: str) -> list[str]:
    """The lower-cased word itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


# --- forward-backward ------------------------------------------------------

class Chains:
    """Chains of a batch, padded: per position the indicators of a token."""

    def __init__(self, chains: list[list[list[int]]]):
        self.length = np.array([len(c) for c in chains], np.int64)
        self.width = int(self.length.max(initial=0))
        flat = [(i, t, f) for i, c in enumerate(chains) for t, fs in enumerate(c) for f in fs]
        self.at = np.array([i * self.width + t for i, t, _ in flat], np.int64)
        self.feature = np.array([f for _, _, f in flat], np.int64)
        self.inside = np.arange(self.width)[None, :] < self.length[:, None]

    def emission(self, weights: np.ndarray, bias: float) -> np.ndarray:
        e = np.bincount(self.at, weights=weights[self.feature], minlength=self.inside.size)
        return e.reshape(self.inside.shape) + bias

    def marginals(self, e: np.ndarray, a: np.ndarray, pairs: bool = False):
        """P(toxic) per token, log Z per chain and expected transition counts.

        a: scores of clean->toxic, toxic->clean and toxic->toxic; the tokens
        before and after a chain are clean."""
        n, width = e.shape
        fo, ft = np.zeros((n, width)), np.zeros((n, width))
        bo, bt = np.zeros((n, width)), np.full((n, width), a[1])
        add = np.logaddexp
        for t in range(width):
            if t == 0:
                ft[:, 0] = a[0] + e[:, 0]
            else:
                fo[:, t] = add(fo[:, t - 1], ft[:, t - 1] + a[1])
                ft[:, t] = e[:, t] + add(fo[:, t - 1] + a[0], ft[:, t - 1] + a[2])
        for t in range(width - 2, -1, -1):
            more = t < self.length - 1
            nxt = e[:, t + 1] + bt[:, t + 1]
            bo[more, t] = add(bo[:, t + 1], a[0] + nxt)[more]
            bt[more, t] = add(a[1] + bo[:, t + 1], a[2] + nxt)[more]
        last = np.maximum(self.length - 1, 0)
        rows = np.arange(n)
        log_z = add(fo[rows, last], ft[rows, last] + a[1])
        p = np.where(self.inside, np.exp(ft + bt - log_z[:, None]), 0.0)
        if not pairs:
            return p
        both = self.inside[:, 1:]
        z = log_z[:, None]
        nxt = e[:, 1:] + bt[:, 1:]
        counts = np.array([p[:, 0].sum() + np.where(both, np.exp(fo[:, :-1] + a[0] + nxt - z), 0).sum(),
                           p[rows, last].sum() + np.where(both, np.exp(ft[:, :-1] + a[1] + bo[:, 1:] - z), 0).sum(),
                           np.where(both, np.exp(ft[:, :-1] + a[2] + nxt - z), 0).sum()])
        return p, log_z, counts


def batches_of(chains: list, most: int) -> Iterator[list[int]]:
    """Numbers of the chains by length, in batches of bounded padded size."""
    part: list[int] = []
    for c in sorted(range(len(chains)), key=lambda c: len(chains[c])):
        if part and (len(part) == most or (len(part) + 1) * len(chains[c]) > CELLS):
            yield part
            part = []
        part.append(c)
    if part:
        yield part


# --- model -----------------------------------------------------------------

class ToxicModel:
    """Indicators with weights, transitions and the document calibration."""

    def __init__(self, indicators: dict[str, int]):
        self.indicators = indicators
        self.weights, self.bias = np.zeros(len(indicators)), 0.0
        self.moves = np.zeros(3)
        self.calibration = np.zeros(4)
        self.known: dict[str, list[int]] = {}

    def hits(self, word: str) -> list[int]:
        """Indices of a token's indicators (remembered per word)."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            low = word.lower()
            found = [self.indicators[f] for f in features(low) if f in self.indicators]
            self.known[word] = found
        return found

    def chains(self, words: list[str]) -> list[tuple[int, list[list[int]]]]:
        """(first token, indicators per token) of the stretches with evidence."""
        hits = self.hits
        active = [i for i, w in enumerate(words) if hits(w)]
        spans: list[list[int]] = []
        for i in active:
            lo, hi = max(0, i - REACH), min(len(words), i + REACH + 1)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        return [(lo, [hits(w) for w in words[lo:hi]]) for lo, hi in spans]

    def token_marginals(self, docs: list[list[str]]) -> list[list[tuple[int, float]]]:
        """Per document (token number, P(toxic)) of all tokens in chains."""
        found, of, start = [], [], []
        for i, words in enumerate(docs):
            for at, chain in self.chains(words):
                found.append(chain)
                of.append(i)
                start.append(at)
        out: list[list[tuple[int, float]]] = [[] for _ in docs]
        for part in batches_of(found, 2048):
            batch = Chains([found[c] for c in part])
            p = batch.marginals(batch.emission(self.weights, self.bias), self.moves)
            for row, c in enumerate(part):
                out[of[c]].extend((start[c] + t, float(p[row, t])) for t in range(len(found[c])))
        return out

    @staticmethod
    def summary(marginals: list[tuple[int, float]], n_tokens: int) -> list[float]:
        """Bias, expected toxic tokens (log), peak and density."""
        total = sum(p for _, p in marginals)
        peak = max((p for _, p in marginals), default=0.0)
        return [1.0, math.log1p(total), peak, 20.0 * total / (n_tokens + 20)]

    def scores(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summaries @ self.calibration, -30, 30)))


def indicators_of(toxic: list[str], clean: list[str]) -> dict[str, int]:
    """Features that stand out in the toxic documents (by document frequency)."""
    def of(text: str) -> set[str]:
        return {f for w in set(TOKEN.findall(text.lower())) for f in features(w)}

    t_df: Counter = Counter()
    for text in toxic:
        t_df.update(of(text))
    t_df = Counter({f: n for f, n in t_df.items() if n >= MIN_DOCS})
    c_df: Counter = Counter()
    for text in clean:
        c_df.update(f for f in of(text) if f in t_df)
    n_t, n_c = max(1, len(toxic)), max(1, len(clean))
    chosen = {}
    for f, t in sorted(t_df.items()):
        c = c_df[f]
        share = n_t / (n_t + n_c)
        g2 = 2 * (t * math.log(t / ((t + c) * share)) + (c * math.log(c / ((t + c) * (1 - share))) if c else 0))
        odds = ((t + 0.5) / (n_t + 1)) / ((c + 0.5) / (n_c + 1))
        if g2 >= MIN_G2 and odds >= MIN_ODDS:
            chosen[f] = len(chosen)
    return chosen


def _adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-9)
    return x


def fit_model(toxic: list[str], clean: list[str], toxic_share: float, steps: int = 120,
              ridge: float = 0.02) -> ToxicModel:
    """CRF and calibration from labelled texts.

    toxic_share: share of toxic rows among all labelled rows, which the
    sample need not keep."""
    model = ToxicModel(indicators_of(toxic, clean))
    n = len(model.indicators)
    words = [TOKEN.findall(x) for x in (*toxic, *clean)]
    chains, labels = [], []
    for i, w in enumerate(words):
        for _, chain in model.chains(w):
            chains.append(chain)
            labels.append([bool(f) and i < len(toxic) for f in chain])
    if chains:
        groups = []
        for part in batches_of(chains, 4096):
            batch = Chains([chains[c] for c in part])
            y = np.zeros(batch.inside.shape)
            for row, c in enumerate(part):
                y[row, :len(labels[c])] = labels[c]
            before = np.pad(y, ((0, 0), (1, 0)))[:, :-1]
            last = y[np.arange(len(part)), batch.length - 1]
            seen = np.array([(y * (1 - before)).sum(),
                             (before * (1 - y) * batch.inside).sum() + last.sum(), (before * y).sum()])
            groups.append((batch, y, seen))
        total = float(sum(g[0].length.sum() for g in groups))

        def gradient(x):
            w, b, a = x[:n], x[n], x[n + 1:]
            g = np.concatenate([ridge * w / max(1, n) ** 0.5, [0.0], ridge * a]) * 0.1
            for batch, y, seen in groups:
                p, _, counts = batch.marginals(batch.emission(w, b), a, pairs=True)
                miss = (p - y) * batch.inside
                g[:n] += np.bincount(batch.feature, weights=miss.ravel()[batch.at], minlength=n) / total
                g[n] += miss.sum() / total
                g[n + 1:] += (counts - seen) / total
            return g

        x = _adam(gradient, np.zeros(n + 4), steps, 0.15)
        model.weights, model.bias, model.moves = x[:n], float(x[n]), x[n + 1:]
    marginals = model.token_marginals(words)
    s = np.array([model.summary(m, len(w)) for m, w in zip(marginals, words)]).reshape(-1, 4)
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    weight = np.where(y > 0, toxic_share / max(1, len(toxic)), (1 - toxic_share) / max(1, len(clean)))

    def slope(c):
        return s.T @ (weight * (1 / (1 + np.exp(-np.clip(s @ c, -30, 30))) - y)) + 1e-4 * c * np.array([0, 1, 1, 1])

    model.calibration = _adam(slope, np.array([-2.0, 0.5, 0.5, 0.5]), 800, 0.05)
    model.calibration[1:] = np.maximum(model.calibration[1:], 0.0)     # more evidence never lowers a score
    return model


# --- Spark -----------------------------------------------------------------

def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Fit on a bounded sample of the labelled rows that are not held out.

    per_class: at most so many labelled ids of each class, the first in hash
    order; they are found among the labels alone, so the documents are read
    once and only the chosen ones shuffled. Of rows with one id the smallest text is used,
    of equal texts one, so the fit gets at most 2 * per_class texts. An id with several labels counts as toxic if any
    says so; null labels and null ids are dropped. Without any label the model
    scores every text alike. Fitting runs in one task, which returns the model
    (a few hundred kB)."""
    lab = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
           .filter("id is not null and y is not null").filter(~held_out(F.col("id")))
           .groupBy("id").agg((F.max("y") > 0).alias("y")))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(True, 0) / max(1, sum(counts.values()))

    def first(y):
        return lab.filter(F.col("y") == y).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(per_class)

    chosen = F.broadcast(first(True).unionByName(first(False)))     # 2 * per_class ids at most
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "id")
    # an id that many rows share gives one text: what one task gets is bounded by the ids
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text"))

    def fit(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["id"].to_pylist(), table["y"].to_pylist(), table["text"].to_pylist()),
                      key=lambda r: (str(r[0]), r[2] or ""))
        # an exact copy adds no evidence
        model = fit_model(list(dict.fromkeys(t or "" for _, y, t in rows if y)),
                          list(dict.fromkeys(t or "" for _, y, t in rows if not y)), share)
        model.known = {}
        return pa.table({"model": pa.array([pickle.dumps(
            (model.indicators, model.weights, model.bias, model.moves, model.calibration))], pa.binary())})

    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "model binary").collect()
    if not got:
        return fit_model([], [], 0.5)
    indicators, *rest = pickle.loads(got[0]["model"])
    model = ToxicModel(indicators)
    model.weights, model.bias, model.moves, model.calibration = rest
    return model


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _score(model, text_col: str, columns: list[str], with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicModel = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                words = [TOKEN.findall(x) for x in texts]
                marginals = m.token_marginals(words)
                s = m.scores(np.array([m.summary(p, len(w)) for p, w in zip(marginals, words)]))
                out = part.select(columns).append_column("score", pa.array(s))
                if with_spans:
                    spans = []
                    for text, p in zip(texts, marginals):
                        toxic = {i: x for i, x in p if x >= 0.5}
                        spans.append([{"start": t.start(), "end": t.end(), "p": toxic[i]}
                                      for i, t in enumerate(TOKEN.finditer(text)) if i in toxic] if toxic else [])
                    out = out.append_column("spans", pa.array(spans, SPAN))
                yield out
    return run


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, text_col: str = "text",
                   columns: list[str] | None = None, spans: bool = True) -> DataFrame:
    """Toxicity of every whole text.

    Returns ``columns`` of ``docs`` (all, by default; columns of the result's
    names are replaced) plus score (0 to 1), predicted (1 if score >=
    ``threshold``) and, unless switched off, spans: start and end (code points)
    and marginal of the offending tokens. A null or empty text has no evidence
    and gets the score of such texts; rows are scored one by one, so repeated
    rows get equal scores; an empty table gives an empty one. A text of any length is
    scored whole in one task; only stretches near an indicator word enter chains.
    """
    keep = [c for c in (columns or docs.columns) if c not in ("score", "predicted", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    fields = list(src.select(*[F.col(f"`{c}`") for c in keep]).schema.fields)
    schema = T.StructType(fields).add("score", "double")
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer")
                                                 .add("p", "double")))
    out = src.mapInArrow(_score(shared, text_col, keep, spans), schema)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
