from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from geotrail.llm import corpus_queries, filter_audit as A
from geotrail.llm.registry import table

DOCS = "doc_id long, text string, lang string, part string, words string, cell int"
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"w{i}" for i in range(120))


def fails(text):
    words = [w for w in text.replace("\x85", "x").replace("\xa0", "x").replace("\x1c", "x").split()]
    capitals = sum("A" <= c <= "Z" for c in text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * capitals > 10 * len(text), "D": any(c in "#$%&*|" for c in text)}


def brute(docs, labels):
    """docs: (doc_id, text, lang), labels: (doc_id, quality, toxic) -> rows of the report."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, lang in docs:
        f = fails(t or "")
        f["E"] = i is not None and first[t or ""] < i
        parts[lang or ""].append((f, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                all_fail = sum(r[0][f] for r in rows)
                out[part, order, step] = [len(stay), len(gone), all_fail - len(gone),
                                          sum(r[0][f] and sum(r[0].values()) == 1 for r in rows),
                                          sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[part, f] += len(gone)
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_every_order_equals_brute_force_with_nulls_copies_and_clashing_columns(spark):
    texts = [LONG, LONG, None, "", "a b c", "A B C", "x #", "y y y y", "word " * 150, LONG + " |", "É" * 300 + " z",
             LONG.upper(), "one\x85two\xa0three four\x1cfive " * 60, "\t\n\x0b\x0c\r "]
    docs = [(i * 7 % 23, t, ("en", None, "", "de")[i % 4]) for i, t in enumerate(texts * 3)]
    docs += [(None, LONG, "en"), (None, LONG, "en"), (None, None, None), (5, "a b c", "de"), (5, "a b c", "de")]
    labels = [(i, i % 2, (i + 1) % 3 % 2) for i in range(0, 23)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (3, None, None),
                                                                   (999, 1, 1)]
    got = A.audit_documents(spark.createDataFrame([(*d, "p", "w", 9) for d in docs], DOCS),
                            spark.createDataFrame([(*x, "p") for x in labels], LABELS))
    assert collected(got) == brute(docs, labels)


def test_query_equals_brute_force_on_the_small_table(spark, sf_small):
    docs = [tuple(r) for r in table(spark, sf_small, "documents").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in table(spark, sf_small, "labels").select("doc_id", "quality", "toxic").collect()]
    assert collected(corpus_queries.op11_filter_audit(spark, sf_small)) == brute(docs, labels)


def test_empty_tables(spark):
    no_docs, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.audit_documents(no_docs, no_labels).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, None)], DOCS)
    got = collected(A.audit_documents(one, no_labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
    assert got["", "BACDE", 2] == (0, 1, 0, 1, 0, 0, 120) and got["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_a_very_long_text_and_a_text_of_a_third_of_all_rows(spark):
    docs = [(0, "w " * 1_000_000, "en")] + [(i, "same", "en") for i in range(1, 400)] + [
        (i, f"{i} own", "en") for i in range(400, 900)]
    got = collected(A.audit_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string"),
                                      spark.createDataFrame([], LABELS)))
    assert got["en", "EABCD", 1][:2] == (502, 398) and got["en", "BEACD", 1][:2] == (899, 1)


def test_other_filters_and_outcomes(spark):
    rows = [("p", bool(i & 1), bool(i & 2), None if i % 3 else True, i % 2 == 0, i % 5 == 0) for i in range(60)]
    facts = spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    got = collected(A.audit_filters(facts, facts, "XYZ"))
    assert len(got) == 18
    removed = [r for r in rows if not r[1] and r[3]]
    assert got["p", "XZY", 2][1] == len(removed) and got["p", "XZY", 2][4] == sum(r[4] for r in removed)
    with pytest.raises(ValueError):
        A.audit_filters(facts, facts, "XX")


def test_contraction_is_exact_beyond_doubles():
    t = np.full((1, 2, 2), 2 ** 58 + 1, np.int64)
    picks = np.array([[A.ALL, A.ALL], [A.PASS, A.FAIL]], np.int64)
    assert A.contract(t, picks).tolist() == [[4 * (2 ** 58 + 1), 2 ** 58 + 1]]
