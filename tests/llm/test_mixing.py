from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from geotrail.llm.mixing import draw, mix_sources


def shares(sizes, weights, share, cap):
    """Share by weight; what is above a cap is shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in free})
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= cap * sizes[s]
        free -= over
    return target


def frame(spark, n=600):
    rows = [(i, " ".join(["w"] * (i * 7 % 90)), ["b", "a", "é", None, "a"][i % 5] if i % 3 else "a", "x")
            for i in range(n)]
    rows += [(None, "null id words", "b", "x"), (None, None, "b", "x"), (5, "again\tand\x0bagain", "c", "x"),
             (5, "again\tand\x0bagain", "c", "x"), (9999, "", "empty", "x"), (10_000, "w " * 3000, "b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")


@pytest.mark.parametrize("weights,share", [((3, 1, 2), 1.5), ((1,), 0.4), ((5, 1), 1.9)])
def test_targets_and_taken(spark, weights, share):
    df = frame(spark)
    got = mix_sources(df, weights, share).collect()
    assert len(got) == df.count()
    size, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        target[r.source] = r.target
    want = shares(size, weights, share, 2)
    for r in got:
        assert r.source_size == size[r.source]
    for s in size:
        assert target[s] == pytest.approx(want[s])
        # rows that share id and source go together
        assert abs(taken[s] - target[s]) <= max(longest[s], 6)
    again = mix_sources(df.repartition(7), weights, share).collect()
    pick = lambda rs: sorted((str(r.doc_id), r.text or "", str(r.source), r.taken) for r in rs)
    assert pick(again) == pick(got)


@pytest.mark.parametrize("text", ["one two three", None])
def test_rows_that_share_an_id_are_split_at_the_target(spark, text):
    """A third of a source has a null id, another a repeated one; equal texts (text given) or different ones."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text or " ".join(["w"] * (1 + i * 7 % 30)), "ab"[i % 2], i)
            for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    for share in (0.5, 1.3):
        got = mix_sources(df, (1,), share).collect()
        assert sorted(r.n for r in got) == list(range(900))
        for s in "ab":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2


def test_inclusion_is_unequal(spark):
    """Long documents come in more often than short ones, in another order than that of the draw."""
    df = spark.createDataFrame([(i, " ".join(["w"] * (4 if i % 2 else 100)), "s") for i in range(4000)],
                               "doc_id long, text string, source string")
    got = mix_sources(df, (1,), 0.5).collect()
    share = [sum(r.copies for r in got if r.size == n) / 2000 for n in (4, 100)]
    odds = [x / (1 - x) for x in share]
    assert odds[1] / odds[0] == pytest.approx(5.0, rel=0.25)       # the square root of 100 / 4
    assert abs(sum(r.taken for r in got) - got[0].target) <= 50
    u = {r.doc_id: r.u for r in df.select("doc_id", draw(F.col("doc_id")).alias("u")).collect()}
    taken = {r.doc_id for r in got if r.copies}
    assert max(u[i] for i in taken) > min(u[i] for i in u if i not in taken)


def test_targets_at_both_ends(spark):
    df = frame(spark)
    assert all(r.copies == 2 for r in mix_sources(df, share=2.0).collect() if r.size)
    assert all(r.copies == 0 for r in mix_sources(df, share=0.0).collect() if r.size)


def test_empty_table(spark):
    assert mix_sources(frame(spark).limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = mix_sources(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
