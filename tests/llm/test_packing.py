import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from geotrail.llm.packing import ByteBpe, CapacityTree, best_fit_plan, cut, pack
from geotrail.llm.text_queries import tokenizer_path


def brute_bins(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else capacity
        n += room == capacity
        if room > x:
            bisect.insort(rooms, room - x)
    return n


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for trial in range(150):
        capacity = rng.randrange(5, 300)
        lengths = [rng.randint(1, capacity if trial % 2 else max(1, capacity // 3))
                   for _ in range(rng.randrange(0, 400))]
        plan = best_fit_plan(dict(Counter(lengths)), capacity)
        fill, count = Counter(), Counter()
        for length, first, n, b, each, offset in plan.tolist():
            assert first == count[length]
            for k in range(n):
                assert fill[b + k // each] == offset + (k % each) * length
                fill[b + k // each] += length
            count[length] += n
        assert count == Counter(lengths) and max(fill.values(), default=0) <= capacity
        assert sorted(fill) == list(range(len(fill)))
        assert len(fill) == brute_bins(lengths, capacity)


def test_plan_size_does_not_follow_the_data():
    small = best_fit_plan({n: 10 for n in range(1, 2049)}, 2048)
    large = best_fit_plan({n: 10_000_000 for n in range(1, 2049)}, 2048)
    assert len(large) <= 2 * len(small) < 3 * 2048 * 64


def test_capacity_tree():
    tree, rng, held = CapacityTree(100), random.Random(2), set()
    for _ in range(3000):
        room = rng.randint(1, 100)
        held.symmetric_difference_update({room})
        tree.set(room, room in held)
        need = rng.randint(1, 100)
        assert tree.tightest(need) == min((x for x in held if x >= need), default=-1)


def test_cut():
    assert cut(2048, 2048) == [(0, 2048)]
    assert cut(2049, 2048) == [(0, 1), (1, 2048)]
    assert cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer
    path = tokenizer_path()
    ref, bpe, rng = Tokenizer.from_file(path), ByteBpe(path), random.Random(1)
    texts = ["", " ", "\n\n  x", "a<|endoftext|>b", "Ünïcode  día ñ", "日本語 text", "'s don't 12 345",
             " ".join(chr(c) for c in range(1, 0x250)), " x\u0085y\x1c z"]
    texts += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(60)) for _ in range(60)]
    texts += ["".join(chr(rng.randrange(1, 0x250)) for _ in range(60)) for _ in range(60)]
    for t in texts:
        assert bpe.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 100])
def test_pack_round_trip(spark, capacity):
    rng = random.Random(capacity)
    rows = [(i, " ".join("word%d" % rng.randrange(99) for _ in range(rng.randrange(0, 60))), "x", 5) for i in range(80)]
    rows += [(None, None, "n", 5), (3, "", "e", 5), (3, "", "e", 5), (4, "long " * 20_000, "l", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, offset int").repartition(3)
    got = pack(df, tokenizer_path(), capacity).collect()
    bpe = ByteBpe(tokenizer_path())
    want = sorted((r[0] is None, r[0] or 0, tuple(bpe.encode(r[1] or "").tolist() + [0])) for r in rows)
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= capacity and r.ids_crc32 == zlib.crc32(r.ids)
        parts[r.doc_id, r.part].append((r.piece, r.start, tuple(ids.tolist())))
        bins[r.sequence_id].append((r.offset, r.length))
    # ids 3 occur three times: their pieces are told apart by the empty text's single id
    lists = []
    for (doc, part), ps in parts.items():
        if part == "e":
            assert ps == [(0, 0, (0,))] * 2
            lists += [(False, 3, (0,))] * 2
            continue
        ps.sort()
        assert [p[0] for p in ps] == list(range(len(ps)))
        flat = tuple(t for p in ps for t in p[2])
        assert all(sum(len(q[2]) for q in ps[:i]) == p[1] for i, p in enumerate(ps))
        assert all(len(p[2]) == capacity for p in ps[1:])
        lists.append((doc is None, doc or 0, flat))
    assert sorted(lists) == want
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= capacity
    assert len(bins) == brute_bins([r.length for r in got], capacity)


def test_pack_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, tokenizer_path()).collect() == []
