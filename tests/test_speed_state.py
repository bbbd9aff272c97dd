import random

from geotrail.streaming import capture
from geotrail.streaming.capture import PreviousPost


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


class Map:
    def __init__(self):
        self.data = {}

    def containsKey(self, k):
        return k in self.data

    def getValue(self, k):
        return self.data[k]

    def updateValue(self, k, v):
        self.data[k] = v

    def removeKey(self, k):
        del self.data[k]

    def keys(self):
        return iter(list(self.data))


class Handle:
    """One user's state and timers, fired the way the engine does it."""

    def __init__(self):
        self.timers, self.watermark = set(), 0
        self.processor = PreviousPost()
        self.processor.init(self)

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def batch(self, rows, watermark):
        """One micro-batch: rows (media_id, t, lat, lon), then the timers that are due."""
        self.watermark = watermark * 1000
        rows = [dict(zip(("media_id", "t", "place_lat", "place_lon"), r)) for r in rows]
        out = list(self.processor.handleInputRows(("u",), iter(rows), self)) if rows else []
        while due := sorted(t for t in self.timers if t <= self.watermark):
            self.timers.remove(due[0])
            out += self.processor.handleExpiredTimer(("u",), self, None)
        return [(r.media_id, r.t, r.prev_t, r.prev_lat, r.prev_lon) for r in out]


def test_a_user_of_the_first_batch_only_is_released():
    h = Handle()
    assert h.batch([("solo", 900, 48.85, 2.35)], 0) == []      # no watermark yet
    assert h.timers == {900_000}
    assert h.batch([], 1_000) == [("solo", 900, None, None, None)]
    assert not h.timers and not h.processor.held.data


def test_orders_within_and_across_batches():
    h = Handle()
    assert h.batch([("b", 900, 48.85, 2.35), ("a", 800, 48.0, 2.0)], 0) == []
    assert h.batch([("0", 800, 1.0, 1.0), ("c", 2000, 48.9, 2.4)], 1_000) == [
        ("0", 800, None, None, None), ("a", 800, 800, 1.0, 1.0), ("b", 900, 800, 48.0, 2.0)]
    assert h.timers == {2_000_000}


def test_releases_up_to_the_watermark_only_and_keeps_the_last_post():
    h = Handle()
    h.batch([("a", 36_000, 48.85, 2.35), ("b", 30_000, 48.0, 2.0)], 100)
    assert [r[0] for r in h.batch([], 30_600)] == ["b"]             # "a" is later than the watermark
    assert h.batch([], 40_000) == [("a", 36_000, 30_000, 48.0, 2.0)]
    assert not h.timers and h.processor.last.exists()
    assert h.batch([("tokyo", 80_000, 35.68, 139.69)], 90_000) == [("tokyo", 80_000, 36_000, 48.85, 2.35)]


def test_an_earlier_arrival_moves_the_timer():
    h = Handle()
    h.batch([("a", 500, 1.0, 1.0)], 0)
    h.batch([("b", 400, 1.0, 1.0)], 100)
    assert h.timers == {400_000}
    h.batch([("c", 450, 1.0, 1.0)], 100)
    assert h.timers == {400_000}


def test_missing_values_pass_through():
    h = Handle()
    assert h.batch([("a", 1, None, None), (None, 1, 5.0, 5.0), ("b", 2, 1.0, 2.0), ("c", 3, 1.0, 2.0)], 10_000) == [
        (None, 1, None, None, None), ("a", 1, 1, 5.0, 5.0), ("b", 2, 1, None, None), ("c", 3, 2, 1.0, 2.0)]


def test_random_batches_equal_the_sorted_sequence():
    r = random.Random(4)
    for _ in range(50):
        posts = [(f"m{i}", r.randint(0, 50) * 10, float(i), float(-i)) for i in range(r.randint(1, 40))]
        h, got, waiting, mark = Handle(), [], list(posts), 0
        r.shuffle(waiting)
        while waiting:
            late = [p for p in waiting if p[1] <= mark]             # the engine would drop these: send them first
            take = late or waiting[:r.randint(1, 6)]
            waiting = [p for p in waiting if p not in take]
            lowest = min([p[1] for p in waiting], default=10 ** 6)
            mark = max(mark, min(mark + 40, lowest - 1))
            got += h.batch(take, mark)
        got += h.batch([], 10 ** 6)
        want, last = [], (None, None, None)
        for media, t, lat, lon in sorted(posts, key=lambda p: (p[1], p[0])):
            want.append((media, t, *last))
            last = (t, lat, lon)
        assert got == want


def test_state_calls_do_not_grow_with_the_posts_of_a_batch(monkeypatch):
    calls = []
    for name in ("containsKey", "getValue", "updateValue", "removeKey"):
        def counted(self, *a, _f=getattr(Map, name)):
            calls.append(a)
            return _f(self, *a)
        monkeypatch.setattr(Map, name, counted)
    h = Handle()
    h.batch([(f"m{t}", t, 1.0, 1.0) for t in range(300)], 0)
    h.batch([(f"n{t}", t, 1.0, 1.0) for t in range(200, 500)], 100)
    assert [r[1] for r in h.batch([], 1_000)] == sorted([*range(101, 300), *range(200, 500)])
    assert len(calls) < 20


def test_more_posts_than_a_chunk_holds(monkeypatch):
    monkeypatch.setattr(capture, "CHUNK", 3)
    h = Handle()
    assert h.batch([(f"m{t}", t, float(t), 0.0) for t in (5, 3, 9, 8, 1, 7, 2)], 4) == [
        ("m1", 1, None, None, None), ("m2", 2, 1, 1.0, 0.0), ("m3", 3, 2, 2.0, 0.0)]
    assert h.timers == {5_000}
    assert [r[:3] for r in h.batch([("m6", 6, 6.0, 0.0)], 100)] == [
        ("m5", 5, 3), ("m6", 6, 5), ("m7", 7, 6), ("m8", 8, 7), ("m9", 9, 8)]
    assert not h.processor.held.data and not h.timers
