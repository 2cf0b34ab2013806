"""Tracking: near pairs as arrays, and state that is touched only where a batch doesn't fit into a chunk."""

import random
from collections import Counter

import pytest
from pyspark.sql import Row

from gondola.streaming import keyed_state, shelf_streams


class State:
    """A state variable of any kind, which counts what is asked of it."""

    def __init__(self, calls, name):
        self.calls, self.name, self.value = calls, name, {}

    def __getattr__(self, verb):
        self.calls[self.name, verb] += 1
        return {
            "exists": lambda: bool(self.value), "get": lambda: self.value["v"], "put": lambda v: self.value.update(v=v), "update": lambda v: self.value.update(v=v), "clear": self.value.clear,
            "containsKey": lambda k: k in self.value, "getValue": lambda k: self.value[k], "updateValue": lambda k, v: self.value.update({k: v}), "keys": lambda: list(self.value),
        }[verb]


def tracked(rows):
    calls = Counter()
    t = keyed_state.Tracker(0.3, 2, 1, None)
    t.tracks, t.next_id, t.waiting = (State(calls, n) for n in ("tracks", "next_id", "waiting"))
    return list(t.handleInputRows((1,), iter(rows), None)), calls


def test_boxes_of_one_chunk_do_not_wait_in_state(monkeypatch):
    r = random.Random(2)
    rows = [Row(frame=f, det=d, x1=x, y1=0.0, x2=x + 9, y2=9.0) for f in range(20) for d, x in ((d, float(r.randrange(40))) for d in range(6))]
    r.shuffle(rows)
    got, calls = tracked(rows)
    assert len(got) == 120 and not [k for k in calls if k[0] == "waiting"]
    for chunk in (7, 120):
        monkeypatch.setattr(keyed_state, "CHUNK", chunk)
        assert tracked(rows)[0] == got
    monkeypatch.setattr(keyed_state, "CHUNK", 7)
    assert tracked(rows)[1]["waiting", "updateValue"] > 0


@pytest.mark.parametrize("least", [0.3, 0.0])
def test_near_pairs_are_those_of_a_loop(least):
    r = random.Random(4)
    box = lambda: (lambda x, y: [float(v) for v in (x, y, x + r.choice([0, 5]), y + 5)])(r.randrange(9), r.randrange(6))
    tracks, boxes = [[i, 1, 0, *box(), 0.0, 0.0] for i in range(20)], [tuple(box()) for _ in range(15)]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0

    want = sorted(((s, -i, -j) for i, t in enumerate(tracks) for j, b in enumerate(boxes) if (s := iou(t[3:7], b)) >= least), reverse=True)
    assert shelf_streams._near(tracks, boxes, least) == want
    assert shelf_streams._near([], boxes, least) == shelf_streams._near(tracks, [], least) == []
