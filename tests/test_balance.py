"""Reviewer balance against a heap that deals image by image."""

import heapq
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.operators import review


def one_by_one(loads, size, count):
    heap = [(load, low, member) for load, low, member in loads]
    heapq.heapify(heap)
    order = []
    for _ in range(count):
        load, low, member = heapq.heappop(heap)
        order.append(member)
        heapq.heappush(heap, (load + size, low, member))
    return order, sorted(heap)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 90))
def test_deal(loads, size, count):
    loads = [(load, f"m{i}", f"M{i}") for i, load in enumerate(loads)]
    stretches, after = review.dealt_by_load(loads, size, count)
    order = [turn[i % len(turn)] for first, stop, turn in stretches for i in range(stop - first)]
    assert (order, sorted(after)) == one_by_one(loads, size, count)


@pytest.mark.parametrize("pools", [1, 2])
def test_balance(spark, pools):
    rng = random.Random(pools)
    names = ["ann", "Bob", "cy", "DEE", "gone"]
    rows, row = [], 0
    for i in range(300):
        image, reviewed = f"i{i:03}", rng.random() < 0.3
        for _ in range(rng.choice([1, 1, 2, 3, 3, 8, 40])):
            rows.append((image, row, rng.choice(names).upper(), reviewed and rng.random() < 0.7))
            row += 1
    team = [(m, i % pools) for i, m in enumerate(names[:4])]
    got = review.balance(spark.createDataFrame(rows, "image string, row bigint, reviewer string, reviewed boolean"), spark.createDataFrame(team, "member string, pool int"))
    sizes, made = Counter(r[0] for r in rows), {}
    for image, row, reviewer, reviewed in rows:
        if reviewed:
            n, first = made.setdefault(image, {}).get(reviewer.lower(), (0, row))
            made[image][reviewer.lower()] = (n + 1, first)
    known = {m.lower(): m for m, _ in team}
    most = {i: min(d.items(), key=lambda kv: (-kv[1][0], kv[1][1]))[0] for i, d in made.items()}
    want = {(i, known[w]) for i, w in most.items() if w in known}
    pinned = {i for i, _ in want}
    load = Counter({known[w]: 0 for w in known})
    for i, m in list(want):
        load[m] += sizes[i]
    for pool in range(pools):
        heap = [(load[m], m.lower(), m) for m, p in team if p == pool]
        heapq.heapify(heap)
        for i in sorted((i for i in sizes if i not in pinned), key=lambda i: (-sizes[i], i)):
            n, low, m = heapq.heappop(heap)
            want.add((i, m))
            heapq.heappush(heap, (n + sizes[i], low, m))
        loads = [h[0] for h in heap]
        assert pools > 1 or max(loads) - min(loads) <= max(sizes.values())
    assert sorted(map(tuple, got.collect())) == sorted(want)
