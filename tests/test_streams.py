"""Streams that are stopped and started again, timers, and tracks against a plain loop over all frames."""

import datetime as dt
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from gondola.operators import review
from gondola.streaming import keyed_state
from gondola.streaming import shelf_streams as st

BOX = "camera bigint, frame bigint, det bigint, x1 double, y1 double, x2 double, y2 double"
EVENT = "image bigint, user string, action string, ts timestamp, event_id bigint"


def put(spark, rows, folder, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def boxes(cameras=3, frames=24, seed=1):
    rng = random.Random(seed)
    rows = []
    for camera in range(cameras):
        things = [[rng.randrange(400), rng.randrange(300), rng.uniform(-9, 9), rng.uniform(-9, 9)] for _ in range(6)]
        for frame in range(frames):
            for det, t in enumerate(things):
                t[0], t[1] = t[0] + t[2], t[1] + t[3]
                if rng.random() < 0.85:
                    rows.append((camera, frame, det, t[0], t[1], t[0] + 60.0, t[1] + 50.0))
    rng.shuffle(rows)
    return rows


def plain_tracks(rows, least_iou=0.3, max_age=2):
    """Every frame's boxes to the tracks by repeated search for the best pair."""

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        size = lambda z: (z[2] - z[0]) * (z[3] - z[1])
        return 0.0 if w <= 0 or h <= 0 else w * h / (size(a) + size(b) - w * h)

    found = []
    for camera in {r[0] for r in rows}:
        tracks, count = [], 0
        for frame in sorted({r[1] for r in rows if r[0] == camera}):
            here = [r[3:] for r in sorted(rows) if r[:2] == (camera, frame)]
            moved = [[x + v for x, v in zip(t["box"], t["v"] * 2, strict=True)] for t in tracks]
            pairs = {(i, j): iou(m, b) for i, m in enumerate(moved) for j, b in enumerate(here)}
            mine = {}
            while pairs:
                (i, j), score = min(pairs.items(), key=lambda p: (-p[1], p[0]))
                if score < least_iou:
                    break
                mine[i] = j
                pairs = {k: v for k, v in pairs.items() if k[0] != i and k[1] != j}
            for i, t in enumerate(tracks):
                t["missed"] = 0 if i in mine else t["missed"] + 1
                t["box"] = list(here[mine[i]]) if i in mine else moved[i]
                if i in mine:
                    t["v"] = [(v + new - old) / 2 for v, new, old in zip(t["v"], t["box"], moved[i], strict=False)]
                    found.append((camera, frame, t["id"], *t["box"]))
            tracks = [t for t in tracks if t["missed"] <= max_age]
            for j, b in enumerate(here):
                if j not in mine.values():
                    count += 1
                    tracks.append({"id": count, "box": list(b), "v": [0.0, 0.0], "missed": 0})
                    found.append((camera, frame, count, *b))
    return sorted(found)


def tracked(spark, folder, out, **how):
    return sorted(tuple(r) for r in st.run_once(keyed_state.track(spark.readStream.schema(BOX).parquet(folder), **how), out, clock=bool(how)).collect())


def test_all_tracks_and_a_restart(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = boxes()
    want = plain_tracks(rows)
    put(spark, rows, f"{root}/whole", BOX)
    got = tracked(spark, f"{root}/whole", f"{root}/a")
    assert [g[:3] for g in got] == [w[:3] for w in want] and len({g[:1] + g[2:3] for g in got}) > 18
    assert all(abs(x - y) < 1e-9 for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))
    # each call is a new query from the checkpoint, as after a restart; a file is broken in between
    for low, high in ((0, 9), (9, 10), (10, 24)):
        put(spark, [r for r in rows if low <= r[1] < high], f"{root}/parts", BOX)
        tracked(spark, f"{root}/parts", f"{root}/b", ttl_minutes=600)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/b").collect()) == got


def test_a_task_that_dies_leaves_the_state_as_it_was(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = boxes(frames=8)
    put(spark, rows, f"{root}/whole", BOX)
    want = tracked(spark, f"{root}/whole", f"{root}/a")
    put(spark, [r for r in rows if r[1] < 4], f"{root}/parts", BOX)
    tracked(spark, f"{root}/parts", f"{root}/b")
    put(spark, [r for r in rows if r[1] >= 4], f"{root}/parts", BOX)
    broken = keyed_state.track(spark.readStream.schema(BOX).parquet(f"{root}/parts")).withColumn("x1", F.when(F.col("frame") == 6, F.raise_error(F.lit("lost"))).otherwise(F.col("x1")))
    with pytest.raises(Exception, match="lost"):
        st.run_once(broken, f"{root}/b")
    assert tracked(spark, f"{root}/parts", f"{root}/b") == want


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def events(n=3000, seed=2):
    rng = random.Random(seed)
    return [(rng.randrange(40), str(rng.randrange(3)), rng.choice(["assign", "label", "relabel", "skip", "release", "recycle", "view"]), at(rng.randrange(900)), i) for i in range(n)]


def test_the_queue_over_restarts_is_the_fold_over_all_events(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = sorted(events(), key=lambda r: (r[3], r[4]))
    want = review.fold_queue(spark.createDataFrame(rows, EVENT)).select("image", "status", "user", "label", "by", "at", "labels").collect()
    for i in range(3):
        put(spark, rows[i * 1000 : (i + 1) * 1000], f"{root}/in", EVENT)
        stream = spark.readStream.schema(EVENT).parquet(f"{root}/in")
        if i == 1:  # breaks off first
            with pytest.raises(Exception, match="lost"):
                st.run_once(keyed_state.queue_changes(stream).withColumn("status", F.when(F.col("image") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("status"))), f"{root}/out", clock=True)
        changes = st.run_once(keyed_state.queue_changes(stream), f"{root}/out", clock=True)
    got = keyed_state.queue_now(changes).select("image", "status", "user", "label", "by", "at", "labels").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["status"] for r in want} == {"assigned", "done", "skipped", "unassigned"}
    # a batch puts out the images that it touches, not the whole state
    assert changes.count() == sum(len({r[0] for r in rows[i * 1000 : (i + 1) * 1000]}) for i in range(3))


def test_a_timer_releases_an_assignment_without_an_event(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    put(spark, [(1, "a", "assign", at(0), 1), (2, "b", "assign", at(0), 2), (2, "b", "label", at(1), 3)], f"{root}/in", EVENT)
    changes = keyed_state.queue_changes(spark.readStream.schema(EVENT).parquet(f"{root}/in"), stale_minutes=0.02)
    query = changes.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        read = lambda: {(r["image"], r["status"], r["cause"]) for r in spark.read.schema(keyed_state.CHANGE).parquet(f"{root}/out").collect()}
        while time.time() < until and (1, "unassigned", "timeout") not in read():
            time.sleep(0.5)
    finally:
        query.stop()
    assert read() == {(1, "assigned", "event"), (1, "unassigned", "timeout"), (2, "done", "event")}


def test_timers_by_event_time(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    put(spark, [(1, "a", "assign", at(0), 1), (2, "b", "assign", at(15), 2), (3, "c", "view", at(30), 3)], f"{root}/in", EVENT)
    put(spark, [(1, "a", "label", at(40), 4), (2, "b", "label", at(41), 5), (9, "z", "assign", at(5), 6)], f"{root}/more", EVENT)
    run = lambda folder: keyed_state.queue_now(st.run_once(keyed_state.queue_changes(spark.readStream.schema(EVENT).parquet(folder), by_event_time=True, late="0 seconds"), f"{root}/out")).collect()
    first = {r["image"]: r["status"] for r in run(f"{root}/in")}
    assert first == {1: "unassigned", 2: "assigned", 3: "unassigned"}
    spark.read.parquet(f"{root}/more").write.mode("append").parquet(f"{root}/in")
    # 1 was taken from its holder, so that the label counts no more; 9 comes later than the watermark
    assert {r["image"]: r["status"] for r in run(f"{root}/in")} == {1: "unassigned", 2: "done", 3: "unassigned"}


def test_state_of_a_stream_without_rows(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([], BOX).write.parquet(f"{root}/none")
    assert tracked(spark, f"{root}/none", f"{root}/s") == []


def test_reviews_merge_from_a_log(spark):
    root, kind = tempfile.mkdtemp(prefix="spark-"), "k bigint, who string, at bigint"
    table = spark.createDataFrame([(1, "none", None), (2, "none", None), (3, "old", 9)], kind)
    run = lambda: sorted(tuple(r) for r in st.upsert_latest(st.run_once(spark.readStream.schema(kind).parquet(f"{root}/in"), f"{root}/log"), table, "k", "at").collect())
    put(spark, [(1, "ann", 5), (1, "bob", 7), (3, "late", 8)], f"{root}/in", kind)
    assert run() == [(1, "bob", 7), (2, "none", None), (3, "old", 9)]
    put(spark, [(1, "cy", 6), (2, "cy", 1), (4, "new", 1)], f"{root}/in", kind)
    assert run() == [(1, "bob", 7), (2, "cy", 1), (3, "old", 9), (4, "new", 1)]
    assert spark.read.parquet(f"{root}/log").count() == 6


OBS, REQ = "store long, sku string, conf long, ts timestamp", "request long, store long, sku string, ts timestamp"


def test_requests_wait_for_observations(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    run = lambda: st.run_once(st.lookup_streams(spark.readStream.schema(REQ).parquet(f"{root}/r"), spark.readStream.schema(OBS).parquet(f"{root}/o"), "30 minutes", "10 minutes"), f"{root}/out").collect()
    rows = lambda found: {(r["request"], r["conf"]) for r in found}
    put(spark, [(1, 7, "a", at(0)), (2, 7, "b", at(20)), (3, 7, None, at(25)), (4, 8, "a", at(0))], f"{root}/r", REQ)
    put(spark, [(7, "a", 50, at(29)), (7, "a", 51, at(31)), (7, "b", 60, at(60))], f"{root}/o", OBS)
    assert rows(run()) == {(1, 50)}  # the slower stream stands at 25: all others may still be met
    put(spark, [(5, 9, "z", at(100)), (6, 7, "b", at(16))], f"{root}/r", REQ)  # 6 is late, but the watermark stands at 15
    put(spark, [(7, "b", 61, at(49)), (9, "y", 1, at(100))], f"{root}/o", OBS)
    assert rows(run()) == {(1, 50), (2, 61), (3, None), (4, None), (6, None)}
    put(spark, [(7, 7, "b", at(2))], f"{root}/r", REQ)  # later than the watermark: left out
    put(spark, [(7, "b", 62, at(3)), (9, "z", 9, at(129))], f"{root}/o", OBS)
    assert rows(run()) == {(1, 50), (2, 61), (3, None), (4, None), (5, 9), (6, None)}


def test_windows_close_once_and_counters_reach_a_listener(spark):
    from pyspark.sql.streaming import StreamingQueryListener

    root, seen = tempfile.mkdtemp(prefix="spark-"), []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            seen.extend(r.asDict() for k, r in event.progress.observedMetrics.items() if k == "intake")

        def onQueryTerminated(self, event):
            pass

    kind = "action string, ts timestamp, value double"
    run = lambda: st.run_once(st.closed_metrics(st.observed(spark.readStream.schema(kind).parquet(f"{root}/in"), bad=F.col("value") < 0), late="30 minutes"), f"{root}/out").collect()
    listener = Listener()
    spark.streams.addListener(listener)
    try:
        values = [5.0, 15.0, 15.0, 25.0, 35.0, 45.0, 55.0, 65.0, 75.0, 9999.0]
        put(spark, [("a", at(i), v) for i, v in enumerate(values)] + [("a", at(80), -1.0)], f"{root}/in", kind)
        assert run() == []
        put(spark, [("a", at(30), 1.0), ("a", at(95), 3.0)], f"{root}/in", kind)  # 30 is late but its window is open
        (first,) = run()
        assert (first["n"], first["longest"], first["p50"], first["p90"], first["p99"]) == (11, 9999.0, 40.0, 80.0, 9999.0)
        put(spark, [("a", at(10), 1.0), ("a", at(200), 3.0)], f"{root}/in", kind)  # 10 is later than the watermark
        assert sorted((r["n"], r["start"].minute) for r in run()) == [(2, 0), (11, 0)]
        until = time.time() + 20
        while time.time() < until and sum(r["rows"] for r in seen) < 15:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r["rows"] for r in seen) == 15 and sum(r["bad"] for r in seen) == 1
