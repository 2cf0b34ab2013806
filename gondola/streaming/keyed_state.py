"""Streams with keyed, timed state: the annotation queue with release of stale assignments, and frame-to-frame tracking.

State lives in Spark's RocksDB state store, whose checkpoints lie in the stream's checkpoint folder: a batch writes what
changed, a restart goes on from the last batch, and nothing of it passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from gondola.streaming.shelf_streams import associate

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs a store with column families; the session's setting counts when a query starts."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, None) or ""):
        spark.conf.set(PROVIDER, ROCKS)


# ---- the annotation queue


class Item(NamedTuple):
    """What the queue knows of an image. ``changes`` counts the rows that were put out for it, ``due`` is its timer."""

    status: str = "unassigned"
    user: str | None = None
    label: str | None = None
    by: str | None = None
    at: object = None
    labels: int = 0
    changes: int = 0
    due: int | None = None


ITEM = "status string, user string, label string, by string, at timestamp, labels int, changes bigint, due bigint"
CHANGE = "image bigint, status string, user string, label string, by string, at timestamp, labels int, changes bigint, cause string"


def act(item: Item, action: str, user: str | None, ts: object, label: str) -> Item:
    """The item after an event; events that its state or its owner doesn't allow change nothing.

    The same steps as ``operators.review.queue_step``, which folds events that are all at hand.
    """
    holds = item.status == "assigned" and item.user == user
    made = item.status == "done" and item.by == user
    if action == "assign" and item.status == "unassigned":
        return item._replace(status="assigned", user=user, at=ts)
    if action == "label" and holds or action == "relabel" and made:
        return item._replace(status="done", user=None, label=label, by=user, at=ts, labels=item.labels + 1)
    if action == "skip" and (holds or made):
        return item._replace(status="skipped", user=None, at=ts)
    if action == "release" and holds or action == "recycle" and item.status == "skipped":
        return item._replace(status="unassigned", user=None, at=ts)
    return item


class Queue(StatefulProcessor):
    """An image's events in order of (ts, event_id) within a batch, upon what earlier batches left of it.

    An assignment sets a timer; when it fires first, the image is free again. ``by_event_time``: timers follow the
    watermark and count from the assignment's own time; else the clock, and count from when the event is handled.
    """

    def __init__(self, stale_minutes: float | None, by_event_time: bool):
        self.stale_ms = None if stale_minutes is None else int(stale_minutes * 60_000)
        self.by_event_time = by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", ITEM)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = item = self._get()
        for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            item = act(item, r["action"], r["user"], r["ts"], f"L{r['event_id']}")
        if (item.status, item.user, item.at) != (before.status, before.user, before.at):
            item = self._timed(item, timerValues)
        yield self._put(key, item, "event")

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        item = self._get()
        if item.status == "assigned" and item.due == expiredTimerInfo.getExpiryTimeInMs():
            yield self._put(key, item._replace(status="unassigned", user=None, due=None), "timeout")

    def close(self) -> None:
        pass

    def _get(self) -> Item:
        return Item(*self.item.get()) if self.item.exists() else Item()

    def _put(self, key, item: Item, cause: str) -> Row:
        item = item._replace(changes=item.changes + 1)
        self.item.update(tuple(item))
        return Row(image=key[0], **{k: v for k, v in item._asdict().items() if k != "due"}, cause=cause)

    def _timed(self, item: Item, timers: TimerValues) -> Item:
        if item.due is not None:
            self.handle.deleteTimer(item.due)
        if item.status != "assigned" or self.stale_ms is None:
            return item._replace(due=None)
        start = int(item.at.timestamp() * 1000) if self.by_event_time else timers.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(start + self.stale_ms)
        return item._replace(due=start + self.stale_ms)


def queue_changes(events: DataFrame, stale_minutes: float | None = 20, by_event_time: bool = False, late: str = "1 hour") -> DataFrame:
    """events: image, user, action, ts, event_id -> a row for each image and batch that touches it, and for each stale
    assignment that a timer releases: the image's state, ``changes`` (1, 2, ...) and ``cause`` (event or timeout).

    A batch's events of an image are in a task's memory; what arrives in a later batch is applied on top, whatever its
    time. By event time, events later than the watermark (``late``) are left out.
    """
    use_state_store(events.sparkSession)
    some = events.select("image", F.col("user").cast("string").alias("user"), "action", "ts", "event_id")
    if by_event_time:
        some = some.withWatermark("ts", late)
    return some.groupBy("image").transformWithState(Queue(stale_minutes, by_event_time), CHANGE, "Append", "EventTime" if by_event_time else "ProcessingTime")


def queue_now(changes: DataFrame) -> DataFrame:
    """The state of each image after the ``queue_changes`` written so far."""
    others = [c for c in changes.columns if c not in ("image", "changes", "cause")]
    return changes.groupBy("image").agg(F.max_by(F.struct(*others), "changes").alias("s")).select("image", "s.*")


# ---- tracking

TRACK = "id bigint, hits int, misses int, x1 double, y1 double, x2 double, y2 double, vx double, vy double"
TRACKED = "camera bigint, frame bigint, track bigint, x1 double, y1 double, x2 double, y2 double"
BOXES = "boxes array<struct<det:bigint,x1:double,y1:double,x2:double,y2:double>>"
CHUNK = 4096


class Tracker(StatefulProcessor):
    """A camera's live tracks as list state, its next id as value state; where a batch brings
    more than a chunk of boxes, they wait in map state by frame until the last one is in, so that frames pass in order and a
    task holds one frame and two chunks of boxes.
    """

    def __init__(self, least_iou: float, max_age: int, min_hits: int, ttl_minutes: float | None):
        self.least_iou, self.max_age, self.min_hits = least_iou, max_age, min_hits
        self.ttl_ms = None if ttl_minutes is None else int(ttl_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getListState("tracks", TRACK, self.ttl_ms)
        self.next_id = handle.getValueState("next_id", "id bigint")
        self.waiting = handle.getMapState("waiting", "frame bigint", BOXES)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        tracks = [list(t) for t in self.tracks.get()] if self.tracks.exists() else []
        next_id = self.next_id.get()[0] if self.next_id.exists() else 1
        for frame, boxes in self._frames(rows):
            tracks, found, next_id = associate(tracks, boxes, next_id, self.least_iou, self.max_age, self.min_hits)
            for track, *box in found:
                yield Row(camera=key[0], frame=frame, track=int(track), **dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)))
        self.next_id.update((next_id,))
        if tracks:
            self.tracks.put([(*map(int, t[:3]), *map(float, t[3:])) for t in tracks])
        else:
            self.tracks.clear()

    def _frames(self, rows: Iterator[Row]) -> Iterator[tuple[int, list[tuple]]]:
        """Frames in order with their boxes in order; the state isn't touched for what fits into one chunk."""
        chunk, waits = list(islice(rows, CHUNK)), False
        while chunk:
            frames: dict[int, list[tuple]] = {}
            for r in chunk:
                frames.setdefault(r["frame"], []).append((r["det"], r["x1"], r["y1"], r["x2"], r["y2"]))
            chunk = list(islice(rows, CHUNK))
            if not chunk and not waits:
                for frame in sorted(frames):
                    yield frame, [b[1:] for b in sorted(frames[frame])]
                return
            waits = True
            for frame, boxes in frames.items():
                earlier = self.waiting.getValue((frame,))[0] if self.waiting.containsKey((frame,)) else []
                self.waiting.updateValue((frame,), ([*map(tuple, earlier), *boxes],))
        if waits:
            for frame in sorted(k[0] for k in self.waiting.keys()):
                yield frame, [tuple(b)[1:] for b in sorted(map(tuple, self.waiting.getValue((frame,))[0]))]
            self.waiting.clear()

    def close(self) -> None:
        pass


def track(boxes: DataFrame, least_iou: float = 0.3, max_age: int = 2, min_hits: int = 1, ttl_minutes: float | None = None) -> DataFrame:
    """boxes: camera, frame, det, x1, y1, x2, y2 -> camera, frame, track and box for the boxes of confirmed tracks.

    Constant velocity and greedy association by IoU (ties: older track, then earlier box). Batches bring a camera's
    frames in order and whole. ``ttl_minutes``: a camera that is silent for so long loses its tracks, but no id is used
    twice.
    """
    use_state_store(boxes.sparkSession)
    some = boxes.select("camera", "frame", F.col("det").cast("bigint").alias("det"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return some.groupBy("camera").transformWithState(Tracker(least_iou, max_age, min_hits, ttl_minutes), TRACKED, "Append", "None" if ttl_minutes is None else "ProcessingTime")
