"""Structured Streaming forms: intake with quarantine, routing, metrics, reviews and lookup; see also ``keyed_state``.

Each builder takes a streaming DataFrame and returns one (or starts a query); batch tables work in all that keep no state.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user string, image bigint, action string, value double"


def run_once(stream: DataFrame, path: str, mode: str = "append", clock: bool = False) -> DataFrame:
    """Everything that is there now through the stream into a Parquet table at ``path``, read back.

    ``clock``: the stream has timers or state that follow the clock. Spark runs batches for these without end, so that
    the query is stopped after two without rows: the first may repeat a batch that was broken off.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}.state")
    if clock:
        query = writer.trigger(processingTime="0 seconds").start()
        try:
            while not query.awaitTermination(0.1) and [p.numInputRows for p in query.recentProgress[-2:]] != [0, 0]:
                pass
        finally:
            query.stop()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def intake(raw: DataFrame, schema: str = EVENT) -> DataFrame:
    """raw: value (JSON text) -> the event's columns, ``raw`` and ``ok``; messages that can't be parsed are kept with
    ``ok`` false, for the quarantine sink. The checkpoint takes the place of acknowledgements.
    """
    parsed = raw.select(F.col("value").alias("raw"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"))
    return parsed.select("e.*", "raw", F.coalesce(F.col("e.event_id").isNotNull() & F.col("e.ts").isNotNull(), F.lit(False)).alias("ok"))


def route(results: DataFrame) -> DataFrame:
    """results: image, status, rows (new path), legacy (fallback path): finished images with rows publish those, all
    others fall back.
    """
    new = (F.col("status") == "FINISHED") & (F.size("rows") > 0)
    return results.select("image", F.when(new, F.col("rows")).otherwise(F.col("legacy")).alias("rows"), F.when(new, "publish").otherwise("fallback").alias("branch"))


def metrics(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and durations by window and action; events later than the watermark are left out of closed windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "action")
    g = w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("longest"))
    return g.select(F.col("window.start").alias("start"), "action", "n", "total", "longest")


#: Widths of the bins of ``closed_metrics``; the last bin is open.
BIN, BINS = 10.0, 64


def closed_metrics(events: DataFrame, every: str = "1 hour", late: str = "2 hours", shares: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Counts, totals and percentiles of ``value`` by window and action, each put out once, when the watermark has passed
    the window; events later than the watermark are left out.

    Percentiles come from a histogram of BINS bins, which partial aggregates add up: the upper edge of the first bin that
    reaches the share (the greatest value seen, in the last bin). Null and negative values count in the first bin.
    """
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.coalesce("value", F.lit(0.0)) / BIN)))
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every), "action")
    w = g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("longest"), F.array(*[F.sum((bin_ == i).cast("bigint")) for i in range(BINS)]).alias("bins"))
    upto = F.transform("bins", lambda _, i: F.aggregate(F.slice("bins", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    first = lambda q: F.array_position(F.transform(upto, lambda c: c >= F.ceil(F.lit(q) * F.col("n"))), True)
    edge = lambda q: F.when(first(q) == BINS, F.col("longest")).otherwise(first(q) * BIN)
    return w.select(F.col("window.start").alias("start"), "action", "n", "total", "longest", *[edge(q).alias(f"p{round(100 * q)}") for q in shares])


def observed(events: DataFrame, name: str = "intake", **counts: Column) -> DataFrame:
    """``events`` with counters that a query listener gets after each batch: rows, and those for which each of ``counts``
    holds. Counting adds no pass over the rows."""
    return events.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def upsert_latest(log: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with each key's latest row by ``order``, of the table and the log: rows that arrived late don't replace
    later ones; a null order comes first. Other keys stay.

    The log is what a stream has appended so far (``run_once``): a batch writes its own rows only, and the merge is made
    where it is read. To shorten the log, write this table once as the next one and begin another log.
    """
    others = [c for c in log.columns if c != key]
    latest = F.max_by(F.struct(*others), F.struct(F.col(order).isNotNull(), F.col(order)))
    return table.select(*log.columns).unionByName(log).groupBy(key).agg(latest.alias("r")).select(key, "r.*").select(*log.columns)


def live_lookup(observations: DataFrame, requests: DataFrame) -> DataFrame:
    """Stream of observations (store, sku, conf, ts) met with a static table of requests (request, store, sku)."""
    return observations.join(requests, ["store", "sku"]).select("request", "store", "sku", "conf", "ts")


def _near(tracks: list[list], boxes: list[tuple], least: float) -> list[tuple[float, int, int]]:
    """(IoU, -track, -box) of the pairs at ``least`` or more, greatest first; as arrays, since few of all pairs are near."""
    if not tracks or not boxes:
        return []
    t, b = np.array([x[3:7] for x in tracks], float).T[:, :, None], np.array(boxes, float).T[:, None, :]
    w, h = np.minimum(t[2], b[2]) - np.maximum(t[0], b[0]), np.minimum(t[3], b[3]) - np.maximum(t[1], b[1])
    both = np.where((w > 0) & (h > 0), w * h, 0.0)
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    iou = np.divide(both, area(t) + area(b) - both, out=np.zeros_like(both), where=both > 0)
    i, j = np.nonzero(iou >= least)
    return sorted(zip(iou[i, j].tolist(), (-i).tolist(), (-j).tolist(), strict=True), reverse=True)


def associate(tracks: list[list], boxes: list[tuple], next_id: int, least_iou: float, max_age: int, min_hits: int) -> tuple[list[list], list[tuple], int]:
    """One frame: tracks [id, hits, misses, x1, y1, x2, y2, vx, vy] move on, take boxes greedily by IoU, age or go.

    Returns tracks, confirmed (id, box) of this frame, and the next id.
    """
    for t in tracks:
        t[3], t[4], t[5], t[6] = t[3] + t[7], t[4] + t[8], t[5] + t[7], t[6] + t[8]
    pairs = _near(tracks, boxes, least_iou)
    taken: dict[int, int] = {}
    used: set[int] = set()
    for score, i, j in pairs:
        if score >= least_iou and -i not in taken and -j not in used:
            taken[-i] = -j
            used.add(-j)
    out = []
    for i, t in enumerate(tracks):
        if i in taken:
            b = boxes[taken[i]]
            t[7], t[8] = (t[7] + b[0] - t[3]) / 2, (t[8] + b[1] - t[4]) / 2
            t[1], t[2], t[3:7] = t[1] + 1, 0, list(b)
            if t[1] >= min_hits:
                out.append((t[0], *b))
        else:
            t[2] += 1
    tracks = [t for t in tracks if t[2] <= max_age]
    for j, b in enumerate(boxes):
        if j not in used:
            tracks.append([next_id, 1, 0, *b, 0.0, 0.0])
            if min_hits <= 1:
                out.append((next_id, *b))
            next_id += 1
    return tracks, out, next_id


def lookup_streams(requests: DataFrame, observations: DataFrame, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Stream of requests (request, store, sku, ts) met with a stream of observations (store, sku, conf, ts): request,
    store, sku, ts, conf, seen for each observation of the same store and code at most ``within`` before or after.

    A request that none met is put out once, with nulls, when the watermarks (``late`` behind the latest of each stream,
    the slower one counts) say that none can come. Later rows of either stream are left out, and both sides' state goes
    as the watermarks pass it.
    """
    r = requests.withWatermark("ts", late)
    o = observations.select(F.col("store").alias("o_store"), F.col("sku").alias("o_sku"), "conf", F.col("ts").alias("seen")).withWatermark("seen", late)
    near = F.expr(f"seen >= ts - INTERVAL {within} AND seen <= ts + INTERVAL {within}")
    met = r.join(o, (F.col("store") == F.col("o_store")) & (F.col("sku") == F.col("o_sku")) & near, "left_outer")
    return met.select("request", "store", "sku", "ts", "conf", "seen")


def json_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("value string").format("text").load(path)


def to_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))
