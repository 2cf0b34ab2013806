"""Streams over the event fixtures: written as message files, read back as a stream, run until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.functions import codes
from gondola.plans import fixtures as fx
from gondola.plans.fixtures import with_tables
from gondola.plans.registry import query
from gondola.plans.review_queries import _FOLD, _QE
from gondola.sources.scratch import shared_path
from gondola.streaming import keyed_state
from gondola.streaming import shelf_streams as st


def _events(spark, sf_dir):
    e = fx.queue_events(spark, sf_dir)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user") % 7).cast("string").alias("user"), "image", "action", "value")


def _stream(spark, df, name):
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id % 7 END::VARCHAR AS user, event_id % 10 <> 0 AS ok FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT NULL, NULL, false FROM events WHERE event_id % 10 = 0")
def t1_intake(spark, sf_dir):
    message = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), F.col("event_id"))).otherwise(st.to_json("event_id", "ts", "user", "image", "action", "value"))
    path = shared_path(spark, "messages")
    _events(spark, sf_dir).select(message.alias("value")).write.text(path)
    return st.run_once(st.intake(st.json_stream(spark, path)), shared_path(spark, "intake")).select("event_id", "user", "ok")


@query(with_tables("SELECT image, CASE WHEN image % 3 <> 0 AND n > 0 THEN n ELSE 1 END AS n, CASE WHEN image % 3 <> 0 AND n > 0 THEN 'publish' ELSE 'fallback' END AS branch FROM (SELECT image, count(CASE WHEN length(text) = 10 THEN 1 END) AS n FROM words GROUP BY image)", "words"))
def t2_routing(spark, sf_dir):
    w = fx.words(spark, sf_dir).groupBy("image").agg(F.collect_list(F.when(F.length("text") == 10, F.col("text"))).alias("rows"))
    r = w.select("image", F.when(F.col("image") % 3 != 0, "FINISHED").otherwise("FAILED").alias("status"), "rows", F.array(F.lit("legacy")).alias("legacy"))
    out = st.run_once(st.route(_stream(spark, r, "results")), shared_path(spark, "routed"))
    return out.select("image", F.size("rows").alias("n"), "branch")


@query("""SELECT date_trunc('hour', ts) AS start, CASE event_type WHEN 'click' THEN 'label' WHEN 'purchase' THEN 'relabel' WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'recycle' ELSE 'assign' END AS action, count(*) AS n, round(max(value), 6) AS longest FROM events GROUP BY ALL""")
def t3_windowed_metrics(spark, sf_dir):
    m = st.metrics(_stream(spark, _events(spark, sf_dir), "events"), late="0 seconds")
    path = shared_path(spark, "metrics")
    q = m.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(m.schema).parquet(path).select("start", "action", "n", F.round("longest", 6).alias("longest"))


_ACTION = "CASE event_type WHEN 'click' THEN 'label' WHEN 'purchase' THEN 'relabel' WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'recycle' ELSE 'assign' END"


@query(f"""WITH e AS (SELECT date_trunc('hour', ts) AS start, {_ACTION} AS action, value, greatest(0, least(63, floor(value / 10))) AS bin FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)),
  w AS (SELECT start, action, count(*) AS n, max(value) AS longest FROM e GROUP BY ALL), b AS (SELECT start, action, bin, sum(count(*)) OVER (PARTITION BY start, action ORDER BY bin) AS upto FROM e GROUP BY start, action, bin),
  f AS (SELECT start, action, any_value(n) AS n, any_value(longest) AS longest, min(CASE WHEN upto >= ceil(0.5 * n) THEN bin END) AS a, min(CASE WHEN upto >= ceil(0.9 * n) THEN bin END) AS b, min(CASE WHEN upto >= ceil(0.99 * n) THEN bin END) AS c FROM w JOIN b USING (start, action) GROUP BY start, action)
  SELECT start, action, n, round(longest, 6) AS longest, {', '.join(f"round(CASE WHEN {x} = 63 THEN longest ELSE ({x} + 1) * 10.0 END, 6)::DOUBLE AS {p}" for x, p in (("a", "p50"), ("b", "p90"), ("c", "p99")))} FROM f""")
def t3_closed_windows(spark, sf_dir):
    """Windows that the watermark has passed, each once, with percentiles from a histogram."""
    m = st.closed_metrics(_stream(spark, _events(spark, sf_dir), "events"), late="0 seconds")
    return st.run_once(m, shared_path(spark, "closed")).select("start", "action", "n", *[F.round(c, 6).alias(c) for c in ("longest", "p50", "p90", "p99")])


@query(with_tables('SELECT image, status, "user", label, "by", labels FROM st', "queue_events", more=_QE + "," + _FOLD))
def t5_queue_stream(spark, sf_dir):
    changes = keyed_state.queue_changes(_stream(spark, _events(spark, sf_dir), "queue"))
    return keyed_state.queue_now(st.run_once(changes, shared_path(spark, "queue"), clock=True)).select("image", "status", "user", "label", "by", "labels")


@query(with_tables("SELECT image, CASE WHEN stale THEN 'unassigned' ELSE status END AS status, CASE WHEN NOT stale THEN \"user\" END AS \"user\", labels, stale AS released FROM (SELECT *, status = 'assigned' AND st.\"at\" < (SELECT max(ts) FROM queue_events) - INTERVAL 20 MINUTE AS stale FROM st)", "queue_events", more=_QE + "," + _FOLD))
def t4_stale_release_stream(spark, sf_dir):
    """Timers by event time: once the watermark is past, assignments of more than 20 minutes are released without an event."""
    changes = keyed_state.queue_changes(_stream(spark, _events(spark, sf_dir), "queue"), stale_minutes=20, by_event_time=True, late="0 seconds")
    done = st.run_once(changes, shared_path(spark, "queue"))
    released = done.groupBy("image").agg(F.max_by(F.col("cause") == "timeout", "changes").alias("released"))
    return keyed_state.queue_now(done).join(released, "image").select("image", "status", "user", "labels", "released")


@query(with_tables("SELECT image, arg_max(user % 7, struct_pack(t := ts, e := event_id))::VARCHAR AS reviewer, count(*) > 0 AS touched FROM queue_events WHERE action = 'label' GROUP BY image UNION ALL SELECT image, 'none', false FROM (SELECT DISTINCT image FROM queue_events) WHERE image NOT IN (SELECT image FROM queue_events WHERE action = 'label')", "queue_events"))
def t6_t8_review_merge(spark, sf_dir):
    """A stream of reviews merged into a table with a row for each image."""
    e = _events(spark, sf_dir)
    table = e.select("image").distinct().select("image", F.lit("none").alias("reviewer"), F.lit(False).alias("touched"), F.lit(None).cast("struct<ts:timestamp,event_id:bigint>").alias("at"))

    reviews = _stream(spark, e, "reviews").where("action = 'label'").select("image", F.col("user").alias("reviewer"), F.lit(True).alias("touched"), F.struct("ts", "event_id").alias("at"))
    return st.upsert_latest(st.run_once(reviews, shared_path(spark, "review-log")), table, "image", "at").select("image", "reviewer", "touched")


@query(with_tables("SELECT r.request, count(*) AS n, max(o.conf) AS best FROM (SELECT l_orderkey * 10 + l_linenumber AS request, store, sku_text FROM observations WHERE (l_orderkey + l_linenumber) % 50 = 0 AND NOT starts_with(sku_text, 'bad')) r JOIN observations o ON r.store = o.store AND r.sku_text = o.sku_text GROUP BY r.request", "observations"))
def t7_live_lookup(spark, sf_dir):
    o = fx.observations(spark, sf_dir).withColumn("sku", codes.published_sku(F.col("sku_text"))).where("NOT startswith(sku_text, 'bad')")
    r = o.where("(l_orderkey + l_linenumber) % 50 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), "store", "sku")
    found = st.run_once(st.live_lookup(_stream(spark, o.select("store", "sku", "conf", "ts"), "observations"), r), shared_path(spark, "found"))
    return found.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("best"))


@query(with_tables("""SELECT request, store, sku, ts, conf, seen FROM (SELECT r.*, o.conf, o.seen FROM r LEFT JOIN o ON r.store = o.store AND r.sku = o.sku AND o.seen BETWEEN r.ts - INTERVAL 30 DAY AND r.ts + INTERVAL 30 DAY)
  WHERE seen IS NOT NULL OR ts + INTERVAL 30 DAY < least((SELECT max(ts) FROM r), (SELECT max(seen) FROM o)) - INTERVAL 1 HOUR""", "observations", more="""o AS (SELECT store, sku_text AS sku, conf, ts::TIMESTAMP AS seen FROM observations WHERE NOT starts_with(sku_text, 'bad')),
  r AS (SELECT l_orderkey * 10 + l_linenumber AS request, (store + 1) % 20 AS store, sku_text AS sku, ts::TIMESTAMP AS ts FROM observations WHERE NOT starts_with(sku_text, 'bad') AND (l_orderkey + l_linenumber) % 3 = 0)"""))
def t7_lookup_streams(spark, sf_dir):
    """Two streams: requests wait thirty days for an observation, then they are put out without one."""
    o = fx.observations(spark, sf_dir).where("NOT startswith(sku_text, 'bad')").select("store", F.col("sku_text").alias("sku"), "conf", F.col("ts").cast("timestamp").alias("ts"), "l_orderkey", "l_linenumber")
    r = o.where("(l_orderkey + l_linenumber) % 3 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), ((F.col("store") + 1) % 20).alias("store"), "sku", "ts")
    met = st.lookup_streams(_stream(spark, r, "requests"), _stream(spark, o.drop("l_orderkey", "l_linenumber"), "observations"), "30 days")
    return st.run_once(met, shared_path(spark, "met"))


@query()
def j22_tracking(spark, sf_dir):
    """Images as frames, fifty a camera, so that cameras grow with the table: ids that live on from frame to frame."""
    p = fx.pred_boxes(spark, sf_dir).select(F.expr("image div 50").alias("camera"), (F.col("image") % 50).alias("frame"), "det", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return st.run_once(keyed_state.track(_stream(spark, p, "frames")), shared_path(spark, "tracks"))
