"""Planogram and layout operators over the fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gondola.functions import codes
from gondola.operators import planogram
from gondola.plans import fixtures as fx
from gondola.plans.fixtures import with_tables
from gondola.plans.registry import query

_R = lambda c: F.round(c, 6)


def _labels(spark, sf_dir):
    """Taller images: the box's row of four is lifted by 90 pixels for every eighth detection."""
    lift = F.expr("(det div 8) * 90").cast("bigint")
    return fx.pred_boxes(spark, sf_dir).select("image", F.col("det").alias("label"), "x1", (F.col("y1") + lift).alias("y1"), "x2", (F.col("y2") + lift).alias("y2"), "conf")


_LABELS = "lab AS (SELECT image, det AS label, x1, y1 + (det // 8) * 90 AS y1, x2, y2 + (det // 8) * 90 AS y2, conf FROM pred_boxes)"


@query(with_tables("""SELECT image, label, shelf_row, row_number() OVER (PARTITION BY image, shelf_row ORDER BY x1, label) AS place FROM (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY cy, label) AS shelf_row FROM (
  SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY image ORDER BY cy, label) >= 20 THEN 1 ELSE 0 END AS new FROM (SELECT *, (y1 + y2) / 2 AS cy FROM lab)))""", "pred_boxes", more=_LABELS))
def w1_rows_by_gap(spark, sf_dir):
    return planogram.rows_by_gap(_labels(spark, sf_dir), 20.0).select("image", "label", "shelf_row", "place")


@query(with_tables("""SELECT image, o.label AS label, o.row AS shelf_row FROM (SELECT image, unnest(r.o) AS o FROM (SELECT image, list_reduce(list({'first': y1, 'n': 0, 'o': [{'label': label, 'row': 0}]} ORDER BY y1, label),
  lambda a, x: CASE WHEN x.first - a.first >= 150 THEN {'first': x.first, 'n': a.n + 1, 'o': a.o || [{'label': x.o[1].label, 'row': a.n + 1}]} ELSE {'first': a.first, 'n': a.n, 'o': a.o || [{'label': x.o[1].label, 'row': a.n}]} END) AS r FROM lab GROUP BY image))""", "pred_boxes", more=_LABELS))
def w2_rows_by_anchor(spark, sf_dir):
    return planogram.rows_by_anchor(_labels(spark, sf_dir))


@query(with_tables("""SELECT image, det, "group", slot, max(y2 - y1) OVER g AS strip_h, max(x2 - x1) OVER g AS slot_w, coalesce(sum(x2 - x1 + 10) OVER (PARTITION BY image, "group" ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
  FROM (SELECT *, (det - 1) // 5 AS "group", (det - 1) % 5 AS slot FROM pred_boxes) WINDOW g AS (PARTITION BY image, "group")""", "pred_boxes"))
def w3_w11_strips(spark, sf_dir):
    return planogram.strips(fx.pred_boxes(spark, sf_dir))


@query(with_tables("""SELECT e.bay, coalesce(have, 0) < greatest(n, 1) OR coalesce(hole, false) AS refresh FROM (SELECT p_brand AS bay, count(*) - 1 AS n FROM part GROUP BY p_brand) e LEFT JOIN (
  SELECT bay, count(*) AS have, bool_or(coalesce(gap > 1, false)) AS hole FROM (SELECT bay, lead(loc) OVER (PARTITION BY bay ORDER BY loc) - loc AS gap FROM sequence) GROUP BY bay) s ON e.bay = s.bay""", "sequence"))
def w7_freshness(spark, sf_dir):
    expected = fx.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("bay")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return planogram.needs_refresh(fx.sequence(spark, sf_dir).select("bay", "loc"), expected)


@query(with_tables("SELECT image, det, row_number() OVER (PARTITION BY image ORDER BY y1, x1, det) - 1 AS flat FROM pred_boxes", "pred_boxes"))
def w8_l3_reading_order(spark, sf_dir):
    return fx.pred_boxes(spark, sf_dir).select("image", "det", (F.row_number().over(Window.partitionBy("image").orderBy("y1", "x1", "det")) - 1).alias("flat"))


_KEY = "CASE WHEN price >= 1 THEN trunc(price)::INT ELSE round_even(price * 100, 0)::INT END"
_SEEDS = f"""
  ck AS (SELECT bay, pos, {_KEY} AS key FROM price_cells WHERE price IS NOT NULL), sk AS (SELECT bay, loc, {_KEY} AS key FROM sequence),
  cl AS (SELECT bay, list(pos ORDER BY pos) AS ps, list(key ORDER BY pos) AS ks FROM ck GROUP BY bay),
  gr AS (SELECT bay, n, ps[i : i + n - 1] AS positions, ks[i : i + n - 1] AS keys FROM (SELECT bay, ps, ks, unnest(range(1, len(ps) + 1)) AS i FROM cl), (SELECT unnest(range(3, 9)) AS n) WHERE i + n - 1 <= len(ps)),
  sl AS (SELECT bay, list(loc ORDER BY loc) AS ps, list(key ORDER BY loc) AS ks FROM sk GROUP BY bay),
  pl AS (SELECT bay, n, ps[i] AS loc, ks[i : i + n - 1] AS keys FROM (SELECT bay, ps, ks, unnest(range(1, len(ps) + 1)) AS i FROM sl), (SELECT unnest(range(3, 9)) AS n) WHERE i + n - 1 <= len(ps) AND ps[i + n - 1] = ps[i] + n - 1)"""


def _priced(spark, sf_dir):
    cells = fx.price_cells(spark, sf_dir).where("price IS NOT NULL").select("bay", "pos", codes.price_key(F.col("price")).alias("key"))
    plan = fx.sequence(spark, sf_dir).select("bay", "loc", codes.price_key(F.col("price")).alias("key"))
    return cells, plan


@query(with_tables("SELECT gr.bay, round(0.7 * gr.n / 8 + 0.3 * len(list_distinct(gr.keys)) / gr.n, 6) AS score, gr.n, array_to_string(positions, ',') AS positions, pl.loc FROM gr JOIN pl ON gr.bay = pl.bay AND gr.keys = pl.keys WHERE len(list_distinct(gr.keys)) >= 2", "price_cells", more=_SEEDS))
def q9_planogram_seeds(spark, sf_dir):
    return planogram.seed_matches(*_priced(spark, sf_dir)).select("bay", _R("score").alias("score"), "n", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), "loc")


@query(with_tables("""SELECT bay, o.p AS pos, o.l AS loc FROM (SELECT bay, unnest(list_transform(range(1, len(r.p) + 1), lambda i: {'p': r.p[i], 'l': r.l[i]})) AS o FROM (SELECT bay, list_reduce(l, lambda a, x: CASE WHEN list_has_any(a.p, x.p) OR list_has_any(a.l, x.l) THEN a ELSE {'p': a.p || x.p, 'l': a.l || x.l} END) AS r
  FROM (SELECT gr.bay, list({'p': positions, 'l': range(pl.loc, pl.loc + gr.n)} ORDER BY round(0.7 * gr.n / 8 + 0.3 * len(list_distinct(gr.keys)) / gr.n, 9) DESC, list_transform(positions, lambda v: -v), pl.loc DESC) AS l FROM gr JOIN pl ON gr.bay = pl.bay AND gr.keys = pl.keys WHERE len(list_distinct(gr.keys)) >= 2 GROUP BY gr.bay)))""", "price_cells", more=_SEEDS))
def q9_placed_seeds(spark, sf_dir):
    return planogram.place_seeds(*_priced(spark, sf_dir))


def _ladder(a, b):
    return f"""CASE WHEN {a} = 0 THEN 0.3 WHEN trunc({a}) = trunc({b}) THEN 1.0 WHEN contains(trunc({a})::INT::VARCHAR, trunc({b})::INT::VARCHAR) OR contains(trunc({b})::INT::VARCHAR, trunc({a})::INT::VARCHAR) THEN 0.7
      WHEN abs({a} - {b}) <= 0.1 THEN 0.9 WHEN abs({a} - {b}) <= 0.5 THEN 0.6 WHEN abs({a} - {b}) <= 1 THEN 0.5 ELSE -1.0 END"""


@query(with_tables(f"""SELECT bay, start, length, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY bay ORDER BY length DESC, start) AS rn FROM (SELECT bay, start, count(*) AS length, avg(s) AS score FROM (
    SELECT *, min(s) OVER w AS low, count(*) OVER w AS n FROM (SELECT c.bay, c.i, s.loc - c.i AS start, {_ladder('c.price', 's.price')} AS s FROM ci c JOIN sequence s ON c.bay = s.bay AND s.loc - c.i IN (SELECT loc FROM sequence q WHERE q.bay = c.bay)) WINDOW w AS (PARTITION BY bay, start ORDER BY i ROWS UNBOUNDED PRECEDING))
    WHERE low >= 0 AND n = i + 1 GROUP BY bay, start) WHERE length >= 3 AND score >= 0.5) WHERE rn = 1""", "price_cells", more="ci AS (SELECT bay, pos, price, row_number() OVER (PARTITION BY bay ORDER BY pos) - 1 AS i FROM price_cells WHERE price IS NOT NULL)"))
def q10_greedy_start(spark, sf_dir):
    c = fx.price_cells(spark, sf_dir).where("price IS NOT NULL")
    c = c.select("bay", "pos", "price", (F.row_number().over(Window.partitionBy("bay").orderBy("pos")) - 1).alias("i"))
    return planogram.greedy_start(c, fx.sequence(spark, sf_dir), codes.price_similarity).withColumn("score", _R("score"))


def _aligned(spark, sf_dir):
    return planogram.fill_alignment(fx.price_cells(spark, sf_dir).select("bay", "pos", "price"), planogram.place_seeds(*_priced(spark, sf_dir)), fx.sequence(spark, sf_dir).select("bay", "loc", "sku", "price"))


@query()
def q11_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query()
def q12_full_grid(spark, sf_dir):
    """Every cell with its product or "No Match"; blank cells are overwritten as empty."""
    cells = fx.price_cells(spark, sf_dir).select("bay", "pos", "price")
    met = cells.join(_aligned(spark, sf_dir), ["bay", "pos"], "left")
    state = F.when(F.col("price").isNull(), "EMPTY").when(F.col("sku").isNull(), "No Match").otherwise("matched")
    return met.select("bay", "pos", state.alias("state"), F.coalesce("sku", F.lit("No Match")).alias("sku"), "loc")


_SPOTS = """
  sc AS (SELECT bay, pos // 10 AS shelf_row, pos % 10 AS col, pos % 9 = 4 AS empty, floor(price) AS price, floor(price)::INT AS d FROM price_cells),
  sw AS (SELECT *, list(d) OVER (PARTITION BY bay, shelf_row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS core, list(d) OVER (PARTITION BY bay, shelf_row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS wide,
    max(col) OVER (PARTITION BY bay, shelf_row) AS lc, max(shelf_row) OVER (PARTITION BY bay) AS lr FROM sc),
  sp AS (SELECT bay, shelf_row, col, d, shelf_row = 0 OR shelf_row = lr OR col = 0 OR col = lc AS edge, least(5, greatest(3, least(col + 3, lc - col + 2))) AS size, list_filter(core, lambda v: v IS NOT NULL) AS core, list_filter(wide, lambda v: v IS NOT NULL) AS wide FROM sw WHERE empty AND price IS NOT NULL),
  ss AS (SELECT *, len(list_filter(core, lambda v: v = d)) / len(core) AS a, CASE WHEN size > 3 THEN 0.5 * len(list_filter(wide, lambda v: v = d)) / len(wide) ELSE 0 END AS b FROM sp),
  sr AS (SELECT bay, shelf_row, col, sku, loc, round(CASE WHEN edge THEN a * 0.8 + b * 0.15 + 0.05 ELSE a * 0.7 + b * 0.2 + 0.1 END, 9) AS score FROM ss JOIN (SELECT bay, loc, sku, floor(price)::INT AS d FROM sequence) USING (bay, d))"""


@query(with_tables("SELECT bay, shelf_row, col, sku, loc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY bay, shelf_row, col ORDER BY score DESC, loc, sku) AS rn FROM sr WHERE score >= 0.3) WHERE rn = 1", "price_cells", more=_SPOTS))
def q13_empty_spots(spark, sf_dir):
    c = fx.price_cells(spark, sf_dir).select("bay", F.expr("pos div 10").alias("shelf_row"), (F.col("pos") % 10).alias("col"), (F.col("pos") % 9 == 4).alias("empty"), F.floor("price").cast("double").alias("price"))
    return planogram.empty_candidates(c, fx.sequence(spark, sf_dir).select("bay", "loc", "sku", F.floor("price").cast("double").alias("price")), 0.3).withColumn("score", _R("score"))


@query(with_tables("SELECT bay AS store, pos, '0000' || sku AS sku FROM price_cells WHERE price IS NULL", "price_cells"))
def q14_missing_requests(spark, sf_dir):
    return fx.price_cells(spark, sf_dir).where("price IS NULL").select(F.col("bay").alias("store"), "pos", codes.published_sku(F.col("sku")).alias("sku"))


@query(with_tables("""SELECT image, label, shelf, how, row_number() OVER (PARTITION BY image, shelf ORDER BY x1, label) AS place FROM (SELECT l.image, l.label, l.x1, s.shelf, CASE WHEN s.shelf IS NULL THEN 'none' WHEN s.inter > 0 THEN 'overlap' ELSE 'nearest' END AS how FROM lab l LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY inter = 0, -inter, CASE WHEN inter > 0 THEN 0 ELSE away END, top, shelf) AS rn FROM (SELECT a.image, a.label, b.shelf, b.y1 AS top, sqrt(((a.x1 + a.x2) / 2 - 130) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) AS away,
     greatest(0, least(a.x2, 230) - greatest(a.x1, 30)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter FROM lab a JOIN shl b ON a.image = b.image) WHERE inter > 0 OR away < 300) WHERE rn = 1) s ON l.image = s.image AND l.label = s.label)""", "pred_boxes", more=_LABELS + ", shl AS (SELECT image, k AS shelf, k * 120 AS y1, k * 120 + 60 AS y2 FROM (SELECT DISTINCT image FROM pred_boxes), (SELECT unnest(range(0, 3)) AS k))"))
def j12_labels_to_shelves(spark, sf_dir):
    lab = _labels(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    shelves = lab.select("image").distinct().select("image", k.alias("shelf")).select("image", "shelf", F.lit(30).alias("x1"), (F.col("shelf") * 120).alias("y1"), F.lit(230).alias("x2"), (F.col("shelf") * 120 + 60).alias("y2"))
    return planogram.labels_to_shelves(lab, shelves)


@query(with_tables("SELECT bay, count(*) AS cells, count(price) AS priced, round(count(price) / count(*), 6) AS coverage, sum(CASE WHEN abs(price - round(price)) > 0.01 THEN 1 ELSE 0 END) AS odd_cents, sum(CASE WHEN loc - pos <> 1 THEN 1 ELSE 0 END) AS moved FROM price_cells GROUP BY bay", "price_cells"))
def a21_a22_grid_statistics(spark, sf_dir):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return fx.price_cells(spark, sf_dir).groupBy("bay").agg(F.count(F.lit(1)).alias("cells"), F.count("price").alias("priced"), _R(F.count("price") / F.count(F.lit(1))).alias("coverage"), n(F.abs(F.col("price") - F.round("price")) > 0.01).alias("odd_cents"), n(F.col("loc") - F.col("pos") != 1).alias("moved"))


@query(with_tables("SELECT bay, pos, array_to_string(list(trunc(price)::INT) FILTER (WHERE price IS NOT NULL) OVER (PARTITION BY bay ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS pattern FROM price_cells", "price_cells"))
def w12_pattern_windows(spark, sf_dir):
    w = Window.partitionBy("bay").orderBy("pos").rowsBetween(-2, 2)
    return fx.price_cells(spark, sf_dir).select("bay", "pos", F.array_join(F.collect_list(F.col("price").cast("int").cast("string")).over(w), ",").alias("pattern"))
