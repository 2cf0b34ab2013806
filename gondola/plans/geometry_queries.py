"""Geometry functions over the box fixtures."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gondola.functions import boxes as bx
from gondola.functions.boxes import Box
from gondola.plans import fixtures as fx
from gondola.plans.fixtures import with_tables
from gondola.plans.registry import query

_PAIR = """
  p AS (SELECT p.image, p.det, p.x1, p.y1, p.x2, p.y2, p.conf, p.cls, g.gt, g.x1 AS a1, g.y1 AS b1, g.x2 AS a2, g.y2 AS b2
        FROM pred_boxes p JOIN gt_boxes g ON p.image = g.image AND p.det = g.gt),
  i AS (SELECT *, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS inter,
        (x2 - x1) * (y2 - y1) AS pa, (a2 - a1) * (b2 - b1) AS ga FROM p)"""


def _pairs(spark, sf_dir):
    """Each prediction beside the ground truth that was derived from it; boxes without prefix and with g_."""
    g = fx.gt_boxes(spark, sf_dir).select("image", F.col("gt").alias("det"), *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    return fx.pred_boxes(spark, sf_dir).join(g, ["image", "det"])


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


@query(with_tables("SELECT image, det, pa AS area, ga AS g_area, inter AS intersection, round(inter / (pa + ga - inter), 6) AS iou, round(inter / ga, 6) AS coverage, round(inter / pa, 6) AS ioa FROM i", "pred_boxes", "gt_boxes", more=_PAIR))
def g3_g4_overlap(spark, sf_dir):
    a, b = Box.of(), Box.of("g_")
    return _pairs(spark, sf_dir).select("image", "det", a.area.alias("area"), b.area.alias("g_area"), bx.intersection(a, b).alias("intersection"), _r(bx.iou(a, b)).alias("iou"), _r(bx.coverage(b, a)).alias("coverage"), _r(bx.coverage(a, b)).alias("ioa"))


_FAMILY = """
  f AS (SELECT *, pa + ga - inter + 1e-9 AS uni, greatest(x2, a2) - least(x1, a1) AS cw, greatest(y2, b2) - least(y1, b1) AS ch,
        ((a1 + a2 - x1 - x2) ** 2 + (b1 + b2 - y1 - y2) ** 2) / 4.0 AS away,
        4 / pi() ** 2 * (atan((a2 - a1) / ((b2 - b1) + 1e-9)) - atan((x2 - x1) / ((y2 - y1) + 1e-9))) ** 2 AS v FROM i),
  h AS (SELECT *, inter / uni AS io, cw * ch + 1e-9 AS hull, cw * cw + ch * ch + 1e-9 AS diag FROM f)"""


@query(with_tables("""SELECT image, det, round(io - (hull - uni) / hull, 6) AS giou, round(io - away / diag, 6) AS diou, round(io - (away / diag + v * (v / (v - io + 1 + 1e-9))), 6) AS ciou,
  round(least(x2 - x1, a2 - a1) * least(y2 - y1, b2 - b1) / (pa + ga - least(x2 - x1, a2 - a1) * least(y2 - y1, b2 - b1)), 6) AS wh_iou FROM h""", "pred_boxes", "gt_boxes", more=_PAIR + "," + _FAMILY))
def g13_iou_variants(spark, sf_dir):
    a, b = Box.of(), Box.of("g_")
    family = [_r(v).alias(k) for k, v in bx.iou_family(a, b).items()]
    return _pairs(spark, sf_dir).select("image", "det", *family, _r(bx.wh_iou(a.w, a.h, b.w, b.h)).alias("wh_iou"))


@query(with_tables("""
  SELECT image, det, x2 >= x1 AND y2 >= y1 AS ok, x2 - x1 > 30 AND y2 - y1 > 25 AS large, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy,
    (x1 + x2) / 2 >= 60 AND (x1 + x2) / 2 < 120 AND (y1 + y2) / 2 >= 20 AND (y1 + y2) / 2 < 50 AS half_open, (x1 + x2) / 2 >= 60 AND (x1 + x2) / 2 <= 120 AND (y1 + y2) / 2 >= 20 AND (y1 + y2) / 2 <= 50 AS closed,
    greatest(0, x1 - trunc((x2 - x1) * 0.12)::INT) AS bx1, greatest(0, y1 - trunc((y2 - y1) * 0.12)::INT) AS by1, least(220, x2 + trunc((x2 - x1) * 0.12)::INT) AS bx2, least(90, y2 + trunc((y2 - y1) * 0.12)::INT) AS by2,
    x1 - 5 AS px1, y2 + 5 AS py2, greatest(0, x1 - 300) AS ux1, x2 - 300 AS ux2,
    round(x1 + (x2 - x1) * 0.1, 6) AS sx1, round(y2 - (y2 - y1) * 0.1, 6) AS sy2,
    greatest(0, round_even((x1 + x2) / 2 - (x2 - x1) * 1.5 / 2 - 3, 0)::INT) AS ex1, least(220, round_even((x1 + x2) / 2 + (x2 - x1) * 1.5 / 2 + 3, 0)::INT) AS ex2,
    CASE WHEN (y1 + y2) / 2 < 45 THEN 'top' ELSE 'bottom' END || '_' || CASE WHEN (x1 + x2) / 2 < 110 THEN 'left' ELSE 'right' END AS quadrant,
    (round_even((x1 + x2) / 2 / 25.0, 0) * 25)::BIGINT AS x_bin, 220 - x2 AS tx1, 90 - y1 AS ty2
  FROM pred_boxes""", "pred_boxes"))
def g1_g10_box_functions(spark, sf_dir):
    b, w, h = Box.of(), F.lit(220), F.lit(90)
    buf, padded, un, small, big, turned = bx.buffer(b, w, h, 0.12), bx.pad(b, 5), bx.unpad(b, 300), bx.shrink(b), bx.expand(b, 1.5, 3, w, h), bx.turned_180(b, w, h)
    area = Box(F.lit(60), F.lit(20), F.lit(120), F.lit(50))
    return fx.pred_boxes(spark, sf_dir).select(
        "image", "det", bx.valid(b).alias("ok"), ((b.w > 30) & (b.h > 25)).alias("large"), _r(b.cx).alias("cx"), _r(b.cy).alias("cy"),
        bx.contains_point(area, b.cx, b.cy).alias("half_open"), bx.contains_point(area, b.cx, b.cy, closed=True).alias("closed"),
        *buf.columns("b"), padded.x1.alias("px1"), padded.y2.alias("py2"), un.x1.alias("ux1"), un.x2.alias("ux2"), _r(small.x1).alias("sx1"), _r(small.y2).alias("sy2"),
        big.x1.alias("ex1"), big.x2.alias("ex2"), bx.quadrant(b.cx, b.cy, w, h).alias("quadrant"), bx.binned(b.cx, 25.0).alias("x_bin"), turned.x1.alias("tx1"), turned.y2.alias("ty2"),
    )


@query(with_tables("""
  SELECT image, det, round((x1 + x2) / 2, 6) AS xc, round((y1 + y2) / 2, 6) AS yc, x2 - x1 AS w, y2 - y1 AS h, x1::DOUBLE AS back_x1, y2::DOUBLE AS back_y2,
    round(x1 / 220.0 * 640 + 4, 6) AS n_x1, round(y2 / 90.0 * 480 + 2, 6) AS n_y2, round((x1 - 16) / 0.5, 6) AS l_x1, round((y2 - 8) / 0.5, 6) AS l_y2, least(greatest(x1 - 10, 0), 100) AS c_x1, least(greatest(x2 - 10, 0), 100) AS c_x2
  FROM pred_boxes""", "pred_boxes"))
def g12_box_formats(spark, sf_dir):
    b = Box.of()
    xc, yc, w, h = bx.to_xywh(b)
    back = bx.from_xywh(xc, yc, w, h)
    norm = bx.scaled(Box(b.x1 / 220.0, b.y1 / 90.0, b.x2 / 220.0, b.y2 / 90.0), 640, 480, 4, 2)
    un, cut = bx.unletterbox(b, F.lit(0.5), F.lit(16), F.lit(8)), bx.clip(bx.shifted(b, F.lit(-10), F.lit(-10)), F.lit(100), F.lit(100))
    return fx.pred_boxes(spark, sf_dir).select(
        "image", "det", _r(xc).alias("xc"), _r(yc).alias("yc"), w.alias("w"), h.alias("h"), back.x1.alias("back_x1"), back.y2.alias("back_y2"),
        _r(norm.x1).alias("n_x1"), _r(norm.y2).alias("n_y2"), _r(un.x1).alias("l_x1"), _r(un.y2).alias("l_y2"), cut.x1.alias("c_x1"), cut.x2.alias("c_x2"),
    )


@query(with_tables("SELECT image, cls, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM pred_boxes GROUP BY image, cls", "pred_boxes"))
def g11_merged_boxes(spark, sf_dir):
    return fx.pred_boxes(spark, sf_dir).groupBy("image", "cls").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n"))


@query(with_tables("""
  SELECT image, det, greatest(0, least(x1, x2 + 3, x1 + 7) - 4) AS x1, greatest(0, least(y1, y1 + 2, y2) - 4) AS y1, least(220, greatest(x1, x2 + 3, x1 + 7) + 4) AS x2, least(90, greatest(y1, y1 + 2, y2) + 4) AS y2,
    round(x1 + (x2 + 3 - x1) * 0.75, 6) AS r1x, round(x2 + 3 + (x1 + 7 - x2 - 3) * 0.5, 6) AS r2x, round(y2 + (y1 - y2) * 0.25, 6) AS r3y FROM pred_boxes""", "pred_boxes"))
def g10_g14_polygons(spark, sf_dir):
    b = Box.of()
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(point(b.x1, b.y1), point(b.x2 + 3, b.y1 + 2), point(b.x1 + 7, b.y2))
    box, ring = bx.of_points(points, 4, F.lit(220), F.lit(90)), bx.resample(points, 5)
    boxes = [c.cast("bigint").alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)]
    # the ring first: inside a lambda, x1 would otherwise name the column that this list defines
    with_ring = fx.pred_boxes(spark, sf_dir).withColumn("ring", ring)
    return with_ring.select("image", "det", *boxes, *[_r(F.col("ring")[i][c]).alias(f"r{i}{c}") for i, c in ((1, "x"), (2, "x"), (3, "y"))])


_LINE = """CASE WHEN x2 < 80 THEN true WHEN cx < 80 THEN true WHEN cx > 120 THEN false ELSE cx < 80 + (70 - cy) / 60.0 * 40 END"""
_LINE_R = """CASE WHEN x2 < 80 THEN true WHEN cx < 80 THEN true WHEN cx > 120 THEN false ELSE cx < 120 - (70 - cy) / 60.0 * 40 END"""


@query(with_tables(f"""
  SELECT image, det, {_LINE} AS left_of, {_LINE_R} AS left_of_right_beam, (x1 > 120) OR NOT (CASE WHEN cx < 80 THEN true WHEN cx > 120 THEN false ELSE cx < 80 + (70 - cy) / 60.0 * 40 END) AS right_of,
    cx > 110 AS leans_right, round(-(a - floor((a + 90) / 180) * 180), 6) AS deskew FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, degrees(atan2(y2 - 60, x1 - 100)) AS a FROM pred_boxes)""", "pred_boxes"))
def g19_g22_beams_and_skew(spark, sf_dir):
    b, beam = Box.of(), Box(F.lit(80.0), F.lit(10.0), F.lit(120.0), F.lit(70.0))
    angle = F.degrees(F.atan2((b.y2 - 60).cast("double"), (b.x1 - 100).cast("double")))
    return fx.pred_boxes(spark, sf_dir).select(
        "image", "det", bx.sku_left_of_beam(b, beam).alias("left_of"), bx.sku_left_of_beam(b, beam, True).alias("left_of_right_beam"), bx.sku_right_of_beam(b, beam).alias("right_of"),
        bx.leans_right_side(b, F.lit(220)).alias("leans_right"), _r(bx.deskew(angle)).alias("deskew"),
    )


_PCA = """SELECT image, n, round(CASE WHEN n >= 5 THEN CASE WHEN a > 90 THEN 180 - a ELSE a END END, 6) AS angle
  FROM (SELECT image, count(*) AS n, abs(degrees(atan2(2 * covar_samp(x1, y1), var_samp(x1) - var_samp(y1)) / 2)) AS a FROM pred_boxes GROUP BY image)"""


@query(with_tables(_PCA, "pred_boxes"))
def g23_principal_angle(spark, sf_dir):
    x, y = F.col("x1").cast("double"), F.col("y1").cast("double")
    s = fx.pred_boxes(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c"))
    return s.select("image", "n", _r(bx.principal_angle(F.col("n"), F.col("vx"), F.col("vy"), F.col("c"))).alias("angle"))


@query(with_tables("""
  SELECT image, round(greatest(0, (p + z2 / (2 * n) - s) / d), 6) AS low, round(least(1, (p + z2 / (2 * n) + s) / d), 6) AS high, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1, CASE WHEN fp = 0 THEN 0 WHEN fp = 1 THEN 0.35 ELSE 0.5 END AS beam,
    round(0.5 - abs(tp - n) / 2 / greatest(tp, n), 3) AS label, round(0.1 * p + 0.9 * p * p, 6) AS fitness, round(0.6 * p + 0.4 * (1 - p), 6) AS fused
  FROM (SELECT *, tp / n AS p, 3.8416 AS z2, 1 + 3.8416 / n AS d, 1.96 * sqrt(tp / n * (1 - tp / n) / n + 3.8416 / (4 * n * n)) AS s
        FROM (SELECT image, count(*)::DOUBLE AS n, sum(CASE WHEN conf >= 30 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN conf < 30 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN conf = 7 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM pred_boxes GROUP BY image HAVING sum(CASE WHEN conf >= 30 THEN 1 ELSE 0 END) > 0))""", "pred_boxes"))
def g24_g28_scores(spark, sf_dir):
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    g = fx.pred_boxes(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).cast("double").alias("n"), one(F.col("conf") >= 30).alias("tp"), one(F.col("conf") < 30).alias("fp"), one(F.col("conf") == 7).alias("fn")).where("tp > 0")
    n, tp, fp, fn = (F.col(c) for c in ("n", "tp", "fp", "fn"))
    ci, pr, p = bx.wilson(tp, n), bx.precision_recall(tp, fp, fn), tp / n
    return g.select(
        "image", *[_r(v).alias(k) for k, v in (*ci.items(), *pr.items())], bx.beam_score(fp).alias("beam"), bx.label_score(tp, n).alias("label"), _r(bx.fitness(p, p * p)).alias("fitness"), _r(bx.fused_confidence(p, 1 - p)).alias("fused")
    )


def smoothed(df, keys, order, value, k):
    """Box filter over 2k + 1 rows; the edge values stand beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    full = w.rowsBetween(-k, k)
    every = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, rn = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(w)
    lead, tail = F.greatest(F.lit(0), k - (rn - 1)), F.greatest(F.lit(0), k - (n - rn))
    total = F.sum(value).over(full) + lead * F.first(value).over(every) + tail * F.last(value).over(every)
    return df.withColumn("smooth", total / (2 * k + 1))


@query(with_tables("""
  SELECT image, det, round((sum(conf) OVER (PARTITION BY image ORDER BY det ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 3 - rn) * first_conf + greatest(0, 2 - (n - rn)) * last_conf) / 5, 6) AS smooth
  FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY det) AS rn, count(*) OVER (PARTITION BY image) AS n, first_value(conf) OVER w AS first_conf, last_value(conf) OVER w AS last_conf
        FROM pred_boxes WINDOW w AS (PARTITION BY image ORDER BY det ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""", "pred_boxes"))
def g29_box_smoothing(spark, sf_dir):
    return smoothed(fx.pred_boxes(spark, sf_dir), ["image"], "det", "conf", 2).select("image", "det", _r(F.col("smooth")).alias("smooth"))


@query(with_tables("SELECT image, det, round(inter / (pa + ga - inter), 6) AS iou, round(inter / ga, 6) AS coverage, round(inter / pa, 6) AS precision FROM i", "pred_boxes", "gt_boxes", more=_PAIR))
def g15_g16_polygon_overlap(spark, sf_dir):
    """Rectangles as polygons, so that the raster's counts are exact; every third has rectangles in place of polygons."""
    from gondola.functions.polygons import chosen, polygon_overlap

    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = lambda b: F.array(point(b.x1, b.y1), point(b.x2, b.y1), point(b.x2, b.y2), point(b.x1, b.y2))
    p = _pairs(spark, sf_dir).select("image", "det", ring(Box.of("g_")).alias("truth"), ring(Box.of()).alias("found"))
    none = F.array().cast(p.select(F.array("found")).schema[0].dataType)
    pick = chosen(F.when(F.col("det") % 3 == 0, none).otherwise(F.array("found")), F.array(F.struct(F.col("found").alias("points"))))
    o = p.select("image", "det", polygon_overlap(F.col("truth"), pick).alias("o"))
    return o.select("image", "det", *[_r(F.col(f"o.{c}")).alias(c) for c in ("iou", "coverage", "precision")])


@query(with_tables("SELECT image, det, x1 - off + 40 AS x1, y1 - 7 AS y1, x1 AS back_x1, y2 AS back_y2 FROM (SELECT *, (det % 5) * 60 AS off FROM pred_boxes)", "pred_boxes"))
def g18_strip_coordinates(spark, sf_dir):
    """Original coordinates to a strip's (less the slot's offset, plus its crop) and back."""
    off = (F.col("det") % 5) * 60
    local = bx.shifted(Box.of(), 40 - off, F.lit(-7))
    back = bx.shifted(local, off - 40, F.lit(7))
    rows = fx.pred_boxes(spark, sf_dir).select("image", "det", local.x1.alias("lx"), local.y1.alias("ly"), back.x1.alias("back_x1"), back.y2.alias("back_y2"))
    return rows.select("image", "det", F.col("lx").alias("x1"), F.col("ly").alias("y1"), "back_x1", "back_y2")
