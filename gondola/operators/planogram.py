"""Planogram: digits to prices, rows, freshness, runs, alignment, empties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions import boxes as bx
from gondola.functions import codes
from gondola.functions.boxes import Box
from gondola.operators.match import sides
from gondola.sources.scratch import written


def digits_to_prices(labels: DataFrame, digits: DataFrame) -> DataFrame:
    """labels: image, label, box; digits: image, det, box, digit, conf -> the digits whose centre lies in the label, from
    left to right; their mean confidence; and the price, the last two digits being cents.
    """
    pairs = sides(digits, labels, ["image"])
    d = Box.of()
    held = pairs.where(bx.contains_point(Box.of("g_"), d.cx, d.cy))
    g = held.groupBy("image", F.col("g_label").alias("label")).agg(F.array_sort(F.collect_list(F.struct("x1", "det", "digit"))).alias("d"), F.avg("conf").alias("conf"))
    text = F.array_join(F.transform("d", lambda x: x["digit"].cast("string")), "")
    g = g.select("image", "label", text.alias("digits"), "conf")
    n = F.length("digits")
    price = F.when(n > 2, F.concat(F.substring("digits", F.lit(1), n - 2), F.lit("."), F.substring("digits", n - 1, F.lit(2)))).otherwise(F.concat(F.lit("0."), F.lpad("digits", 2, "0")))
    return g.withColumn("price", price)


def rows_by_gap(labels: DataFrame, gap: float = 100.0) -> DataFrame:
    """labels: image, label, box -> shelf_row (a new row where the next centre is ``gap`` or more below the previous)
    and place (from left to right).
    """
    by_y = Window.partitionBy("image").orderBy("cy", "label")
    n = labels.withColumn("cy", Box.of().cy)
    new = F.when(F.col("cy") - F.lag("cy").over(by_y) >= gap, 1).otherwise(0)
    n = n.withColumn("new", new).withColumn("shelf_row", F.sum("new").over(by_y))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("image", "shelf_row").orderBy("x1", "label"))).drop("new", "cy")


def rows_by_anchor(labels: DataFrame, gap: float = 150.0, value: str = "y1") -> DataFrame:
    """Like ``rows_by_gap``, but a row ends ``gap`` below its first label: a fold over the image's labels."""
    item = F.struct(F.col(value).cast("double").alias("v"), F.col("label").cast("bigint").alias("label"))
    g = labels.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("l"))
    kind = "array<struct<label:bigint,shelf_row:int>>"
    init = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("n"), F.array().cast(kind).alias("out"))

    def step(a, x):
        new = a["first"].isNull() | (x["v"] - a["first"] >= gap)
        n = F.when(new, a["n"] + 1).otherwise(a["n"])
        return F.struct(F.when(new, x["v"]).otherwise(a["first"]).alias("first"), n.alias("n"), F.array_append(a["out"], F.struct(x["label"].alias("label"), n.alias("shelf_row"))).alias("out"))

    return g.select("image", F.inline(F.aggregate("l", init, step, lambda a: a["out"])))


def strips(tracks: DataFrame, size: int = 5, margin: int = 10) -> DataFrame:
    """Chunks of ``size`` boxes in order: group, slot, the group's largest height and width, and the running offset."""
    order = Window.partitionBy("image").orderBy("det")
    n = tracks.withColumn("rn", F.row_number().over(order) - 1).withColumns({"group": F.floor(F.col("rn") / size), "slot": F.col("rn") % size})
    whole, before = Window.partitionBy("image", "group"), Window.partitionBy("image", "group").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return n.select("image", "det", "group", "slot", F.max(h).over(whole).alias("strip_h"), F.max(w).over(whole).alias("slot_w"), F.coalesce(F.sum(w + margin).over(before), F.lit(0)).alias("offset"))


def needs_refresh(sequence: DataFrame, expected: DataFrame) -> DataFrame:
    """bay, refresh: a bay's sequence is stale if it is empty, shorter than expected, has a location that is no whole
    number, or a hole. sequence: bay, loc; expected: bay, n.
    """
    loc = F.col("loc").cast("double")
    hole = F.lead(loc).over(Window.partitionBy("bay").orderBy(loc)) - loc > 1
    g = sequence.withColumns({"bad": loc.isNull() | (loc != F.floor(loc)), "hole": F.coalesce(hole, F.lit(False))})
    g = g.groupBy("bay").agg(F.count(F.lit(1)).alias("have"), F.max("bad").alias("bad"), F.max("hole").alias("hole"))
    e = expected.join(g, "bay", "left")
    return e.select("bay", (F.coalesce(F.col("have"), F.lit(0)) < F.greatest(F.col("n"), F.lit(1))) | F.coalesce(F.col("bad") | F.col("hole"), F.lit(False)).alias("refresh")).toDF("bay", "refresh")


def _runs(rows: DataFrame, order: str, key: str, least: int, most: int) -> DataFrame:
    """bay, first, n, keys of runs of ``least`` to ``most`` rows that follow each other by one in ``order``."""
    w = Window.partitionBy("bay").orderBy(order)
    wide = rows.select("bay", F.col(order).alias("first"), F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"))).over(w.rowsBetween(0, most - 1)).alias("r"))
    each = wide.select("bay", "first", F.explode(F.sequence(F.lit(least), F.lit(most))).alias("n"), "r").where(F.size("r") >= F.col("n"))
    return each.select("bay", "first", "n", F.slice("r", F.lit(1), F.col("n")).alias("r"))


def seed_matches(cells: DataFrame, sequence: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """cells: bay, pos, key (known prices only, ``pos`` in reading order); sequence: bay, loc, key. Runs of neighbouring
    cells whose keys equal those of neighbouring locations, with two keys or more: bay, score, positions, loc.

    One equi-join of runs on (bay, keys); the score is 0.7 * length / most + 0.3 * distinct keys / length.
    """
    grid = _runs(cells, "pos", "key", least, most).select("bay", "n", F.transform("r", lambda x: x["o"]).alias("positions"), F.transform("r", lambda x: x["k"]).alias("keys"))
    grid = grid.where(F.size(F.array_distinct("keys")) >= 2)
    plan = _runs(sequence, "loc", "key", least, most).where(F.element_at("r", -1)["o"] == F.col("first") + F.col("n") - 1)
    plan = plan.select("bay", F.col("first").alias("loc"), F.transform("r", lambda x: x["k"]).alias("keys"))
    # merge: the size that Spark expects leaves out that runs are six rows a place, so that it would broadcast them
    met = grid.join(plan.hint("merge"), ["bay", "keys"])
    score = _seed_score(F.col("n"), F.col("keys"), most)
    return met.select("bay", score.alias("score"), "n", "positions", "loc")


def _seed_score(n, keys, most: int):
    return 0.7 * n / most + 0.3 * F.size(F.array_distinct(keys)) / n


def place_seeds(cells: DataFrame, sequence: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """bay, pos, loc: the seeds of ``seed_matches`` by score (ties: later positions, then later locations), none that
    uses a cell or location twice.

    A seed's score and positions are those of its run of cells, so that a run takes the last location of its keys that is
    free, and a location once used stays used: each run of cells and of locations is looked at once, and the pairs, whose
    number grows with the square of what repeats in a bay, are never made.
    """
    known = cells.withColumn("i", F.row_number().over(Window.partitionBy("bay").orderBy("pos")).cast("bigint"))
    grid = _runs(known, "i", "key", least, most).withColumn("keys", F.transform("r", lambda x: x["k"])).where(F.size(F.array_distinct("keys")) >= 2)
    plan = _runs(sequence, "loc", "key", least, most).where(F.element_at("r", -1)["o"] == F.col("first") + F.col("n") - 1).withColumn("keys", F.transform("r", lambda x: x["k"]))
    row = lambda df, kind, at, n, neg, keys, pos: df.where("bay IS NOT NULL").select("bay", F.lit(kind).alias("kind"), at.cast("bigint").alias("at"), n.cast("int").alias("n"), neg.cast("double").alias("neg"), keys.cast("string").alias("keys"), pos.cast("bigint").alias("pos"))
    none = F.lit(None)
    rows = row(grid, "run", F.col("first"), F.col("n"), -F.round(_seed_score(F.col("n"), F.col("keys"), most), 9), F.col("keys"), none)
    rows = rows.unionByName(row(plan, "plan", F.col("first"), F.col("n"), none, F.col("keys"), none)).unionByName(row(known, "cell", F.col("i"), none, none, none, F.col("pos")))

    def place(pdf):
        from gondola.operators.alignment import place

        return place(pdf)

    return rows.groupBy("bay").applyInPandas(place, "bay string, pos bigint, loc bigint")


def greedy_start(cells: DataFrame, sequence: DataFrame, similarity, least: int = 3, mean: float = 0.5) -> DataFrame:
    """For bays without seeds: the start location from which the cells, in order, fit longest (mean similarity at or
    above ``mean``; ties: smaller location). cells: bay, i (0, 1, ...), pos, price; sequence: bay, loc, price.

    A start fits only if its first ``least`` cells do: only the first cell meets all locations, each further one the
    starts that are left, and all cells of a bay only the starts that fit so far.
    """
    known = sequence.select("bay", "loc", F.col("price").alias("known")).hint("merge")
    fits = similarity(F.col("price"), F.col("known"))
    head = cells.where("i = 0").join(known, "bay").where(fits >= 0).select("bay", F.col("loc").alias("start"))
    for i in range(1, least):
        at = known.withColumn("start", F.col("loc") - i).hint("merge")
        head = head.join(cells.where(F.col("i") == i), "bay").join(at, ["bay", "start"]).where(fits >= 0).select("bay", "start")
    # stretches of cells, each twice as long as all before it, meet only the starts that fit all of those
    zero, ended = F.lit(0).cast("bigint"), []
    alive, low, high = written(head.select("bay", "start", F.lit(0.0).alias("total"), zero.alias("scored"), zero.alias("length"))), 0, 2 * least
    by = Window.partitionBy("bay", "start").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    while not alive.isEmpty():
        real = cells.where((F.col("i") >= low) & (F.col("i") < high)).join(alive.select("bay", "start"), "bay").withColumn("loc", F.col("start") + F.col("i"))
        real = real.join(known, ["bay", "loc"]).withColumn("s", fits)
        ok = real.withColumns({"low": F.min("s").over(by), "n": F.count(F.lit(1)).over(by)}).where(f"coalesce(low >= 0, true) AND n = i + 1 - {low}")
        more = ok.groupBy("bay", "start").agg(F.sum("s").alias("_total"), F.count("s").alias("_scored"), F.count(F.lit(1)).alias("_length"))
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("total", "scored", "length")]
        met = written(alive.join(more, ["bay", "start"], "left").select("bay", "start", *sums))
        ended.append(met.where(F.col("length") < high))
        alive, low, high = met.where(F.col("length") == high), high, 3 * high
    fit = reduce(DataFrame.unionByName, ended) if ended else alive
    fit = fit.withColumn("score", F.col("total") / F.nullif("scored", F.lit(0))).where((F.col("length") >= least) & (F.col("score") >= mean))
    return fit.groupBy("bay").agg(F.min(F.struct((-F.col("length")).alias("neg"), "start", "score")).alias("b")).select("bay", F.col("b.start").alias("start"), (-F.col("b.neg")).alias("length"), F.col("b.score").alias("score"))


def fill_alignment(cells: DataFrame, placed: DataFrame, sequence: DataFrame) -> DataFrame:
    """Extends anchors (bay, pos, loc) over the bay's other cells: bay, pos, loc, sku, how.

    Per bay: equal gaps between anchors are bridged where prices agree, anchors grow to both sides, equal gaps are filled,
    repeated facings follow their anchor, and anchors grow once more.
    """
    row = lambda df, kind, **c: df.select("bay", F.lit(kind).alias("kind"), *[c.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("pos", "bigint"), ("loc", "bigint"), ("sku", "string"), ("price", "double"))])
    c = row(cells, "cell", pos=F.col("pos"), price=F.coalesce("price", F.lit(0.0)))
    rows = c.unionByName(row(placed, "anchor", pos=F.col("pos"), loc=F.col("loc"))).unionByName(row(sequence, "plan", loc=F.col("loc"), sku=F.col("sku"), price=F.col("price")))

    def run(pdf):
        from gondola.operators.alignment import align

        return align(pdf)

    return rows.where("bay IS NOT NULL").groupBy("bay").applyInPandas(run, "bay string, pos bigint, loc bigint, sku string, how string")


def empty_candidates(cells: DataFrame, sequence: DataFrame, least: float = 0.9) -> DataFrame:
    """For each cell marked empty (with a target price): the best product of the same whole dollars by its neighbours.

    cells: bay, shelf_row, col, price, empty. Neighbours within one cell (core) and two (extended) of the row; shares of
    readable neighbours with the product's dollars, and similarity of the cents; rows' and shelves' edges weigh
    differently. bay, shelf_row, col, sku, loc, score (ties: smaller location).
    """
    row = Window.partitionBy("bay", "shelf_row").orderBy("col")
    whole, all_rows = Window.partitionBy("bay", "shelf_row"), Window.partitionBy("bay")
    dollars = F.col("price").cast("int")
    n = cells.withColumns(
        {
            "core": F.collect_list(dollars).over(row.rowsBetween(-1, 1)), "wide": F.collect_list(dollars).over(row.rowsBetween(-2, 2)), "dollars": dollars,
            "last_col": F.max("col").over(whole), "last_row": F.max("shelf_row").over(all_rows),
        }
    )
    spot = n.where("empty AND price IS NOT NULL")
    edge = (F.col("shelf_row") == 0) | (F.col("shelf_row") == F.col("last_row")) | (F.col("col") == 0) | (F.col("col") == F.col("last_col"))
    size = F.least(F.lit(5), F.greatest(F.lit(3), F.least(F.col("col") + 3, F.col("last_col") - F.col("col") + 2)))
    spot = spot.withColumns({"edge": edge, "size": size})
    met = spot.join(sequence.select("bay", "loc", "sku", F.col("price").alias("known"), F.col("price").cast("int").alias("dollars")), ["bay", "dollars"])
    share = lambda a: F.when(F.size(a) > 0, F.size(F.filter(a, lambda d: d == F.col("dollars"))) / F.size(a)).otherwise(0.0)
    wide = F.when(F.col("size") > 3, 0.5 * share(F.col("wide"))).otherwise(0.0)
    score = codes.blended(share(F.col("core")), wide, codes.cents_similarity(F.col("price"), F.col("known")), F.col("edge"))
    good = met.withColumn("score", F.round(score, 9)).where(F.col("score") >= least)
    best = good.groupBy("bay", "shelf_row", "col").agg(F.min(F.struct((-F.col("score")).alias("neg"), "loc", "sku")).alias("b"))
    return best.select("bay", "shelf_row", "col", F.col("b.sku").alias("sku"), F.col("b.loc").alias("loc"), (-F.col("b.neg")).alias("score"))


def labels_to_shelves(labels: DataFrame, shelves: DataFrame, near: float = 300.0) -> DataFrame:
    """Each label's shelf (boxes): the one with the largest overlap (ties: upper shelf), else the nearest centre closer
    than ``near``; how = overlap, nearest or none; place from left to right within a shelf.
    """
    pairs = sides(labels, shelves, ["image"])
    a, b = Box.of(), Box.of("g_")
    away = F.sqrt(F.pow(a.cx - b.cx, F.lit(2)) + F.pow(a.cy - b.cy, F.lit(2)))
    pairs = pairs.withColumns({"inter": bx.intersection(a, b), "away": away}).where((F.col("inter") > 0) | (F.col("away") < near))
    pick = pairs.groupBy("image", "label").agg(F.min(F.struct((F.col("inter") == 0).alias("far"), (-F.col("inter")).alias("neg"), F.when(F.col("inter") > 0, 0.0).otherwise(F.col("away")).alias("away"), F.col("g_y1").alias("top"), F.col("g_shelf").alias("shelf"))).alias("s"))
    out = labels.select("image", "label", "x1").join(pick, ["image", "label"], "left")
    how = F.when(F.col("s").isNull(), "none").when(F.col("s.far"), "nearest").otherwise("overlap")
    out = out.select("image", "label", "x1", F.col("s.shelf").alias("shelf"), how.alias("how"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("image", "shelf").orderBy("x1", "label"))).drop("x1")
