"""Temporal slots, review progress, reviewer balance and the annotation queue (batch form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions import codes
from gondola.operators import prefix_scan

# ---- temporal empty slots


def image_order(captures: DataFrame) -> DataFrame:
    """bay, image, idx (0, 1, ... in order of the image's name within the bay), n_images."""
    one = captures.select("bay", "image").distinct()
    return one.select("bay", "image", (F.row_number().over(Window.partitionBy("bay").orderBy("image")) - 1).alias("idx"), F.count(F.lit(1)).over(Window.partitionBy("bay")).alias("n_images"))


def slot_predictions(captures: DataFrame, least_images: int = 2, share: float = 0.34) -> DataFrame:
    """bay, image, slot, seen, predicted for every slot of a bay in each of its images.

    A slot is predicted empty if it was in at least ``share`` of the bay's earlier images. The first image falls back to
    slots that recur overall (``least_images`` images and ``share`` of all) - which looks ahead, as the method does.
    """
    order = image_order(captures)
    slots = captures.select("bay", "slot").distinct()
    grid = order.join(slots, "bay").join(captures.select("bay", "image", "slot", F.lit(1).alias("seen")), ["bay", "image", "slot"], "left").na.fill(0, ["seen"])
    before = Window.partitionBy("bay", "slot").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("bay", "slot")
    g = grid.withColumns({"prior": F.coalesce(F.sum("seen").over(before), F.lit(0)), "total": F.sum("seen").over(every)})
    first = (F.col("total") >= least_images) & (F.col("total") / F.col("n_images") >= share)
    return g.withColumn("predicted", F.when(F.col("idx") > 0, F.col("prior") / F.col("idx") >= share).otherwise(first))


def slot_metrics(captures: DataFrame, least_images: int = 2, share: float = 0.34) -> DataFrame:
    """A row a bay: tp, fp, fn, precision, recall, f1 (4 places), count_mae, chronic (slots in ``least_images`` images or more)."""
    p = slot_predictions(captures, least_images, share)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    seen, pred = F.col("seen") == 1, F.col("predicted")
    image = p.groupBy("bay", "image").agg(n(seen & pred).alias("tp"), n(~seen & pred).alias("fp"), n(seen & ~pred).alias("fn"))
    bay = image.groupBy("bay").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg(F.abs(F.col("fp") - F.col("fn"))), 4).alias("count_mae"))
    chronic = captures.groupBy("bay", "slot").agg(F.count_distinct("image").alias("c")).where(F.col("c") >= least_images).groupBy("bay").agg(F.count(F.lit(1)).alias("chronic"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pr, rc = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return bay.join(chronic, "bay", "left").na.fill(0, ["chronic"]).select("bay", "tp", "fp", "fn", F.round(pr, 4).alias("precision"), F.round(rc, 4).alias("recall"), F.round(f1, 4).alias("f1"), "count_mae", "chronic")


def audit(rows: DataFrame) -> DataFrame:
    """rows: image, slot, verdict (yes, no, unsure or empty) -> precision and counts overall, by image and by slot."""
    n = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    g = rows.groupingSets([[], ["image"], ["slot"]], "image", "slot").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("total"), n("yes").alias("yes"), n("no").alias("no"), n("unsure").alias("unsure"), n("").alias("remaining"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "image").otherwise("slot")
    judged = F.col("yes") + F.col("no")
    return g.select(level.alias("level"), F.coalesce("image", F.col("slot").cast("string"), F.lit("")).alias("name"), "total", "yes", "no", "unsure", "remaining", F.round(F.when(judged > 0, F.col("yes") / judged).otherwise(0.0), 6).alias("precision"))


# ---- reviews


def progress(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows: keys, status (canonical), expected, predicted, hint, has_prediction -> counts and accuracy of scorable rows.

    The prediction's text counts where the image has predictions, else the stored hint.
    """
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    text = F.when(F.col("has_prediction"), F.col("predicted")).otherwise(F.col("hint"))
    good = (F.col("status") == "scorable") & (codes.digits(text) == codes.digits(F.col("expected")))
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), n(F.col("status") != "").alias("reviewed"), n(F.col("status") == "scorable").alias("scorable"), n(good).alias("correct"))
    return g.withColumns({"non_scorable": F.col("reviewed") - F.col("scorable"), "accuracy": F.round(F.when(F.col("scorable") > 0, F.col("correct") / F.col("scorable")).otherwise(0.0), 6)})


def dealt_by_load(loads: Sequence[tuple[int, str, str]], size: int, count: int) -> tuple[list[tuple[int, int, list[str]]], list[tuple[int, str, str]]]:
    """How ``count`` items of ``size`` go, one after the other, to whoever has least then, without going through them.

    loads: (load, name for ties, member). A member's turns come at load, load + size, load + 2 * size, ...; all turns in
    order of (load, name) are the deal. In units of ``size`` a member enters in round load // size, and each round goes
    through all who are in by (remainder, name). Returns stretches (first, stop, members in turn) and the loads after.
    """
    who = sorted((load // size, load % size, low, member) for load, low, member in loads)
    stretches, at, enter = [], 0, sorted({w[0] for w in who})
    extra = dict.fromkeys([w[3] for w in who], 0)
    for i, first_round in enumerate(enter):
        turn = [w[3] for w in sorted((w for w in who if w[0] <= first_round), key=lambda w: (w[1], w[2]))]
        rounds = (enter[i + 1] - first_round) if i + 1 < len(enter) else count
        n = min(count - at, rounds * len(turn))
        if n:
            stretches.append((at, at + n, turn))
            for j, member in enumerate(turn):
                extra[member] += n // len(turn) + (j < n % len(turn))
        at += n
    return stretches, [(load + extra[member] * size, low, member) for load, low, member in loads]


def balance(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows: image, row, reviewer, reviewed; members: member, pool. image, owner for each image (and each pool).

    An image with reviews stays with the member who made most of them (first seen on ties, case ignored); all others go,
    largest first (ties: by name), to the member with the least load (ties: the name in lower case).

    The members' loads and how many images there are of each size go to the driver: few members, and n sizes need at
    least n * n / 2 rows. ``dealt_by_load`` says which places of a size go to whom; images find theirs by rank, from a
    prefix scan. Without members an image has no owner.
    """
    n = rows.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    made = rows.where(F.col("reviewed") & (F.trim("reviewer") != "")).groupBy("image", F.lower(F.trim("reviewer")).alias("who")).agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("first"))
    most = made.groupBy("image").agg(F.min(F.struct((-F.col("c")).alias("neg"), "first", "who")).alias("m")).select("image", F.col("m.who").alias("who"))
    known = members.select(F.lower("member").alias("who"), "member")
    pinned = most.join(known, "who").select("image", F.col("member").alias("owner"))
    load = members.join(pinned.join(n, "image").groupBy(F.col("owner").alias("member")).agg(F.sum("n").alias("load")), "member", "left")
    left = n.join(pinned, "image", "left_anti")
    placed = prefix_scan.running_sums(prefix_scan.place(left, [-F.col("n"), "image"]), ["n"], {"rank": F.lit(1)})
    pools: dict = {}
    for r in load.select("pool", "member", F.coalesce("load", F.lit(0)).alias("load")).collect():
        pools.setdefault(r["pool"], []).append((r["load"], r["member"].lower(), r["member"]))
    sizes = sorted(((r["n"], r["count"]) for r in left.groupBy("n").count().collect()), reverse=True)
    plan = []
    for loads in pools.values():
        for size, count in sizes:
            stretches, loads = dealt_by_load(loads, size, count)
            plan += [(size, *s) for s in stretches]
    turns = rows.sparkSession.createDataFrame(plan, "size bigint, first bigint, stop bigint, turn array<string>")
    mine = placed.join(F.broadcast(turns), (F.col("n") == F.col("size")) & (F.col("rank") > F.col("first")) & (F.col("rank") <= F.col("stop")))
    owner = F.get("turn", ((F.col("rank") - 1 - F.col("first")) % F.size("turn")).cast("int"))
    return pinned.select(F.col("image").cast("string").alias("image"), "owner").unionByName(mine.select(F.col("image").cast("string").alias("image"), owner.alias("owner")))


def next_after_save(rows: DataFrame) -> DataFrame:
    """rows: image, row -> the next row in the image, wrapped to its first, and the next over all (by image, row).

    Rows without an image are in no queue. Neighbours are found range by range, so that neither a large image nor the
    whole list is one task.
    """
    placed = prefix_scan.place(rows.select("image", "row").where("image IS NOT NULL"), ["image", "row"])
    n = prefix_scan.following(placed, ["image", "row"], "next").join(rows.groupBy("image").agg(F.min("row").alias("first")), "image")
    own = F.when(F.col("next.image") == F.col("image"), F.col("next.row"))
    return n.select("image", "row", own.alias("next_in_image"), F.coalesce(own, "first").alias("next_wrapped"), F.col("next.row").alias("next_row"))


# ---- truth

#: What a truth row sets in a shape, and the fields' names there. Reviewer and notes are set only where they aren't empty.
SHAPE_FIELDS = {"expected_sku": "expected_sku", "status": "expected_sku_review_status", "scorability": "expected_sku_scorability", "digit_class": "expected_sku_digit_class", "source": "expected_sku_source"}
OPTIONAL_FIELDS = {"reviewer": "expected_sku_reviewer", "notes": "expected_sku_notes"}


def truth_values(rows: DataFrame, source: str = "golden_sku_truth.csv") -> DataFrame:
    """rows: file, shape_idx, label, expected_sku, review_status, scorability, sku_digit_class, reviewer, notes, ord ->
    the values to set, a row for each (file, shape_idx, label): the last by ``ord``.

    A row without a code sets nothing, nor does N/A without notes; empty fields follow from the code.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    na = codes.is_na(text("expected_sku"))
    sku = F.when(na, F.when(F.upper(text("expected_sku")) == "X", "X").otherwise("N/A")).otherwise(F.coalesce(codes.clean_expected(text("expected_sku")), F.lit("")))
    v = rows.where(F.col("shape_idx").isNotNull()).withColumn("expected_sku", sku).where((F.col("expected_sku") != "") & (~na | (text("notes") != "")))
    told = ("expected_sku", "review_status", "scorability", "sku_digit_class", "reviewer", "notes")
    # dealt by file once: the rows of a place, and later those of a file, are already together
    last = v.repartition("file").groupBy("file", F.col("shape_idx").cast("int").alias("shape_idx"), "label").agg(F.max_by(F.struct(*told), "ord").alias("v")).select("file", "shape_idx", "label", "v.*")
    known = F.col("expected_sku").isNotNull()  # of rows without any ord nothing is known
    other = lambda c, d: F.when(known, F.when(text(c) != "", text(c)).otherwise(d))
    return last.select(
        "file", "shape_idx", "label", "expected_sku", other("review_status", F.when(codes.is_na(F.col("expected_sku")), "not_applicable").otherwise("reviewed")).alias("status"), other("scorability", codes.scorability(F.col("expected_sku"))).alias("scorability"),
        other("sku_digit_class", codes.digit_class(F.col("expected_sku"))).alias("digit_class"), F.when(known, F.lit(source)).alias("source"), *[F.when(known, text(c)).alias(c) for c in ("reviewer", "notes")],
    )


def sync_truth(files: DataFrame, truth: DataFrame) -> DataFrame:
    """files: file, shapes (array of map<string,string>, ``label`` among the keys); truth: as ``truth_values`` puts it out.
    file, shapes, updated, missing for each file of either side; shapes is null for files that aren't there.

    A truth row whose file, place or label isn't there counts as missing. The rows of a file meet it as one map from place
    to the fields to set, made once a row (a file has a few hundred shapes); places of one index with several labels are
    told apart by the label. A shape looks up its row once. A second run changes nothing.
    """
    named = {name: F.col(c) for c, name in SHAPE_FIELDS.items()} | {name: F.nullif(F.col(c), F.lit("")) for c, name in OPTIONAL_FIELDS.items()}
    new = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values())), lambda _, x: x.isNotNull())
    keyed = F.struct(F.struct("shape_idx", "label").alias("key"), new.alias("value"))
    of = truth.groupBy("file").agg(F.map_from_entries(F.collect_list(keyed)).alias("values"))
    place = lambda s, i: F.struct(i.cast("int").alias("shape_idx"), s["label"].alias("label"))
    met = files.join(of, "file", "full").withColumn("set", F.transform("shapes", lambda s, i: F.element_at("values", place(s, i))))
    set_in = lambda s, v: F.when(v.isNull(), s).otherwise(F.map_concat(F.map_filter(s, lambda k, _: ~F.map_contains_key(v, k)), v))
    n = F.coalesce(F.size("values"), F.lit(0))
    updated = F.when(F.col("shapes").isNull() | F.col("values").isNull(), 0).otherwise(F.size(F.filter("set", lambda v: v.isNotNull())))
    shapes = F.when(F.col("values").isNull(), F.col("shapes")).otherwise(F.zip_with("shapes", "set", set_in))
    return met.select("file", shapes.alias("shapes"), updated.cast("bigint").alias("updated"), (F.when(F.col("values").isNull(), 0).otherwise(n) - updated).cast("bigint").alias("missing"))


# ---- queue

STATE = "struct<status:string,user:string,label:string,by:string,at:timestamp,labels:int>"


def fold_queue(events: DataFrame) -> DataFrame:
    """The queue's state after all events of each image in order (ts, event_id).

    assign: an unassigned image goes to the user; label: its holder finishes it; relabel: whoever labelled it may change
    the label; skip: its holder puts it aside, as may whoever labelled it; release: its holder gives it back; recycle: a skipped image returns.
    events: image, user, action, ts, event_id. image, status, user, label, by, at, labels.
    """
    e = F.struct("ts", "event_id", "user", "action")
    g = events.groupBy("image").agg(F.array_sort(F.collect_list(e)).alias("e"))
    none = F.lit(None).cast("string")
    init = F.struct(F.lit("unassigned").alias("status"), none.alias("user"), none.alias("label"), none.alias("by"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("labels")).cast(STATE)
    return g.select("image", F.aggregate("e", init, queue_step).alias("s")).select("image", "s.*")


def queue_step(a: Column, x: Column) -> Column:
    user = x["user"].cast("string")
    none = F.lit(None).cast("string")
    holds, made = a["user"].eqNullSafe(user) & (a["status"] == "assigned"), a["by"].eqNullSafe(user) & (a["status"] == "done")
    to = lambda status, who, label, by, n: F.struct(F.lit(status).alias("status"), who.alias("user"), label.alias("label"), by.alias("by"), x["ts"].alias("at"), n.alias("labels")).cast(STATE)
    label = F.concat(F.lit("L"), x["event_id"].cast("string"))
    act, n = x["action"], a["labels"]
    return (
        F.when((act == "assign") & (a["status"] == "unassigned"), to("assigned", user, a["label"], a["by"], n))
        .when((act == "label") & holds, to("done", none, label, user, n + 1)).when((act == "relabel") & made, to("done", none, label, user, n + 1))
        .when((act == "skip") & (holds | made), to("skipped", none, a["label"], a["by"], n)).when((act == "release") & holds | (act == "recycle") & (a["status"] == "skipped"), to("unassigned", none, a["label"], a["by"], n))
        .otherwise(a)
    )


def release_stale(state: DataFrame, now: Column, minutes: int = 20) -> DataFrame:
    stale = (F.col("status") == "assigned") & (F.col("at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return state.withColumns({"status": F.when(stale, "unassigned").otherwise(F.col("status")), "user": F.when(~stale, F.col("user"))})


def queue_heads(state: DataFrame, users: DataFrame) -> DataFrame:
    """Each user's next image: the one that the user holds (smallest), else the smallest unassigned one."""
    held = state.where("status = 'assigned'").groupBy("user").agg(F.min("image").alias("held"))
    free = state.where("status = 'unassigned'").agg(F.min("image").alias("free"))
    return users.join(held, "user", "left").join(free, F.lit(True), "left").select("user", F.coalesce("held", "free").alias("image"), F.col("held").isNotNull().alias("resumed"))
