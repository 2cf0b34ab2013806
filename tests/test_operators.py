"""Operators on small tables and invariants on the fixtures."""

import pytest

from gondola.operators import match, planogram, review, suppress
from gondola.plans import fixtures as fx
from gondola.streaming import shelf_streams as st

SF = "/root/testdata/sf0.001"
BOXES = "image bigint, det bigint, cls string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, conf bigint"
TRUTH = "image bigint, gt bigint, cls string, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def test_greedy_takes_the_next_free_truth(spark):
    p = spark.createDataFrame([(1, 1, "a", 0, 0, 10, 10, 90), (1, 2, "a", 0, 0, 10, 10, 80), (1, 3, "a", 50, 50, 60, 60, 70)], BOXES)
    g = spark.createDataFrame([(1, 1, "a", 0, 0, 10, 10), (1, 2, "a", 0, 0, 10, 9), (1, 3, "b", 50, 50, 60, 60)], TRUTH)
    m = match.confidence_greedy(p, g)
    assert sorted((r["det"], r["gt"]) for r in m["matches"].collect()) == [(1, 1), (2, 2)]
    assert [(r["det"], r["best_iou"]) for r in m["false_positives"].collect()] == [(3, 0.0)]
    assert [r["gt"] for r in m["false_negatives"].collect()] == [3]


def test_matching_adds_up_under_any_partitioning(spark):
    p, g = fx.pred_boxes(spark, SF).drop("pk", "sk"), fx.gt_boxes(spark, SF).drop("pk", "sk")
    results = []
    for n in (1, 16):
        m = match.confidence_greedy(p.repartition(n), g.repartition(n))
        rows = m["matches"].collect()
        results.append(sorted(tuple(r) for r in rows))
        assert len(rows) + m["false_positives"].count() == p.count()
        assert len(rows) + m["false_negatives"].count() == g.count()
        assert len({(r["image"], r["det"]) for r in rows}) == len(rows) == len({(r["image"], r["gt"]) for r in rows})
    assert results[0] == results[1]


def test_grid_pairs_are_all_overlapping_pairs(spark):
    p, g = fx.pred_boxes(spark, SF).where("image < 20"), fx.gt_boxes(spark, SF).where("image < 20")
    got = {(r["image"], r["det"], r["g_gt"]) for r in match.grid_pairs(p, g, ["image"], 16).collect()}
    plain = match.sides(p, g, ["image"]).where("x1 < g_x2 AND g_x1 < x2 AND y1 < g_y2 AND g_y1 < y2").collect()
    assert got == {(r["image"], r["det"], r["g_gt"]) for r in plain} and len(plain) == len(got)


def test_suppression_is_idempotent(spark):
    p = fx.pred_boxes(spark, SF)
    once = suppress.nms(p, 0.45, 10)
    again = suppress.nms(p.join(once.select("image", "det"), ["image", "det"]), 0.45, 10)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_seeds_growth_and_facings(spark):
    plan = spark.createDataFrame([("b", i, f"s{i}", float(10 + 7 * i)) for i in range(1, 9)], "bay string, loc bigint, sku string, price double")
    seen = [17.0, 24.0, 31.0, 0.0, 45.0, 45.0, 52.0]
    cells = spark.createDataFrame([("b", i, v or None) for i, v in enumerate(seen)], "bay string, pos bigint, price double")
    anchors = spark.createDataFrame([("b", 0, 1), ("b", 1, 2), ("b", 2, 3)], "bay string, pos bigint, loc bigint")
    got = {r["pos"]: (r["loc"], r["how"]) for r in planogram.fill_alignment(cells, anchors, plan).collect()}
    assert got[4] == (5, "grown") and got[3][0] == 4 and got[5] == (5, "facing") and got[6] == (6, "next")


def test_queue_rules(spark):
    e = [(1, "u", "assign"), (1, "v", "label"), (1, "u", "label"), (1, "v", "relabel"), (1, "u", "relabel"), (2, "u", "skip"), (2, "u", "assign"), (2, "u", "skip"), (2, "v", "recycle"), (2, "v", "assign")]
    rows = [(i, u, a, f"2024-01-01 00:00:{n:02d}", n) for n, (i, u, a) in enumerate(e)]
    df = spark.createDataFrame(rows, "image bigint, user string, action string, ts string, event_id bigint").selectExpr("image", "user", "action", "cast(ts as timestamp) as ts", "event_id")
    got = {r["image"]: (r["status"], r["user"], r["label"], r["labels"]) for r in review.fold_queue(df).collect()}
    assert got == {1: ("done", None, "L4", 2), 2: ("assigned", "v", None, 0)}


def test_balance_pins_reviewed_images_and_levels_the_rest(spark):
    rows = [("i1", 1, "Ann", True), ("i1", 2, "", False), ("i2", 3, "", False), ("i2", 4, "", False), ("i3", 5, "gone", True), ("i4", 6, "", False)]
    members = spark.createDataFrame([("ann", 0), ("bob", 0)], "member string, pool int")
    got = {r["image"]: r["owner"] for r in review.balance(spark.createDataFrame(rows, "image string, row bigint, reviewer string, reviewed boolean"), members).collect()}
    assert got["i1"] == "ann" and got["i2"] == "bob" and set(got) == {"i1", "i2", "i3", "i4"}


def test_tracks_keep_their_ids():
    tracks, out, n = st.associate([], [(0, 0, 10, 10), (50, 0, 60, 10)], 1, 0.3, 1, 1)
    tracks, out, n = st.associate(tracks, [(51, 0, 61, 10), (1, 0, 11, 10)], n, 0.3, 1, 1)
    assert [o[0] for o in sorted(out)] == [1, 2] and n == 3
    tracks, out, n = st.associate(tracks, [], n, 0.3, 1, 1)
    tracks, out, n = st.associate(tracks, [], n, 0.3, 1, 1)
    assert tracks == [] and out == []


@pytest.mark.parametrize("name", ["a1_class_metrics", "t3_windowed_metrics", "io2_payload_source", "j22_tracking"])
def test_queries_run(spark, name):
    from gondola import catalog

    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_legacy_codes_of_a_line(spark):
    from gondola.operators import text

    lines = ["12 1234-567-890 QTY", "12 1004-567-890", "1004-567-890", "SKU#1004567890", "123456", "123456 SKU:123456 334-515", "22 1004215338", "02/05/26 21004215338", "12 SKU# 123456", "", "QTY"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "image long, line long, text string")
    got = {}
    for r in sorted(text.legacy_codes(rows).collect(), key=lambda r: (r["line"], r["pos"])):
        got.setdefault(lines[r["line"]], []).append((r["sku"], r["how"]))
    assert got == {
        "12 1004-567-890": [("1004567890", "vendor")],
        "1004-567-890": [("1004567890", "vendor")],
        "SKU#1004567890": [("1004567890", "vendor")],
        "123456": [("123456", "vendor")],
        "123456 SKU:123456 334-515": [("123456", "word"), ("123456", "word"), ("334515", "word")],
        "22 1004215338": [("1004215338", "vendor")],
        "02/05/26 21004215338": [("1004215338", "recovered")],
        "12 SKU# 123456": [("123456", "vendor")],
    } | {"12 1234-567-890 QTY": [("1234567890", "word")]}
