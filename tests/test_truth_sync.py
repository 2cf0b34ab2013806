"""Truth rows set fields of shapes in annotation files; the regression verdict on hand-made runs."""

from pyspark.sql import functions as F

from gondola.operators import evaluate, review

TRUTH = "file string, shape_idx long, label string, expected_sku string, review_status string, scorability string, sku_digit_class string, reviewer string, notes string, ord long"
FILES = "file string, shapes array<map<string,string>>"


def test_truth_sync(spark):
    files = spark.createDataFrame(
        [("a.json", [{"label": "RDC_SKU", "points": "p0"}, {"label": "Pallet_SKU", "expected_sku_notes": "old"}, {"label": None}]), ("b.json", []), ("c.json", [{"label": "RDC_SKU"}])], FILES
    )
    rows = [
        ("a.json", 0, "RDC_SKU", "123-456", "", None, "", " ann ", "", 1),
        ("a.json", 0, "RDC_SKU", "1001234567", "glare", "", "", "", "seen twice", 2),  # the later row counts
        ("a.json", 1, "Pallet_SKU", "N/A", "", "", "", "", "torn", 3),
        ("a.json", 1, "RDC_SKU", "123456", "", "", "", "", "", 4),  # another label
        ("a.json", 9, "RDC_SKU", "123456", "", "", "", "", "", 5),  # no such shape
        ("a.json", 2, "Pallet_SKU", "n/a", "", "", "", "", "", 6),  # no notes: sets nothing, isn't missing
        ("a.json", 2, "Pallet_SKU", None, "", "", "", "", "", 7),
        ("gone.json", 0, "RDC_SKU", "123456", "", "", "", "", "", 8),
        ("gone.json", 1, "RDC_SKU", "123456", "", "", "", "", "", 9),
    ]
    truth = review.truth_values(spark.createDataFrame(rows, TRUTH))
    once = review.sync_truth(files, truth)
    got = {r["file"]: r for r in once.collect()}
    assert {f: (r["updated"], r["missing"]) for f, r in got.items()} == {"a.json": (2, 2), "b.json": (0, 0), "c.json": (0, 0), "gone.json": (0, 2)}
    first, second, third = got["a.json"]["shapes"]
    assert first["points"] == "p0" and first["expected_sku"] == "1001234567" and first["expected_sku_review_status"] == "glare"
    assert first["expected_sku_notes"] == "seen twice" and "expected_sku_reviewer" not in first and first["expected_sku_source"] == "golden_sku_truth.csv"
    assert second["expected_sku"] == "N/A" and second["expected_sku_review_status"] == "not_applicable" and second["expected_sku_notes"] == "torn"
    assert third == {"label": None} and got["gone.json"]["shapes"] is None and got["c.json"]["shapes"] == [{"label": "RDC_SKU"}]
    again = review.sync_truth(once.where("shapes IS NOT NULL").select("file", "shapes"), truth)
    assert {r["file"]: r["shapes"] for r in again.collect()} == {f: r["shapes"] for f, r in got.items()}
    assert review.sync_truth(files.limit(0), truth.limit(0)).count() == 0


def test_a_shape_looks_its_row_up_once(spark):
    files = spark.createDataFrame([("a.json", [{"label": "A"}, {"label": "B"}])], FILES)
    rows = [("a.json", 0, "A", "123456", "", "", "", "", "", 1), ("a.json", 1, "B", "654321", "", "", "", "", "", None)]
    truth = review.truth_values(spark.createDataFrame(rows, TRUTH))
    done = review.sync_truth(files, truth)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at(") == 1 and plan.count("RepartitionByExpression") == 1
    got = done.first()
    assert (got["updated"], got["missing"]) == (2, 0)
    assert got["shapes"][0]["expected_sku"] == "123456" and got["shapes"][1] == {"label": "B"}  # a row without ord tells nothing


def test_regression_verdict(spark):
    det = "strip string, pos long, cls string, conf double, x1 double, y1 double, x2 double, y2 double"
    base = [(s, i, "ab"[i], 0.9, 0.0, 0.0, 10.0 + i, 10.0) for s in ("same", "box", "conf", "cls", "few", "mask", "lost") for i in (0, 1)]
    change = {"box": lambda r: (*r[:5], 1.5, *r[6:]), "conf": lambda r: (*r[:3], 0.902, *r[4:]), "cls": lambda r: (*r[:2], "b", *r[3:])}
    new = [change.get(r[0], lambda r: r)(r) for r in base if r[0] != "lost" and (r[0], r[1]) != ("few", 1)]
    masks = spark.createDataFrame([("mask", False, 3), ("same", True, 0)], "strip string, exact boolean, differing long")
    got = {r["strip"]: r for r in evaluate.regression_verdict(spark.createDataFrame(base, det), spark.createDataFrame(new, det), masks).collect()}
    assert {s for s, r in got.items() if r["passed"]} == {"same"}
    assert (got["box"]["max_box_delta"], got["few"]["n_new"], got["lost"]["n_new"], got["mask"]["diff_pixels"]) == (1.5, 1, 0, 3)
    assert abs(got["conf"]["max_conf_delta"] - 0.002) < 1e-12 and not got["cls"]["classes_equal"] and not got["lost"]["classes_equal"]
    assert evaluate.regression_verdict(spark.createDataFrame([], det), spark.createDataFrame([], det), masks.where(F.lit(False))).count() == 0
