"""Findings of round 3: results against plain versions, and plans that don't grow faster than the tables."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from gondola import catalog
from gondola.operators import planogram

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def shelves(spark):
    """Two bays whose prices repeat: cells (bay, pos, key) with holes, locations (bay, loc, key) with gaps."""
    rng = random.Random(3)
    keys = {b: [rng.randrange(3) for _ in range(40)] * 2 for b in "ab"}
    cells = [(b, p, k) for b in "ab" for p, k in enumerate(keys[b]) if p % 7 != 3]
    plan = [(b, 2 * p // 2 + p // 9, k) for b in "ab" for p, k in enumerate(keys[b])]
    return cells, plan, spark.createDataFrame(cells, "bay string, pos long, key int"), spark.createDataFrame(plan, "bay string, loc long, key int")


def test_seeds_are_not_broadcast(spark):
    _, _, cells, plan = shelves(spark)
    assert "Broadcast" not in plan_of(planogram.seed_matches(cells, plan))


def test_placed_seeds_are_those_of_a_pass_over_all_pairs(spark):
    cells, plan, c, s = shelves(spark)
    pairs = defaultdict(list)
    for r in planogram.seed_matches(c, s).collect():
        pairs[r["bay"]].append((-round(r["score"], 9), [-p for p in r["positions"]], -r["loc"]))
    want = set()
    for bay, rows in pairs.items():
        used, locs = set(), set()
        for _, ps, loc in sorted(rows):
            p, at = [-v for v in ps], list(range(-loc, -loc + len(ps)))
            if not used & set(p) and not locs & set(at):
                used |= set(p)
                locs |= set(at)
                want |= {(bay, x, y) for x, y in zip(p, at, strict=True)}
    placed = planogram.place_seeds(c, s)
    assert set(map(tuple, placed.collect())) == want and len(want) > 50
    assert "Join" not in plan_of(placed)  # no pairs


def test_bays_are_no_lists_in_a_row(spark):
    for name in ("q11_alignment", "q12_full_grid"):
        assert not any(f in plan_of(catalog.QUERIES[name](spark, SF)) for f in ("array_sort", "MapInPandas")), name


def test_greedy_start_leaves_cells_that_no_start_reaches(spark):
    cells = spark.createDataFrame([("b", i, i, float(i) if i < 30 else -1.0) for i in range(200)], "bay string, i long, pos long, price double")
    plan = spark.createDataFrame([("b", loc, float(loc - 5)) for loc in range(300)], "bay string, loc long, price double")

    def similarity(seen, known):  # the 25th cell fits nowhere, those after the 110th must not be looked at
        return F.when(seen == 24, -1.0).when(seen < 0, F.raise_error(F.lit("met"))).when(seen == known, 1.0).otherwise(-1.0)

    assert [tuple(r) for r in planogram.greedy_start(cells.where("i < 30 OR i > 110"), plan, similarity).collect()] == [("b", 5, 24, 1.0)]


def test_rings_and_line_groups_have_no_fold_in_a_fold(spark):
    assert "lambda" not in plan_of(catalog.QUERIES["g10_g14_polygons"](spark, SF))
    optimized = catalog.QUERIES["q2_line_groups"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("aggregate(w#") == 1


def test_inference_in_a_block_is_inference_among_its_images(spark):
    from gondola.operators import match
    from tests.test_image_inference import BOX, fixture

    preds, gts = fixture()
    p, g = spark.createDataFrame(preds, f"source long, det long, cls string, {BOX}"), spark.createDataFrame(gts, f"image long, cls string, {BOX}")
    want = sorted(map(tuple, match.infer_image(p, g).collect()))
    assert sorted(map(tuple, match.infer_in_block(p.withColumn("b", F.lit(1)), g.withColumn("b", F.lit(1)), "b").collect())) == want and len(want) > 20
    assert "Generate" not in plan_of(catalog.QUERIES["j9_image_inference"](spark, SF))  # no probes


def test_a_code_is_cleaned_once(spark):
    from gondola.functions import codes

    df = spark.range(1).select(codes.sku_candidate(F.col("id").cast("string")).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 3
    texts = {"1004-567 890": "1004567890", "21004215338": "1004215338", "334-515": "334515", "x334-515": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codes.sku_candidate(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in rows.collect()} == texts
