"""Whole shelf tables, against plain versions."""

from collections import defaultdict

from gondola import catalog
from gondola.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_tracking_takes_all_boxes(spark):
    boxes = fx.pred_boxes(spark, SF)
    assert boxes.where("det > 12").count() > 0
    assert catalog.QUERIES["j22_tracking"](spark, SF).count() == boxes.count()


def ladder(a, b):
    x, y = str(int(a)), str(int(b))
    if a == 0:
        return 0.3
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.7
    d = abs(a - b)
    return 0.9 if d <= 0.1 else 0.6 if d <= 0.5 else 0.5 if d <= 1 else -1.0


def test_greedy_start_over_all_cells(spark):
    cells, plan = defaultdict(list), defaultdict(dict)
    for r in fx.price_cells(spark, SF).where("price IS NOT NULL").orderBy("bay", "pos").collect():
        cells[r["bay"]].append(float(r["price"]))
    for r in fx.sequence(spark, SF).collect():
        plan[r["bay"]][r["loc"]] = float(r["price"])
    want = {}
    for bay, prices in cells.items():
        best = None
        for start in plan[bay]:
            s = []
            for i, p in enumerate(prices):
                v = ladder(p, plan[bay][start + i]) if start + i in plan[bay] else -1.0
                if v < 0:
                    break
                s.append(v)
            if len(s) >= 3 and sum(s) / len(s) >= 0.5:
                best = min(best or (0, 0), (-len(s), start))
        if best:
            want[bay] = (best[1], -best[0])
    assert {r["bay"]: (r["start"], r["length"]) for r in catalog.QUERIES["q10_greedy_start"](spark, SF).collect()} == want


def test_image_inference_over_all_images(spark):
    gts, score = defaultdict(list), defaultdict(float)
    for g in fx.gt_boxes(spark, SF).collect():
        gts[g["image"] // 25, g["cls"]].append((g["image"], g["x1"], g["y1"], g["x2"], g["y2"]))
    for p in fx.pred_boxes(spark, SF).collect():
        best = {}
        for image, x1, y1, x2, y2 in gts[p["image"] // 25, p["cls"]]:
            inter = max(0, min(p["x2"], x2) - max(p["x1"], x1)) * max(0, min(p["y2"], y2) - max(p["y1"], y1))
            if inter > 0:
                iou = inter / ((p["x2"] - p["x1"]) * (p["y2"] - p["y1"]) + (x2 - x1) * (y2 - y1) - inter)
                best[image] = max(best.get(image, 0), iou)
        for image, iou in best.items():
            score[p["image"], image] += iou
    want = {}
    for (source, image), s in score.items():
        want[source] = max(want.get(source, (0, 0)), (round(s, 9), image))
    want = {k: v[1] for k, v in want.items() if v[0] >= 1}
    assert any(k % 25 != 3 for k in want)
    assert {r["source"]: r["image"] for r in catalog.QUERIES["j9_image_inference"](spark, SF).collect()} == want
