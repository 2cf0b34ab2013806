"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from gondola.functions import boxes as bx
from gondola.functions import codes
from gondola.functions.boxes import Box


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def box(*v):
    return Box(*map(F.lit, v))


def test_iou_of_half_shifted_boxes(spark):
    assert one(spark, bx.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, bx.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert one(spark, bx.iou(box(0, 0, 0, 0), box(0, 0, 0, 0), empty_value=1.0)) == 1.0


def test_wilson(spark):
    ci = bx.wilson(F.lit(5), F.lit(10))
    assert one(spark, ci["low"]) == pytest.approx(0.2366, abs=1e-3)
    assert one(spark, ci["high"]) == pytest.approx(0.7634, abs=1e-3)


@pytest.mark.parametrize(
    ("text", "want"),
    [("1004334515", "1004334515"), ("1004 334-515", "1004334515"), ("$123456:", "123456"), ("D28 04/01/26", None), ("22 1004215338", "1004215338"), ("11004334515", "1004334515"), ("023 02/05/26", None), ("12345", None), ("", None)],
)
def test_sku_candidate(spark, text, want):
    assert one(spark, codes.sku_candidate(F.lit(text))) == want


@pytest.mark.parametrize(("raw", "value"), [("123456", "123456"), ("12-34.56", "123456"), ("x", "X"), ("n/a", "N/A"), ("12x456", "12X456"), ("123", None), (" ", None)])
def test_expected_input(spark, raw, value):
    got = one(spark, codes.expected_input(F.lit(raw)))
    assert got["value"] == value and (got["error"] is None) == (value is not None)


def test_prices(spark):
    assert one(spark, codes.price_similarity(F.lit(14.97), F.lit(14.0))) == 1.0
    assert one(spark, codes.price_similarity(F.lit(14.0), F.lit(140.0))) == 0.7
    assert one(spark, codes.price_similarity(F.lit(20.0), F.lit(50.0))) == -1.0
    assert one(spark, codes.price(F.lit("$7.99")))["cents"] == 99
    assert one(spark, codes.price(F.lit("Empty")))["valid"] is False


def test_zfill_keeps_long_texts(spark):
    assert one(spark, codes.zfill(F.lit("12345"), 4)) == "12345"
    assert one(spark, codes.zfill(F.lit("12"), 4)) == "0012"


def test_rotation_and_source(spark):
    assert one(spark, codes.best_rotation(F.lit("90:1|-5:2"), F.lit(""))) == -5.0
    assert one(spark, codes.best_rotation(F.lit("90:1|-5:2"), F.lit("1"))) == 90.0
    assert one(spark, codes.source_priority(F.lit("google_rot180"))) == 4


def test_box_text_round_trip(spark):
    text = codes.box_text(*map(F.lit, (1, 2, 3, 4)))
    assert [tuple(b) for b in one(spark, codes.parse_box_text(F.concat(text, F.lit(", "), text)))] == [(1, 2, 3, 4)] * 2
