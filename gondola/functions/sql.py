"""The scalar functions for ``spark.sql``: temporary SQL functions with the text of the same column expressions.

``register`` makes one function ``shelf_<name>`` for each entry. They run as the column forms do, inside generated code;
no Python is involved after registration. Boxes are passed as four numbers, results of several parts are structs.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gondola.functions import boxes as bx
from gondola.functions import codes
from gondola.functions.boxes import Box

TEXT, NUMBER, WHOLE, TRUTH = "string", "double", "bigint", "boolean"


def _parts(found: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in found.items()])


def _one_box(f: Callable, *rest: str) -> tuple[Callable, str]:
    """``f(box, *rest)`` as a function of numbers; boxes come back as structs."""

    def run(*args: Column) -> Column:
        got = f(Box(*args[:4]), *args[4:])
        return got.struct() if isinstance(got, Box) else got if isinstance(got, Column) else F.struct(*[c.alias(f"v{i + 1}") for i, c in enumerate(got)])

    return run, ", ".join(f"{n} {NUMBER}" for n in ("x1", "y1", "x2", "y2", *rest))


def _two_boxes(f: Callable, *rest: str) -> tuple[Callable, str]:
    def run(*args: Column) -> Column:
        got = f(Box(*args[:4]), Box(*args[4:8]), *args[8:])
        return _parts(got) if isinstance(got, dict) else got

    return run, ", ".join(f"{n} {NUMBER}" for n in ("x1", "y1", "x2", "y2", "a1", "b1", "a2", "b2", *rest))


def _typed(f: Callable, *kinds: str) -> tuple[Callable, str]:
    names = [p for p in inspect.signature(f).parameters][: len(kinds)]

    def run(*args: Column) -> Column:
        got = f(*args)
        return _parts(got) if isinstance(got, dict) else got

    return run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))


#: name -> (function of columns, its parameters)
SCALARS: dict[str, tuple[Callable, str]] = {
    **{f.__name__: _typed(f, TEXT) for f in (
        codes.digits, codes.published_sku, codes.clean_expected, codes.sku_candidate, codes.token, codes.valid_token, codes.is_na, codes.digit_class, codes.scorability,
        codes.expected_input, codes.class_token, codes.recovered, codes.parse_box_text, codes.line_boxes, codes.uri_parts, codes.file_details, codes.epoch_ms, codes.price,
        codes.source_priority, codes.plain_label, codes.first_digits, codes.image_urls, codes.base_name,
    )},
    "preferred_text": _typed(codes.preferred_text, "array<string>"),
    "review_status": _typed(codes.review_status, TEXT, TEXT, TEXT),
    "box_text": _typed(codes.box_text, WHOLE, WHOLE, WHOLE, WHOLE),
    "price_key": _typed(codes.price_key, NUMBER),
    **{f.__name__: _typed(f, NUMBER, NUMBER) for f in (codes.price_contains, codes.price_similarity, codes.cents_similarity, bx.label_score, bx.fitness, bx.fused_confidence)},
    "blended": _typed(codes.blended, NUMBER, NUMBER, NUMBER, TRUTH),
    "empty_region_key": _typed(codes.empty_region_key, TEXT, WHOLE),
    "item_code": (lambda x: x.rlike(codes.ITEM_CODES), f"x {TEXT}"),
    "vendor_code": (lambda x: x.rlike(codes.VENDOR_CODES), f"x {TEXT}"),
    **{f"box_{f.__name__}": _one_box(f) for f in (bx.valid, bx.to_xywh)},
    "box_area": _one_box(lambda b: b.area),
    "box_centre": _one_box(lambda b: (b.cx, b.cy)),
    "box_parse": _one_box(lambda b: bx.parse(*b)),
    "box_contains_point": _one_box(bx.contains_point, "x", "y"),
    "box_buffer": _one_box(bx.buffer, "width", "height", "share"),
    "box_pad": _one_box(bx.pad, "margin"),
    "box_unpad": _one_box(bx.unpad, "margin"),
    "box_shrink": _one_box(bx.shrink, "share"),
    "box_clip": _one_box(bx.clip, "width", "height"),
    "box_turned_180": _one_box(bx.turned_180, "width", "height"),
    "box_shifted": _one_box(bx.shifted, "dx", "dy"),
    "box_beam_line_x": _one_box(bx.beam_line_x, "y"),
    **{f"box_{f.__name__}": _two_boxes(f) for f in (bx.intersection, bx.iou, bx.coverage, bx.overlaps, bx.inside, bx.iou_family)},
    **{f.__name__: _typed(f, *[NUMBER] * n) for f, n in ((bx.deskew, 1), (bx.beam_score, 1), (bx.quadrant, 4), (bx.binned, 2), (bx.wh_iou, 4), (bx.principal_angle, 4), (bx.wilson, 2), (bx.precision_recall, 3))},
}

_LITERAL = re.compile(r"('(?:[^'\\]|\\.|'')*')")
_DOUBLE = re.compile(r"(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])")
_OPERATOR = re.compile(r"(?<![\w`])(and|or|in|not|[-+*/%=<>!|&^~]+)\(")


def text_of(column: Column) -> str:
    """SQL text of an expression; operators, which it names as functions, are quoted so that they parse as such, and
    doubles are marked so that they don't become decimals."""
    parts = _LITERAL.split(column._jc.node().sql())
    plain = lambda p: re.sub(r"\b(Infinity|NaN)\b", r"CAST('\1' AS DOUBLE)", _DOUBLE.sub(r"\1D", _OPERATOR.sub(r"`\1`(", p)))
    return "".join(p if i % 2 else plain(p) for i, p in enumerate(parts))


def register(spark: SparkSession, prefix: str = "shelf_") -> list[str]:
    """Makes all of SCALARS known to ``spark.sql``; their names."""
    for name, (f, parameters) in SCALARS.items():
        arguments = [F.col(p.split()[0]) for p in parameters.split(", ")]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURN {text_of(f(*arguments))}")
    return [prefix + name for name in SCALARS]
