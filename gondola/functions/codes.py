"""Codes, labels, prices and keys as column expressions, without Python UDFs.

Digits are ASCII digits on both sides of every comparison; casts that fail give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: review vocabulary
NA_VALUES = ("N/A", "NA", "N-A", "X")
NON_SCORABLE = ("non_scorable", "motion_blur", "glare", "occluded", "cropped", "resolution_too_low", "damaged_label", "unreadable", "ambiguous", "other")
LEGACY_SCORABLE = ("reviewed", "reviewed_ocr_assisted")
NOTE_REASONS = (
    ("motion_blur", "motion blur|blur"), ("glare", "glare"), ("occluded", "occluded|occlusion"), ("cropped", "cropped|crop cut"),
    ("resolution_too_low", "resolution|too small|low res"), ("damaged_label", "damaged|damage"), ("ambiguous", "ambiguous|uncertain"),
)
REQUIRED = "expected_sku is required (enter SKU digits or N/A with notes)."
WRONG_LENGTH = "expected_sku must be exactly 6 or 10 characters (digits and X for unclear digits)."
# fixed values: item and vendor code shapes
# fixed values: the shapes of item codes, one a line. \d and \W are those of Java, so ASCII digits and word characters.
ITEM_SHAPES = (
    r"\d{6}",
    r"\d{10}",
    r"\d{3}-\d{3}",
    r"\d{4}-\d{3}-\d{3}",
    r"SKU:\d{6}",
    r"SKU:\d{10}",
    r"SKU-\d{6}",
    r"SKU-\d{10}",
)
# fixed values: the shapes of vendor codes, one a line
VENDOR_SHAPES = (
    r"\d{4}\W\d{3}\W\d{3}",
    r"\d{2}\W\d{4}\W\d{3}\W\d{3}",
    r"\d{2}\WSKU#\d{4}\W\d{3}\W\d{3}",
    r"SKU#\d{4}\W\d{3}\W\d{3}",
    r"SKU\W\d{4}\W\d{3}\W\d{3}",
    r"SKU#\d{10}",
    r"\d{6}",
    r"\d{2}\W\d{6}",
    r"\d{2}\WSKU\W#\d{6}",
    r"\d{2}\WSKU#\W\d{6}",
    r"\d{3}\W\d{3}",
    r"\d{2}\W\d{3}\W\d{3}",
    r"\d{2}\W\d{10}",
)
ITEM_CODES = f"^(?:{'|'.join(ITEM_SHAPES)})$"
VENDOR_CODES = f"^(?:{'|'.join(VENDOR_SHAPES)})$"
DATES = r"^(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$"
DASHES = "‐‑‒–—"


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def zfill(x: Column, n: int) -> Column:
    """Zeros in front up to ``n`` characters; longer texts stay whole."""
    return F.when(F.length(x) < n, F.lpad(x, n, "0")).otherwise(x)


def published_sku(x: Column) -> Column:
    """Ten digits, six zero-filled to ten, else null; an integral number as text counts as its digits."""
    d = digits(F.regexp_replace(x, r"^\s*([0-9]+)\.0+\s*$", "$1"))
    return F.when(F.length(d) == 10, d).when(F.length(d) == 6, F.lpad(d, 10, "0"))


def clean_expected(x: Column) -> Column:
    """Digits only, but blank and not-available values as they are."""
    return F.when((F.trim(x) == "") | is_na(x), x).otherwise(digits(x))


def _first(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def rescue(d: Column) -> Column:
    """6 or 10 digits from digits with extra ones around a code that begins with 10; else null."""
    n = F.length(d)
    return (
        F.when((n == 11) & (F.substring(d, 2, 2) == "10"), F.substring(d, 2, 10))
        .when(n.isin(11, 12) & F.startswith(d, F.lit("10")), F.substring(d, 1, 10))
        .when((n > 10) & (F.substring(d, -10, 2) == "10"), F.substring(d, -10, 10))
        .when(n.isin(6, 10), d)
    )


def sku_candidate(x: Column) -> Column:
    """A 6- or 10-digit code in OCR text: an isolated run of ten, then of six; else what is left of clean digits."""
    core = F.regexp_replace(F.regexp_replace(x, "^[^0-9]+", ""), "[^0-9]+$", "")
    # a lambda's variable is worked out once, where a column would be worked out anew in each branch that names it
    once = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    clean = once(core, lambda c: F.when(c.rlike(rf"^[0-9\s\-{DASHES}]+$"), F.regexp_replace(c, rf"[\s\-{DASHES}]+", "")))
    saved = F.when(~x.rlike("[A-Za-z]"), once(clean, rescue))
    return F.coalesce(_first(x, "(?:^|[^0-9])([0-9]{10})(?:$|[^0-9])"), _first(x, "(?:^|[^0-9])([0-9]{6})(?:$|[^0-9])"), saved)


def token(x: Column) -> Column:
    """Digits and X without separators; anything else gives the empty text."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s\-_./]", "")
    return F.when(t.rlike("^[0-9Xx]+$"), F.upper(t)).otherwise("")


def valid_token(x: Column) -> Column:
    return F.length(token(x)).isin(6, 10)


def is_na(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit("")))).isin(*NA_VALUES)


def digit_class(x: Column) -> Column:
    n = F.length(token(x))
    return F.when(is_na(x), "not-visible").when(n == 6, "6-digit").when(n == 10, "10-digit").otherwise("")


def scorability(x: Column) -> Column:
    return F.when(is_na(x), "non-scorable").when(valid_token(x), "scorable").otherwise("")


def review_status(status: Column, sku: Column, notes: Column) -> Column:
    """The canonical status; a value that says "not applicable" takes its reason from the notes, first hit wins."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(status, F.lit("")))), " ", "_")
    n = F.lower(F.coalesce(notes, F.lit("")))
    reason = F.lit("unreadable")
    for name, terms in reversed(NOTE_REASONS):
        reason = F.when(n.rlike(terms), name).otherwise(reason)
    return (
        F.when(s.isin("scorable", *LEGACY_SCORABLE), "scorable").when(s.isin(*NON_SCORABLE), s)
        .when((s == "not_applicable") | is_na(sku), reason).when(valid_token(sku), "scorable").otherwise("")
    )


def expected_input(raw: Column) -> Column:
    """struct<value, error> of what a reviewer typed."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    ok = valid_token(t)
    value = F.when(t == "", None).when(is_na(t), F.when(F.upper(t) == "X", "X").otherwise("N/A")).when(ok, token(t))
    error = F.when(t == "", REQUIRED).when(is_na(t) | ok, None).otherwise(WRONG_LENGTH)
    return F.struct(value.alias("value"), error.alias("error"))


def class_token(x: Column) -> Column:
    """Lower-case letters, without a final "sku", one common misspelling folded."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z]", ""), "sku$", "")
    return F.when(t.isin("handwritte", "handwritten"), "handwritten").otherwise(t)


def preferred_text(texts: Column) -> Column:
    """The valid token that is longest, then greatest; empty if none is valid."""
    good = F.filter(F.transform(texts, token), lambda t: F.length(t).isin(6, 10))
    best = F.array_max(F.transform(good, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    return F.coalesce(best["t"], F.lit(""))


def recovered(x: Column) -> Column:
    """Codes inside noisy text, in the order of the rules; texts that look like dates have none."""
    d = digits(x)
    n = F.length(d)
    rules = F.array(
        F.when((n == 10) & F.startswith(d, F.lit("10")), d),
        F.when((n == 11) & (F.substring(d, 2, 2) == "10"), F.substring(d, 2, 10)),
        F.when(n.isin(11, 12) & F.startswith(d, F.lit("10")), F.substring(d, 1, 10)),
        F.when((n > 10) & (F.substring(d, -10, 2) == "10"), F.substring(d, -10, 10)),
    )
    return F.when(x.rlike(DATES), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(rules)))


def box_text(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.format_string("{'%d','%d','%d','%d'}", x1, y1, x2, y2)


def parse_box_text(x: Column) -> Column:
    """array of (x1, y1, x2, y2); a last group of fewer than four numbers is dropped. Numbers beyond an int are null."""
    n = F.transform(F.regexp_extract_all(x, F.lit("(-?[0-9]+)"), F.lit(1)), lambda v: v.try_cast("int"))
    whole = F.floor(F.size(n) / 4).cast("int")
    box = lambda i: F.struct(n[i * 4].alias("x1"), n[i * 4 + 1].alias("y1"), n[i * 4 + 2].alias("x2"), n[i * 4 + 3].alias("y2"))
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), box)).otherwise(F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>"))


def line_boxes(x: Column) -> Column:
    """Boxes of the point lists in parentheses, ``(x y, x y, ...)``; lists of fewer than two points are dropped."""
    lists = F.regexp_extract_all(x, F.lit(r"\(([^()]*)\)"), F.lit(1))

    def numbers(t: Column) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda v: v.cast("double"))

    def box(v: Column) -> Column:
        xs, ys = F.filter(v, lambda _, i: i % 2 == 0), F.filter(v, lambda _, i: i % 2 == 1)
        return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))

    return F.transform(F.filter(F.transform(lists, numbers), lambda v: F.size(v) >= 4), box)


def uri_parts(uri: Column, scheme: str = "gs") -> Column:
    """struct<bucket, name> of ``scheme://bucket/name``; null if it has another form."""
    p = rf"(?s)^{scheme}://(.*?)/(.*)"
    return F.when(uri.rlike(p), F.struct(F.regexp_extract(uri, p, 1).alias("bucket"), F.regexp_extract(uri, p, 2).alias("name")))


def file_details(name: Column) -> Column:
    """struct<store, bay> of ``<digits>#<4-digit store>#...#<aisle-bay>`` with an optional image suffix; else null."""
    p = r"^[0-9]+#([0-9]{4})#.*?#([0-9]{2}-[0-9]{3})(?:\.jpg|\.jpeg|\.webp)?$"
    return F.when(name.rlike(p), F.struct(F.regexp_extract(name, p, 1).alias("store"), F.regexp_extract(name, p, 2).alias("bay")))


def epoch_ms(iso: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(iso))


def price(x: Column) -> Column:
    """struct<valid, full, dollars, cents> of a price text."""
    v = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\$", "").try_cast("double")
    return F.struct(v.isNotNull().alias("valid"), v.alias("full"), v.cast("int").alias("dollars"), F.rint((v % 1) * 100).cast("int").alias("cents"))


def price_key(p: Column, mode: str = "round") -> Column:
    """Whole dollars, or cents below one dollar (rounded half to even, or cut)."""
    cents = F.rint(p * 100) if mode == "round" else p * 100
    return F.when(p >= 1, p.cast("int")).otherwise(cents.cast("int"))


def price_contains(a: Column, b: Column) -> Column:
    x, y = F.abs(price_key(a)).cast("string"), F.abs(price_key(b)).cast("string")
    return (x != y) & (F.contains(x, y) | F.contains(y, x))


def price_similarity(seen: Column, known: Column) -> Column:
    away = F.abs(seen - known)
    return (
        F.when(seen == 0, 0.3).when(price_key(seen) == price_key(known), 1.0).when(price_contains(seen, known), 0.7).when(away <= 0.10, 0.9)
        .when(away <= 0.50, 0.6).when(away <= 1.00, 0.5).when((seen.cast("int") == known.cast("int")) & (away < 2.0), 0.6).otherwise(-1.0)
    )


def cents_similarity(a: Column, b: Column) -> Column:
    x, y = (F.rint((p % 1) * 100).cast("int") for p in (a, b))
    tens = lambda v: F.floor(v / 10)
    return F.when(tens(x) == tens(y), 0.6).otherwise(0.0) + F.when(x % 10 == y % 10, 0.4).otherwise(0.0)


def blended(core: Column, extended: Column, cents: Column, edge: Column) -> Column:
    return F.when(edge, core * 0.8 + extended * 0.15 + cents * 0.05).otherwise(core * 0.7 + extended * 0.2 + cents * 0.1)


def region_key(image: Column, label: Column, box) -> Column:
    return F.concat_ws("|", image, label, *box)


def crop_name(index: Column, label: Column, box) -> Column:
    return F.concat(F.concat_ws("_", zfill(index.cast("string"), 3), label, *box), F.lit(".jpg"))


def slot_id(cx: Column, cy: Column, size: float) -> Column:
    """The binned centre with one decimal (bins half to even)."""
    bin_ = lambda v: F.format_string("%.1f", F.bround(v / size) * size)
    return F.concat_ws(",", bin_(cx), bin_(cy))


def empty_region_key(url_tail: Column, index: Column) -> Column:
    return F.concat_ws("::", url_tail, index)


def rotation_text(hints: Column) -> Column:
    """``angle:sku|...`` of an array of (angle, sku), by angle."""
    return F.array_join(F.transform(F.array_sort(hints), lambda h: F.concat_ws(":", h["angle"], h["sku"])), "|")


def best_rotation(text: Column, preferred: Column) -> Column:
    """The hinted angle nearest to upright (full turns don't count), then the smaller one; 0 without hints.

    Hints for the preferred code win; without any, an upright hint, then all hints count.
    """
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: F.split(p, ":", 2))
    ranked = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].try_cast("double").alias("angle"), digits(p[1]).alias("sku")))
    ranked = F.filter(ranked, lambda x: x["angle"].isNotNull())

    def nearest(xs: Column) -> Column:
        rank = lambda x: F.struct(F.abs(F.pmod(x["angle"] + 180.0, F.lit(360.0)) - 180.0).alias("turn"), F.abs(x["angle"]).alias("size"), x["angle"].alias("angle"))
        return F.array_min(F.transform(xs, rank))["angle"]

    want = digits(preferred)
    return F.coalesce(F.when(want != "", nearest(F.filter(ranked, lambda x: x["sku"] == want))), nearest(ranked), F.lit(0.0))


def source_priority(source: Column) -> Column:
    s = F.coalesce(source, F.lit(""))
    return (
        F.when(s.isin("", "google_ocr_sku_parse"), 0).when(F.contains(s, F.lit("enhanced")), 1).when(s.rlike("rot5|rotneg5"), 2)
        .when(s.rlike("rot10|rotneg10"), 3).when(F.contains(s, F.lit("rot180")), 4).otherwise(5)
    )


def plain_label(x: Column) -> Column:
    """Lower-case letters only (yes, no, unsure)."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z]", "")


def first_digits(x: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), digits), lambda d: d != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def image_urls(text: Column, kinds: Sequence[str] = (".jpg", ".jpeg", ".png", ".webp")) -> Column:
    """array of URLs in the text that name an image, closing punctuation cut."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"""(https?://[^\s"'<>\\]+)"""), F.lit(1)), lambda u: F.regexp_replace(u, r"[).,;\]]+$", ""))
    return F.filter(found, lambda u: F.lower(u).rlike("|".join(k.replace(".", r"\.") for k in kinds)))


def base_name(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)$", 1)


def expected_status(expected: Column, reads: Column) -> Column:
    """not_applicable, needs_ground_truth, correct or incorrect: the expected code among the codes that were read."""
    d = digits(expected)
    return F.when(is_na(expected), "not_applicable").when(d == "", "needs_ground_truth").when(F.array_contains(reads, d), "correct").otherwise("incorrect")
