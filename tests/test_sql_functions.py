"""Every SQL function against the column expression that it is made of."""

import math

import pytest
from pyspark.sql import functions as F

from gondola.functions import sql

TEXTS = [None, "", "123456", "1001-234-567", "SKU:123456", "12 SKU#1234-567-890", "$1,234.50", "0.99", "N/A", "x", "12345X", "Shelves", "TRUE ", "no", "{'10', '20', '100', '50'}", "LINESTRING(1 2, 30 40)", "gs://bucket/a/b.jpg",
         "1775040219354_0639_1219_29-014.jpg", "2024-05-06T07:08:09Z", "see https://x.example.com/a.jpg, and b", "google|12|345", "it's \\d", "02/05/26 1004"]
NUMBERS = [0.0, 1.0, 2.5, 10.0, 7.25, 33.0, 0.5, -4.0, 100.0, 12.99, 13.49]


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b)
    return type(a) is type(b) and (len(a) == len(b) and all(map(same, a, b)) if isinstance(a, (tuple, list)) else a == b)


@pytest.mark.parametrize("name", sql.SCALARS)
def test_function(spark, names, name):
    f, parameters = sql.SCALARS[name]
    fields = [p.split() for p in parameters.split(", ")]
    pools = {"string": TEXTS, "double": NUMBERS, "bigint": [0, 1, 17, None], "boolean": [True, False], "array<string>": [[], None, ["123456", "1234567890", None]]}
    fine = lambda n, v: 16.0 if n == "size" else v
    rows = [tuple(fine(fields[j][0], pools[kind][(i * (3 * j + 1) + j) % len(pools[kind])]) for j, (_, kind) in enumerate(fields)) for i in range(40)]
    df = spark.createDataFrame(rows, parameters)
    df.createOrReplaceTempView("given")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    want = df.select(f(*[F.col(n) for n, _ in fields]).alias("v"))
    got = spark.sql(f"SELECT shelf_{name}({', '.join(n for n, _ in fields)}) AS v FROM given")
    assert f"shelf_{name}" in names and got.schema["v"].dataType == want.schema["v"].dataType
    assert all(same(a["v"], b["v"]) for a, b in zip(want.collect(), got.collect(), strict=True))


def test_in_a_query(spark, names):
    got = spark.sql("SELECT shelf_box_iou(0, 0, 10, 10, 5, 0, 15, 10) AS iou, shelf_published_sku('123-456') AS sku WHERE shelf_item_code('123-456') AND NOT shelf_vendor_code('abc')").first()
    assert abs(got["iou"] - 1 / 3) < 1e-12 and got["sku"] == "0000123456"
