"""Running totals, running maxima and neighbours over one total order of any length, without a task that sees all of it.

``place`` deals rows to ranges of the order and numbers them. Each range is then scanned by itself; what the ranges before
it (or behind it) come to is a table with a row for each range and group, whose running totals are added to its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gondola.sources.scratch import shared_path, written

PLACE, PART = "_place", "_part"
#: Behind every place.
LAST = 2**63 - 1


def place(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` in the shared folder with ``_place``, which grows along ``order``, and ``_part``, the range of a row.

    Ranges come from a sample of the order, so that the rows are read twice: they are written first, not made twice.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "ordered")
    df = written(df)
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.schema(StructType([*df.schema.fields, StructField(PLACE, LongType())])).parquet(path).withColumn(PART, F.shiftright(PLACE, 33))


def _meet(rows: DataFrame, parts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` of the range and group that they are in; groups may be null."""
    other = parts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate([PART, *keys])], *columns)
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate([PART, *keys])]
    return rows.join(other, same).drop(*[f"_{i}" for i in range(len(keys) + 1)])


def _scanned(placed: DataFrame, base: DataFrame, values: Mapping[str, Column], scan: Callable[[str], Column]) -> DataFrame:
    """``placed`` and ``base`` rows with ``scan`` of each value: what other ranges come to is a row of its range and group,
    ahead of the others, so that the rows are shuffled once and meet no table."""
    rows = placed.withColumns({f"_value_{k}": v for k, v in values.items()}).unionByName(base, allowMissingColumns=True)
    return rows.withColumns({k: scan(f"_value_{k}") for k in values}).drop(*[f"_value_{k}" for k in values])


def running_sums(placed: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``placed`` with the sum of each of ``sums`` over the rows of the same keys up to and with this one."""
    keys = list(keys)
    here = Window.partitionBy(PART, *keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(PART, *keys).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    base = totals.select(PART, *keys, F.lit(-1).cast("bigint").alias(PLACE), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_value_{k}") for k in sums])
    return _scanned(placed, base, sums, lambda c: F.sum(c).over(here)).where(F.col(PLACE) >= 0)


def maxima_ahead(placed: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """``placed`` with the greatest of each of ``values`` over the rows of the same keys from this one on."""
    keys = list(keys)
    here = Window.partitionBy(PART, *keys).orderBy(F.col(PLACE).desc()).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy(PART, *keys).agg(*[F.max(v).alias(k) for k, v in values.items()])
    base = tops.select(PART, *keys, F.lit(LAST).alias(PLACE), *[F.max(k).over(behind).alias(f"_value_{k}") for k in values])
    return _scanned(placed, base, values, lambda c: F.max(c).over(here)).where(F.col(PLACE) < LAST)


def following(placed: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``placed`` with ``name``: a struct of ``columns`` of the next row in the order (null for the last)."""
    here = Window.partitionBy(PART).orderBy(PLACE)
    firsts = placed.groupBy(PART).agg(F.min_by(F.struct(*columns), PLACE).alias("_first"))
    heads = firsts.select(PART, F.lead("_first").over(Window.orderBy(PART)).alias("_head"))  # a row a range
    local = placed.withColumn(name, F.lead(F.struct(*columns)).over(here))
    return _meet(local, heads, [], ["_head"]).withColumn(name, F.coalesce(name, "_head")).drop("_head")
