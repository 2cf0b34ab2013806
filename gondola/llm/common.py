"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, start: Column, state: str, kind: str, step, last=None, block: int = 128) -> Column:
    """All that ``step(state, item) -> (state, array of kind)`` puts out, and at the end ``last(state)``, in order.

    A fold copies all that it carries at every step, so that one that gathers its output takes time in the square of the
    items. Here only the state goes through all items; then each block of items is run from the state at its start.
    ``state`` and ``kind`` are SQL types.
    """
    none, zero = F.array().cast(f"array<{kind}>"), start.cast(state)

    def body(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
        of = lambda i: F.slice(xs, i * block + 1, F.lit(block))
        through = lambda s, i: F.aggregate(of(i), s, lambda a, x: step(a, x)[0])
        states = F.aggregate(blocks, F.array(zero), lambda a, i: F.concat(a, F.array(through(F.element_at(a, -1), i))))

        def one(s: Column, i: Column) -> Column:
            def put(a: Column, x: Column) -> Column:
                now, out = step(a["s"], x)
                return F.struct(now.alias("s"), F.concat(a["out"], out).alias("out"))

            return F.aggregate(of(i), F.struct(s.alias("s"), none.alias("out")), put, lambda a: a["out"])

        def run(ss: Column) -> Column:
            out = F.flatten(F.transform(blocks, lambda i: one(ss[i], i)))
            return out if last is None else F.concat(out, last(F.element_at(ss, -1)))

        return F.when(F.size(xs) > 0, let(states, run)).otherwise(none if last is None else last(zero))

    return let(items, body)


def words(text: Column) -> Column:
    """White-space separated words; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where it is unset (tests), a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="spark-gondola-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gondola-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of frames that nothing names any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame | None, sweep: bool = False) -> None:
    """Deletes tables that ``materialize`` made, once nothing reads them any more. Frames not made by it are left alone.

    With ``sweep``, Spark also lets go of the shuffle files of frames that nothing names any more.
    """
    found = [t for t in tables if getattr(t, "scratch_path", None)]
    if not found:
        return
    context = found[0].sparkSession.sparkContext
    for t in found:
        path = context._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if sweep:
        let_go(found[0].sparkSession)


def packed(rows: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The ``own`` columns and one struct of all others under a name of its own, so that no name of theirs meets an
    operator's; and a function that unpacks rows of it to the columns of ``rows``, in their order, and adds columns that
    it is given (those of the same name go).
    """
    name = f"rest_{uuid.uuid4().hex}"
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    others = [c for c in rows.columns if c not in own]
    inner = rows.select(*map(quoted, own), *([F.struct(*map(quoted, others)).alias(name)] if others else []))

    def whole(df: DataFrame, **more: Column) -> DataFrame:
        kept = [c for c in rows.columns if c.lower() not in more]
        return df.select(*[quoted(c) if c in own else F.col(name)[c].alias(c) for c in kept], *[v.alias(k) for k, v in more.items()])

    return inner, whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
