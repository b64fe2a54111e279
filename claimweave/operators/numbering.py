"""Running numbers and sums over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.tables import written


def running_total(df: DataFrame, order: list[str], amount: Column, out: str) -> DataFrame:
    """df with the sum of ``amount`` over all rows before each one, in the order of the named columns.

    Rows go to ranges of the order; each range sums up by itself, and one row for each range
    tells the others its total. The ranges are written once, since their bounds are drawn from
    a sample. Rows alike in the order follow each other in any order. A null amount counts as 0.
    """
    part, own, base = (f"__{out}_{x}" for x in ("part", "own", "base"))
    ranges = written(df.withColumn(own, F.coalesce(amount, F.lit(0)).cast("long")).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(part).agg(F.sum(own).alias(base))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.withColumn(base, F.coalesce(F.sum(base).over(earlier), F.lit(0)))
    inner = ranges.withColumn(out, F.coalesce(F.sum(own).over(before), F.lit(0)))
    return inner.join(F.broadcast(starts), part).withColumn(out, F.col(out) + F.col(base)).select(*df.columns, out)


def numbered(df: DataFrame, order: list[str], out: str = "uid") -> DataFrame:
    """df with 0-based numbers in the order of the named columns."""
    return running_total(df, order, F.lit(1), out)


def dense_uid(rows: DataFrame, key: str, order: list[str], uid: str = "uid") -> DataFrame:
    """(key, uid): 0-based numbers of the keys in the order of first sight. A null key is a key."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first_sight"))
    return numbered(first, ["first_sight"], uid).drop("first_sight")
