"""Orders and running totals without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize


def hash_order(seed: int | str, key: Column) -> Column:
    """A seeded order by key: the same everywhere, whatever the partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def running_total(df: DataFrame, order: list[str], value: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """The sum of ``value`` over earlier rows (by ``order`` within ``by``) as a column, exclusive of the row.

    Rows are dealt by ranges of (by, order) and summed within each range; ranges get the totals before them from a
    table with a row for each range and group.  No group is gathered in a task.
    """
    by = by or []
    dealt = df.withColumn("__value", value.cast("long")).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    held = materialize(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    totals = held.groupBy("__range", *by).agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__range", *by, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = held.withColumn("__before", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    same = None
    for c in ["__range", *by]:
        term = summed[c].eqNullSafe(bases[c])
        same = term if same is None else same & term
    joined = summed.join(bases.select("__base", *["__range", *by]), same).select(*[summed[c] for c in df.columns], (F.col("__before") + F.col("__base")).alias(name))
    return joined


def row_numbers(df: DataFrame, order: list[str], name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """Numbers from 0 by ``order`` within ``by``."""
    return running_total(df, order, F.lit(1), name, by)
