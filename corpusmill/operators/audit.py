"""Audits: percentiles, comparisons, elementwise means, streaks, manifests and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (10, 25, 50, 75, 90, 95, 99)


def percentiles(df: DataFrame, value: str, by: str, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """``n, mean`` and exact interpolated percentiles of each group and, with null as group, of all rows."""
    at = F.percentile(value, F.array(*[F.lit(p / 100) for p in percents]))
    held = df.rollup(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), at.alias("p"))
    return held.select(by, "n", "mean", *[F.col("p")[i].alias(f"p{p}") for i, p in enumerate(percents)])


def side_by_side(df: DataFrame, by: str, column: str, names: tuple[str, str], value: str) -> DataFrame:
    """Mean of each group under two names, and the second less the first."""
    out = df.groupBy(by).pivot(column, list(names)).agg(F.avg(value))
    return out.withColumn("delta", F.col(names[1]) - F.col(names[0]))


def elementwise_mean(df: DataFrame, by: str, vector: str) -> DataFrame:
    """``by, place, mean``: the mean of each place of vectors."""
    return df.select(by, F.posexplode(vector).alias("place", "x")).groupBy(by, "place").agg(F.avg("x").alias("mean"))


def latest(df: DataFrame, by: list[str], at: Column, *columns: str) -> DataFrame:
    """The latest record of each group."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), at).alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in columns])


def retained(df: DataFrame, by: list[str], step: str, keep: int) -> DataFrame:
    """The last ``keep`` snapshots of each run; 0 keeps all."""
    if keep <= 0:
        return df
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(step)))).where(F.col("__r") <= keep).drop("__r")


def growth(df: DataFrame, by: list[str], at: str, size: str) -> DataFrame:
    """Difference and rate against the record before, and how long each run without growth is."""
    order = Window.partitionBy(*by).orderBy(at)
    seconds = lambda c: F.col(c).cast("timestamp").cast("double") if dict(df.dtypes)[c].startswith("timestamp") else F.col(c).cast("double")
    held = df.withColumn("delta", F.col(size) - F.lag(size).over(order)).withColumn("seconds", seconds(at) - F.lag(seconds(at)).over(order))
    held = held.withColumn("rate", F.when(F.col("seconds") > 0, F.col("delta") / F.col("seconds")))
    flat = F.col("delta").isNotNull() & (F.col("delta") <= 0)
    island = F.sum(F.when(flat, 0).otherwise(1)).over(order)
    held = held.withColumn("__island", island)
    streak = F.sum(F.when(flat, 1).otherwise(0)).over(Window.partitionBy(*by, "__island").orderBy(at))
    return held.withColumn("streak", F.when(flat, streak).otherwise(0)).drop("__island")


def missing_files(listing: DataFrame, local: DataFrame, share: float = 0.99) -> DataFrame:
    """Listed files without a local one of at least a share of their size."""
    a, b = listing.alias("a"), local.alias("b")
    enough = (F.col("a.path") == F.col("b.path")) & (F.col("a.size") > 0) & (F.col("b.size") >= share * F.col("a.size"))
    return a.join(b, enough, "left_anti")


def starts(df: DataFrame, path: str, n: Column) -> DataFrame:
    """Shards without sequences dropped, and the sequences before each (``start``): one row a shard."""
    from corpusmill.operators.order import running_total

    held = df.withColumn("n_seqs", n.cast("long")).where("n_seqs > 0")
    return running_total(held, [path], F.col("n_seqs"), "start")


def boundary_mean(total: Column, n: Column, last: Column) -> Column:
    """The interval's mean, else the last one logged."""
    return F.coalesce(F.when(n > 0, total / n), last)
