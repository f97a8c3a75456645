"""Top-k, quotas, systematic samples, splits, interleaving and replication, all in explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.order import hash_order, row_numbers


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows, numbered from 0; the bound is the feature."""
    held = df.orderBy(*order).limit(n)
    return held.withColumn("idx", F.row_number().over(Window.orderBy(*order)) - 1)


def quota(df: DataFrame, by: list[str], most: Column | int, *order: Column) -> DataFrame:
    """At most so many rows of each group; the engine keeps a group's first rows in every task before it shuffles."""
    most = F.lit(most) if isinstance(most, int) else most
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= most).drop("__rank")


def shuffled(df: DataFrame, key: str, seed: int | str = 42) -> DataFrame:
    return df.orderBy(hash_order(seed, F.col(key)), key)


def systematic(df: DataFrame, n: int, order: list[str], by: list[str]) -> DataFrame:
    """Every step-th row of each group from its first, ``n`` at most, with step = max(1, total // n)."""
    numbered = row_numbers(df, order, "__i", by)
    totals = numbered.groupBy(*by).agg(F.count("*").alias("__n"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / n))
    return numbered.join(totals, by).where((F.col("__i") % step == 0) & (F.col("__i") < step * n)).drop("__i", "__n")


def validation_split(df: DataFrame, path: str, fraction: float = 0.01) -> DataFrame:
    """``is_val`` for the last share of paths by md5, one at least; a table of files, not of rows."""
    ranked = row_numbers(df.withColumn("__m", F.md5(F.col(path).cast("string"))), ["__m", path], "__i")
    total = df.agg(F.count("*").alias("__n"))
    n_val = F.greatest(F.lit(1), F.floor(F.col("__n") * fraction))
    return ranked.crossJoin(F.broadcast(total)).withColumn("is_val", F.col("__i") >= F.col("__n") - n_val).drop("__m", "__i", "__n")  # one row


def batches(df: DataFrame, size: int, order: list[str], name: str = "batch") -> DataFrame:
    """Batch numbers of fixed size in order."""
    return row_numbers(df, order, "__i").withColumn(name, F.floor(F.col("__i") / size)).drop("__i")


def alternate(df: DataFrame, order: list[str]) -> DataFrame:
    """Side A for even places, B for odd ones."""
    return row_numbers(df, order, "__i").withColumn("side", F.when(F.col("__i") % 2 == 0, "A").otherwise("B")).drop("__i")


def interleaved(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Rows of two tables in turn, then the tail of the longer: ``place`` in the result's order."""
    both = row_numbers(a, order, "__i").withColumn("side", F.lit(0)).unionByName(row_numbers(b, order, "__i").withColumn("side", F.lit(1)))
    return row_numbers(both, ["__i", "side"], "place").drop("__i")


def replicated(df: DataFrame, times: int, key: str, seed: int | str = 42) -> DataFrame:
    """Every row so many times with its copy's number and place in a seeded order of all copies."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return copies.withColumn("place_key", hash_order(seed, F.concat_ws(":", F.col("copy").cast("string"), F.col(key).cast("string"))))


def window_starts(df: DataFrame, path: Column, tokens: Column, length: int = 2048) -> DataFrame:
    """Sequence starts of shards: from a hashed offset in steps of ``length``; odd shards backwards."""
    n = tokens - length
    offset = F.pmod(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long"), n)
    starts = F.sequence(offset, n - 1, F.lit(length).cast("long"))
    ordered = F.when(F.col("shard") % 2 == 1, F.reverse(starts)).otherwise(starts)
    return df.where(n > 0).select("shard", F.posexplode(ordered).alias("place", "start"))
