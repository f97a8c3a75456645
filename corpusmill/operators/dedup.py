"""First-wins deduplication by explicit order, fingerprints and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key (null is a key like others); ``order`` must identify rows.

    The least order of a key comes from partial aggregation, so a key that a third of all rows share needs no task
    of its own; rows then stay by a semi join on their order.
    """
    winners = df.groupBy(key.alias("__key")).agg(F.min(F.struct(*order)).alias("__first")).select([F.col(f"__first.{c}").alias(f"__{c}") for c in order])
    same = F.lit(True)
    for c in order:  # an order may be null
        same = same & df[c].eqNullSafe(winners[f"__{c}"])
    return df.join(winners, same, "left_semi")


def by_prefix(df: DataFrame, text: Column, order: list[str], n: int = 300) -> DataFrame:
    """One row for each md5 of the first ``n`` characters; filters on scores belong after it."""
    return first_wins(df, F.md5(F.substring(text, 1, n)), order)


def prefer(sources: list[DataFrame], key: Column, order: list[str]) -> DataFrame:
    """Union in which earlier sources win a key, then the first row."""
    ranked = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    union = ranked[0]
    for s in ranked[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    return first_wins(union, key, ["__source", *order])


def sequence_key(tokens: Column, n: int = 13) -> Column:
    """The first and last ``n`` tokens; shorter sequences share one key."""
    ends = F.concat_ws(",", F.concat(F.slice(tokens, 1, n), F.slice(tokens, -n, n)).cast("array<string>"))
    return F.when(F.size(tokens) < n, F.lit("0")).otherwise(ends)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't completed, with one declared key type on both sides."""
    kinds = dict(df.dtypes)
    return df.join(done.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys]).distinct(), keys, "left_anti")
