"""Telemetry: log lines, count windows, and stateful controllers over streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bounds of the download controller.
LOW, HIGH, LEAST, MOST, LOWS, STALLS = 0.15, 1.2, 6, 8, 2, 4


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fields of training log lines; lines of another kind are dropped.  Works on batches and streams."""
    field = lambda pattern: F.regexp_extract(value, pattern, 1)
    head = r"Step\s+([\d,]+)/"
    return lines.where(F.col(value).rlike(head)).select(
        F.regexp_replace(field(head), ",", "").try_cast("long").alias("step"),
        F.regexp_replace(field(r"Step\s+[\d,]+/([\d,]+)"), ",", "").try_cast("long").alias("total"),
        field(r"Loss\s+([\d.]+)").try_cast("double").alias("loss"),
        field(r"LR\s+([\d.eE+-]+)").try_cast("double").alias("lr"),
        field(r"([\d.]+)\s*s/step").try_cast("double").alias("seconds"),
        F.regexp_replace(field(r"([\d,]+)\s*tok/s"), ",", "").try_cast("double").alias("tokens_per_second"),
    )


def domain_losses(lines: DataFrame, value: str = "value") -> DataFrame:
    """``domain, loss`` of per-domain report lines."""
    pairs = F.regexp_extract_all(value, F.lit(r"(\w+ [\d.]+)"), 1)
    body = lines.where(F.contains(F.col(value), F.lit("per-domain:"))).withColumn(value, F.element_at(F.split(value, "per-domain:"), -1))
    each = body.select(F.explode(pairs).alias("p"))
    return each.select(F.element_at(F.split("p", " "), 1).alias("domain"), F.element_at(F.split("p", " "), 2).try_cast("double").alias("loss"))


def count_windows(events: DataFrame, step: Column, every: int, domain: str, loss: str) -> DataFrame:
    """Mean loss of each domain over consecutive windows of steps, on batches and streams."""
    return events.groupBy(F.floor(step / every).alias("window"), F.col(domain).alias("domain")).agg(F.count(loss).alias("updates"), F.avg(loss).alias("mean_loss"))


def concurrency(speeds: DataFrame) -> DataFrame:
    """Workers after each speed sample: two low samples take one away, a high one brings one back.

    ``key, at, mb_per_s`` as a stream; state is the workers and the run of low samples.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        workers, low = state.get if state.exists else (MOST, 0)
        for part in parts:
            out = []
            for r in part.sort_values("at").itertuples():
                workers, low = controlled(workers, low, r.mb_per_s)
                out.append((key[0], r.at, r.mb_per_s, workers, low))
            yield pd.DataFrame(out, columns=["key", "at", "mb_per_s", "workers", "low"])
        state.update((workers, low))

    return speeds.groupBy("key").applyInPandasWithState(step, "key string, at long, mb_per_s double, workers int, low int", "workers int, low int", "append", GroupStateTimeout.NoTimeout)


def controlled(workers: int, low: int, speed: float) -> tuple[int, int]:
    """One step of the controller."""
    if speed >= LOW:
        return (min(MOST, workers + 1) if speed > HIGH else workers), 0
    low += 1
    return (workers - 1, 0) if low >= LOWS and workers > LEAST else (workers, low)


def stalls(samples: DataFrame) -> DataFrame:
    """Restart signals: ``STALLS`` samples in a row without growth, then the count starts anew.

    ``key, at, size`` as a stream.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, flat = state.get if state.exists else (-1, 0)
        for part in parts:
            out = []
            for r in part.sort_values("at").itertuples():
                flat = 0 if r.size > last else flat + 1
                last = r.size
                restart = flat >= STALLS
                out.append((key[0], r.at, r.size, flat, restart))
                flat = 0 if restart else flat
            yield pd.DataFrame(out, columns=["key", "at", "size", "flat", "restart"])
        state.update((last, flat))

    return samples.select("key", "at", F.col("size")).groupBy("key").applyInPandasWithState(step, "key string, at long, size long, flat int, restart boolean", "last long, flat int", "append", GroupStateTimeout.NoTimeout)


def reweight_each(stream: DataFrame, settle: Any, every: int = 2000, least: int = 16_000):
    """A writer that hands window means to ``settle``, windows with enough updates only.

    Windows are aggregated in the stream's state, so one that several batches reach is whole: it is handed over again,
    as it stands, after each batch that changed it, and what came before is to be replaced.  Rows are one a window and
    domain.  Side files (boosts, references) are read inside ``settle``, so each batch sees their present content.
    """
    told: dict[int, int] = {}

    def batch(means: DataFrame, _: int) -> None:
        totals = means.groupBy("window").agg(F.sum("updates").alias("n")).where(F.col("n") >= least).collect()  # a row a window
        new = [r["window"] for r in totals if told.get(r["window"]) != r["n"]]
        told.update({r["window"]: r["n"] for r in totals})
        if new:
            settle(means.where(F.col("window").isin(new)))

    return count_windows(stream, F.col("step"), every, "domain", "loss").writeStream.outputMode("complete").foreachBatch(batch)
