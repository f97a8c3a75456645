"""Pluggable hooks: generators, scorers and code checks, with deterministic offline stands-in."""

from __future__ import annotations

import hashlib
import subprocess
import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stub_generator(prompt: str) -> str:
    """A reply that depends on the prompt alone."""
    return f"<answer>{hashlib.md5(prompt.encode()).hexdigest()}</answer>"


def generated(df: DataFrame, prompt: str, client: Callable[[str], str] = stub_generator, retries: int = 3, name: str = "reply", wait: float = 0.0, failed: str = "empty") -> DataFrame:
    """Replies of a client by row, in batches.

    Between tries it waits ``wait`` seconds, twice as long each time.  A prompt that fails every time has an empty
    reply, or loses its row (``failed="drop"``), or fails the job (``failed="raise"``).
    """
    if failed not in ("empty", "drop", "raise"):
        raise ValueError(failed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for p in part[prompt]:
                reply = None
                for k in range(retries):
                    try:
                        reply = client(p or "")
                        break
                    except Exception:  # noqa: BLE001 - any failure of a client counts as one try
                        if k == retries - 1 and failed == "raise":
                            raise
                        if wait and k < retries - 1:
                            time.sleep(wait * 2**k)
                out.append(reply if reply is not None or failed == "drop" else "")
            made = part.assign(**{name: out})
            yield made[made[name].notna()] if failed == "drop" else made

    return df.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` string"]))


def scored(c: Column, scorer: Callable[[str], float]) -> Column:
    """A score for each text by a Python scorer, in Arrow batches; null stays null."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else float(scorer(x))), "double")(c)


_CHECK = """
import resource, sys
resource.setrlimit(resource.RLIMIT_CPU, (5, 5))
resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
exec(compile(sys.stdin.read(), '<checked>', 'exec'), {'__name__': '__checked__'})
"""


def passes(source: str | None, timeout: float = 6.0) -> bool:
    """Whether a program ends well in a process of its own, under limits of time, memory and files."""
    if not source:
        return False
    try:
        done = subprocess.run([sys.executable, "-I", "-c", _CHECK], input=source, text=True, capture_output=True, timeout=timeout, env={}, cwd="/")
    except subprocess.TimeoutExpired:
        return False
    return done.returncode == 0


def verified(code: Column, test: Column, entry_point: Column) -> Column:
    """Whether the code defines its entry point and its test's ``check`` accepts it."""
    program = F.concat_ws("\n", code, test, F.concat(F.lit("check("), entry_point, F.lit(")")))
    return F.pandas_udf(lambda s: s.map(lambda x: passes(x)), "boolean")(program)


def first_key(df: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """The first key, in ``ord``, that a text contains (any case); null without one.  ``keys`` is a list of at most 1,000."""
    held = [r["key"] for r in keys.where("key is not null").orderBy("ord").limit(1001).collect()]
    if len(held) > 1000:
        raise ValueError("more than 1,000 keys")
    low = F.lower(F.col(text))
    return df.withColumn("key", F.coalesce(*[F.when(F.contains(low, F.lit(k)), k) for k in held], F.lit(None).cast("string")))
