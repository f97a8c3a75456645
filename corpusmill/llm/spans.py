"""Spans in texts: their digest, and texts rewritten with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span in a table: code points, end exclusive; ``kind`` is the kind's place in its operator's list.
SPANS = "array<struct<start:int,kind:int,stop:int>>"


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"], F.lit(":"), s["stop"])))


def _of(kind: int):
    return lambda s: s["kind"] == kind


def digests(base: Column, all_spans: Column, kinds: Sequence[str]) -> list[Column]:
    """Counts of base spans by kind, their sha256, and all spans."""
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(kinds)]
    return [*counts, F.sha2(joined(base, kinds), 256).alias("base_sha256"), joined(all_spans, kinds).alias("spans")]


def rewritten(text: str, spans: Sequence[dict], kinds: Sequence[str]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{kinds[s['kind']].upper()}]"]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])
