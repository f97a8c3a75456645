"""Personal data by bootstrapped contextual extraction.

Formats give the seeds: e-mail, IP, card and phone spans.  Every seed, and every other identifier-like word
(4 or more characters with a digit, ``@`` or ``_``) and run of digit groups (joined by single or double spaces, dots,
hyphens and parentheses, of 4 or more characters), is an instance met in lexical patterns: the two words before
it, or the words on both sides, each with the instance's coarse shape.  The graph of distinct (pattern,
instance) edges is scored for a few rounds: a pattern's confidence for a kind is the share of its instances that
are members of the kind, and it is trusted from ``MIN_MEMBERS`` members and ``MIN_CONFIDENCE`` on; an instance
joins a kind when the noisy-or of its trusted patterns reaches ``MIN_BELIEF``.  Occurrences of the instances that
joined become further spans; seeds always stay.

Joins run on distinct edges, so a line that a third of all documents repeat counts once.  Texts aren't
shuffled; only identifiers with their contexts are.

Defined results: a null text is empty; null or repeated ``doc_id`` values give a row each; an empty table gives
no row; a text without identifiers gives zeros and empty strings; very long texts, words and identifiers are read
whole; other columns, whatever their names, are not read (``redact`` keeps them).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.memos import tidy
from corpusmill.llm.spans import SPANS, digests, rewritten
from corpusmill.session import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_MEMBERS, MIN_CONFIDENCE, MIN_BELIEF = 3, 4, 0.8, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@_]")
_GROUPS = re.compile(r"(?:\+|\()?[0-9]++(?:[().-]*+(?:\x20{1,2}+[().-]*+)?[0-9]++)++")
_BLANK = re.compile(r"\s")
_WORD = re.compile(r"\S++")
_EDGE = ".,;:!?()[]{}<>\"'"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each ``@`` backwards, so that long words without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def addresses(text: str) -> list[Span]:
    """Groups of four parts of each dotted run of numbers."""
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                stop = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((at, 1, stop))
                at = stop + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    return out


def phones(text: str) -> list[Span]:
    out, at = [], text.find("+")
    while at >= 0:
        after = at + 1
        if m := _PHONE.match(text, at):
            after = m.end()
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((at, 3, after))
        at = text.find("+", after)
    return out


def base_spans(text: str | None) -> list[Span]:
    """The seeds: (start, kind, end) by start, then kind."""
    return sorted(emails(text) + addresses(text) + cards(text) + phones(text)) if text else []


def _shape(word: str) -> str:
    """Coarse shape: an address, or which of letters, digits and underlines a word has."""
    if "@" in word:
        return "@"
    return ("_" if "_" in word else "") + ("a" if any(map(str.isalpha, word)) else "") + ("9" if any(map(str.isdigit, word)) else "")


class Words:
    """A text's whole words and their places, found when first asked for."""

    def __init__(self, text: str):
        self.text, self.starts = text, None

    def around(self, start: int, stop: int) -> tuple[str, str, str]:
        """The second and first word, or part of one, before a span, and the first after it; of any length."""
        if self.starts is None:
            found = [m.span() for m in _WORD.finditer(self.text)]
            self.starts, self.stops = [s for s, _ in found], [e for _, e in found]
        k = bisect_left(self.starts, start)  # words that begin before the span
        j = bisect_right(self.stops, stop)  # the first word that ends behind it
        cut = lambda i, lo, hi: self.text[max(lo, self.starts[i]) : min(hi, self.stops[i])].strip(_EDGE).lower()
        last = len(self.text)
        return cut(k - 2, 0, start) if k > 1 else "", cut(k - 1, 0, start) if k else "", cut(j, stop, last) if j < len(self.starts) else ""


def groups(text: str) -> list[tuple[int, int]]:
    """Maximal runs of at least two digit groups that stand alone: joined by spaces, dots, hyphens and parentheses."""
    out = []
    for m in _GROUPS.finditer(text):
        start, stop = m.span()
        left = start == 0 or text[start - 1].isspace() or text[start - 1] in _EDGE
        right = stop == len(text) or text[stop].isspace() or text[stop] in _EDGE
        if left and right and stop - start >= 4:
            out.append((start, stop))
    return out


def identifiers(text: str, base: list[Span]) -> list[tuple[int, int, int | None]]:
    """Runs of digit groups, and identifier-like words, that overlap no seed; a word in a run has the run's start."""

    def free(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out, k = [], 0
        for start, stop in found:
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if not any(s < stop and e > start for s, e in taken[k : k + 8]):
                out.append((start, stop))
        return out

    seeds = [(s, e) for s, _, e in base]
    runs = free(groups(text), seeds)
    words, at = [], 0
    while m := _SIGN.search(text, at):
        start, stop = m.start(), m.end()
        blank = _BLANK.search(text, stop)
        stop = blank.start() if blank else len(text)
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = stop
        while start < stop and text[start] in _EDGE:
            start += 1
        while stop > start and text[stop - 1] in _EDGE:
            stop -= 1
        if stop - start >= 4:
            words.append((start, stop))
    out, k = [(s, e, None) for s, e in runs], 0
    for start, stop in free(words, seeds):
        while k < len(runs) and runs[k][1] <= start:
            k += 1
        inner = k < len(runs) and runs[k][0] < stop
        if not inner or (start, stop) != runs[k]:
            out.append((start, stop, runs[k][0] if inner else None))
    return sorted(out, key=lambda x: (x[0], -x[1]))


_FOUND = f"row long, doc_id long, base {SPANS}, met array<struct<start:int,stop:int,kind:int,instance:string,before:string,around:string,run:int>>"
_FOUND_TYPES = [
    ("row", pa.int64()),
    ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))),
    ("met", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("before", pa.string()), ("around", pa.string()), ("run", pa.int32())]))),
]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_FOUND_TYPES)
    for b in batches:
        bases, mets = [], []
        for t in b.column(2):
            text = t.as_py() or ""
            base = base_spans(text)
            met, words = [], Words(text)
            for start, kind, stop, run in [*((*x, None) for x in base), *((s, -1, e, run) for s, e, run in identifiers(text, base))]:
                # A word in a run has no context of its own; it is spanned where its instance joins elsewhere.
                w2, w1, w = words.around(start, stop) if run is None else ("", "", "")
                shape = _shape(text[start:stop])
                met.append({"start": start, "stop": stop, "kind": kind, "instance": text[start:stop].lower(), "before": f"{w2} {w1} <{shape}>" if w1 else None, "around": f"{w1} <{shape}> {w}" if w1 or w else None, "run": run})
            bases.append([{"start": s, "kind": k, "stop": e} for s, k, e in base])
            mets.append(met)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bases, schema.field("base").type), pa.array(mets, schema.field("met").type)], schema=schema)


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Instances beyond the seeds that join a kind: ``instance, kind``."""
    met = found.select(F.explode("met").alias("m")).select("m.instance", "m.kind", F.explode(F.array("m.before", "m.around")).alias("pattern")).where("pattern is not null")
    # The least kind that a seed of this text has; -1 marks none.
    edges = materialize(met.groupBy("pattern", "instance").agg(F.min(F.when(F.col("kind") >= 0, F.col("kind"))).alias("seed")), "edges")
    joined = None
    for _ in range(rounds):
        known = edges if joined is None else edges.join(joined, "instance", "left").withColumn("seed", F.coalesce("seed", "kind")).drop("kind")
        sizes = [F.count("*").alias("n"), *[F.count(F.when(F.col("seed") == k, 1)).alias(f"k{k}") for k in range(len(KINDS))]]
        best = F.greatest(*[F.struct(F.col(f"k{k}").alias("members"), F.lit(-k).alias("kind")) for k in range(len(KINDS))])
        trusted = (
            known.groupBy("pattern").agg(*sizes).withColumn("best", best)
            .select("pattern", (-F.col("best.kind")).alias("kind"), (F.col("best.members") / F.col("n")).alias("confidence"), F.col("best.members").alias("members"))
            .where((F.col("members") >= MIN_MEMBERS) & (F.col("confidence") >= MIN_CONFIDENCE))
        )
        doubt = F.sum(F.log1p(-F.least(F.col("confidence") * (1 - 1 / (F.col("members") + 1.0)), F.lit(0.999))))
        belief = edges.where("seed is null").join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        chosen = belief.where(F.col("belief") >= MIN_BELIEF).groupBy("instance").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))
        # An instance that is a seed anywhere is already spanned wherever its format matches.
        joined = materialize(chosen.select("instance", F.col("kind").cast("int").alias("kind")), "joined")
    return joined


def find(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Seeds and discoveries of ``row, doc_id, text``: ``row, doc_id, base, spans``; ``row`` is unique."""
    found = materialize(rows.select("row", "doc_id", "text").mapInArrow(tidy("pii", _scan), _FOUND), "identifiers")
    met = found.select("row", F.explode("met").alias("m")).where("m.kind < 0").select("row", "m.start", "m.stop", "m.instance", "m.run")
    hits = met.join(discovered(found, rounds), "instance").groupBy("row", F.coalesce("run", "start").alias("at")).agg(F.collect_list(F.struct("start", "kind", "stop", "run")).alias("own"))
    # A run that joins covers the words in it.
    alone = F.filter("own", lambda s: s["run"].isNull())
    kept = F.transform(F.when(F.size(alone) > 0, alone).otherwise(F.col("own")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    more = hits.groupBy("row").agg(F.flatten(F.collect_list(kept)).alias("more"))
    spans = F.concat("base", F.coalesce("more", F.array().cast(SPANS)))
    return found.select("row", "doc_id", "base").join(more, "row", "left").select("row", "doc_id", "base", F.array_sort(spans).alias("spans"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def detect(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, spans as structs: the operator's general output."""
    return find(_rows(docs), rounds).select("doc_id", "base", "spans")


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The same table with every span of ``text`` replaced by its kind in brackets; null texts stay null."""
    columns = docs.columns
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    spans = find(held.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")), rounds).where(F.size("spans") > 0)

    rewrite = F.pandas_udf(lambda texts, spans: pd.Series([t if t is None or s is None else rewritten(t, list(s), KINDS) for t, s in zip(texts, spans)], dtype=object), "string")
    whole = held.join(spans.select("row", "spans"), "row", "left")
    text = F.when(F.col("spans").isNull(), F.col("doc.text").cast("string")).otherwise(rewrite(F.col("doc.text").cast("string"), "spans"))
    return whole.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in columns])


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = find(_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", *digests(F.col("base"), F.col("spans"), KINDS))
