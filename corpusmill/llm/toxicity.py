"""Toxic passages by maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled training rows (``CLASS_ROWS`` of each label, the first by hash; ids are
broadcast, so texts aren't shuffled): token counts of words, at most ``REPEATS`` a document, and of their first
letters in toxic and clean documents.  A word's log-odds come from nested Dirichlet priors - equal odds are the prior of its first three
letters, those of the first four, and so on to the word - read at the deepest level with enough observations and
lowered by their standard error, so that chance counts bring nothing and a word never met is judged by its
beginning.  What is met often in clean text keeps its own odds under a toxic beginning.  Counts are read of the
``TABLE`` most frequent features (of a feature with fewer than ``ENOUGH`` observations they'd change nothing); the
lexicon keeps the ``LEXICON`` entries that change most from their beginnings' odds.

Score: token log-odds less a drift, the rate by which scoring tokens are denser in toxic text (a Poisson
likelihood ratio), make a walk; a linear scan finds every maximal scoring segment of it.  A clean text's best
segment grows as the logarithm of its scoring tokens, so the sum less that logarithm follows an extreme-value law;
Gumbel laws fitted to clean and toxic training documents give the document's probability by Bayes with the share
of toxic labels.  ``segments`` returns the significant passages, the score is the document's.

Labels, language, source and ids are no inputs of a score.  Defined results: a null or empty text has the score of
a text without any scoring segment; a null ``doc_id`` is never a training row and not held out; repeated labels of
an id count as toxic if any is; repeated documents are scored alike, and each trains; very long texts are scanned whole,
in time linear in their words; other columns, whatever their names, stay as they are; an empty table gives no row;
without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.memos import tidy
from corpusmill.session import lean, materialize

CLASS_ROWS, LEXICON, THRESHOLD, TABLE = 8192, 60_000, 0.3, 300_000
PRIOR, ENOUGH, LEAST, REPEATS, LEVELS = 4.0, 10.0, 0.7, 2, (3, 4, 5, 6, 7, 8)
_EDGE = ".,;:!?()[]{}<>\"'*#$%&"


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(word: str) -> tuple[str, ...]:
    """Prefixes from general to special, then the word."""
    return (*(f"{k} {word[:k]}" for k in LEVELS if k < len(word)), f"w {word}")


def plain(raw: str) -> str:
    return raw.strip(_EDGE).lower()


class Lexicon:
    """Log-odds of words, and the calibration of their best segments.

    ``values`` has the log-odds of each prefix and word whose own differ from what its longest kept prefix gives, an
    explicit 0 where a prefix is toxic and what goes on from it is not.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int, entries: int = LEXICON):
        self.toxic, self.clean = toxic, clean  # tokens
        self.values: dict[str, float] = {}
        self.memo: dict[str, float] = {}
        self.laws: tuple[float, float, float, float] | None = None
        self.share = self.drift = self.rate = 0.0
        if toxic and clean:
            self._read(counts, entries)

    def _read(self, counts: dict[str, tuple[int, int]], entries: int) -> None:
        """Equal odds, then each prefix's as the prior of the next; and how dense scoring tokens are."""
        state: dict[str, tuple[float, float]] = {}  # share of toxic, raw log-odds
        own = {f: list(c) for f, c in counts.items()}  # tokens that are read at a feature
        weight: dict[str, float] = {}
        shown = lambda out: min(6.0, out) if out >= LEAST else 0.0
        order = lambda f: (f[:2] == "w ", len(f))
        for f in sorted(counts, key=order):
            up = next((g for g in reversed(features(f[2:])[:-1]) if g in state), "")
            q, out = state.get(up, (0.5, 0.0))
            c1, c0 = counts[f]
            n1, n0 = c1, c0 * self.toxic / self.clean
            a, b = PRIOR * q + n1, PRIOR * (1 - q) + n0
            before = shown(out)
            if n1 + n0 >= ENOUGH:
                out = math.log(a / b) - math.sqrt(1 / (a + 1) + 1 / (b + 1))
            state[f] = min(1 - 1e-6, max(1e-6, a / (a + b))), out
            if up:
                own[up][0] -= c1
                own[up][1] -= c0
            if shown(out) != before:
                self.values[f] = shown(out)
                weight[f] = abs(shown(out) - before) * math.sqrt(n1 + n0)
        if len(self.values) > entries:
            kept = sorted(self.values, key=lambda f: (-weight[f], f))[:entries]
            self.values = {f: self.values[f] for f in kept}
        scoring = [c for f, c in own.items() if self.read((*features(f[2:])[:-1], f)) > 0]
        self.rate = sum(c0 for _, c0 in scoring) / self.clean
        self.drift = max(sum(c1 for c1, _ in scoring) / self.toxic - self.rate, 0.002)

    def read(self, chain: tuple[str, ...]) -> float:
        """The value of the last feature of a chain that has one."""
        return next((self.values[f] for f in reversed(chain) if f in self.values), 0.0)

    def log_odds(self, word: str) -> float:
        """Evidence of toxic text, 0 or more."""
        return self.read(features(word))

    def score_of(self, raw: str) -> float:
        s = self.memo.get(raw)
        if s is None:
            word = plain(raw)
            if len(self.memo) > 250_000:
                self.memo.clear()
            s = (self.log_odds(word) if word else 0.0) - self.drift
            if len(raw) <= 32:
                self.memo[raw] = s
        return s

    def scores(self, words: list[str]) -> np.ndarray:
        """The walk's steps; every occurrence of a word counts, whatever came before it."""
        get, own = self.memo.get, self.score_of
        out = list(map(get, words))
        if None in out:
            out = [own(w) if s is None else s for w, s in zip(words, out)]
        return np.array(out, np.float64)

    def probability(self, best: float, words: int) -> float:
        """Of a document's best segment under the two extreme-value laws."""
        if self.laws is None:
            return 0.0
        m0, b0, m1, b1 = self.laws
        z = min(max(self.normal(best, words), m0), max(m1, m0) + 4 * b1)
        density = lambda m, b: -math.log(b) - (z - m) / b - math.exp(min(50.0, -(z - m) / b))
        x = density(m1, b1) - density(m0, b0) + math.log(max(self.share, 1e-6) / max(1 - self.share, 1e-6))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))

    def normal(self, best: float, words: int) -> float:
        """The best sum, less what the length alone brings."""
        return best - math.log1p(self.rate * words)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum) in linear time.

    Runs of negative scores are taken as one step, so the scan's length is the number of positive scores.  Each segment
    keeps a link to the last one before it that begins at a lower sum, and the search follows links: segments passed
    over on the way begin at no lower sum than the new one and are never asked again.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.flatnonzero(scores > 0)
    held: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, link
    for k, left, right in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist()):
        first, j = k, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                break
            # The pair is one segment from there on; its link is the next to ask.
            first, left, link = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = link
        held.append((first, k + 1, left, right, j))
    return [(first, end, right - left) for first, end, left, right, _ in held]


def best_segment(scores: np.ndarray) -> float:
    """The largest segment sum, 0 if none is positive."""
    if not len(scores):
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return float(np.max(sums - np.minimum.accumulate(sums)))


def fit(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS, entries: int = LEXICON) -> Lexicon:
    """The lexicon and its calibration from labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    pick = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_rows) for k in (0, 1)]
    ids = [(r["doc_id"], r["toxic"]) for p in pick for r in p.collect()]  # at most two samples
    spark = lean(docs.sparkSession)
    if not ids:
        return Lexicon({}, 0, 0)
    sample = spark.createDataFrame(ids, "id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = (Counter(), Counter())
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                words[k].update({w: min(n, REPEATS) for w, n in Counter((t.as_py() or "").split()).items()})
        tally = (Counter(), Counter())
        for k in (0, 1):
            for raw, n in words[k].items():
                if word := plain(raw):
                    tally[k][""] += n
                    for f in features(word):
                        tally[k][f] += n
            words[k].clear()
        names = list(tally[0].keys() | tally[1].keys())
        for at in range(0, len(names), 20_000):
            own = names[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([tally[1][f] for f in own], pa.int64()), pa.array([tally[0][f] for f in own], pa.int64())], names=["feature", "c1", "c0"])

    # Partial sums leave the tasks; the features are those of the bounded sample.
    counts = rows.mapInArrow(tidy("toxicity", count), "feature string, c1 long, c0 long").groupBy("feature").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    counts = materialize(counts, "features")
    whole = counts.where("feature = ''").collect()  # one row
    toxic, clean = (whole[0]["c1"], whole[0]["c0"]) if whole else (0, 0)
    seen = F.col("c1") + F.col("c0") * (toxic / max(1, clean))
    top = counts.where((F.col("feature") != "") & (seen >= ENOUGH)).orderBy(seen.desc(), "feature").limit(TABLE).toArrow()
    table = dict(zip(top["feature"].to_pylist(), zip(top["c1"].to_pylist(), top["c0"].to_pylist())))
    lexicon = Lexicon(table, toxic, clean, entries)
    held = spark.sparkContext.broadcast(lexicon)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t.as_py() or "").split() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held.value.normal(best_segment(held.value.scores(w)), len(w)) for w in words], pa.float64())], names=["toxic", "z"])

    laws = {r["toxic"]: r for r in rows.mapInArrow(tidy("toxicity", moments), "toxic int, z double").groupBy("toxic").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).collect()}  # two rows
    if 0 in laws and 1 in laws:
        scale = {k: max(r["s"] or 0.0, 0.25) * math.sqrt(6) / math.pi for k, r in laws.items()}
        lexicon.laws = (laws[0]["m"] - 0.5772 * scale[0], scale[0], laws[1]["m"] - 0.5772 * scale[1], scale[1])
        lexicon.share = total.get(1, 0) / max(1, sum(total.values()))
    lexicon.memo = {}
    return lexicon


def scored(texts: DataFrame, lexicon: Lexicon, keep: bool = False) -> DataFrame:
    """``score`` and the significant ``segments`` (first word, end, sum) beside every column of the table."""
    held = texts.sparkSession.sparkContext.broadcast(lexicon)  # bounded by LEXICON
    place = texts.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("sum", pa.float64())]))
        for b in batches:
            p, found = [], []
            for t in b.column(place):
                words = (t.as_py() or "").split()
                s = held.value.scores(words)
                best = best_segment(s)
                p.append(held.value.probability(best, len(words)))
                found.append([{"first": f, "stop": e, "sum": x} for f, e, x in segments(s) if held.value.probability(x, len(words)) >= THRESHOLD] if best > 0 else [])
            own = [c for k, c in enumerate(b.columns) if keep or k != place]
            names = [n for k, n in enumerate(b.schema.names) if keep or k != place]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p, pa.float64()), pa.array(found, kind)], names=[*names, "__score", "__segments"])

    kinds = [f"`{c}` {t}" for c, t in texts.dtypes if keep or c != "text"]
    return texts.mapInArrow(tidy("toxicity", score), ", ".join([*kinds, "__score double, __segments array<struct<first:int,stop:int,sum:double>>"]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, segments`` for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(rows, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.col("__segments").alias("segments"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that aren't predicted toxic, with all their columns."""
    return scored(docs, fit(docs, labels), keep=True).where(F.col("__score") < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
