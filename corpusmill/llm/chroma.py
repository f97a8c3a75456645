"""Audio fingerprints from chroma features, and alignment of recordings.

A recording (WAV, 16-bit PCM) becomes frames of pitch-class energies; differences of rectangles in their integral
image, the sixteen filters, are each quantised to two bits (Gray code), so a frame gives one 32-bit integer.  Two
recordings are aligned by an offset many of their like integers agree on, and compared by the share of
differing bits over the overlap.

Recordings with equal fingerprints are one class; classes meet in an inverted index by three of an integer's four
bytes, so that any errors in one byte are borne.  Every start of a run of equal integers votes in an offset histogram;
of the ``OFFSETS`` offsets with most votes, the one within the bit error whose overlap tells most against chance wins.
No bucket is capped: classes, not copies, share a bucket.  Tasks hold blocks of classes with their index and pass all
queries through them, so votes are counted where they fall and only matches leave a task.

Defined results: null, empty or unreadable audio has an empty fingerprint and is a class of its own kind that
matches nothing; shorter audio than one filter has an empty fingerprint; repeated rows share a class; an empty
table gives no row.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import memos
from corpusmill.llm.tokenfiles import _place
from corpusmill.session import lean, materialize

RATE, FRAME, HOP, WIDTH, LOW, HIGH = 11_025, 4096, 1365, 16, 28.0, 3520.0
MIN_COMMON, MAX_ERROR, OFFSETS = 3, 0.25, 8
#: Bounds on memory, not on what meets: integers of a block of recordings, and meetings, or integers compared, at once (those of one query at least).
BLOCK, TOGETHER = 1 << 18, 1 << 21
_BYTES = (0xFFFFFF00, 0xFFFF00FF, 0xFF00FFFF, 0x00FFFFFF)
THRESHOLDS = (-0.12, 0.0, 0.12)
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def decode(audio: bytes | None) -> np.ndarray:
    """Mono samples at the working rate; empty if the bytes aren't 16-bit PCM."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as w:
            if w.getsampwidth() != 2:
                return np.empty(0)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
            rate = w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.empty(0)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


def _classes() -> np.ndarray:
    """The pitch class of each frequency bin, -1 outside the range."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    with np.errstate(divide="ignore"):
        note = np.round(12 * np.log2(np.maximum(f, 1e-9) / 440)).astype(int)
    return np.where((f >= LOW) & (f <= HIGH), note % 12, -1)


_CLASS = _classes()
_ROWS = np.stack([(_CLASS == k) for k in range(12)]).astype(float)
_TAPER = np.hamming(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch class, smoothed over time and of unit length."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < len(_SMOOTH):
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    energy = np.abs(np.fft.rfft(frames * _TAPER, axis=1)) ** 2 @ _ROWS.T
    energy = sum(w * energy[k : n - len(_SMOOTH) + 1 + k] for k, w in enumerate(_SMOOTH))
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.divide(energy, norm, out=np.zeros_like(energy), where=norm > 0.01)


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of sixteen filters, spread over kinds, classes and spans by rule."""
    return [(i % 6, (5 * i) % 9, 2 + i % 3, WIDTH - 2 * (i % 4)) for i in range(16)]


def _areas(image: np.ndarray, kind: int, y: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a filter's two halves at every frame, from the integral image."""
    n = image.shape[0] - WIDTH

    def box(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[x1 : x1 + n, y1] - image[x0 : x0 + n, y1] - image[x1 : x1 + n, y0] + image[x0 : x0 + n, y0]

    h2, w2, h3, w3 = h // 2, w // 2, max(1, h // 3), w // 3
    whole = box(0, w, y, y + h)
    if kind == 0:
        return whole, np.zeros(n)
    if kind == 1:
        b = box(0, w, y + h2, y + h)
    elif kind == 2:
        b = box(w2, w, y, y + h)
    elif kind == 3:
        b = box(0, w2, y + h2, y + h) + box(w2, w, y, y + h2)
    elif kind == 4:
        b = box(0, w, y + h3, y + min(h, 2 * h3))
    else:
        b = box(w3, 2 * w3, y, y + h)
    return whole - b, b


def fingerprint(audio: bytes | None) -> np.ndarray:
    """One unsigned 32-bit integer a frame."""
    features = chroma(decode(audio))
    if len(features) < WIDTH:
        return np.empty(0, np.uint32)
    image = np.zeros((len(features) + 1, 13))
    image[1:, 1:] = features.cumsum(0).cumsum(1)
    out = np.zeros(image.shape[0] - WIDTH, np.uint32)
    for kind, y, h, w in _filters():
        a, b = _areas(image, kind, y, h, w)
        level = np.searchsorted(THRESHOLDS, np.log((1 + a) / (1 + b)) - (0.9 if kind == 0 else 0)).astype(np.uint32)
        out = out << np.uint32(2) | level ^ level >> np.uint32(1)
    return out


def bit_error(x: np.ndarray, y: np.ndarray, offset: int) -> float:
    """Share of differing bits where ``x[i]`` meets ``y[i + offset]``; 1 without overlap."""
    lo, hi = max(0, -offset), min(len(x), len(y) - offset)
    if hi <= lo:
        return 1.0
    return float(np.bitwise_count(x[lo:hi] ^ y[lo + offset : hi + offset]).sum() / (32 * (hi - lo)))


def fingerprints(recordings: DataFrame) -> DataFrame:
    """``id, prints array<long>`` from ``id, audio binary``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(a.as_py()).astype(np.int64) for a in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "prints"])

    lean(recordings.sparkSession)
    return recordings.select(F.col("id").cast("long").alias("id"), "audio").mapInArrow(make, "id long, prints array<long>")


def _cut(n: np.ndarray) -> Iterator[slice]:
    """Slices of counts that sum up to some ``TOGETHER`` each."""
    starts = np.flatnonzero(np.diff(np.cumsum(n) // TOGETHER, prepend=-1))
    yield from map(slice, starts, np.append(starts[1:], len(n)))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` numbers from each start on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Recordings:
    """Fingerprints one after the other, and the starts of their runs of equal integers: a held tone repeats one."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.size = np.array(ids, np.int64), np.array([len(p) for p in prints], np.int64)
        self.flat, self.edge = np.concatenate(prints).astype(np.uint32), np.cumsum(self.size) - self.size
        first = np.ones(len(self.flat), bool)
        first[1:] = self.flat[1:] != self.flat[:-1]
        first[self.edge] = True
        place = np.flatnonzero(first)
        self.owner = np.searchsorted(self.edge, place, "right") - 1
        self.at, self.value = place - self.edge[self.owner], self.flat[place]


class Block(Recordings):
    """Recordings with an index of their starts by three bytes of four."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        super().__init__(ids, prints)
        keys = [self.value & np.uint32(m) for m in _BYTES]
        self.parts = [(k[by], by) for k in keys for by in [np.argsort(k, kind="stable")]]

    def votes(self, asked: Recordings, min_common: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Queries, recordings, offsets and the votes they have in common, in the order of queries."""
        low, n = (np.empty((len(_BYTES), len(asked.value)), np.int64) for _ in range(2))
        for p, (m, (keys, _)) in enumerate(zip(_BYTES, self.parts)):
            key = asked.value & np.uint32(m)
            low[p] = np.searchsorted(keys, key)
            n[p] = np.searchsorted(keys, key, "right") - low[p]
        wide, deep = int(self.size.max() + asked.size.max()), len(self.ids)
        for own in _cut(np.bincount(asked.owner, n.sum(0), len(asked.ids)).astype(np.int64)):
            at = slice(*np.searchsorted(asked.owner, (own.start, own.stop)))
            codes = []
            for p, (_, by) in enumerate(self.parts):
                x, y = np.repeat(np.arange(at.start, at.stop), n[p, at]), by[_ranges(low[p, at], n[p, at])]
                # Equal integers meet in all four parts and vote in the first; others meet in one.
                keep = asked.ids[asked.owner[x]] != self.ids[self.owner[y]]
                if p:
                    keep &= asked.value[x] != self.value[y]
                x, y = x[keep], y[keep]
                codes.append((asked.owner[x] * deep + self.owner[y]) * wide + self.at[y] - asked.at[x] + int(asked.size.max()))
            code, common = np.unique(np.concatenate(codes), return_counts=True)
            code, common = code[common >= min_common], common[common >= min_common]
            pair, offset = np.divmod(code, wide)
            yield *np.divmod(pair, deep), offset - int(asked.size.max()), common

    def matches(self, asked: Recordings, max_error: float, min_common: int) -> Iterator[list[np.ndarray]]:
        """Class, match, offset, votes in common and bit error of what queries match."""
        for q, r, offset, common in self.votes(asked, min_common):
            pair = q * len(self.ids) + r
            by = np.lexsort((offset, np.abs(offset), -common, pair))
            by = by[np.arange(len(by)) - np.searchsorted(pair[by], pair[by]) < OFFSETS]
            q, r, offset, common, pair = (x[by] for x in (q, r, offset, common, pair))
            low = np.maximum(0, -offset)
            n = np.minimum(asked.size[q], self.size[r] - offset) - low
            x, y, bits = asked.edge[q] + low, self.edge[r] + low + offset, np.zeros(len(n), np.int64)
            for own in _cut(n):
                differ = np.bitwise_count(asked.flat[_ranges(x[own], n[own])] ^ self.flat[_ranges(y[own], n[own])])
                bits[own] = np.add.reduceat(differ, np.cumsum(n[own]) - n[own], dtype=np.int64)
            error = (2_000_000 * bits + 32 * n) // (64 * n) / 1e6  # half up, at six places
            near = np.flatnonzero(error <= max_error)
            by = near[np.lexsort((-offset[near], -np.abs(offset[near]), common[near], ((0.5 - error) * n)[near], pair[near]))]
            best = by[np.append(pair[by][1:] != pair[by][:-1], True)] if len(by) else by
            yield [asked.ids[q[best]], self.ids[r[best]], offset[best].astype(np.int32), common[best].astype(np.int64), error[best]]


def _asked(path: str) -> Iterator[Recordings]:
    """The queries in the shared folder, some at a time."""
    from pyarrow import fs as filesystems

    fs, where = _place(path)
    fs = fs or filesystems.LocalFileSystem()
    for f in sorted(x.path for x in fs.get_file_info(filesystems.FileSelector(where)) if x.path.endswith(".parquet")):
        with fs.open_input_file(f) as opened:
            for b in pq.ParquetFile(opened).iter_batches(128, columns=["class_id", "prints"]):
                yield Recordings(b.column(0).to_pylist(), [p.values.to_numpy() for p in b.column(1)])


def align(prints: DataFrame, asked: DataFrame, max_error: float = MAX_ERROR, min_common: int = MIN_COMMON) -> DataFrame:
    """Matches between classes of equal fingerprints: ``class_id, match_id, offset, common, bit_error``.

    ``asked`` holds the class ids that are queries; a class is named by its least id.
    """
    classes = prints.where("size(prints) > 0 and class_id is not null").select("class_id", "prints")
    path = materialize(classes.join(asked.select("class_id").distinct(), "class_id"), "asked")._written

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, many = [], [], 0

        def found() -> Iterator[pa.RecordBatch]:
            block = Block(ids, held)
            for some in _asked(path):
                for columns in block.matches(some, max_error, min_common):
                    for a in range(0, len(columns[0]), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 10_000]) for c in columns], names=["class_id", "match_id", "offset", "common", "bit_error"])

        for b in batches:
            for i, p in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                held.append(p.values.to_numpy().astype(np.uint32))
                many += len(held[-1])
                if many >= BLOCK:
                    yield from found()
                    ids, held, many = [], [], 0
        if ids:
            yield from found()

    spark = lean(prints.sparkSession)
    tasks = max(2 * spark.sparkContext.defaultParallelism, classes.rdd.getNumPartitions())
    return classes.repartition(tasks).mapInArrow(memos.tidy("chroma", meet), "class_id long, match_id long, offset int, common long, bit_error double")


def tones(vectors: DataFrame) -> DataFrame:
    """Recordings ``id, audio`` of vectors, for tables that hold no audio: each value is a note of 1/16 second."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = RATE // 16
        t = np.arange(step) / RATE
        for b in (b.slice(k, 50) for b in batches for k in range(0, b.num_rows, 50)):
            out = []
            for v in b.column(1):
                values = np.array([x for x in (v.as_py() or []) if x is not None and np.isfinite(x)], float)
                notes = 57 + np.round(6 * np.clip(values / max(np.abs(values).max(), 1e-9), -1, 1)) if len(values) else values
                x = np.sin(2 * np.pi * (440 * 2 ** ((notes - 69) / 12))[:, None] * t[None, :]).ravel() if len(values) else np.empty(0)
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(RATE)
                    w.writeframes((x * 20_000).astype("<i2").tobytes())
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "audio"])

    return vectors.mapInArrow(play, "id long, audio binary")


def op6_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made of all ``embeddings``: a row each with its class; in rows of a query's class, its links.

    ``n_links`` counts the classes a query matches, all of them; the other columns are the match of the least bit error,
    then most votes, then least id. ``align`` lists every match. Both are null in classes without a query, the latter
    also in queries without a match.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    found = materialize(fingerprints(tones(vectors)), "prints")
    named = found.withColumn("digest", F.md5(F.concat_ws(",", F.col("prints").cast("array<string>"))))
    return linked(named)


def linked(named: DataFrame) -> DataFrame:
    """``op6_chroma_prints`` of ``id, prints, digest``."""
    of_class = [F.min("id").alias("class_id"), F.first("prints").alias("prints"), F.coalesce(F.bool_or(F.expr("id % 20 = 0")), F.lit(False)).alias("asked")]
    classes = materialize(named.groupBy("digest").agg(*of_class), "classes")
    best = F.min_by(F.struct("match_id", "offset", "common", "bit_error"), F.struct("bit_error", -F.col("common"), "match_id"))
    links = align(classes, classes.where("asked")).groupBy("class_id").agg(F.count("*").alias("n_links"), best.alias("best"))
    answers = classes.drop("prints").join(links, "class_id", "left")
    n_links = F.when(F.col("asked"), F.coalesce("n_links", F.lit(0)).cast("long")).alias("n_links")
    rows = named.select(F.col("id").alias("vec_id"), "digest", F.size("prints").cast("long").alias("n_prints")).join(answers, "digest")
    return rows.select("vec_id", "class_id", "digest", "n_prints", n_links, "best.*")
