"""Best-fit packing by patterns: non-negative least squares on the length histogram.

1. Texts are encoded where they lie; each task numbers its pieces of a length from 0 and the rows (counts and
   checksums, no texts) go to the shared folder.
2. The histogram has at most ``capacity`` rows whatever the input, so the driver takes it.  All patterns of one to
   three lengths that fill a sequence exactly are enumerated (about capacity**2 / 12), and their repeat counts are
   fitted to the histogram by accelerated projected gradient on the non-negative least squares problem.
3. Counts are rounded down, fractions are taken up greedily where pieces are left, and what remains is packed
   best-fit decreasing on counts.
4. The plan says for each length which ranks go to which run of sequences.  A piece's rank is its number inside
   its task plus the pieces of that length in earlier tasks, so no group of equal lengths meets in one task.

Defined results: a null or empty text is one piece with the end id alone; only longer documents are cut, into
full pieces and a rest; repeated rows are packed like others; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.encoding import encoder, vocabulary_path
from corpusmill.llm.memos import tidy
from corpusmill.session import lean, materialize

CAPACITY = 2048
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long, ids binary"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Cuts every document into pieces of at most ``capacity`` ids; ``local`` numbers a task's pieces of a length."""
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        encode, end = encoder(vocabulary).encode, end_id.to_bytes(2, "little")
        for b in batches:
            out = [[], [], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(encode(text.as_py()) + end, "<u2")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    for column, v in zip(out, (doc, k, at, len(own), zlib.crc32(own.astype("<u4").tobytes()), seen[len(own)], own.tobytes() if keep_ids else None)):
                        column.append(v)
                    seen[len(own)] += 1
            n = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array([part] * n, pa.int32()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(None, cut), _PIECE)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three lengths of the histogram that fill a sequence; rows descending, 0 for none."""
    lengths = np.flatnonzero(present)
    out = [np.array([[capacity, 0, 0]])] if present[capacity] else []
    low = lengths[lengths * 2 <= capacity]
    pair = low[present[capacity - low] > 0]
    out.append(np.stack([capacity - pair, pair, np.zeros_like(pair)], 1))
    for c in lengths[lengths * 3 <= capacity]:
        b = lengths[(lengths >= c) & (lengths * 2 <= capacity - c)]
        a = capacity - c - b
        keep = present[a] > 0
        out.append(np.stack([a[keep], b[keep], np.full(keep.sum(), c)], 1))
    return np.concatenate(out).astype(np.int64)


def fit(histogram: np.ndarray, made: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Repeat counts that fit the histogram: min ||W(Ax - h)|| with x >= 0, by accelerated projected gradient.

    Long pieces weigh more, as short ones fill what is left over.
    """
    size = len(histogram)
    weight = np.where(np.arange(size) * 8 >= size, 1.0, 0.3)
    weight[0] = 0

    def down(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(made[:, k], x, size) for k in range(3))

    def up(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return r[made[:, 0]] + r[made[:, 1]] + r[made[:, 2]]

    v = np.ones(len(made))
    for _ in range(12):  # the largest eigenvalue gives the step
        v = up(down(v))
        v /= max(np.linalg.norm(v), 1e-300)
    step = 1 / max(np.linalg.norm(up(down(v))) * 1.05, 1e-12)
    x = np.zeros(len(made))
    y, t = x, 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * up(down(y) - histogram))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / s * (z - x)
        x, t = z, s
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs counts of lengths best-fit decreasing; equal bins are kept as one with a count."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    room = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                space = length + int(fits[0])
                content, count = bins[space].pop()
                take = min(count, n)
                if take < count:
                    bins[space].append((content, count - take))
                room[space] = bool(bins[space])
            else:
                space, content, take = capacity, (), -(-n // (capacity // length))
            times = 1 if content else min(capacity // length, max(1, n // take))
            bins[space - times * length].append((content + (length,) * times, take))
            room[space - times * length] = True
            n -= take * times
    return [x for own in bins.values() for x in own]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of every kind of sequence; together they hold exactly the histogram."""
    left = histogram.astype(np.int64).copy()
    made = patterns(left > 0, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    if len(made):
        x = fit(left.astype(float), made)
        whole = np.floor(x + 1e-6).astype(np.int64)
        part = x - whole
        # Rounding: the whole repeats, largest first, then one more by falling fraction while pieces last.
        ordered = [(i, int(whole[i])) for i in np.argsort(-x, kind="stable") if whole[i] > 0]
        ordered += [(i, 1) for i in np.argsort(-part, kind="stable") if part[i] > 0.02]
        for i, most in ordered:
            lengths = tuple(int(v) for v in made[i] if v)
            need = {v: lengths.count(v) for v in lengths}
            k = min(most, *(int(left[v]) // c for v, c in need.items()))
            if k > 0:
                out.append((lengths, k))
                for v, c in need.items():
                    left[v] -= c * k
    return out + best_fit(left, capacity)


def _slots(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, pieces of that length in a sequence, offset of the first of them."""
    at, rank, slots = 0, defaultdict(int), defaultdict(list)
    for lengths, k in made:
        place = 0
        for v in sorted(set(lengths), reverse=True):
            c = lengths.count(v)
            slots[v].append((rank[v], at, c, place))
            rank[v] += c * k
            place += c * v
        at += k
    return {v: tuple(np.array(c, np.int64) for c in zip(*own)) for v, own in slots.items()}


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Packs all documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    spark = lean(docs.sparkSession)
    cut = materialize(pieces(docs, vocabulary, capacity, end_id, keep_ids), "pieces")
    counts = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity), capacity))  # bounded by the patterns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("local")) + np.asarray(b.column("base"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                own = length == v
                first, at, c, start = slots.value[int(v)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                q = rank[own] - first[k]
                sequence[own] = at[k] + q // c[k]
                offset[own] = start[k] + q % c[k] * v
            kept = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset), b.column("ids")], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task at most
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = cut.join(bases, ["length", "part"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
    return placed if keep_ids else placed.drop("ids")


def assemble(packed: DataFrame) -> DataFrame:
    """Sequences from a packing with ``keep_ids``: ``sequence_id, ids`` (binary, unsigned 16-bit)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most ``capacity`` pieces
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
