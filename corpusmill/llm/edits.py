"""Edit-aware token counts.

A document's pre-tokens are kept in leaves of about ``LEAF`` pieces, cut where a single space stands between two
non-blank characters (always a pre-token boundary); a segment tree over the leaves sums characters and tokens.  An
edit finds its leaves from the character sums, re-encodes only their text with the edit applied - with a
neighbouring leaf as context where the edit touches a leaf's edge and leaves a blank there - and updates the sums
on the paths to the root.  When leaves split or vanish the tree's upper part is made anew from the leaf sums,
without encoding.

Defined results: a null text is empty; edits apply in order, each to the text the one before left; ranges beyond
the text end at its end; an empty edit list leaves the count; repeated rows and null ids are counted like others; very
long texts have deeper trees, and only touched leaves are encoded again; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.encoding import PieceEncoder, encoder, vocabulary_path

LEAF = 64


class TokenTree:
    """The token count of a text under edits."""

    def __init__(self, text: str, encode: PieceEncoder):
        self.encoder = encode
        self.encoded = 0  # characters encoded so far
        self.texts: list[str] = []
        self.counts: list[int] = []
        self._put(0, 0, text)
        self.encoded = 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return " ".join(self.texts)

    def _leaves(self, text: str) -> list[str]:
        """A text cut at every ``LEAF``-th safe space."""
        out, held = [], []
        for w in text.split(" "):
            # A cut needs a non-blank on both sides; a piece next to a blank stays with its neighbour.
            if len(held) >= LEAF and held[-1] and not held[-1][-1].isspace() and w and not w[0].isspace():
                out.append(" ".join(held))
                held = []
            held.append(w)
        out.append(" ".join(held))
        return out

    def _count(self, text: str, first: bool) -> int:
        self.encoded += len(text)
        if not first:
            n = self.encoder.count_after_space(text.split(" "))
            return len(self.encoder.whole(" " + text)) // 2 if n is None else n
        return len(self.encoder.encode(text)) // 2

    def _put(self, i: int, j: int, text: str) -> None:
        """Replaces leaves i..j-1 by those of a text."""
        new = self._leaves(text)
        counts = [self._count(t, i + k == 0) for k, t in enumerate(new)]
        same = len(new) == j - i
        self.texts[i:j], self.counts[i:j] = new, counts
        if same and hasattr(self, "sums"):
            for k in range(i, j):
                self._set(k)
        else:
            self._build()

    def _build(self) -> None:
        n = max(1, len(self.texts))
        self.size = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), np.int64)  # characters with their space, tokens
        self.sums[0, self.size : self.size + len(self.texts)] = [len(t) + 1 for t in self.texts]
        self.sums[1, self.size : self.size + len(self.texts)] = self.counts
        level = self.size
        while level > 1:
            self.sums[:, level // 2 : level] = self.sums[:, level : 2 * level : 2] + self.sums[:, level + 1 : 2 * level : 2]
            level //= 2

    def _set(self, leaf: int) -> None:
        k = self.size + leaf
        self.sums[:, k] = len(self.texts[leaf]) + 1, self.counts[leaf]
        while k > 1:
            k //= 2
            self.sums[:, k] = self.sums[:, 2 * k] + self.sums[:, 2 * k + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf of a character, and the characters before the leaf."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at >= before + self.sums[0, k] and self.sums[0, k + 1]:
                before += int(self.sums[0, k])
                k += 1
        return k - self.size, before

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replaces the characters from start to stop."""
        length = int(self.sums[0, 1]) - 1
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        i, before = self._find(start)
        j, before_j = self._find(stop)
        whole = self.texts[i] if i == j else " ".join(self.texts[i : j + 1])
        new = whole[: start - before] + text + whole[stop - before :]
        j += 1
        # Boundary context: an edge that is blank, or empty, now belongs to a run with the space beside it.
        while i > 0 and (not new or new[0].isspace()):
            i -= 1
            new = f"{self.texts[i]} {new}"
        while j < len(self.texts) and (not new or new[-1].isspace()):
            new = f"{new} {self.texts[j]}"
            j += 1
        self._put(i, j, new)


def recount(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_before, n_after, n_chars, n_encoded`` from ``doc_id, text, edits array<struct<start,stop,text>>``."""
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            out = [[], [], [], []]
            for t, edits in zip(b.column(1), b.column(2).to_pylist()):
                tree = TokenTree(t.as_py() or "", own)
                n = tree.tokens
                for e in edits or []:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                for column, v in zip(out, (n, tree.tokens, int(tree.sums[0, 1]) - 1, tree.encoded)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_before", "n_after", "n_chars", "n_encoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast("array<struct<start:int,stop:int,text:string>>").alias("edits"))
    return rows.mapInArrow(count, "doc_id long, n_before long, n_after long, n_chars long, n_encoded long")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all ``documents`` before and after three edits each: a cut, an insertion and a replacement."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda a, b: (F.col("n") * a / b).cast("int")
    edit = lambda start, stop, text: F.struct(start.alias("start"), stop.alias("stop"), F.lit(text).alias("text"))
    edits = F.array(edit(at(1, 4), at(1, 4) + 20, ""), edit(at(1, 2), at(1, 2), " an added remark, "), edit(at(3, 4), at(3, 4) + 12, "replaced"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", n.alias("n"))
    return recount(docs.withColumn("edits", edits))
