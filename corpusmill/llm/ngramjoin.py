"""Exact Jaccard join on word n-gram sets by prefix filters under several global orders.

Two sets whose Jaccard similarity reaches the threshold share a token among the first ``n - ceil(t n) + 1`` of each
under *any* global order of tokens.  The first order - the hashes of tokens, but with the ``HEAVY`` most frequent
tokens last, so that shared passages rarely stand in a prefix - finds candidates through an index, with bounds on
lengths and on the number of shared prefix tokens.  What it leaves must share prefix tokens under two more orders as
well, each of them; only what passes all three has its whole sets fetched and compared.

Equal sets are one node from the start.  Links are found in three steps, so that groups of near copies are never
expanded into all pairs:

1. each node of a prefix token meets its next ``BESIDE`` neighbours by size and the token's least set, and the classes
   of the verified links are found;
2. what is left between classes is nodes against blocks: nodes with a frequent token in common, or of one large class, and of like
   size, are dealt by hash to blocks of about ``BLOCK`` tokens; a node meets a block of other classes when enough of its
   prefix tokens are in prefixes of the block (counts by block, not by pair);
3. a block's nodes and those that meet it are swept twice: first by the prefixes under the two other orders, then, for
   the nodes left, by whole sets through an inverted index of the block.  A sweep joins classes as it goes.

Every pair that reaches the threshold is inside a class or compared, so components are exact.  The links are a subset
that spans the components and only serves them: pairs inside a class are left out once it is known, so links don't
count a document's near copies.

Defined results: words are runs of other characters than ASCII blanks, lower-cased A-Z; fewer words than ``n`` make
one token; a text without words has an empty set and its own class; null ids are kept (their class is the least id
it reaches, null if none); repeated rows are equal sets; very long texts are whole sets like others (one alone may
exceed a block); an empty table gives no row; other columns, whatever their names, are not read.  Tokens and sets are
known by 64-bit hashes; the prefixes of the two other orders by 32 bits, which can only let more through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusmill.llm.components import connected_components
from corpusmill.llm.memos import tidy
from corpusmill.session import discard, lean, materialize, release

WORDS, THRESHOLD = 5, 75
HEAVY, TASK_HEAVY, BITMAP_BITS, BESIDE, BLOCK, LARGE_CLASS = 262_144, 16_384, 23, 3, 1 << 19, 32
_ORDERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_FACTORS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37, 0x880355F21E6D1965], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct n-gram hashes of a text, ascending."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    if len(h) < words:
        return mixed(np.array([np.sum(h * _FACTORS[: len(h)]) + np.uint64(len(h))], np.uint64))
    total = np.zeros(len(h) - words + 1, np.uint64)
    for k in range(words):
        total += h[k : len(h) - words + 1 + k] * _FACTORS[k]
    return np.unique(mixed(total))


def node_of(tokens: np.ndarray) -> int:
    """A set's 64-bit name, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-n * threshold // 100) + 1


def prefix(tokens: np.ndarray, heavy: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The first tokens under the first order: by hash, heavy ones last (the most frequent at the very end)."""
    size = prefix_length(len(tokens), threshold)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        is_heavy = heavy[at] == tokens
        if is_heavy.any():
            light = tokens[~is_heavy]
            if len(light) >= size:
                return light[:size]
            return np.concatenate([light, tokens[is_heavy]])[:size]
    return tokens[:size]


def other_prefixes(tokens: np.ndarray, threshold: int = THRESHOLD) -> list[np.ndarray]:
    """The prefixes under the other orders, by 32 bits of each token there."""
    size = prefix_length(len(tokens), threshold)
    return [np.sort(mixed(tokens * factor))[:size].astype(np.uint32).astype(np.int32) for factor in _ORDERS]


def linked(x: np.ndarray, y: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Jaccard similarity of two sets at least the threshold, in integers."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def heavy_tokens(docs: DataFrame, words: int = WORDS, most: int = HEAVY) -> np.ndarray:
    """The most frequent tokens, from each task's own most frequent ones over all its texts; ascending hashes.

    Any choice gives exact joins; this one keeps frequent tokens out of prefixes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, held, size, met = Counter(), [], 0, set()

        def flush():
            if held:
                tokens, n = np.unique(np.concatenate(held), return_counts=True)
                keep = n > 1
                tokens, n = tokens[keep], n[keep]
                if len(n) > 4 * TASK_HEAVY:
                    top = np.argpartition(-n, 4 * TASK_HEAVY)[: 4 * TASK_HEAVY]
                    tokens, n = tokens[top], n[top]
                tally.update(dict(zip(tokens.tolist(), n.tolist())))
                held.clear()

        for b in batches:
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                name = node_of(s)
                if name not in met:
                    met.add(name)
                    held.append(s)
                    size += len(s)
                if size > 2_000_000:
                    flush()
                    size = 0
        flush()
        top = tally.most_common(TASK_HEAVY)
        yield pa.RecordBatch.from_arrays([pa.array(np.array([t for t, _ in top], np.uint64).astype(np.int64)), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])

    counts = _texts(docs).mapInArrow(tidy("ngrams", count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 2")
    counts = materialize(counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "frequent")
    # The least level from which on all tokens fit; a table of at most 1,024 levels.
    sizes, least, held = counts.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect(), 1 << 20, 0
    for r in sizes:
        held += r["k"]
        if held > most:
            break
        least = r["level"]
    top = counts.where(F.col("level") >= least).select("token").toArrow()  # at most ``most`` rows
    return np.sort(np.asarray(top.column("token")).astype(np.uint64))


def _candidates(met: DataFrame, threshold: int, part: float = 1.0) -> DataFrame:
    """Pairs ``a, b`` of nodes whose shared prefix tokens allow the threshold, from ``token, x, n, y, m`` rows.

    Where ``met`` has only some of a pair's tokens, a ``part`` of the least count is asked for.
    """
    ordered = met.where("x <> y").select("token", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.greatest("n", "m").alias("big"), F.least("n", "m").alias("less"))
    counts = ordered.groupBy("a", "b", "big", "less").agg(F.count("*").alias("c"))
    return counts.where(F.col("c") * (100 + threshold) >= _least_shared("big", F.col("less"), threshold) * part).select("a", "b")


def _alike(n: Column, m: Column, threshold: int) -> Column:
    """Sizes that allow the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * threshold


def _sets(docs: DataFrame, nodes: DataFrame, ends: DataFrame, words: int, threshold: int) -> DataFrame:
    """``node, p2, p3, tokens`` of the nodes in ``ends``: prefixes under the other orders, and whole sets.

    They are made again from the nodes' texts; a bitmap of fixed size over id hashes keeps other texts from being
    sent (when it fills up, they are sent and dropped by the join).
    """
    wanted = materialize(nodes.join(ends, "node"), "wanted")
    slot = F.pmod(F.xxhash64("key"), F.lit(1 << BITMAP_BITS))
    bits = wanted.select(slot.alias("slot")).selectExpr("shiftright(slot, 5) word", "shiftleft(1L, cast(slot % 32 as int)) bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    found = bits.toArrow()  # at most 2**18 rows
    bitmap[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = np.asarray(b.column(1))
            keep = np.flatnonzero(held.value[slots >> 5] >> (slots & 31).astype(np.uint32) & 1)
            out = [[], [], [], []]
            for k in keep.tolist():
                s = shingle_set(b.column(2)[k].as_py(), words)
                if len(s):
                    for column, v in zip(out, (node_of(s), *(p.tobytes() for p in other_prefixes(s, threshold)), s.tobytes())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["node", "p2", "p3", "tokens"])

    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    keyed = _texts(docs).select(key.alias("key"), "text").select("key", slot.alias("slot"), "text")
    # Repeated rows of an id, or rows without one, may give a set more than once.
    made = materialize(keyed.mapInArrow(tidy("ngrams", sets), "node long, p2 binary, p3 binary, tokens binary").dropDuplicates(["node"]), "sets")
    discard(wanted)
    return made


def _checked(pairs: DataFrame, made: DataFrame, columns: list[str], passes) -> DataFrame:
    """The pairs ``a, b`` whose columns of ``made`` pass."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [k for k, own in enumerate(zip(*b.columns[2:])) if passes(*(np.frombuffer(v.as_py(), np.int32 if n[1] == "p" else np.uint64) for n, v in zip(b.schema.names[2:], own)))]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    side = lambda node, mark: made.select(F.col("node").alias(node), *[F.col(c).alias(mark + c) for c in columns])
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", *[f"{mark}{c}" for c in columns for mark in "xy"])
    return both.mapInArrow(check, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs ``a, b`` of nodes that are links: prefixes under the other orders first, whole sets of what is left."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    made = _sets(docs, nodes, ends, words, threshold)
    shared = lambda x, y, z, w: bool(len(np.intersect1d(x, y)) and len(np.intersect1d(z, w)))
    left = materialize(_checked(pairs, made, ["p2", "p3"], shared), "candidates")
    links = materialize(_checked(left, made, ["tokens"], lambda x, y: linked(x, y, threshold)).distinct(), "links")
    discard(made, left)
    release(docs.sparkSession)
    return links


class Index:
    """An inverted index over the arrays of a block."""

    def __init__(self, arrays: list[np.ndarray]):
        self.size = len(arrays)
        owners = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        tokens = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owners[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many of these distinct tokens each array has."""
        first, stop = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
        n = stop - first
        places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owners[places], minlength=self.size)


def _swept(rows: DataFrame, threshold: int, whole: bool) -> DataFrame:
    """Rows ``block, chunk, side, node, n, c`` and arrays, swept by block; side 0 is the block, side 1 meets it.

    ``whole``: links ``a, b`` by whole sets, of which each joins two classes.  Else ``block, side, node`` of what
    shares prefixes under both other orders with a set of another class and like size.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"] if whole else ["block", "side", "node"]
        kinds = [pa.int64(), pa.int64()] if whole else [pa.int64(), pa.int32(), pa.int64()]
        now, block, indexes = None, [], None
        for b in batches:
            out = [[] for _ in names]
            keys, side, node, size, c = zip(b.column(0).to_pylist(), b.column(1).to_pylist()), *(b.column(k).to_pylist() for k in range(2, 6))
            for k, key in enumerate(keys):
                if key != now:
                    now, block, indexes = key, [], None
                arrays = [np.frombuffer(v[k].as_py(), np.uint64 if whole else np.int32) for v in b.columns[6:]]
                if not whole:
                    arrays = [np.unique(x) for x in arrays]
                if side[k] == 0:
                    block.append((node[k], size[k], c[k], arrays))
                    continue
                if not block:
                    continue
                if indexes is None:
                    indexes = [Index([x[3][i] for x in block]) for i in range(len(arrays))]
                    nodes, sizes, classes = (np.array([x[i] for x in block], np.int64) for i in range(3))
                    up: dict[int, int] = {}
                    told = np.zeros(len(block), bool)
                mine = c[k]
                while mine in up:
                    mine = up[mine]
                shared = [i.shared(x) for i, x in zip(indexes, arrays)]
                if whole:
                    met = np.flatnonzero((100 * shared[0] >= threshold * (size[k] + sizes - shared[0])) & (classes != mine))
                    for other, at in zip(*np.unique(classes[met], return_index=True)):
                        out[0].append(node[k])
                        out[1].append(int(nodes[met[at]]))
                        classes[classes == other] = mine
                        up[int(other)] = mine
                else:
                    alike = 100 * np.minimum(sizes, size[k]) >= threshold * np.maximum(sizes, size[k])
                    met = (shared[0] > 0) & (shared[1] > 0) & alike & (classes != mine)
                    if met.any():
                        new = np.flatnonzero(met & ~told)
                        told[new] = True
                        for s, x in [(1, node[k]), *((0, y) for y in nodes[new].tolist())]:
                            out[0].append(key[0])
                            out[1].append(s)
                            out[2].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=names)

    lean(rows.sparkSession)
    dealt = rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "side", "node")
    return dealt.mapInArrow(tidy("ngrams", sweep), "a long, b long" if whole else "block long, side int, node long")


def _sides(sides: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """Sides with arrays, in chunks: what meets a block is dealt by hash so that each chunk holds about ``BLOCK`` tokens, and the block goes to each of them."""
    chunks = F.ceil(F.col("held") / BLOCK).cast("int")
    totals = sides.where("side = 1").groupBy("block").agg(F.sum("n").alias("held")).select("block", F.greatest(chunks, F.lit(1)).alias("chunks"))
    dealt = sides.join(totals, "block")
    own = F.when(F.col("side") == 1, F.array(F.pmod(F.xxhash64("node"), "chunks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = dealt.join(made.select("node", *columns), "node").select("block", F.explode(own).alias("chunk"), "side", "node", "n", "c", *columns)
    return placed


def _least_shared(n: str, m, threshold: int) -> Column:
    """Sets of these sizes share at least that many prefix tokens, times ``100 + threshold``.

    Past the earlier end of two prefixes at most ``ceil(t n) - 1`` tokens of a set are left, so those and the shared
    prefix tokens must reach the least overlap.
    """
    left = F.floor((F.greatest(n, m) * threshold + 99) / 100) - 1
    return F.lit(threshold) * (F.col(n) + m) - left * (100 + threshold)


def across(docs: DataFrame, nodes: DataFrame, known: DataFrame, classes: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links between classes that the postings ``token, node, n, c`` allow, found by blocks."""
    open_tokens = known.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("often")).where("c1 <> c2").select("token", "often")
    left = materialize(known.join(open_tokens, "token"), "open")
    # A node's home: its large class, or its most frequent open token; sets of a home and of like size make blocks.
    sized = classes.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") >= LARGE_CLASS)
    homes = left.groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.max(F.struct("often", "token"))["token"].alias("token"))
    homes = homes.join(sized.withColumnRenamed("component", "c"), "c", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / threshold)))
    homes = materialize(homes.select("node", "n", "c", "k", F.xxhash64(F.when(F.col("k") > 0, F.col("c")).otherwise(F.col("token")), F.col("k") > 0, size_class).alias("home")), "homes")
    parts = homes.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("parts"))
    members = materialize(homes.join(parts, "home").select("node", "n", "c", "k", F.xxhash64("home", F.pmod(F.xxhash64("node"), "parts")).alias("block")), "members")
    placed = materialize(left.select("token", "node").join(members, "node"), "placed")
    discard(left, homes)
    release(known.sparkSession)
    in_block = placed.groupBy("token", "block").agg(F.max("k").alias("bk"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("n").alias("lo"), F.max("n").alias("hi")).withColumnRenamed("block", "other")
    # Of two blocks the node of the one with the lesser class meets the other one.
    turn = F.struct("k", "block") <= F.struct(F.col("bk").alias("k"), F.col("other").alias("block"))
    meets = turn & ((F.col("c1") != F.col("c2")) | (F.col("c1") != F.col("c"))) & (F.col("hi") * 100 >= F.col("n") * threshold) & (F.col("n") * 100 >= F.col("lo") * threshold)
    met = placed.join(in_block, "token").where(meets).groupBy("node", "n", "c", "other").agg(F.count("*").alias("shared"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lo, hi = F.greatest(F.col("lo"), F.ceil(F.col("n") * threshold / 100)), F.least(F.col("hi"), F.floor(F.col("n") * 100 / threshold))
    # The bound falls with the distance of sizes, but for one token by rounding.
    need = F.least(_least_shared("n", lo, threshold), _least_shared("n", hi, threshold)) - (100 + threshold)
    meeting = materialize(met.where(F.col("shared") * (100 + threshold) >= need).select(F.col("other").alias("block"), F.lit(1).alias("side"), "node", "n", "c"), "meeting")
    release(known.sparkSession)
    block = members.join(meeting.select("block").distinct(), "block", "left_semi").select("block", F.lit(0).alias("side"), "node", "n", "c")
    sides = materialize(meeting.unionByName(block), "sides")
    discard(placed, meeting)
    release(known.sparkSession)
    made = _sets(docs, nodes, sides.select("node").distinct(), words, threshold)
    stay = materialize(_swept(_sides(sides, made, ["p2", "p3"]), threshold, False).distinct(), "stay")
    links = materialize(_swept(_sides(sides.join(stay, ["block", "side", "node"], "left_semi"), made, ["tokens"]), threshold, True).distinct(), "links")
    discard(members, sides, made, stay)
    release(known.sparkSession)
    return links


def join(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents ``doc_id, n_shingles, node``; links ``a, b`` between nodes, only those that span components; components ``node, component``."""
    spark = lean(docs.sparkSession)
    heavy = spark.sparkContext.broadcast(heavy_tokens(docs, words))  # at most HEAVY

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "node"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            out = [[], [], []]
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                own = node_of(s)
                # A task gives the tokens of equal sets once.
                if len(s) and own not in met:
                    met.add(own)
                    for column, v in zip(out, (own, len(s), prefix(s, heavy.value, threshold).astype(np.int64))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    # Sets are made once for names and once for postings: cheaper than a table of prefixes beside their shuffle.
    found = materialize(_texts(docs).mapInArrow(tidy("ngrams", name), "doc_id long, n_shingles long, node long"), "found")
    nodes = materialize(found.where("node is not null").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("key")), "nodes")
    postings = _texts(docs).mapInArrow(tidy("ngrams", post), "node long, n int, tokens array<long>").select("node", "n", F.explode("tokens").alias("token"))

    order = Window.partitionBy("token").orderBy("n", "node")
    near = lambda f: F.struct(f("node").over(order).alias("node"), f("n").over(order).alias("n"))
    held = postings.select("token", "node", "n", F.lag("node").over(order).alias("before"), F.lead("node").over(order).alias("after"), near(F.first).alias("least"), *[near(lambda c, k=k: F.lag(c, k)).alias(f"near{k}") for k in range(1, BESIDE + 1)])
    # Equal sets of other tasks follow each other; the first stands for them.
    fresh = F.col("before").isNull() | (F.col("before") != F.col("node"))
    ends = F.filter(F.array_distinct(F.array("least", *[f"near{k}" for k in range(1, BESIDE + 1)])), lambda o: o["node"].isNotNull() & (o["node"] != F.col("node")) & _alike(o["n"], F.col("n"), threshold))
    shared = materialize(held.where(fresh & (F.col("before").isNotNull() | F.col("after").isNotNull())).select("token", "node", "n", ends.alias("ends")), "shared")
    release(spark)

    # Neighbours stand side by side at some of their tokens only, so half the count is asked for.
    met = shared.select("token", F.col("node").alias("x"), "n", F.explode("ends").alias("o")).select("token", "x", "n", F.col("o.node").alias("y"), F.col("o.n").alias("m"))
    tried = materialize(_candidates(met, threshold, 0.5), "pairs")
    release(spark)
    links = verified(docs, nodes, tried, words, threshold)
    known, classes = _by_class(shared, links)
    discard(shared, tried)
    release(spark)
    last = across(docs, nodes, known, classes, words, threshold)
    whole = materialize(links.unionByName(last), "links")
    discard(links, last, known, nodes)
    return found, whole, connected_components(whole)


def _by_class(postings: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings ``token, node, n, c`` with the classes that links make, and the classes."""
    classes = connected_components(links)
    release(postings.sparkSession)
    known = postings.select("token", "node", "n").join(classes, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("c"))
    return materialize(known, "postings"), classes


def components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; the class is its least document."""
    found, _, classes = join(docs, words, threshold)
    least = found.groupBy("node").agg(F.min("doc_id").alias("id")).join(classes, "node", "left").withColumn("c", F.coalesce("component", "node"))
    ids = least.where("node is not null").groupBy("c").agg(F.min("id").alias("component_id"))
    by_node = least.where("node is not null").join(ids, "c").select("node", "component_id")
    return found.join(by_node, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each class, with the table's columns: the least id (a null one last), then the first row read.

    Texts without words are classes of their own and stay.
    """
    names = docs.columns
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("place")), "documents")
    # The place stands for the id, so repeated and null ids stay apart.
    found, _, classes = join(held.select(F.col("place").alias("doc_id"), F.col("doc.text").alias("text")), words, threshold)
    ids = held.select(F.col("place"), F.col("doc.doc_id").cast("long").alias("id"))
    grouped = found.join(classes, "node", "left").select(F.col("doc_id").alias("place"), "node", F.coalesce("component", "node").alias("c")).join(ids, "place")
    first = grouped.where("node is not null").groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("r")).select("r.place")
    stay = first.unionByName(grouped.where("node is null").select("place"))
    return held.join(stay, "place", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in names])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates over all of ``documents``."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
