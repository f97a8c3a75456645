"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the mean number of copies of each of its documents; the whole part is certain
and the fraction is rounded dependently.  Two documents with fractional mass (fraction times size) move mass
between them, in a random direction that keeps each one's mean, until one is taken once more or not at all; the
other meets the next one.  Mass is kept in every step, so a source misses its target by less than its last
document.  Documents of like size (within a factor of two) meet first, in buckets of about 32 by a hash of their
key; each bucket leaves one residual, residuals meet in the buckets above, and so on: a reduction tree whose depth
is the logarithm of the row count.  At most 32 residuals of each size class come to a source's root.  There the largest
meets all lesser ones at once: they take or give its mass in shares fixed before the draw, so every mean stays and the
large one is settled; then the next, down to the least ones, which pair again.  The last one of all is taken with the
probability that its mass says.  So every document's mean number of copies is its fraction, and a source misses its
target by less than the last unsettled document: one of its least, unless what reached the root beside a large one
couldn't bear that.

Rows that agree in source, id and size are one unit with a multiplicity: all but one fraction of a unit is whole,
so no bucket grows with repeated rows.  Random numbers are hashes of keys and the seed, so reruns agree whatever
the partitions.

Defined results: a null text has size 0; null sources are one source, last; a document of size 0 takes 0 words; a
source of size 0 has target 0; very long texts are units like others; other columns, whatever their names, are not
read (``mixture`` keeps them); an empty table gives no row.  Sources' totals and targets are a row a source, which
must fit one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize

BUCKET_BITS, FAN_BITS, CAP = 5, 5, 3.0


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII blanks."""
    blanks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.regexp_replace(blanks, r"[\x20\x09-\x0D]++", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row a source, weights by code point order.

    Targets share all words by weight, stop at ``cap`` times a source's size, and the excess is shared anew by
    weight.  In closed form: with sources by rising cap over weight, the first k are capped, where k is the least
    for which the words left over share out below every remaining cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    weighed = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    by_cap = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    upto, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = weighed.select(
        "*",
        F.coalesce(F.sum("most").over(upto), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum("w").over(upto), F.lit(0.0)).alias("w_before"),
        F.sum("source_size").over(everything).alias("all_words"),
        F.sum("w").over(everything).alias("all_w"),
    ).withColumn("level", (F.col("all_words") - F.col("before")) / (F.col("all_w") - F.col("w_before")))
    # Where a source isn't capped the level is the same for it and all after it.
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("before", "w_before", "level"))).over(everything)
    return steps.withColumn("free", free).select(
        "source", "source_size", F.when(F.col("before") < F.col("free.before"), F.col("most")).otherwise(F.least(F.col("free.level") * F.col("w"), F.col("most"))).alias("target")
    )


_UNIT = "struct<source:string,doc_id:bigint,size:bigint,h:bigint,m:bigint,mass:double>"


def _fold(items: Column, seed: int) -> Column:
    """Pivots over one bucket: decided units with the words they take, and the residual."""
    start = F.struct(F.lit(None).cast(_UNIT).alias("rest"), F.array().cast(f"array<struct<unit:{_UNIT},take:bigint>>").alias("out"))

    def moved(unit: Column, mass: Column) -> Column:
        return F.struct(unit["source"].alias("source"), unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), unit["h"].alias("h"), unit["m"].alias("m"), mass.alias("mass"))

    def decided(unit: Column, take: Column) -> Column:
        return F.array(F.struct(unit.cast(_UNIT).alias("unit"), take.cast("bigint").alias("take")))

    def pair(acc: Column, x: Column) -> Column:
        a = acc["rest"]
        to_a = F.least(a["size"] - a["mass"], x["mass"])  # up to this a gains from x
        to_x = F.least(a["mass"], x["size"] - x["mass"])
        u = F.pmod(F.xxhash64(a["h"], x["h"], F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        gain = F.when(u * (to_a + to_x) < to_x, to_a).otherwise(-to_x)  # the mean gain is 0
        sums = F.array(F.struct((a["mass"] + gain).alias("a"), (x["mass"] - gain).alias("x")))
        whole = lambda s, unit: (s < 1e-6) | (s > unit["size"] - 1e-6)

        def settle(s: Column) -> Column:
            done_a, done_x = whole(s["a"], a), whole(s["x"], x)
            out_a = decided(a, F.when(s["a"] < 1e-6, F.lit(0)).otherwise(a["size"]))
            out_x = decided(x, F.when(s["x"] < 1e-6, F.lit(0)).otherwise(x["size"]))
            none = F.lit(None).cast(_UNIT)
            return F.struct(
                F.when(done_a & done_x, none).when(done_a, moved(x, s["x"])).otherwise(moved(a, s["a"])).cast(_UNIT).alias("rest"),
                F.when(done_a & done_x, F.concat(acc["out"], out_a, out_x)).when(done_a, F.concat(acc["out"], out_a)).otherwise(F.concat(acc["out"], out_x)).alias("out"),
            )

        first = F.struct(x.cast(_UNIT).alias("rest"), acc["out"].alias("out"))
        return F.when(a.isNull(), first).otherwise(F.element_at(F.transform(sums, settle), 1))

    return F.aggregate(items, start, pair)


def _settled(items: Column, seed: int) -> Column:
    """Masses of a root's units, from the largest size down, after each has met all lesser ones at once.

    A unit gains or gives what makes it whole, as far as the lesser ones can bear it either way; each of those bears a
    share in proportion to its distance from the nearer whole, so both outcomes keep it within its bounds.
    """
    sizes = F.transform(items, lambda x: x["size"].cast("double"))

    def settle(m: Column, i: Column) -> Column:
        room = F.aggregate(F.slice(F.zip_with(m, sizes, lambda x, s: F.least(x, s - x)), i + 2, F.size(items)), F.lit(0.0), lambda a, x: a + x)
        up, down = F.least(F.get(sizes, i) - F.get(m, i), room), F.least(F.get(m, i), room)
        u = F.pmod(F.xxhash64(F.get(items, i)["h"], F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        gain = F.when(u * (up + down) < down, up).otherwise(-down)  # the mean gain is 0
        drawn = F.array(F.struct(gain.alias("gain"), room.alias("room")))

        def shared(d: Column) -> Column:
            lesser = lambda x, j: F.when(d["room"] > 0, x - d["gain"] * F.least(x, F.get(sizes, j) - x) / d["room"]).otherwise(x)
            return F.transform(m, lambda x, j: F.when(j < i, x).when(j == i, x + d["gain"]).otherwise(lesser(x, j)))

        return F.element_at(F.transform(drawn, shared), 1)

    return F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), F.transform(items, lambda x: x["mass"]), settle)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP, seed: int = 7, sizes: Column | None = None) -> DataFrame:
    """Units of rows with what the mix takes: ``source, doc_id, size, m, source_size, target, base, extra, part``.

    Each of a unit's ``m`` rows takes ``base`` copies, the first ``extra`` one more, the next ``part`` words more.
    """
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), (word_count(F.col("text").cast("string")) if sizes is None else sizes).alias("size"))
    units = materialize(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")), "units")
    shares = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, cap)
    shared = materialize(shares, "targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(copies + 1e-12)
    mean = units.join(shared, units["source"].eqNullSafe(shared["source"])).drop(shared["source"]).withColumn("base", base).withColumn("more", F.greatest(copies - base, F.lit(0.0)) * F.col("m"))
    mean = mean.withColumn("extra", F.floor(F.col("more") + 1e-12)).withColumn("mass", F.greatest(F.col("more") - F.col("extra"), F.lit(0.0)) * F.col("size"))
    h = F.pmod(F.xxhash64("source", "doc_id", "size", F.lit(seed)), F.lit(1 << 62))
    mean = mean.withColumn("h", h)
    open_units = (F.col("mass") > 1e-6) & (F.col("mass") < F.col("size") - 1e-6)
    count = units.count()
    bits = max(0, math.ceil(math.log2(max(count, 1))) - BUCKET_BITS)
    level = mean.where(open_units).select(F.struct("source", "doc_id", "size", "h", "m", "mass").cast(_UNIT).alias("unit"), F.pmod("h", F.lit(1 << bits)).alias("bucket"))
    taken = []
    while True:
        root = bits == 0
        by_size = lambda a, b: F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1))
        by_hash = lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).when(a["doc_id"] < b["doc_id"], -1).otherwise(1)
        ordered = F.array_sort(F.collect_list("unit"), (lambda a, b: F.coalesce(by_size(a, b), by_hash(a, b))) if root else by_hash)
        alike = F.lit(0) if root else F.floor(F.log2("unit.size")).cast("int")
        folded = level.groupBy(F.col("unit.source").alias("s"), alike.alias("alike"), "bucket").agg(ordered.alias("units"))
        if root:
            moved = folded.select("bucket", F.zip_with("units", _settled(F.col("units"), seed + 1), lambda x, m: x.withField("mass", m)).alias("units"))
            moved = materialize(moved, "settled")
            done = moved.select(F.explode("units").alias("unit")).where("unit.mass < 1e-6 or unit.mass > unit.size - 1e-6")
            taken.append(done.select("unit", F.when(F.col("unit.mass") < 1e-6, F.lit(0)).otherwise(F.col("unit.size")).cast("long").alias("take")))
            folded = moved.withColumn("units", F.filter("units", lambda x: (x["mass"] >= 1e-6) & (x["mass"] <= x["size"] - 1e-6)))
        folded = folded.select("bucket", _fold(F.col("units"), seed).alias("f"))
        folded = materialize(folded.select("bucket", "f.rest", "f.out"), "rounded")
        taken.append(folded.select(F.explode("out").alias("d")).select("d.unit", "d.take"))
        bits = max(0, bits - FAN_BITS)
        level = folded.where("rest is not null").select(F.col("rest").alias("unit"), F.pmod("bucket", F.lit(1 << bits)).alias("bucket"))
        if root:
            break
    # The last residual of a source is drawn by its mass.
    u = F.pmod(F.xxhash64("unit.h", F.lit(seed + 2)), F.lit(1 << 52)) / float(1 << 52)
    taken.append(level.select("unit", F.when(u * F.col("unit.size") < F.col("unit.mass"), F.col("unit.size")).otherwise(F.lit(0)).cast("long").alias("take")))
    chosen = taken[0]
    for t in taken[1:]:
        chosen = chosen.unionByName(t)
    chosen = chosen.select(*[F.col(f"unit.{c}").alias(f"_{c}") for c in ("source", "doc_id", "size")], "take")
    same = mean["source"].eqNullSafe(F.col("_source")) & mean["doc_id"].eqNullSafe(F.col("_doc_id")) & (mean["size"] == F.col("_size"))
    kept = ["source", "doc_id", "size", "m", "source_size", "target", "base", "extra"]
    settled = F.when(F.col("mass") >= F.col("size") - 1e-6, F.col("size")).otherwise(F.lit(0))
    return mean.join(chosen, same, "left").select(*kept, F.when(F.col("size") == 0, 0).otherwise(F.coalesce("take", settled)).cast("long").alias("part"))


def per_row(mixed: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, taken, copies, source``."""
    each = mixed.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    more = F.when(F.col("i") <= F.col("extra"), 1).when((F.col("i") == F.col("extra") + 1) & (F.col("part") > 0), 1).otherwise(0)
    copies = (F.col("base") + more).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the table's columns.

    Rows of equal source, id and size share their unit's copies in the order of a hash of their text.
    """
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("source").cast("string").alias("_source"), F.col("doc_id").cast("long").alias("_doc_id"), word_count(F.col("text").cast("string")).alias("_size")
    )
    mixed = mix(docs, **how)
    same = keyed["_source"].eqNullSafe(mixed["source"]) & keyed["_doc_id"].eqNullSafe(mixed["doc_id"]) & (keyed["_size"] == mixed["size"])
    both = keyed.join(mixed, same)
    # Only repeated rows need a number within their unit.
    single = both.where("m = 1").withColumn("i", F.lit(1))
    repeated = both.where("m > 1").withColumn("i", F.row_number().over(Window.partitionBy("_source", "_doc_id", "_size").orderBy(F.xxhash64("doc.text"))))
    more = F.when(F.col("i") <= F.col("extra"), 1).when((F.col("i") == F.col("extra") + 1) & (F.col("part") > 0), 1).otherwise(0)
    times = (F.col("base") + more).cast("int")
    return single.unionByName(repeated).select("doc", F.explode(F.array_repeat(F.lit(1), times)).alias("one")).select(*[F.col(f"doc.`{c}`").alias(c) for c in names])


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` mixed to weights 1, 2, 3 by source."""
    return per_row(mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "size", "source_size", "target", "taken")
