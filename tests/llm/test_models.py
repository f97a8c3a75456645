"""op4, op10 and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, queries, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    words = [f"n{i}" for i in range(400)]
    bad = ["vile", "awful", "rotten", "nasty"] + [f"grub{x}" for x in "abcdefghijklmnop"]
    rows, labels = [], []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.choice([20, 120]))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(own))
            own[at:at] = [rng.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    got = toxicity.classify(docs, labels).where("held_out").collect()
    hits = [r["predicted"] == truth[r["doc_id"]] for r in got]
    assert len(hits) > 150 and sum(hits) / len(hits) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["segments"] for r in got if r["predicted"])


def test_labels_of_held_out_rows_change_nothing(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda l: sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.classify(docs, l).collect())
    assert score(labels) == score(flipped)


def test_toxic_defined_cases(spark, odd_docs, no_docs, labelled):
    _, labels, _ = labelled
    got = toxicity.classify(odd_docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, toxic int")))
    assert got.count() == odd_docs.count() and got.where("score is null or held_out is null").count() == 0
    assert toxicity.classify(no_docs, labels).count() == 0
    assert toxicity.classify(odd_docs, labels.limit(0)).where("score > 0").count() == 0
    kept = toxicity.without_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() > 0


def test_earlier_text_silences_no_passage(spark, labelled):
    """One slur repeated, later passages with the same words, and a passage after both words were used twice."""
    docs, labels, _ = labelled
    lexicon = toxicity.fit(docs, labels)
    passage, clean = ["vile", "awful", "rotten", "nasty"], [f"n{i}" for i in range(400)] * 3

    def found(words, start, stop):
        return any(e > start and f < stop for f, e, x in toxicity.segments(lexicon.scores(words)) if lexicon.probability(x, len(words)) >= toxicity.THRESHOLD)

    words = [*passage, *clean, *passage, *clean, *passage]
    assert all(found(words, k, k + 4) for k in (0, 1204, 2408))
    used = [w for p in passage for w in (p, *clean[:100], p, *clean[100:200])]
    assert found(used + clean + passage, len(used) + 1200, len(used) + 1204)
    assert lexicon.scores(["vile"] * 6).min() > 0


def test_clean_words_below_a_toxic_prefix(spark):
    """Words met often, and only in clean text, keep their own odds; only words never met have their prefix's."""
    toxic = [(i, " ".join(["and so on"] * 9 + [f"grub{x}" for x in "abcdefgh"]), 1) for i in range(60)]
    clean = [(100 + i, " ".join(["and so on"] * 9 + (["grubstake"] if i % 3 == 0 else [])), 0) for i in range(300)]
    df = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert lexicon.log_odds("grubz") > 1 and lexicon.log_odds("gruba") > 1
    assert lexicon.log_odds("grubstake") == 0 and lexicon.log_odds("and") == 0
    counts = {"3 gru": (900, 60), "4 grub": (900, 60), "w gruba": (900, 0), "w grubstake": (0, 60), "w and": (500, 5000)}
    assert toxicity.Lexicon(counts, 9000, 9000, entries=3).log_odds("grubstake") == 0


@pytest.mark.parametrize("seed", range(20))
def test_segments_are_all_maximal(seed):
    """Against the definition: recursively the best segment, then what is left of it and right of it."""
    rng = random.Random(seed)
    s = np.array([rng.choice([-3, -2, -1, 1, 2, 3]) * 1.0 for _ in range(40)])

    def maximal(lo, hi):
        best = max(((s[i:j].sum(), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return [*maximal(lo, i), (i, j, best[0]), *maximal(j, hi)]

    got, want = toxicity.segments(s), maximal(0, len(s))
    assert sum(x for *_, x in got) == pytest.approx(sum(x for *_, x in want))
    assert toxicity.best_segment(s) == pytest.approx(max(x for *_, x in want))
    assert max(x for *_, x in got) == pytest.approx(max(x for *_, x in want))


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return {s: 3.0 * sizes[s] for s in order}
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free)
        new = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= new


def test_mix(spark, odd_docs, no_docs):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "é", "😀", "z", None, "tiny"] if i < 40 else ["a", "a", "a", "é", "z"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.per_row(mixing.mix(df)).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sums = defaultdict(int)
    for i in size:
        sums[source[i]] += size[i]
    want, taken = plain_targets(sums), defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sums:
        assert abs(taken[s] - want[s]) <= max(200, 0.02 * want[s])
    again = mixing.per_row(mixing.mix(df.repartition(2))).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_copies_have_their_fractions_as_means(spark):
    sizes = {"a": [3, 50, 7, 400, 20], "b": [9, 9, 30, 11], "c": [1000, 2, 5]}
    rows = [(k * 10 + i, " ".join(["w"] * n), f"{seed:03d}{s}") for seed in range(300) for k, (s, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    # Three hundred groups of sources, each with weights and targets of its own place in the turn of weights.
    got = mixing.per_row(mixing.mix(df)).where("size > 0").collect()
    error, n = defaultdict(float), defaultdict(int)
    for r in got:
        fraction = r["target"] / r["source_size"]
        assert abs(r["copies"] - fraction) < 1 + 1e-9
        error[r["doc_id"]] += r["copies"] - fraction
        n[r["doc_id"]] += 1
    assert all(abs(error[i] / n[i]) < 4 * 0.5 / n[i] ** 0.5 for i in n)


def test_large_units_settle_first(spark):
    rows = [(i, " ".join(["w"] * n), s) for s in "ab" for i, n in enumerate([20_000, 9000, 500, 100, 40, 20, 10, 5, 3, 2, 1, 1, 1] + [30] * 40)]
    got = mixing.per_row(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        # Nothing lesser can bear the two largest; beside them every unit is settled.
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20_000
    rows = [(i, " ".join(["w"] * n), s) for s in "ab" for i, n in enumerate([60, 50, 45, 40] + [30] * 20 + [20, 15, 9, 5, 3, 2, 1, 1])]
    got = mixing.per_row(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30


def test_word_count(spark):
    texts = [None, "", " a\tb\x0bc\n", "é x y", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", mixing.word_count(F.col("t")).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_mix_defined_cases(spark, odd_docs, no_docs):
    got = mixing.per_row(mixing.mix(odd_docs))
    assert got.count() == odd_docs.count() and mixing.per_row(mixing.mix(no_docs)).count() == 0
    same = spark.createDataFrame([(7, "a b c", "s"), (7, "d e f", "s")] * 50 + [(8, "x y", "t")], "doc_id long, text string, source string")
    rows = mixing.per_row(mixing.mix(same)).collect()
    assert len(rows) == 101 and abs(sum(r["taken"] for r in rows if r["doc_id"] == 7) - rows[0]["target"]) <= 6
    out = mixing.mixture(odd_docs)
    assert out.columns == odd_docs.columns and mixing.mixture(no_docs).count() == 0
    total = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    copies = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    assert total == copies


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    from corpusmill.session import materialize

    held = docs
    for name, stage in p.STAGES[:-1]:
        before = held
        held = materialize(stage(spark, held, sf_dir), name)
        assert held.columns == names, name
        assert 0 < held.count() and (name == "mixing" or held.count() <= before.count())
        assert held.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
    last = p.STAGES[-1][1](spark, held, sf_dir)
    pieces = last.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert pieces.where("n > 2048").count() == 0
    assert last.where("piece = 0").count() == held.count()
    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard", "pii", "mixing", "packing"]


def maximal_by_definition(x):
    """The best segment, the shortest of equals, then the same on either side of it."""
    found = []

    def inside(low, high):
        best = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += x[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j + 1)
        if best:
            inside(low, best[1])
            found.append(best[1:])
            inside(best[2], high)

    inside(0, len(x))
    return found


@pytest.mark.parametrize("seed", range(60))
def test_segments_one_by_one(seed):
    x = np.random.default_rng(seed).normal(-0.3, 1, 1 + seed % 24)
    assert [(a, b) for a, b, _ in toxicity.segments(x)] == maximal_by_definition(x)


def test_segments_are_linear():
    import time

    rng = np.random.default_rng(1)
    for n in (80_000, 800_000):
        x = np.where(rng.random(n) < 0.2, 1.0, -0.4)
        began = time.process_time()
        toxicity.segments(x)
        assert time.process_time() - began < n * 5e-6


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert packing.CAPACITY == 2048
