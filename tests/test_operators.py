"""Operators against plain Python on tiny inputs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import hooks
from corpusmill.functions import text as T
from corpusmill.operators import audit, curriculum, dedup, order, quality, sampling
from corpusmill.operators import tokens as K


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, text, column, name="t"):
    return spark.createDataFrame([(text,)], f"{name} string").select(column.alias("out")).first()["out"]


def test_running_total(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("ab"), rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(data)
    out = order.running_total(spark.createDataFrame(data, "id int, g string, v int").repartition(7), ["id"], F.col("v"), "before", ["g"])
    sums, want = {"a": 0, "b": 0}, {}
    for i, g, v in sorted(data):
        want[i] = sums[g]
        sums[g] += v
    assert dict(values(out, "id", "before")) == want
    assert order.row_numbers(spark.createDataFrame([], "id int"), ["id"]).count() == 0


def test_first_wins_keeps_one_null_key(spark):
    df = spark.createDataFrame([(3, None), (1, None), (2, "a"), (4, "a")], "id int, k string")
    assert sorted(values(dedup.first_wins(df, F.col("k"), ["id"]), "id")) == [(1,), (2,)]


def test_short_sequences_share_a_key(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, list(range(30))), (4, [*range(13), 99, *range(17, 30)])], "id int, t array<int>")
    assert sorted(values(dedup.first_wins(df.withColumn("k", dedup.sequence_key(F.col("t"))), F.col("k"), ["id"]), "id")) == [(1,), (3,)]


@pytest.mark.parametrize("seed", range(4))
def test_interleave_is_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    weights = {d: rng.choice([0, 0.1, 0.15, 0.4, 0.9]) for d in "abcd"} | {"e": 0.2}
    sizes = {d: rng.randint(0, 40) for d in weights}
    df = spark.createDataFrame([(f"{d}{i}", d) for d, n in sizes.items() for i in range(n)] or [("e0", "e")], "k string, domain string")
    got = {pos: d for d, pos in values(curriculum.interleaved(df, weights, "k"), "domain", "pos")}
    live = {d: w for d, w in weights.items() if w > 0}
    turn = {d: max(1, round(w / min(live.values()))) for d, w in live.items()}
    left, want = {d: sizes[d] for d in live}, []
    while any(left.values()):
        for d in live:
            n = min(left[d], turn[d])
            want += [d] * n
            left[d] -= n
    assert [got[i] for i in range(len(want))] == want


def test_interleave_refuses_zero_weights(spark):
    with pytest.raises(ValueError):
        curriculum.interleaved(spark.createDataFrame([("a", "a")], "k string, domain string"), {"a": 0.0}, "k")


def test_jitter_is_a_permutation_inside_windows(spark):
    df = spark.range(1000).withColumnRenamed("id", "pos")
    got = values(curriculum.jittered(df.withColumn("k", F.col("pos")), "k", 100), "pos", "epoch_pos")
    assert sorted(e for _, e in got) == list(range(1000))
    assert all(p // 100 == e // 100 for p, e in got) and any(p != e for p, e in got)


GOLDENS = {0: (0.3, 0.45, 0.25), 937: (0.361056, 0.390631, 0.248313), 1875: (0.26875, 0.425, 0.30625), 7500: (0.175, 0.35, 0.475), 14999: (0.299984, 0.449987, 0.25003)}


@pytest.mark.parametrize("step", GOLDENS)
def test_tier_weights(step):
    got = curriculum.tier_weights(step, 15_000)
    assert np.allclose([got["easy"], got["medium"], got["hard"]], GOLDENS[step], atol=1e-6)


@pytest.mark.parametrize("step", range(0, 15_000, 1111))
def test_ratios_sum_to_one_and_keep_tiers(step):
    plain = curriculum.ratios(step, 15_000, {d: 1.0 for d in curriculum.TIER})
    raised = curriculum.ratios(step, 15_000)
    for got in (plain, raised):
        assert abs(sum(got.values()) - 1) < 5e-4
    for tier in curriculum.SPLITS:
        total = [sum(v for d, v in x.items() if curriculum.TIER[d] == tier) for x in (plain, raised)]
        assert abs(total[0] - total[1]) < 1e-3
    assert raised["web_easy"] > plain["web_easy"]


def test_boost_file(tmp_path):
    p = tmp_path / "b.json"
    p.write_text('{"web_easy": 3}')
    assert curriculum.boosts(str(p)) == {"web_easy": 3.0} and curriculum.boosts(str(tmp_path / "none")) == {}
    p.write_text("{")
    assert curriculum.boosts(str(p)) == {}


def test_reweight_clamps_and_keeps_tiers(spark):
    df = spark.createDataFrame([("a", "easy", 0.3, 1e6, 0.01), ("b", "easy", 0.2, 1.0, 1.0), ("c", None, 0.1, 2.0, 1.0), ("d", "hard", 0.4, None, 1.0)], "domain string, tier string, ratio double, loss double, ref double")
    got = dict(values(curriculum.reweighted(df), "domain", "ratio"))
    assert abs(got["a"] + got["b"] - 0.5) < 2e-3 and got["a"] / got["b"] == pytest.approx(6, rel=1e-2)
    assert got["c"] == pytest.approx(0.1 * math.exp(0.3), abs=1e-4) and got["d"] == 0.4


@pytest.mark.parametrize(("step", "warmup", "want"), [(0, 100, 0.0), (50, 100, 0.005), (100, 100, 0.01), (1000, 100, 1e-6), (0, 0, 0.01)])
def test_learning_rate(spark, step, warmup, want):
    assert spark.range(1).select(curriculum.learning_rate(F.lit(step), warmup, 1000, 0.01).alias("x")).first()["x"] == pytest.approx(want, abs=1e-12)


def test_save_and_resume():
    assert curriculum.due(10, 5, 0, 0) and not curriculum.due(11, 5, 0, 59, 1) and curriculum.due(11, 5, 0, 60, 1) and not curriculum.due(0, 5, 0, 0)
    assert curriculum.resume_path("x", "y", bool) == "x" and curriculum.resume_path(None, "y", lambda _: False) is None


@pytest.mark.parametrize(("prompt", "response"), [(3, 4), (9, 4), (20, 10), (2, 15), (0, 3), (5, 5)])
def test_example_cuts(spark, prompt, response):
    p, r = list(range(prompt)), list(range(100, 100 + response))
    over = prompt + response - 10
    want = (p, r) if over <= 0 else ([], r[:10]) if over >= prompt else (p[over:], r)
    got = spark.createDataFrame([(p, r)], "p array<int>, r array<int>").select(K.example(F.col("p"), F.col("r"), 10).alias("e")).first()["e"]
    assert got["input_ids"] == want[0] + want[1] and got["labels"] == [-100] * len(want[0]) + want[1]


def test_packing_is_naive_packing(spark):
    rng = random.Random(5)
    docs = [(i, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(60)]
    stream = [t for _, d in docs for t in d]
    df = spark.createDataFrame(docs, "id int, tokens array<int>").repartition(5)
    got = dict(values(K.packed(df, ["id"], length=16), "seq_id", "tokens"))
    assert got == {k: stream[16 * k : 16 * k + 16] for k in range(len(stream) // 16)}
    shards = {(s, k): t for s, k, t in values(K.packed(df, ["id"], length=16, shard=50), "shard", "seq_id", "tokens")}
    assert shards == {(s, k): stream[50 * s : 50 * s + 50][16 * k : 16 * k + 16] for s in range(len(stream) // 50 + 1) for k in range(3) if len(stream[50 * s : 50 * s + 50][16 * k : 16 * k + 16]) == 16}


def test_chunks_and_windows(spark):
    df = spark.createDataFrame([([],), ([1],), (list(range(9)),)], "t array<int>")
    assert [r[0] for r in df.select(K.chunks(F.col("t"), 4)).collect()] == [[], [[1, 0, 0, 0]], [[0, 1, 2, 3], [4, 5, 6, 7], [8, 0, 0, 0]]]
    assert [r[0] for r in df.select(K.windows(F.col("t"), 4)).collect()] == [[], [], [[0, 1, 2, 3, 4], [4, 5, 6, 7, 8]]]


def test_retention_and_means(spark):
    df = spark.createDataFrame([("r", s) for s in (100, 200, 300, 400, 500)], "run string, step int")
    assert sorted(values(audit.retained(df, ["run"], "step", 3), "step")) == [(300,), (400,), (500,)]
    assert audit.retained(df, ["run"], "step", 0).count() == 5
    m = spark.createDataFrame([("p", [1.0, 2.0, 3.0, 4.0]), ("p", [5.0, 6.0, 7.0, 8.0])], "k string, v array<double>")
    assert sorted(values(audit.elementwise_mean(m, "k", "v"), "place", "mean")) == [(0, 3.0), (1, 4.0), (2, 5.0), (3, 6.0)]


def test_nan_passes_no_gate(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (3.0,)], "x double")
    assert df.where(quality.at_least(F.col("x"), 2.26)).count() == 1
    assert df.where(quality.finite(F.col("x"))).count() == 1


def test_boundary_of_fifty(spark):
    df = spark.createDataFrame([(" " + "a" * 50 + " ",)], "t string")
    assert df.select(quality.length_gate(F.col("t"), "stripped"), quality.length_gate(F.col("t"), "loaded")).first()[:] == (True, False)


def test_systematic_and_quota(spark):
    df = spark.range(103)
    assert [r[0] for r in sampling.systematic(df.withColumn("g", F.lit(1)), 10, ["id"], ["g"]).orderBy("id").select("id").collect()] == list(range(0, 100, 10))
    assert sampling.quota(df.withColumn("g", F.col("id") % 3), ["g"], 5, F.col("id")).count() == 15


@pytest.mark.parametrize(("text", "want"), [("a\n<answer>  x = 1 </answer> b", "x = 1"), ("<answer></answer> rest", ""), ("t\n```python\ncode\n```", "code"), ("  all ", "all")])
def test_answer(spark, text, want):
    assert one(spark, text, T.answer(F.col("t"))) == want


def test_code(spark):
    assert one(spark, "<thinking>x</thinking> Sure:\n```python\ndef f():\n    return 1\nThat is it.\n```", T.code(F.col("t"))) == "def f():\n    return 1"
    assert one(spark, "Here: def g(x):\n  return x\n\nDone", T.code(F.col("t"))) == "def g(x):\n  return x"


def test_preamble(spark):
    assert one(spark, "Okay, let me see.\nSo, this is it. Well, fine. The text stays.", T.without_preamble(F.col("t"))) == "The text stays."
    assert one(spark, "Plain text. More.", T.without_preamble(F.col("t"))) == "Plain text. More."


def test_renames_are_ordered(spark):
    assert one(spark, "count total result res results", T.renamed(F.col("t"), T.RENAME_SETS[3])) == "cnt tot out out results"


def test_document_and_its_key(spark):
    doc = T.document(F.lit("code"), F.col("t"), F.lit("easy"), F.lit("M"), F.lit(""), F.lit("S"))
    want = "# CODE QUESTION\nDifficulty: easy\nwhat  is\n\tit\n\n## THREE SOLUTION METHODS\nM\n\n## SIMILAR QUESTIONS\nS"
    assert one(spark, "what  is\n\tit", doc) == want
    assert one(spark, "what  is\n\tit", T.history_key(doc)) == re.sub(r"\s+", " ", "what  is\n\tit") == one(spark, "what  is\n\tit", T.question_key(F.col("t")))


def test_json_inside(spark):
    col = T.json_inside(F.col("t"), "quality int")["quality"]
    assert one(spark, '<think>{"quality": 1}</think> so {"quality": 7} end', col) == 7 and one(spark, "none", col) is None


def test_code_check_is_bounded():
    assert hooks.passes("def check(f):\n    assert f(1) == 2\ncheck(lambda x: x + 1)")
    assert not hooks.passes("assert False") and not hooks.passes("while True: pass", timeout=2) and not hooks.passes(None)


def test_generator_retries(spark):
    def client(p):
        if "bad" in p:
            raise RuntimeError
        return p.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, p string")
    assert dict(values(hooks.generated(df, "p", client), "id", "reply")) == {1: "OK", 2: "", 3: ""}


def test_first_wins_keeps_null_orders(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (1, "b")], "id int, k string")
    assert sorted(values(dedup.first_wins(df, F.col("k"), ["id"]), "k")) == [("a",), ("b",)]


def test_first_key_keeps_repeated_rows(spark):
    keys = spark.createDataFrame([("ab", 1), ("a", 0)], "key string, ord int")
    df = spark.createDataFrame([("xAb",), ("xAb",), ("b",), (None,)], "t string")
    assert sorted((r["t"] or "", r["key"] or "") for r in hooks.first_key(df, keys, "t").collect()) == [("", ""), ("b", ""), ("xAb", "a"), ("xAb", "a")]


def test_generator_failures(spark):
    def client(p):
        if "bad" in p:
            raise RuntimeError
        return p

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, p string")
    assert values(hooks.generated(df, "p", client, wait=0.01, failed="drop"), "id") == [(1,)]
    with pytest.raises(Exception):  # noqa: B017 - Spark's own
        hooks.generated(df, "p", client, failed="raise").collect()


def test_hooks_score_and_verify(spark):
    df = spark.createDataFrame([("def f(x):\n    return x + 1", "def check(g):\n    assert g(1) == 2", "f"), ("def f(x):\n    return x", "def check(g):\n    assert g(1) == 2", "f")], "c string, t string, e string")
    assert [r[0] for r in df.select(hooks.verified(F.col("c"), F.col("t"), F.col("e"))).collect()] == [True, False]
    assert [r[0] for r in df.select(hooks.scored(F.col("e"), len)).collect()] == [1.0, 1.0]


@pytest.mark.parametrize(("text", "want"), [("p\n# Solution\n s # Solution", ("p\n", "s # Solution")), ("# Solution x", None), ("p # Solution \n", None), ("p", None), (None, None)])
def test_solution_split(spark, text, want):
    got = one(spark, text, T.solution_split(F.col("t")))
    assert (got and tuple(got)) == want


def test_function_name_is_the_first_lower_case_runs(spark):
    assert one(spark, "Find the Longest path of x", T.function_name(F.col("t"))) == "solve_ind_the_ongest"


def test_a_bad_row_stops_the_write(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert quality.all_or_nothing(df.where("not isnan(x)"), quality.finite(F.col("x"))).count() == 1
    with pytest.raises(ValueError):
        quality.all_or_nothing(df, quality.finite(F.col("x")))
