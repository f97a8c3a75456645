"""op9, op8 and op6 against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chroma, components, ngramjoin, search


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(str(d), len(sets[i]), str(min((x for x in least[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows)]


def near_copies(seed):
    """Groups of edited copies of a base, some with a passage many share, at and around the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(rng.choice([2, 12, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    for n in (0, 3, 6, 9, 12, 15, 20, 30):
        for _ in range(4):
            rows.append((len(rows), " ".join(passage + [rng.choice(words) for _ in range(n)])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(spark, seed):
    rows = near_copies(seed)
    got = ngramjoin.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == sorted(classes(rows))


def test_defined_cases(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = ngramjoin.components(odd_docs).collect()
    want = [w if w[1] else (w[0], 0, w[0]) for w in classes(rows)]
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(want)
    assert ngramjoin.components(no_docs).count() == 0
    kept = ngramjoin.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    empty = sum(1 for _, t in rows if not shingles(t))
    # Rows by place, as an id may stand for several texts.
    assert kept.count() == len({c for _, n, c in classes([(k, t) for k, (_, t) in enumerate(rows)]) if n}) + empty
    assert ngramjoin.representatives(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), alone=0).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def test_blocks_and_chunks_lose_no_link(spark, monkeypatch):
    """Blocks of a few sets, classes of two as homes: every way through the blocks is taken."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 300)
    monkeypatch.setattr(ngramjoin, "LARGE_CLASS", 2)
    rows = near_copies(7)
    got = ngramjoin.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == sorted(classes(rows))


def test_other_orders_must_meet(spark):
    """A link passes only if its prefixes share tokens under both other orders."""
    x = np.sort(np.random.default_rng(1).choice(2**62, 40, replace=False).astype(np.uint64))
    y = np.sort(np.concatenate([x[:-4], np.array([1, 2, 3, 4], np.uint64)]))
    assert ngramjoin.linked(x, y) and all(len(np.intersect1d(a, b)) for a, b in zip(ngramjoin.other_prefixes(x), ngramjoin.other_prefixes(y)))
    index = ngramjoin.Index([x, y])
    assert index.shared(x).tolist() == [40, 36]
    rows = [(1, 0, 0, 5, 40, 1), (1, 0, 1, 6, 40, 2)]
    made = [r + tuple(bytearray(p.tobytes()) for p in ngramjoin.other_prefixes(s)) for r, s in zip(rows, (x, y))]
    kind = "block long, chunk int, side int, node long, n int, c long, p2 binary, p3 binary"
    assert ngramjoin._swept(spark.createDataFrame(made, kind), 75, False).count() == 2
    for k in (6, 7):  # one order that shares nothing is enough to stop a pair
        other = [made[0], made[1][:k] + (bytearray(np.arange(5, dtype=np.int32).tobytes()),) + made[1][k + 1 :]]
        assert ngramjoin._swept(spark.createDataFrame(other, kind), 75, False).count() == 0


def bm25(docs, q):
    bags = [(i, search.terms(t)) for i, t in docs]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / max(1, len(bags))
    df = Counter(t for _, b in bags for t in b)
    out = []
    for i, b in bags:
        length = sum(b.values())
        s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t, m in search.terms(q).items() if t in b)
        if s > 0:
            out.append((-round(s, 9), i))
    return sorted(out)


def test_search_is_exact(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 100])))) for i in range(700)] + [(900, None), (901, "")]
    asked = [(i, t) for i, t in docs if i % 20 == 0]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    got = defaultdict(list)
    for r in search.top_k(df, spark.createDataFrame(asked, "id long, text string"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for i, t in asked:
        want = bm25(docs, t)[:5]
        assert np.allclose([s for _, s in got[i]], [-s for s, _ in want]) and [d for d, _ in got[i]] == [d for _, d in want]
    assert search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_search_rows_of_their_own(spark):
    """Null ids, equal texts, repeated query ids and rows, ties, a very long text, clashing columns."""
    docs = [(None, "aa bb"), (3, "aa bb"), (1, "aa bb"), (1, "aa cc"), (4, "dd " * 30_000 + "aa"), (5, None)]
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in docs], "id long, text string, names string, score double, rank int").repartition(3)
    asked = spark.createDataFrame([(7, "aa bb"), (7, "cc"), (8, "aa bb"), (8, "aa bb"), (None, "cc"), (9, "")], "id long, text string")
    got = sorted(((r["query_id"] or -1, r["rank"], r["doc_id"]) for r in search.top_k(df, asked, 3).collect()), key=str)
    three = [(1, 1), (2, 3), (3, None)]
    assert got == sorted([(q, k, d) for q in (7, 8, 8) for k, d in three] + [(7, 1, 1), (-1, 1, 1)], key=str)


def test_pruning_reads_less():
    rng = random.Random(9)
    bags = [Counter({rng.randrange(50): 1 for _ in range(5)} | ({999: 3} if i < 20 else {})) for i in range(5000)]
    shard = search.Shard(list(range(5000)), bags, 5.0)
    ids, _, read = shard.best(np.array([1, 2, 3, 999]), np.array([0.1, 0.1, 0.1, 9.0]), 10)
    assert set(ids.tolist()) <= set(range(20)) and read < 1200


def test_least_score_carries_over_shards():
    """A query gives k rows, however many shards there are, equal to brute force; a shard of worse documents gives none."""
    rng = random.Random(11)
    tongues = [[rng.randrange(1 << 40) for _ in range(400)] for _ in range(3)]
    bag = lambda v: Counter(v[min(int(rng.paretovariate(0.5)), 399)] for _ in range(rng.choice([5, 40, 90])))
    bags = [bag(tongues[i % 3]) for i in range(1500)] + [Counter(), Counter()]
    bags += bags[:40]
    ids = [None, *range(len(bags) - 1)]
    mean, df = sum(sum(b.values()) for b in bags) / len(bags), Counter(t for b in bags for t in b)
    weigh = lambda b: {t: n * math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) for t, n in b.items()}
    score = lambda w, b: round(sum(w[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, n in b.items() if t in w), 9)
    shards = [search.Shard(ids[a : a + 600], bags[a : a + 600], mean) for a in range(0, len(bags), 600)]
    asked = [weigh(bags[q]) for q in range(0, 300, 4)]
    found = search.Found(len(asked), 5)
    for shard in [*shards, search.Shard([7000, 7001], [Counter({t: 1}) for t in tongues[0][1:3]], mean)]:
        own = [(shard.find(np.array([*w])), np.array([*w.values()])) for w in asked]
        q, place, scores, _ = shard.search(own, found.least, 5)
        found.add(q, shard.ids[place], shard.null[place], scores)
    assert not len(q) and len(found.queries) == 5 * len(asked)
    for q, w in enumerate(asked):
        best = sorted((-score(w, b), i is None, i or 0) for i, b in zip(ids, bags))[:5]
        own = found.queries == q
        assert [None if n else i for i, n in zip(found.ids[own].tolist(), found.null[own])] == [None if n else i for _, n, i in best]
        assert np.allclose(found.scores[own], [-s for s, _, _ in best], atol=2e-9)


def test_shards_are_read_one_at_a_time(spark, monkeypatch):
    """A file's shards are groups of rows of their own, and an opened one takes little beside its postings."""
    import tracemalloc

    import pyarrow.parquet as pq

    monkeypatch.setattr(search, "SHARD", 40)
    docs = spark.createDataFrame([(i, f"a b w{i % 9}") for i in range(200)] + [(900, None)], "id long, text string").coalesce(1)
    path = search.shards(docs)._written.removeprefix("file://")
    groups = [pq.ParquetFile(f).metadata for f in Path(path).glob("*.parquet")]
    assert sum(m.num_rows for m in groups) == 6 and all(m.row_group(g).num_rows == 1 for m in groups for g in range(m.num_row_groups))
    assert sorted(i for row in search._rows(path) for i in row["ids"]) == [*range(200), 900]
    rng, n = np.random.default_rng(3), 1 << 21
    columns = search.index([*range(4096)], np.full(4096, n // 4096), rng.integers(0, 1 << 16, n), rng.integers(1, 9, n))
    tracemalloc.start()
    shard = search.Shard.opened(columns, 3.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 8 bytes a score; documents and counts are views.
    assert len(shard.docs) == n and most < 16 * n


def wav(notes, lead=0.0):
    import io
    import wave

    t = np.arange(chroma.RATE // 8) / chroma.RATE
    x = np.concatenate([np.zeros(int(lead * chroma.RATE)), *(np.sin(2 * np.pi * 440 * 2 ** (n / 12) * t) for n in notes)])
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(chroma.RATE)
        w.writeframes((x * 20_000).astype("<i2").tobytes())
    return held.getvalue()


def test_fingerprints_align_recordings(spark):
    rng = random.Random(6)
    tunes = [[rng.randrange(-12, 12) for _ in range(80)] for _ in range(4)]
    hops = 8
    rows = [(0, wav(tunes[0])), (1, wav(tunes[0], lead=hops * chroma.HOP / chroma.RATE)), (2, wav(tunes[1])), (3, wav(tunes[2])), (4, wav(tunes[0])), (5, None), (6, b"no audio"), (7, wav(tunes[3][:3]))]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"))
    got = {r["id"]: r["prints"] for r in prints.collect()}
    assert got[0] == got[4] and got[5] == got[6] == got[7] == []
    named = prints.where("id <> 4").withColumnRenamed("id", "class_id")
    found = chroma.align(named, named.where("class_id = 0")).collect()
    assert [(r["match_id"], r["offset"]) for r in found] == [(1, hops)]
    x, y = (np.array(got[i], np.uint32) for i in (0, 1))
    assert found[0]["bit_error"] == pytest.approx(chroma.bit_error(x, y, hops), abs=1e-6)


def test_alignment_recall_on_noise_and_motifs(spark):
    """Against the best of all offsets: noisy excerpts, excerpts whose motif also comes earlier, held tones."""
    rng = np.random.default_rng(9)
    tune = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    noisy = lambda x, p: x ^ np.packbits(rng.random((len(x), 32)) < p, axis=1).view(">u4").ravel().astype(np.uint32)
    rows, want = [], {}
    for k in range(60):
        kind = k % 4
        if kind < 2:  # noise
            full = tune(400)
            cut = noisy(full[(at := int(rng.integers(0, 300))) :][:100], (0.05, 0.12)[kind])
        elif kind == 2:  # a motif of which the excerpt has a later copy, with an end of its own
            motif = tune(40)
            full = np.concatenate([motif, tune(60), motif, tune(2), motif, tune(90)])
            at, cut = 100, noisy(full[100:184], 0.02)
        else:  # held tones
            full = np.repeat(tune(60), rng.integers(1, 8, 60))
            cut = full[(at := 30) :][:100]
        rows += [(2 * k, cut.astype(np.int64).tolist()), (2 * k + 1, full.astype(np.int64).tolist())]
        places = range(len(full) - len(cut) + 1)
        want[2 * k, 2 * k + 1] = min(places, key=lambda o: chroma.bit_error(cut, full, o))
        assert want[2 * k, 2 * k + 1] == at
    prints = spark.createDataFrame(rows, "class_id long, prints array<long>")
    got = {(r["class_id"], r["match_id"]): r["offset"] for r in chroma.align(prints, prints.where("class_id % 2 = 0")).collect()}
    hit = {kind: sum(got.get(p) == o for p, o in want.items() if p[0] // 2 % 4 == kind) / 15 for kind in range(4)}
    assert min(hit.values()) >= 0.9, hit
    assert set(got) <= set(want)


def test_chroma_query_names_every_row(spark, sf_dir):
    out = chroma.op6_chroma_prints(spark, sf_dir)
    rows = out.where("vec_id is not null")
    assert rows.count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() == rows.select("vec_id").distinct().count()
    assert out.where(F.col("match_id") == F.col("class_id")).count() == 0


def alignments(prints, asked):
    """All pairs, all offsets: the definition of ``chroma.align``."""
    out = {}
    starts = {i: [k for k, v in enumerate(x) if not k or v != x[k - 1]] for i, x in prints.items()}
    alike = lambda v, w: sum(v >> s & 255 != w >> s & 255 for s in (0, 8, 16, 24)) <= 1
    for a in asked:
        for b in prints:
            x, y = prints[a], prints[b]
            votes = Counter(j - i for i in starts[a] for j in starts[b] if alike(x[i], y[j])) if a != b else {}
            best = None
            for o in sorted((o for o, n in votes.items() if n >= 3), key=lambda o: (-votes[o], abs(o), o))[: chroma.OFFSETS]:
                lo, hi = max(0, -o), min(len(x), len(y) - o)
                error = math.floor(sum((x[i] ^ y[i + o]).bit_count() for i in range(lo, hi)) / (32 * (hi - lo)) * 1e6 + 0.5) / 1e6
                if error <= chroma.MAX_ERROR:
                    best = max(best or (-1,), ((0.5 - error) * (hi - lo), votes[o], -abs(o), -o, error))
            if best:
                out[a, b] = (-best[3], best[1], best[4])
    return out


def chance_prints():
    """Recordings of few integers near each other, so that many match by chance."""
    rng = random.Random(4)
    root = rng.getrandbits(32)
    base = [root ^ sum(1 << k for k in rng.sample(range(32), 4)) for _ in range(12)]
    near = lambda v: v ^ rng.getrandbits(8) << rng.choice((0, 8, 16, 24)) if rng.random() < 0.3 else v
    return {i: [near(rng.choice(base)) for _ in range(rng.choice([3, 8, 25])) for _ in range(rng.choice([1, 1, 3]))] for i in range(70)}


@pytest.mark.parametrize("together", [1, 50, 1 << 21])
def test_blocks_of_recordings_equal_all_pairs(monkeypatch, together):
    monkeypatch.setattr(chroma, "TOGETHER", together)
    prints = chance_prints()
    want, ids = alignments(prints, range(0, 70, 3)), [*prints]
    arrays = [np.array(prints[i], np.uint32) for i in ids]
    got = {}
    for a in range(0, 70, 33):
        block = chroma.Block(ids[a : a + 33], arrays[a : a + 33])
        for b in range(0, 70, 30):
            some = [i for i in ids[b : b + 30] if i % 3 == 0]
            for c in block.matches(chroma.Recordings(some, [arrays[i] for i in some]), chroma.MAX_ERROR, chroma.MIN_COMMON):
                got |= {(q, m): tuple(r) for q, m, *r in zip(*(x.tolist() for x in c))}
    assert len(want) > 400 and got == want


def test_chroma_links_are_counted_not_listed(spark):
    """A row a recording however many match, copies among them; null ids, empty fingerprints and an empty table too."""
    prints = chance_prints()
    rows = [(i, x) for i, x in prints.items()] + [(200, prints[1]), (201, prints[1]), (None, prints[2]), (None, [9, 9, 8]), (220, []), (221, [])]
    df = spark.createDataFrame(rows, "id long, prints array<long>").withColumn("digest", F.md5(F.concat_ws(",", F.col("prints").cast("array<string>")))).repartition(3)
    want = defaultdict(dict)
    asked = [0, 1, 20, 40, 60]
    for (a, b), (offset, common, error) in alignments(prints, asked).items():
        want[a][b] = (error, -common, b, offset)
    got = chroma.linked(df).collect()
    assert len(got) == len(rows) and Counter(r["vec_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        found = want[r["class_id"]]
        assert r["n_links"] == (len(found) if r["class_id"] in asked else 0 if r["class_id"] == 220 else None)
        assert (r["bit_error"], -(r["common"] or 0), r["match_id"], r["offset"]) == (min(found.values()) if found else (None, 0, None, None))
    assert sum(len(found) for found in want.values()) > len(rows)
    assert chroma.linked(df.limit(0)).count() == 0
