"""op2, op5 and op7 against encoding whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import edits, memos, packing, tokenfiles
from corpusmill.llm.encoding import PieceEncoder, vocabulary_path

TEXTS = ["", " ", "a  b", " x ", "It's we'll don't 12345 4a5b", "A\n B\tc", "İstanbul ΟΔΟΣ é́ straße", "<|endoftext|> x <|startoftext|>", "a😀 b", "x" * 3000, "…“quoted” – text’s", "Z.\nThe end! (no)?"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, spark, sf_dir):
    e = PieceEncoder(vocabulary_path(name))
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    assert [e.encode(t) for t in texts] == [e.whole(t) if t else b"" for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_are_the_librarys(name):
    rng, e, t = random.Random(5), PieceEncoder(vocabulary_path(name), 50), Tokenizer.from_file(vocabulary_path(name))
    parts = ["a", "B", "the", "İ", "é", "é", "  ", " ", "\n", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "12", "!", "ǅ", "😀", "x" * 40, "word", "ﬁ", "Σ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 12)))
        assert np.frombuffer(e.encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_plain_latin_texts_need_no_library_pipeline(monkeypatch):
    """Neither the whole pipeline, nor the normalizer, for a first piece or for letters with marks."""
    path = vocabulary_path("word_bpe_49k.json")
    e, t = PieceEncoder(path), Tokenizer.from_file(path)
    assert e.lowers and e.first == "<"
    monkeypatch.setattr(e, "whole", lambda text: pytest.fail(text))
    for text in ("ÜBER Straße, GARÇON; x=Ünï12 O'Ñ! end.", "ǅ İstanbul İx.", "One", "Ĳ ŉ ſ ŷ. Ÿ"):
        assert np.frombuffer(e.encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def plain(name, rows):
    t = Tokenizer.from_file(vocabulary_path(name))
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in rows]


def test_token_files_round_trip(spark, odd_docs, no_docs):
    path, manifest = tokenfiles.write_token_files(odd_docs)
    got = tokenfiles.read_token_files(spark, path, manifest).collect()
    want = plain("byte_bpe_50k.json", [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), crc(x)) for i, x in want)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in ordered])[:-1]]).tolist()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert keys == sorted(keys)
    part = manifest.first()["part"]
    assert len(tokenfiles.token_ids(path, part, 0)) == ordered[0]["n_tokens"] or part
    path, manifest = tokenfiles.write_token_files(no_docs)
    assert tokenfiles.read_token_files(spark, path, manifest).count() == 0


def check_packing(rows, docs, name, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = [(i, k, at, x[at : at + capacity]) for i, x in plain(name, docs) for k, at in enumerate(range(0, len(x), capacity))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted((str(i), k, s, len(x), crc(x)) for i, k, s, x in want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark, odd_docs, no_docs):
    packed = packing.pack(odd_docs, keep_ids=True)
    rows = packed.collect()
    used, least = check_packing(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], "word_bpe_49k.json", 2048)
    plain_fit = packing.best_fit(np.bincount([r["length"] for r in rows], minlength=2049), 2048)
    assert least <= used <= sum(k for _, k in plain_fit)
    whole = {r["sequence_id"]: len(r["ids"]) // 2 for r in packing.assemble(packed).collect()}
    assert sum(whole.values()) == sum(r["length"] for r in rows) and max(whole.values()) <= 2048
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    lengths = np.clip(rng.lognormal(4 + seed / 5, 1, 4000).astype(int), 1, capacity)
    histogram = np.bincount(lengths, minlength=capacity + 1)
    made = packing.plan(histogram, capacity)
    back = np.zeros(capacity + 1, int)
    for pattern, k in made:
        assert sum(pattern) <= capacity and k > 0
        for v in pattern:
            back[v] += k
    assert (back == histogram).all()
    assert sum(k for _, k in made) <= 1.01 * max(-(-lengths.sum() // capacity), (lengths > capacity // 2).sum()) + 1


def test_edits_are_full_encodings():
    e, rng = PieceEncoder(vocabulary_path("byte_bpe_50k.json")), random.Random(3)
    words = ["alpha", "be.\nTa", "x", "don't", "12", "ü", "long" * 20]
    for t in [*TEXTS, " ".join(rng.choice(words) for _ in range(600))]:
        tree = edits.TokenTree(t, e)
        for _ in range(15):
            a = rng.randint(0, len(t) + 2)
            b = a + rng.choice([0, 1, 3, 40, 700])
            new = rng.choice(["", " ", "  ", "word", " two words ", "\n", "a b"])
            t = t[: min(a, len(t))] + new + t[min(b, len(t)) :] if a <= len(t) else t + new
            tree.edit(a, b, new)
            assert tree.text == t and tree.tokens == len(e.whole(t)) // 2


def test_edits_touch_little():
    e = PieceEncoder(vocabulary_path("byte_bpe_50k.json"))
    tree = edits.TokenTree("some words in a row " * 5000 + "end", e)
    tree.edit(50_000, 50_004, "other")
    assert 0 < tree.encoded < 2000


def test_recount_defined_cases(spark, odd_docs, no_docs):
    with_edits = odd_docs.withColumn("edits", F.when(F.col("doc_id") != 4, F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("stop"), F.lit("zz ").alias("text")))))
    e = PieceEncoder(vocabulary_path("byte_bpe_50k.json"))
    count = lambda t: len(e.whole(t)) // 2 if t else 0
    want = []
    for r in odd_docs.collect():
        t = r["text"] or ""
        after = t if r["doc_id"] in (4, None) else t[:1] + "zz " + t[3:]
        want.append((str(r["doc_id"]), count(t), count(after)))
    got = [(str(r["doc_id"]), r["n_before"], r["n_after"]) for r in edits.recount(with_edits).collect()]
    assert sorted(got) == sorted(want)
    assert edits.recount(no_docs.withColumn("edits", F.array().cast("array<struct<start:int,stop:int,text:string>>"))).count() == 0


def test_memos_of_one_owner_at_a_time():
    """Work of another owner drops the memo, work without an owner keeps it, and rows pass as they are."""
    memos._HELD.clear()
    first = memos.claim("first", list)
    rows = [pa.RecordBatch.from_pydict({"a": [1, 2]}), pa.RecordBatch.from_pydict({"a": []})]
    assert list(memos.tidy(None, iter)(rows)) == rows
    assert memos.claim("first", list) is first
    assert list(memos.tidy("second", iter)(rows)) == rows
    assert memos.claim("first", list) is not first
    memos._HELD.clear()
