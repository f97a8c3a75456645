"""Readers, writers and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, tokenbin
from corpusmill.streaming import telemetry


def test_tokenbin_round_trip(spark, tmp_path):
    tokenbin.register(spark)
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 49_152, 32 * 5 + 3).astype("<u2"), rng.integers(0, 49_152, 10).astype("<u2")
    a.tofile(tmp_path / "s0.bin")
    b.tofile(tmp_path / "s1.bin")
    df = spark.read.format("tokenbin").option("path", str(tmp_path)).option("seq_len", 32).load()
    got = {(r["shard"], r["seq_id"]): r["tokens"] for r in df.collect()}
    assert got == {("s0.bin", i): a[32 * i : 32 * i + 32].tolist() for i in range(5)}
    assert sorted(r["seq_id"] for r in df.where("seq_id >= 2 and seq_id < 4").collect()) == [2, 3]
    out = tmp_path / "out"
    df.orderBy("seq_id").coalesce(1).write.format("tokenbin").option("path", str(out)).mode("append").save()
    assert np.fromfile(next(out.glob("*.bin")), "<u2").tolist() == a[:160].tolist()


def test_jsonl_modes(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(json.dumps({"text": "a"}) + "\n\n" + json.dumps({"text": "b"}) + "\n")
    bad.write_text(json.dumps({"text": "a"}) + "\n{broken\n" + json.dumps({"other": 1}) + "\n")
    assert files.read_jsonl(spark, str(good), "text string", "blank").count() == 2
    assert [r[0] for r in files.read_jsonl(spark, str(bad), "text string", "tolerant", required="text").collect()] == ["a"]
    with pytest.raises(Exception):  # noqa: B017 - Spark's own
        files.read_jsonl(spark, str(bad), "text string", "strict").collect()
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "text string", missing="skip").count() == 0


def test_load_keeps_texts_over_fifty(spark, tmp_path):
    spark.createDataFrame([("a" * 50,), ("b" * 51,), (None,), ("c" * 60,)], "text string").coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    assert [r["text"][0] for r in files.load(spark, str(tmp_path / "x.parquet")).collect()] == ["b", "c"]
    assert files.load(spark, str(tmp_path / "x.parquet"), 1).count() == 1
    with pytest.raises(ValueError):
        files.load(spark, "x.csv")


def test_shards_and_numbers(spark, tmp_path):
    files.write_shards(spark.range(25).repartition(3), str(tmp_path / "s"), ["id"], 10)
    got = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.min("id"), F.max("id"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 9), (1, 10, 19), (2, 20, 24)]
    for n in ("shard_3.bin", "shard_11.bin"):
        (tmp_path / n).write_text("")
    assert files.next_index(spark, str(tmp_path)) == 12 and files.next_index(spark, str(tmp_path / "none")) == 0


def test_controller_steps():
    workers, low, seen = 8, 0, []
    for speed in (0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 2.0, 0.5):
        workers, low = telemetry.controlled(workers, low, speed)
        seen.append((workers, low))
    assert seen == [(8, 1), (7, 0), (7, 1), (6, 0), (6, 1), (6, 2), (7, 0), (7, 0)]


def run(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_stateful_streams(spark, tmp_path):
    speeds = [0.1, 0.1, 2.0, 0.5]
    spark.createDataFrame([("q", i, s) for i, s in enumerate(speeds)], "key string, at long, mb_per_s double").coalesce(1).write.parquet(str(tmp_path / "speeds"))
    stream = spark.readStream.schema("key string, at long, mb_per_s double").parquet(str(tmp_path / "speeds"))
    got = run(spark, telemetry.concurrency(stream), tmp_path, "workers").orderBy("at").collect()
    assert [r["workers"] for r in got] == [8, 7, 8, 8]
    sizes = [5, 5, 5, 5, 5, 6, 6]
    spark.createDataFrame([("q", i, s) for i, s in enumerate(sizes)], "key string, at long, size long").coalesce(1).write.parquet(str(tmp_path / "sizes"))
    stream = spark.readStream.schema("key string, at long, size long").parquet(str(tmp_path / "sizes"))
    got = run(spark, telemetry.stalls(stream), tmp_path, "stalled").orderBy("at").collect()
    assert [r["restart"] for r in got] == [False, False, False, False, True, False, False]


def test_count_windows_on_a_stream_are_the_batch_ones(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    seen = []

    def settle(means):
        seen.extend(tuple(r) for r in means.collect())

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "events")).select(F.col("event_id").alias("step"), F.col("event_type").alias("domain"), F.col("value").alias("loss"))
    q = telemetry.reweight_each(stream, settle, 500, 10).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    batch = telemetry.count_windows(events, F.col("event_id"), 500, "event_type", "value")
    assert sorted((w, d, n) for w, d, n, _ in seen) == sorted((r["window"], r["domain"], r["updates"]) for r in batch.collect())


def test_log_lines(spark):
    lines = ["Step 1,200/115,000 | Loss 1.0870 | LR 3.00e-04 | 9.12 s/step | 7,183 tok/s | GPU 5.1", "noise", "📊 per-domain: math_easy 1.50 · web_hard 2.75"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert telemetry.parsed(df).first()[:] == (1200, 115_000, 1.087, 3e-4, 9.12, 7183.0)
    assert sorted(tuple(r) for r in telemetry.domain_losses(df).collect()) == [("math_easy", 1.5), ("web_hard", 2.75)]


def test_tokenbin_filters_ranges_and_appends(spark, tmp_path):
    tokenbin.register(spark)
    a = np.arange(32 * 5, dtype="<u2")
    a.tofile(tmp_path / "s0.bin")
    read = lambda path, **o: spark.read.format("tokenbin").options(path=str(path), seq_len=32, **o).load()
    df = read(tmp_path)
    assert df.count() == 5 and df.where("seq_id = 1").count() == 1 and df.count() == 5
    assert sorted(r["seq_id"] for r in read(tmp_path, first=1, limit=3).collect()) == [1, 2]
    out = tmp_path / "out"
    put = lambda mode: df.orderBy("seq_id").coalesce(1).write.format("tokenbin").option("path", str(out)).mode(mode).save()
    put("append")
    put("append")
    assert sorted(p.name for p in out.iterdir()) == ["shard_00000.bin", "shard_00001.bin"]
    assert read(out).count() == 10 and read(out, files=1).count() == 5
    put("overwrite")
    assert [p.name for p in out.iterdir()] == ["shard_00000.bin"] and np.fromfile(out / "shard_00000.bin", "<u2").tolist() == a.tolist()


def test_windows_across_batches_are_whole(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(1, 41)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "step long, domain string, loss double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    last = {}

    def settle(means):
        last.update({(r["window"], r["domain"]): (r["updates"], r["mean_loss"]) for r in means.collect()})

    stream = spark.readStream.schema("step long, domain string, loss double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    q = telemetry.reweight_each(stream, settle, 15, 3).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    whole = telemetry.count_windows(spark.createDataFrame(rows, "step long, domain string, loss double"), F.col("step"), 15, "domain", "loss")
    assert last == {(r["window"], r["domain"]): (r["updates"], r["mean_loss"]) for r in whole.collect()}


def test_read_column_folder_size_and_formats(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "body string, n int").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert sorted(r["text"] for r in files.read_column(spark, str(tmp_path / "p"), "body").collect()) == ["a", "b"]
    size = files.folder_size(spark, str(tmp_path / "p")).first()
    assert size["files"] == 1 and size["bytes"] == sum(p.stat().st_size for p in (tmp_path / "p").glob("*.parquet"))
    df = spark.createDataFrame([("qa", "x"), ("book", "y")], "format_type string, text string")
    for _ in range(2):
        files.write_by_format(df, str(tmp_path / "f"))
    assert sorted((r["format_type"], r["text"]) for r in spark.read.json(str(tmp_path / "f")).collect()) == [("book", "y")] * 2 + [("qa", "x")] * 2
