"""Queries over whole tables against brute force in Python."""

import hashlib
import re

import pyarrow as pa
import pyarrow.parquet as pq

from corpusmill.functions import text as T
from corpusmill.plans import catalog


def got(spark, sf_dir, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()]


def read(sf_dir, name, *columns):
    return pq.read_table(f"{sf_dir}/{name}.parquet", columns=list(columns)).to_pylist()


def test_log_parse_all(spark, sf_dir):
    events = read(sf_dir, "events", "event_id", "value", "event_type")
    out = got(spark, sf_dir, "log_parse_all")
    assert {(s, d) for s, _, _, d in out} == {(e["event_id"], e["event_type"]) for e in events} and len(out) == len(events)
    value = {e["event_id"]: e["value"] for e in events}
    assert all(t == 10_000 and abs(x - value[s]) <= 0.005001 for s, t, x, _ in out)


def test_single_renames_all(spark, tmp_path):
    pq.write_table(pa.table({"conv_id": [k // 2 for k in range(200)], "turn": [k % 2 for k in range(200)]}), tmp_path / "conversations.parquet")
    want = []
    for k in range(100):
        t = f"def solve(arr, nums, s): total = s; res = nums; return total, res, target{k} lo hi count result"
        want += [(k, i, v) for i, (a, b) in enumerate(T.RENAMES) if (v := re.sub(rf"\b{a}\b", b, t)) != t]
    out = catalog.QUERIES["single_renames_all"](spark, str(tmp_path)).select("id", "conv_id", "variant", "text").collect()
    assert sorted(map(tuple, out)) == [(i, *w) for i, w in enumerate(want)]


def test_replicate_shuffle_all(spark, sf_dir):
    ids = [d["doc_id"] for d in read(sf_dir, "documents", "doc_id")]
    order = sorted((hashlib.md5(f"42:{c}:{i}".encode()).hexdigest(), i, c) for i in ids for c in (1, 2, 3))
    assert sorted(got(spark, sf_dir, "replicate_shuffle_all"), key=lambda r: r[2]) == [(i, c, k) for k, (_, i, c) in enumerate(order)]


def test_interval_lookup_all(spark, sf_dir):
    sizes: dict[str, int] = {}
    for d in read(sf_dir, "documents", "source", "text"):
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(d["text"] or "")
    places = [(p, k) for p in sorted(sizes) for k in range(sizes[p] // 2048)]
    assert sorted(got(spark, sf_dir, "interval_lookup_all")) == [(i, *p) for i, p in enumerate(places)]
