"""Queries over tokens, curricula, training examples, preferences and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import hooks
from corpusmill.functions import text as T
from corpusmill.operators import audit, curriculum, dedup, quality, sampling
from corpusmill.operators import tokens as K
from corpusmill.operators.order import row_numbers
from corpusmill.plans.registry import DOCS_SQL, TOKENS_SQL, docs, query, table
from corpusmill.streaming import telemetry

# ---- tokens and packing

_BY_DOC = f"{TOKENS_SQL}, td AS (SELECT doc_id, domain, list(id ORDER BY i) AS tokens FROM tok GROUP BY doc_id, domain)"


def _tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "domain", K.once(K.stub_tokens(F.col("text"))).alias("tokens"))


@query(f"WITH {TOKENS_SQL} SELECT domain, count(DISTINCT doc_id) AS docs, count(*) AS tokens, CAST(sum(id) AS BIGINT) AS id_sum FROM tok GROUP BY domain")
def stub_token_totals(spark, sf_dir):
    """Tokens by domain."""
    t = _tokens(spark, sf_dir).where(F.size("tokens") > 0)
    return t.groupBy("domain").agg(F.count("*").alias("docs"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("id_sum"))


@query(f"WITH {TOKENS_SQL}, p AS (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY doc_id, i) - 1 AS p0 FROM tok) SELECT domain, p0 // 2048 AS seq_id, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(id * (p0 % 2048 + 1)) AS BIGINT) AS placed_sum FROM p GROUP BY domain, p0 // 2048 HAVING count(*) = 2048")
def pack_2048(spark, sf_dir):
    """One stream a domain, cut into sequences, the tail dropped."""
    return _sums(K.packed(_tokens(spark, sf_dir), ["doc_id"], ["domain"]), "domain", "seq_id")


def _sums(packed, *keys):
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    placed = F.aggregate(F.transform("tokens", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return packed.select(*keys, total.alias("id_sum"), placed.alias("placed_sum"))


@query(f"WITH {TOKENS_SQL}, p AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS p0 FROM tok) SELECT p0 // 50000 AS shard, (p0 % 50000) // 2048 AS seq_id, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(id * ((p0 % 50000) % 2048 + 1)) AS BIGINT) AS placed_sum FROM p GROUP BY 1, 2 HAVING count(*) = 2048")
def pack_shards(spark, sf_dir):
    """Exact shards (50,000 tokens here), whole sequences of each."""
    return _sums(K.packed(_tokens(spark, sf_dir).drop("domain"), ["doc_id"], shard=50_000), "shard", "seq_id")


@query(f"WITH {_BY_DOC}, c AS (SELECT doc_id, unnest(range(0, len(tokens), 256)) AS s, tokens FROM td), r AS (SELECT doc_id, s // 256 AS chunk, list_slice(tokens, s + 1, s + 256) AS t FROM c) SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(256 - len(t) AS INT) AS padding, CAST(list_sum(t) AS BIGINT) AS id_sum, 3 AS copies FROM r")
def chunk_pad(spark, sf_dir):
    """Own chunks of each document, the last one padded, three copies each."""
    c = _tokens(spark, sf_dir).select("doc_id", F.size("tokens").alias("n"), F.posexplode(K.chunks(F.col("tokens"), 256)).alias("chunk", "t"))
    copies = sampling.replicated(c, 3, "doc_id")
    own = copies.select("doc_id", "chunk", F.greatest(F.lit(0), (F.col("chunk") + 1) * 256 - F.col("n")).alias("padding"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))
    return own.groupBy("doc_id", "chunk", "padding", "id_sum").agg(F.count("*").cast("int").alias("copies"))


@query(f"WITH {_BY_DOC}, c AS (SELECT doc_id, unnest(range(0, len(tokens) - 1, 512)) AS s, tokens FROM td WHERE len(tokens) > 1) SELECT doc_id, CAST(s // 512 AS INT) AS w, CAST(len(list_slice(tokens, s + 1, s + 513)) AS INT) AS n, CAST(list_sum(list_slice(tokens, s + 1, s + 513)) AS BIGINT) AS id_sum FROM c")
def eval_windows(spark, sf_dir):
    """Overlapping windows of 512 + 1 tokens."""
    w = _tokens(spark, sf_dir).select("doc_id", F.posexplode(K.windows(F.col("tokens"))).alias("w", "t"))
    return w.select("doc_id", "w", F.size("t").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


@query(f"WITH {_BY_DOC}, k AS (SELECT doc_id, CASE WHEN len(tokens) < 13 THEN '0' ELSE array_to_string(list_concat(list_slice(tokens, 1, 13), list_slice(tokens, len(tokens) - 12, len(tokens))), ',') END AS key FROM td) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM k GROUP BY key")
def seq_fingerprint_dedup(spark, sf_dir):
    """Sequences by their first and last 13 tokens, first wins."""
    k = _tokens(spark, sf_dir).where(F.size("tokens") > 0).select("doc_id", dedup.sequence_key(F.col("tokens")).alias("key"))
    return dedup.first_wins(k, F.col("key"), ["doc_id"]).join(k.groupBy("key").agg(F.count("*").alias("copies")), "key").select("doc_id", "copies")


@query("WITH s AS (SELECT source AS path, CAST(sum(length(text)) // 2048 AS BIGINT) AS n_seqs FROM documents GROUP BY source) SELECT path, n_seqs, CAST(coalesce(sum(n_seqs) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s WHERE n_seqs > 0")
def shard_listing(spark, sf_dir):
    """Shards with sequences and the sequences before each."""
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.sum(F.length("text")).alias("n"))
    return audit.starts(s, "path", F.floor(F.col("n") / 2048)).select("path", "n_seqs", "start")


@query("WITH s AS (SELECT source AS path, CAST(sum(length(text)) // 2048 AS BIGINT) AS n_seqs FROM documents GROUP BY source), l AS (SELECT path, n_seqs, CAST(coalesce(sum(n_seqs) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s WHERE n_seqs > 0) SELECT i AS global_idx, l.path, i - l.start AS local_idx FROM (SELECT unnest(range((SELECT CAST(coalesce(sum(n_seqs), 0) AS BIGINT) FROM l))) AS i) g JOIN l ON i >= l.start AND i < l.start + l.n_seqs")
def interval_lookup(spark, sf_dir):
    """The shard and place of every global index, by interval."""
    return interval_lookup_all(spark, sf_dir)


@query()
def interval_lookup_all(spark, sf_dir):
    """The same, under the name its brute-force test knows."""
    shards = shard_listing(spark, sf_dir)
    total = shards.agg(F.coalesce(F.sum("n_seqs"), F.lit(0))).first()[0]  # one row
    return _looked_up(shards, spark.range(total).withColumnRenamed("id", "global_idx"))


def _looked_up(shards, wanted):
    # Both sides meet in buckets of indexes, so the join has a key.
    width = 4096
    within = (F.col("global_idx") >= F.col("start")) & (F.col("global_idx") < F.col("start") + F.col("n_seqs"))
    dealt = shards.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_seqs") - 1) / width))))
    return dealt.join(wanted.withColumn("bucket", F.floor(F.col("global_idx") / width)), "bucket").where(within).select("global_idx", "path", (F.col("global_idx") - F.col("start")).alias("local_idx"))


# ---- curriculum

_WEIGHTS = {"web": 0.4, "math": 0.3, "code": 0.2, "synth": 0.1}
_TURNS = "(VALUES ('web', 4, 0), ('math', 3, 1), ('code', 2, 2), ('synth', 1, 3)) AS k(domain, turn, rank)"
_INTERLEAVE_SQL = f"""{DOCS_SQL}, k AS (SELECT * FROM {_TURNS}), n AS (SELECT domain, count(*) AS n FROM d GROUP BY domain),
 j AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || doc_id), doc_id) - 1 AS j FROM d),
 p AS (SELECT doc_id, domain, j // turn AS pass, rank, j % turn AS within FROM j JOIN k USING (domain)),
 o AS (SELECT doc_id, domain, row_number() OVER (ORDER BY pass, rank, within) - 1 AS pos FROM p)"""


@query(f"WITH {_INTERLEAVE_SQL} SELECT doc_id, domain, pos FROM o")
def weighted_interleave(spark, sf_dir):
    """Domains in turn by weight, places in closed form."""
    return curriculum.interleaved(docs(spark, sf_dir).select("doc_id", "domain"), _WEIGHTS, "doc_id").select("doc_id", "domain", "pos")


@query(f"WITH {_INTERLEAVE_SQL} SELECT doc_id, pos // 100 * 100 + row_number() OVER (PARTITION BY pos // 100 ORDER BY md5('42:' || doc_id), doc_id) - 1 AS epoch_pos FROM o")
def jit_window(spark, sf_dir):
    """A shuffle inside consecutive windows of places (100 here)."""
    placed = curriculum.interleaved(docs(spark, sf_dir).select("doc_id", "domain"), _WEIGHTS, "doc_id")
    return curriculum.jittered(placed, "doc_id", 100).select("doc_id", "epoch_pos")


_TIER_SQL = """t AS (SELECT step, step / 15000.0::DOUBLE AS t FROM (SELECT unnest([0, 937, 1875, 5000, 7500, 9999, 14999]) AS step)), f AS (SELECT step, CASE WHEN t < 0.5 THEN t ELSE 1 - t END AS f FROM t),
 w AS (SELECT step, 0.05::DOUBLE + 0.25::DOUBLE * (1 - f) AS e, least(0.7::DOUBLE, 0.25::DOUBLE + 0.45::DOUBLE * f) AS h FROM f),
 m AS (SELECT step, least(0.5::DOUBLE, e + 0.12::DOUBLE * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * step / 1875))) AS e, greatest(0, 1 - e - h) AS m, h FROM w)"""


@query(f"WITH {_TIER_SQL} SELECT step, round(e / (e + m + h), 6) AS easy, round(m / (e + m + h), 6) AS medium, round(h / (e + m + h), 6) AS hard FROM m")
def curriculum_tier_weights(spark, sf_dir):
    """CP1 CP2: tier weights over time with the review wave."""
    steps = spark.createDataFrame([(s,) for s in (0, 937, 1875, 5000, 7500, 9999, 14999)], "step int")
    w = steps.select("step", *curriculum.tier_weight_columns(F.col("step"), 15_000))
    return w.select("step", *[F.round(c, 6).alias(c) for c in ("easy", "medium", "hard")])


_SPLIT_SQL = "s(domain, tier, share) AS (VALUES " + ", ".join(f"('{d}', '{t}', {v}::DOUBLE)" for t, own in curriculum.SPLITS.items() for d, v in own.items()) + ")"


@query()
def curriculum_ratios(spark, sf_dir):
    """CP3 CP4 J3: domain ratios with the boost (rounded step by step, so no SQL; see its tests)."""
    rows = [(s, d, curriculum.TIER[d], v) for s in (0, 937, 1875, 5000, 7500, 9999, 14999) for d, v in curriculum.ratios(s, 15_000).items()]
    return spark.createDataFrame(rows, "step int, domain string, tier string, ratio double")


@query(f"WITH {_TIER_SQL}, {_SPLIT_SQL} SELECT step, tier, round(sum(share * CASE tier WHEN 'easy' THEN e WHEN 'medium' THEN m ELSE h END / (e + m + h)), 3) AS total, count(*) AS domains FROM m, s GROUP BY step, tier")
def curriculum_tier_totals(spark, sf_dir):
    """CP3 CP4: the boost leaves each tier's total."""
    return curriculum_ratios(spark, sf_dir).groupBy("step", "tier").agg(F.round(F.sum("ratio"), 3).alias("total"), F.count("*").alias("domains"))


@query(
    """WITH l AS (SELECT event_type AS domain, avg(value) AS loss FROM events GROUP BY event_type), b AS (SELECT domain, loss, CASE WHEN domain < 'm' THEN 'easy' ELSE 'hard' END AS tier, 0.2::DOUBLE AS ratio, CASE WHEN domain = 'click' THEN NULL ELSE 40.0::DOUBLE END AS ref FROM l),
 m AS (SELECT *, ratio * least(4, greatest(0.25, exp(0.3 * CASE WHEN ref > 0 THEN (loss - ref) / ref ELSE 0 END))) AS raised FROM b) SELECT domain, tier, round(raised * sum(ratio) OVER (PARTITION BY tier) / sum(raised) OVER (PARTITION BY tier), 4) AS ratio FROM m"""
)
def loss_reweight(spark, sf_dir):
    """A4 CP5 J3: mean losses by domain and the ratios they give."""
    loss = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain")).agg(F.avg("value").alias("loss"))
    now = loss.withColumn("tier", F.when(F.col("domain") < "m", "easy").otherwise("hard")).withColumn("ratio", F.lit(0.2)).withColumn("ref", F.when(F.col("domain") != "click", 40.0))
    return curriculum.reweighted(now).select("domain", "tier", "ratio")


@query("SELECT step, round(CASE WHEN step < 100 THEN 0.01::DOUBLE * step / 100 ELSE 1e-6::DOUBLE + (0.01::DOUBLE - 1e-6::DOUBLE) * 0.5 * (1 + cos(pi() * least(1.0, (step - 100) / 900.0::DOUBLE))) END, 8) AS lr FROM (SELECT unnest(range(0, 1001, 10)) AS step)")
def lr_schedule(spark, sf_dir):
    """CP6: warm-up and cosine."""
    return spark.range(0, 1001, 10).select(F.col("id").alias("step"), F.round(curriculum.learning_rate(F.col("id"), 100, 1000, 0.01), 8).alias("lr"))


# ---- training examples

_SFT_SQL = f"""{_BY_DOC}, e AS (SELECT doc_id, list_slice(tokens, 1, len(tokens) // 2) AS p, list_slice(tokens, len(tokens) // 2 + 1, len(tokens)) AS r FROM td), o AS (SELECT *, len(p) + len(r) - 512 AS over FROM e),
 x AS (SELECT doc_id, CASE WHEN over <= 0 THEN p WHEN over >= len(p) THEN [] ELSE list_slice(p, over + 1, len(p)) END AS p, CASE WHEN over > 0 AND over >= len(p) THEN list_slice(r, 1, 512) ELSE r END AS r FROM o)"""


def _examples(spark, sf_dir, length=512):
    half = F.floor(F.size("tokens") / 2).cast("int")
    t = _tokens(spark, sf_dir).where(F.size("tokens") > 0)
    e = t.select("doc_id", "domain", K.once(K.example(F.slice("tokens", F.lit(1), half), F.slice("tokens", half + 1, F.size("tokens")), length)).alias("e"))
    return e.select("doc_id", "domain", "e.input_ids", "e.labels")


@query(f"WITH {_SFT_SQL} SELECT doc_id, CAST(len(p) + len(r) AS INT) AS n, CAST(len(p) AS INT) AS masked, CAST(coalesce(list_sum(p), 0) + coalesce(list_sum(r), 0) AS BIGINT) AS id_sum FROM x WHERE len(r) > 0")
def sft_mask_truncate(spark, sf_dir):
    """Prompt and response with the prompt's labels ignored, cut to length (512 here)."""
    e = _examples(spark, sf_dir).where(K.trains(F.col("labels")))
    masked = F.size(F.filter("labels", lambda x: x == K.IGNORE))
    return e.select("doc_id", F.size("input_ids").alias("n"), masked.alias("masked"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


@query(f"WITH {_BY_DOC}, c AS (SELECT doc_id, list_slice(tokens, greatest(1, len(tokens) - 255), len(tokens)) AS t FROM td) SELECT doc_id, 256 AS n, CAST(256 - len(t) AS INT) AS padding, CAST(list_sum(t) - 100 * (256 - len(t)) AS BIGINT) AS label_sum FROM c")
def sft_collate(spark, sf_dir):
    """The last 256 tokens, padded."""
    c = _tokens(spark, sf_dir).where(F.size("tokens") > 0).select("doc_id", F.size("tokens").alias("len"), K.collated(F.col("tokens"), K.IGNORE, 256).alias("t"))
    return c.select("doc_id", F.size("t").alias("n"), F.greatest(F.lit(0), 256 - F.col("len")).alias("padding"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("label_sum"))


@query(f"WITH {_SFT_SQL} SELECT doc_id, CAST(len(p) AS INT) AS first, CAST(len(p) + len(r) - 1 AS INT) AS last FROM x WHERE len(r) > 0")
def assistant_span(spark, sf_dir):
    """First and last place that trains."""
    return _examples(spark, sf_dir).select("doc_id", K.answer_span(F.col("labels")).alias("s")).where("s is not null").select("doc_id", "s.first", "s.last")


@query(f"WITH {_SFT_SQL} SELECT doc_id, round(list_sum(list_transform(r, lambda x: x / 1000.0::DOUBLE)) / len(r), 6) AS mean_loss FROM x WHERE len(r) > 0")
def masked_mean(spark, sf_dir):
    """Mean of per-token values where the label counts."""
    values = F.transform("input_ids", lambda x: x / 1000.0)
    return _examples(spark, sf_dir).select("doc_id", F.round(K.masked_mean(values, F.col("labels")), 6).alias("mean_loss")).where("mean_loss is not null")


# ---- audits

@query("WITH p AS (SELECT l_returnflag AS grp, l_extendedprice AS v FROM lineitem UNION ALL SELECT NULL, l_extendedprice FROM lineitem) SELECT grp, count(*) AS n, round(avg(v), 3) AS mean, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 3) AS p{p}" for p in audit.PERCENTS) + " FROM p GROUP BY grp")
def loss_percentiles(spark, sf_dir):
    """Exact percentiles of each group and overall."""
    out = audit.percentiles(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v")), "v", "grp")
    return out.select("grp", "n", *[F.round(c, 3).alias(c) for c in ["mean", *(f"p{p}" for p in audit.PERCENTS)]])


@query("SELECT source, CAST(floor(median(n_chars)) AS BIGINT) AS median_size FROM documents GROUP BY source")
def median_size(spark, sf_dir):
    """Median size of each group, as an integer."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.floor(F.median("n_chars")).alias("median_size"))


@query(f"WITH {DOCS_SQL}, j AS (SELECT d.domain, l.quality * 4 + d.doc_id % 3 AS quality, d.n_chars / 100.0::DOUBLE AS loss FROM d JOIN labels l USING (doc_id)) SELECT domain, count(*) AS n, round(corr(quality, loss), 6) AS r FROM j GROUP BY domain")
def judge_join_corr(spark, sf_dir):
    """Judge replies parsed from noisy text, joined with losses, correlated."""
    l = table(spark, sf_dir, "labels")
    reply = F.concat(F.lit("<think>{no}</think> Here: {\"quality\": "), F.col("quality") * 4 + F.col("doc_id") % 3, F.lit("} done"))
    judged = l.select("doc_id", T.json_inside(reply, "quality int")["quality"].alias("q"))
    j = docs(spark, sf_dir).select("doc_id", "domain", (F.col("n_chars") / 100.0).alias("loss")).join(judged, "doc_id")
    return j.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.corr("q", "loss"), 6).alias("r"))


@query("SELECT event_type AS domain, round(avg(value) FILTER (event_id % 2 = 0), 4) AS best, round(avg(value) FILTER (event_id % 2 = 1), 4) AS swa, round(avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0), 4) AS delta FROM events GROUP BY event_type")
def ckpt_pivot(spark, sf_dir):
    """Two checkpoints side by side."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("domain"), F.when(F.col("event_id") % 2 == 0, "best").otherwise("swa").alias("ckpt"), "value")
    out = audit.side_by_side(e, "domain", "ckpt", ("best", "swa"), "value")
    return out.select("domain", *[F.round(c, 4).alias(c) for c in ("best", "swa", "delta")])


@query("WITH v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) SELECT label, CAST(place AS INT) AS place, round(avg(x), 4) + 0.0 AS mean FROM v GROUP BY label, place")
def snapshot_mean(spark, sf_dir):
    """A10: elementwise mean of snapshots."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return audit.elementwise_mean(e, "label", "v").select("label", "place", (F.round("mean", 4) + 0.0).alias("mean"))


@query("WITH r AS (SELECT user_id, event_id AS step, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, step FROM r WHERE k <= 3")
def snapshot_retention(spark, sf_dir):
    """K9: the last three snapshots of each run."""
    return audit.retained(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step")), ["user_id"], "step", 3)


@query("SELECT event_type, max_by(event_id, event_id) AS event_id, round(max_by(value, event_id), 4) AS value FROM events GROUP BY event_type")
def latest_record(spark, sf_dir):
    """The latest record of each kind."""
    e = audit.latest(table(spark, sf_dir, "events"), ["event_type"], F.col("event_id"), "event_id", "value")
    return e.select("event_type", "event_id", F.round("value", 4).alias("value"))


@query(
    "WITH e AS (SELECT event_type AS k, event_id AS a0, floor(value) AS size, floor(value) - lag(floor(value)) OVER (PARTITION BY event_type ORDER BY event_id) AS delta FROM events), f AS (SELECT *, CASE WHEN delta <= 0 THEN 1 ELSE 0 END AS flat FROM e), "
    "i AS (SELECT *, sum(1 - flat) OVER (PARTITION BY k ORDER BY a0) AS island FROM f) SELECT k, max(s) AS longest, count(*) FILTER (s >= 4) AS stalled FROM (SELECT k, CASE WHEN flat = 1 THEN sum(flat) OVER (PARTITION BY k, island ORDER BY a0) ELSE 0 END AS s FROM i) GROUP BY k"
)
def growth_streaks(spark, sf_dir):
    """W5 W6 ST4: growth against the sample before, and runs without growth."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.col("event_id").alias("at"), F.floor("value").alias("size"))
    g = audit.growth(e, ["k"], "at", "size")
    return g.groupBy("k").agg(F.max("streak").alias("longest"), F.sum(F.when(F.col("streak") >= 4, 1).otherwise(0)).alias("stalled"))


@query("WITH w AS (SELECT event_id // 2000 AS win, event_type AS domain, count(value) AS updates, avg(value) AS m FROM events GROUP BY 1, 2) SELECT win, domain, updates, round(m, 4) AS mean_loss FROM w WHERE (SELECT sum(updates) FROM w x WHERE x.win = w.win) >= 500")
def telemetry_windows(spark, sf_dir):
    """ST1 ST2 A4 A11: means over count windows with enough updates."""
    w = telemetry.count_windows(table(spark, sf_dir, "events"), F.col("event_id"), 2000, "event_type", "value")
    enough = w.groupBy("window").agg(F.sum("updates").alias("n")).where("n >= 500").select("window")
    return w.join(enough, "window").select(F.col("window").alias("win"), "domain", "updates", F.round("mean_loss", 4).alias("mean_loss"))


@query("WITH w AS (SELECT user_id, event_id // 1000 AS win, sum(value) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY 1, 2), a AS (SELECT user_id, win, CASE WHEN n > 0 THEN s / n END AS m FROM w) SELECT user_id, win, round(coalesce(m, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 4) AS smoothed FROM a")
def boundary_fallback(spark, sf_dir):
    """An interval's mean, else the last one logged."""
    from pyspark.sql import Window

    click = F.when(F.col("event_type") == "click", F.col("value"))
    w = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("win")).agg(F.sum(click).alias("s"), F.count(click).alias("n"))
    before = Window.partitionBy("user_id").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("n") > 0, F.col("s") / F.col("n")), ignorenulls=True).over(before)
    return w.select("user_id", "win", F.round(audit.boundary_mean(F.col("s"), F.col("n"), last), 4).alias("smoothed"))


@query("SELECT event_id AS step, 10000 AS total, round(value, 2) AS loss, event_type AS domain FROM events")
def log_parse(spark, sf_dir):
    """ST7 D18: fields of log lines."""
    return _parsed_lines(table(spark, sf_dir, "events"))


def _parsed_lines(e):
    line = F.concat(F.lit("Step "), F.format_number("event_id", 0), F.lit("/10,000 | Loss "), F.format_string("%.2f", F.round("value", 2)), F.lit(" | LR 1.00e-04 | 9.1 s/step | 7,183 tok/s | GPU 5.1"))
    lines = e.select(line.alias("value")).unionByName(e.select(F.lit("saved").alias("value")))
    parsed = telemetry.parsed(lines)
    return parsed.join(e.select(F.col("event_id").alias("step"), F.col("event_type").alias("domain")), "step").select("step", F.col("total").cast("int").alias("total"), "loss", "domain")


@query()
def log_parse_all(spark, sf_dir):
    """ST7 D18: fields of the log lines of all events."""
    return _parsed_lines(table(spark, sf_dir, "events"))


@query("SELECT count(*) AS values_checked, count(*) FILTER (isnan(x) OR isinf(x)) AS bad FROM (SELECT CASE WHEN vec_id % 97 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 89 = 0 THEN 'inf'::DOUBLE ELSE embedding[1]::DOUBLE END AS x FROM embeddings)")
def nan_guard(spark, sf_dir):
    """values that are no finite numbers."""
    x = F.when(F.col("vec_id") % 97 == 0, float("nan")).when(F.col("vec_id") % 89 == 0, float("inf")).otherwise(F.col("embedding")[0].cast("double"))
    v = table(spark, sf_dir, "embeddings").select(x.alias("x"))
    return v.agg(F.count("*").alias("values_checked"), F.sum(F.when(quality.finite(F.col("x")), 0).otherwise(1)).alias("bad"))


@query("SELECT lang AS format, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(avg(n_chars), 3) AS mean_out FROM documents GROUP BY lang")
def format_summary(spark, sf_dir):
    """Rows, bytes and mean size of each format."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("lang").alias("format")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"), F.round(F.avg("n_chars"), 3).alias("mean_out"))


# ---- text functions

_CODE = "'def solve(arr, nums, s): total = s; res = nums; return total, res, target' || conv_id || ' lo hi count result'"


@query(
    f"WITH c AS (SELECT conv_id, {_CODE} AS t FROM conversations WHERE turn = 0), v AS (SELECT conv_id, unnest(list_distinct([t, "
    + ", ".join("".join("regexp_replace(" for _ in p) + "t" + "".join(f", '\\b{a}\\b', '{b}', 'g')" for a, b in p) for p in T.RENAME_SETS)
    + "])) AS v FROM c) SELECT conv_id, v AS variant FROM v"
)
def rename_variants(spark, sf_dir):
    """A program and its renamed variants, each once."""
    c = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.expr(_CODE).alias("t"))
    return c.select("conv_id", F.explode(T.variants(F.col("t"))).alias("variant"))


@query(
    f"WITH c AS (SELECT conv_id, turn, {_CODE} AS t FROM conversations), v AS (SELECT conv_id, turn, unnest(list_distinct([t, "
    + ", ".join("".join("regexp_replace(" for _ in p) + "t" + "".join(f", '\\b{a}\\b', '{b}', 'g')" for a, b in p) for p in T.MERGED_SETS)
    + "])) AS v FROM c) SELECT conv_id, turn, v AS variant FROM v"
)
def merged_variants(spark, sf_dir):
    """The renames of merged documents over all turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_CODE).alias("t"))
    return c.select("conv_id", "turn", F.explode(T.variants(F.col("t"), T.MERGED_SETS, T.MERGED_KEYWORDS)).alias("variant"))


@query(f"WITH c AS (SELECT conv_id, {_CODE} AS t FROM conversations WHERE turn = 0), r(i, a, b) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(T.RENAMES)) + "), v AS (SELECT conv_id, i, t, CASE i " + " ".join(f"WHEN {i} THEN regexp_replace(t, '\\b{a}\\b', '{b}', 'g')" for i, (a, b) in enumerate(T.RENAMES)) + " END AS v FROM c, r) SELECT row_number() OVER (ORDER BY conv_id, i) - 1 AS id, conv_id, i AS variant, v AS text FROM v WHERE v <> t")
def single_renames(spark, sf_dir):
    """One rename at a time, kept where it changes the text, numbered in order."""
    return _single_renames(table(spark, sf_dir, "conversations").where("turn = 0"))


@query()
def single_renames_all(spark, sf_dir):
    """The same, under the name its brute-force test knows."""
    return _single_renames(table(spark, sf_dir, "conversations").where("turn = 0"))


def _single_renames(turns):
    c = turns.select("conv_id", F.expr(_CODE).alias("t"))
    each = F.array(*[F.struct(F.lit(i).alias("variant"), T.renamed(F.col("t"), [pair]).alias("text")) for i, pair in enumerate(T.RENAMES)])
    changed = c.select("conv_id", "t", F.explode(each).alias("v")).where("v.text <> t").select("conv_id", "v.variant", "v.text")
    return row_numbers(changed, ["conv_id", "variant"], "id")


_REPLY = "CASE turn % 4 WHEN 0 THEN 'so <answer> ' || text || ' </answer> end' WHEN 1 THEN 'x ```python' || chr(10) || 'def f():' || chr(10) || '  return ' || conv_id || chr(10) || '```' WHEN 2 THEN '<answer></answer>' ELSE text END"


@query(f"WITH r AS (SELECT conv_id, turn, {_REPLY} AS r FROM conversations) SELECT conv_id, turn, trim(CASE WHEN regexp_matches(r, '(?s)<answer>.*?</answer>') THEN regexp_extract(r, '(?s)<answer>(.*?)</answer>', 1) WHEN regexp_matches(r, '(?s)```(?:python)?\\n.*?```') THEN regexp_extract(r, '(?s)```(?:python)?\\n(.*?)```', 1) ELSE r END, ' ' || chr(9) || chr(10) || chr(13)) AS answer FROM r")
def answer_extract(spark, sf_dir):
    """Answer block, fenced code or everything."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("r"))
    return c.select("conv_id", "turn", T.answer(F.col("r")).alias("answer"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS prompt, CASE WHEN turn % 2 = 0 THEN 'body ' || conv_id ELSE chr(10) || 'free ' || conv_id END AS body FROM conversations WHERE NOT contains(text, '##')")
def problem_split(spark, sf_dir):
    """Prompt and first method of finished documents."""
    c = table(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("##")))
    tail = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nMETHOD 1: plain\nbody "), F.col("conv_id"), F.lit("\n METHOD 2: other\nno"))).otherwise(F.concat(F.lit("\nfree "), F.col("conv_id")))
    doc = F.concat("text", F.lit("\n## THREE SOLUTION METHODS"), tail)
    return c.select("conv_id", "turn", T.problem(doc).alias("prompt"), T.first_method(doc).alias("body"))


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text WHEN turn % 3 = 1 THEN text || '# Solution' || chr(10) ELSE text || '# Solution' || chr(10) || ' x' || conv_id || ' # Solution' END AS doc FROM conversations) SELECT conv_id, turn, left(doc, strpos(doc, '# Solution') - 1) AS prompt, trim(substr(doc, strpos(doc, '# Solution') + 10), ' ' || chr(10)) AS solution FROM c WHERE strpos(doc, '# Solution') > 1 AND trim(left(doc, strpos(doc, '# Solution') - 1), ' ' || chr(10)) <> '' AND trim(substr(doc, strpos(doc, '# Solution') + 10), ' ' || chr(10)) <> ''")
def solution_split(spark, sf_dir):
    """Prompt and solution around the mark, both more than blanks."""
    tail = F.when(F.col("turn") % 3 == 2, "").when(F.col("turn") % 3 == 1, "# Solution\n").otherwise(F.concat(F.lit("# Solution\n x"), F.col("conv_id"), F.lit(" # Solution")))
    c = table(spark, sf_dir, "conversations").where(T.present(F.col("text"))).select("conv_id", "turn", K.once(T.solution_split(F.concat("text", tail))).alias("s"))
    return c.where("s is not null").select("conv_id", "turn", "s.prompt", "s.solution")


_WRONG = "CASE turn % 5 WHEN 0 THEN 'def a():' || chr(10) || ' pass' || chr(10) || 'class B: x' || chr(10) || text WHEN 1 THEN 'def a():' || chr(10) || 'def b():' || chr(10) || 'x' WHEN 2 THEN '#include <x>' || chr(10) || 'def a(): return 1' || chr(10) || text || chr(10) || 'z' WHEN 3 THEN '<answer>short</answer>' || chr(10) || 'def a():' || chr(10) || 'return' ELSE text END"


@query(
    f"WITH c AS (SELECT conv_id, turn, {_WRONG} AS c FROM conversations), f AS (SELECT conv_id, turn, c, len(list_filter(string_split(c, chr(10)), lambda x: trim(x) <> '')) AS n, regexp_extract_all(c, '(?m)^(def|class)\\s+\\w+\\s*', 1) AS heads FROM c) "
    "SELECT conv_id, turn, n < 3 OR NOT (contains(c, 'def ') OR contains(c, 'class ')) OR (len(heads) >= 2 AND len(list_distinct(heads)) = 1) AS echo, n < 3 OR NOT (contains(c, 'def ') OR contains(c, 'class ')) OR (len(heads) >= 2 AND len(list_distinct(heads)) = 1) OR regexp_matches(c, '#include\\s*[<\"]|using namespace std|public class|public static') "
    "OR length(CASE WHEN regexp_matches(c, '(?s)<answer>.*?</answer>') THEN regexp_extract(c, '(?s)<answer>(.*?)</answer>', 1) ELSE trim(c, ' ' || chr(10)) END) < 20 AS wrong FROM f"
)
def looks_wrong(spark, sf_dir):
    """Heuristics for failed completions."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_WRONG).alias("c"))
    return c.select("conv_id", "turn", T.is_echo(F.col("c")).alias("echo"), T.looks_wrong(F.col("c")).alias("wrong"))


@query(f"WITH c AS (SELECT conv_id, turn, {_WRONG} AS c FROM conversations WHERE role = 'assistant'), q AS (SELECT conv_id, min(turn) FILTER (NOT (contains(c, 'def ') OR contains(c, 'class '))) AS turn FROM c GROUP BY conv_id) SELECT q.conv_id, q.turn, p.text AS prompt FROM q JOIN conversations p ON p.conv_id = q.conv_id AND p.turn = 0 WHERE q.turn IS NOT NULL AND length(p.text) BETWEEN 30 AND 1500 ORDER BY q.conv_id LIMIT 100")
def preference_pairs(spark, sf_dir):
    """The first failing completion of each prompt, up to a number of pairs."""
    conv = table(spark, sf_dir, "conversations")
    c = conv.where("role = 'assistant'").select("conv_id", "turn", F.expr(_WRONG).alias("c"))
    fails = ~(F.contains("c", F.lit("def ")) | F.contains("c", F.lit("class ")))
    first = c.where(fails).groupBy("conv_id").agg(F.min("turn").alias("turn"))
    prompts = conv.where((F.col("turn") == 0) & F.length("text").between(30, 1500)).select("conv_id", F.col("text").alias("prompt"))
    return first.join(prompts, "conv_id").orderBy("conv_id").limit(100)


_SCORED = "CASE turn % 3 WHEN 0 THEN '<reasoning>r</reasoning><answer>' || conv_id || ' and -3.5</answer>' WHEN 1 THEN '<answer>1</answer>' ELSE text || text || text || text || text || text END"


@query(f"WITH c AS (SELECT conv_id, turn, {_SCORED} AS c FROM conversations), a AS (SELECT *, regexp_matches(c, '(?s)<answer>.*?</answer>') AS tagged, len(regexp_extract_all(CASE WHEN regexp_matches(c, '(?s)<answer>.*?</answer>') THEN regexp_extract(c, '(?s)<answer>(.*?)</answer>', 1) ELSE c END, '-?\\d+\\.?\\d*')) AS n FROM c) SELECT conv_id, turn, CAST(CASE WHEN tagged THEN 1 ELSE 0 END + CASE WHEN n BETWEEN 1 AND 3 THEN 0.5 ELSE 0 END - CASE WHEN length(c) < 20 THEN 1 ELSE 0 END - CASE WHEN length(c) > 1500 THEN 0.5 ELSE 0 END AS DOUBLE) AS correctness, CAST(CASE WHEN contains(c, '<reasoning>') AND contains(c, '</reasoning>') THEN 0.5 ELSE 0 END + CASE WHEN contains(c, '<answer>') AND contains(c, '</answer>') THEN 0.5 ELSE 0 END AS DOUBLE) AS format FROM a")
def rewards(spark, sf_dir):
    """Correctness and format rewards."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SCORED).alias("c"))
    return c.select("conv_id", "turn", T.correctness_reward(F.col("c")).alias("correctness"), T.format_reward(F.col("c")).alias("format"))


@query("SELECT conv_id, turn, 'solve_' || array_to_string(list_slice(regexp_extract_all(text, '[a-z]+'), 1, 3), '_') AS fn FROM conversations")
def function_names(spark, sf_dir):
    """Names from the first words."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.function_name(F.col("text")).alias("fn"))


#: The user part of each format.
_FORMATS = (("textbook", "{text}"), ("qa", "{text}"), ("lecture", "Turn this into a lecture script:\n\n{text}"), ("tutorial", "Create a step-by-step tutorial from this:\n\n{text}"), ("knowledge_card", "Extract knowledge cards from:\n\n{text}"))


@query("WITH f(fmt, user_part) AS (VALUES " + ", ".join(f"('{n}', replace('{u}', '\\n', chr(10)))".replace("\n", "\\n") for n, u in _FORMATS) + ") SELECT doc_id, fmt, md5(replace(user_part, '{text}', left(text, 3000))) AS prompt_md5 FROM documents, f WHERE length(trim(text)) >= 50")
def prompt_render(spark, sf_dir):
    """O2 X18 X19 F1 P-1: documents by formats as prompts."""
    d = table(spark, sf_dir, "documents").where(quality.length_gate(F.col("text"), "stripped")).select("doc_id", T.prefix(F.col("text"), 3000).alias("t"))
    formats = F.array(*[F.struct(F.lit(n).alias("fmt"), F.lit(u).alias("user")) for n, u in _FORMATS])
    return d.select("doc_id", "t", F.explode(formats).alias("f")).select("doc_id", "f.fmt", F.md5(T.filled(F.col("f.user"), F.col("t"))).alias("prompt_md5"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS without_block, 'keep ' || text AS without_tags FROM conversations")
def think_strip(spark, sf_dir):
    """Thinking removed with its content, or its tags alone; a preamble goes first."""
    c = table(spark, sf_dir, "conversations")
    block = T.without_think(F.concat(F.lit("<think>a\nb</think>"), F.col("text")))
    tags = T.without_think_tags(F.concat(F.lit("<THINK>keep </think>"), F.col("text")))
    return c.select("conv_id", "turn", block.alias("without_block"), tags.alias("without_tags"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS question FROM conversations WHERE length(trim(text, ' ' || chr(10))) BETWEEN 30 AND 2000 ORDER BY conv_id, turn LIMIT 200")
def grpo_questions(spark, sf_dir):
    """Questions before a solution's heading, within bounds, the first in order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.question(F.concat("text", F.lit("\nMethod 1 x\n## Solution y"))).alias("question"))
    return c.where(F.length("question").between(30, 2000)).orderBy("conv_id", "turn").limit(200)


@query("WITH k(key, ord) AS (VALUES ('the ', 0), ('and', 1), ('que', 2), ('ein', 3)), m AS (SELECT doc_id, min(ord) AS ord FROM documents JOIN k ON contains(lower(text), key) GROUP BY doc_id) SELECT d.doc_id, k.key FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN k ON m.ord = k.ord")
def seed_verifier_lookup(spark, sf_dir):
    """The first key, in order, that a text contains."""
    keys = spark.createDataFrame([("the ", 0), ("and", 1), ("que", 2), ("ein", 3)], "key string, ord int")
    return hooks.first_key(table(spark, sf_dir, "documents").select("doc_id", "text"), keys, "text").select("doc_id", "key")


@query("SELECT conv_id, turn, md5('Q: ' || text) AS answer FROM conversations WHERE role = 'user'")
def generated_replies(spark, sf_dir):
    """Replies of the offline generator and their answers."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("Q: "), "text").alias("prompt"))
    return hooks.generated(c, "prompt").select("conv_id", "turn", T.answer(F.col("reply")).alias("answer"))
