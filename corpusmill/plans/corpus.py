"""Queries over raw documents: gates, tiers, deduplication, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import audit, dedup, quality, sampling
from corpusmill.operators.order import hash_order, row_numbers
from corpusmill.operators.tokens import once
from corpusmill.plans.registry import DOCS_SQL, docs, query, table

_CLASS_SQL = (
    DOCS_SQL
    + r""", m AS (SELECT *, length(text) AS n, length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) AS letters,
      len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10))) AS line_share,
      len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')) AS word_share, length(text) / len(string_split(text, ' ')) AS mean_word FROM d),
    c AS (SELECT *, CASE WHEN n < 50 THEN 'too_short' WHEN n > 50000 THEN 'too_long' WHEN letters < 0.5 THEN 'low_alpha'
      WHEN line_share < 0.5 THEN 'repetitive' WHEN word_share < 0.15 THEN 'low_diversity' ELSE 'ok' END AS reason,
      CASE WHEN mean_word >= 7.5 OR n > 6000 THEN 'hard' WHEN mean_word >= 6.0 OR n > 2000 THEN 'medium' ELSE 'easy' END AS tier,
      letters * 0.5 + line_share * 0.2 + word_share * 0.3 AS q_score FROM m)"""
)


@query(f"WITH {_CLASS_SQL} SELECT domain, tier, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chars, round(avg(q_score), 4) AS mean_score FROM c WHERE reason = 'ok' GROUP BY domain, tier")
def gate_tier_counts(spark, sf_dir):
    """Gate, classify, count by domain and tier."""
    c = docs(spark, sf_dir).select("domain", "text", once(quality.classify(F.col("text"))).alias("c")).where(quality.length_gate(F.col("text"), "plain") & F.col("c.ok"))
    return c.groupBy("domain", F.col("c.tier").alias("tier")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.round(F.avg("c.q_score"), 4).alias("mean_score"))


@query(f"WITH {_CLASS_SQL} SELECT reason, count(*) AS docs FROM c GROUP BY reason")
def classify_reasons(spark, sf_dir):
    """How many documents each rule stops."""
    return docs(spark, sf_dir).select(quality.classify(F.col("text"))["reason"].alias("reason")).groupBy("reason").agg(F.count("*").alias("docs"))


_STRIPPED = "s AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, (doc_id * 7919) % 1000 + (doc_id * 104729) % 1000 AS composite FROM d)"
_PREFIX_SQL = f"{DOCS_SQL}, {_STRIPPED}, r AS (SELECT *, row_number() OVER (PARTITION BY md5(left(t, 300)) ORDER BY doc_id) AS k FROM s WHERE length(t) BETWEEN 400 AND 6000)"


def _scored(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("t", T.strip(F.col("text")))
    return d.withColumn("composite", quality.composite((F.col("doc_id") * 7919) % 1000, (F.col("doc_id") * 104729) % 1000).cast("long"))


@query(f"WITH {_PREFIX_SQL} SELECT doc_id, composite FROM r WHERE k = 1 AND composite >= 1400")
def dedup_prefix_md5(spark, sf_dir):
    """One document a prefix, and only then the threshold."""
    kept = dedup.by_prefix(_scored(spark, sf_dir).where(quality.length_gate(F.col("text"), "web")), F.col("t"), ["doc_id"])
    return kept.where(quality.at_least(F.col("composite"), 1400)).select("doc_id", "composite")


@query(f"WITH {_PREFIX_SQL} SELECT CAST(row_number() OVER (ORDER BY composite DESC, t DESC) - 1 AS INT) AS idx, doc_id, round(composite / 1000.0, 3) AS composite FROM r WHERE k = 1 AND composite >= 1400 QUALIFY idx < 50")
def web_topk_composite(spark, sf_dir):
    """The best by score, then text."""
    kept = dedup.by_prefix(_scored(spark, sf_dir).where(quality.length_gate(F.col("text"), "web")), F.col("t"), ["doc_id"])
    best = sampling.top(kept.where("composite >= 1400"), 50, F.desc("composite"), F.desc("t"))
    return best.select("idx", "doc_id", F.round(F.col("composite") / 1000.0, 3).alias("composite"))


@query("WITH q AS (SELECT conv_id, left(regexp_replace(text, '\\s+', ' ', 'g'), 200) AS fp FROM conversations WHERE role = 'user'), r AS (SELECT fp, min(conv_id) AS conv_id FROM q GROUP BY fp) SELECT conv_id, count(*) AS kept FROM r GROUP BY conv_id")
def question_fingerprint(spark, sf_dir):
    """Questions by fingerprint, first wins."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_key(F.col("text")).alias("fp"))
    return dedup.first_wins(q, F.col("fp"), ["conv_id", "turn"]).groupBy("conv_id").agg(F.count("*").alias("kept"))


@query(
    "WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND NOT contains(text, '##')), h AS (SELECT DISTINCT left(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), "
    "lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#') AND NOT starts_with(trim(x), 'Difficulty:')), chr(10)), '\\s+', ' ', 'g')), 200) AS fp FROM q WHERE conv_id % 2 = 0) "
    "SELECT conv_id, turn FROM q WHERE left(regexp_replace(text, '\\s+', ' ', 'g'), 200) NOT IN (SELECT fp FROM h)"
)
def resume_antijoin_fp(spark, sf_dir):
    """New questions against the fingerprints that finished documents give back."""
    q = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & ~F.contains("text", F.lit("##"))).select("conv_id", "turn", "text")
    done = q.where("conv_id % 2 = 0").select(T.document(F.lit("code"), F.col("text"), F.lit("easy"), F.lit("METHOD 1: x"), F.lit(""), F.lit("")).alias("doc"))
    return dedup.pending(q.withColumn("fp", T.question_key(F.col("text"))), done.select(T.history_key(F.col("doc")).alias("fp")), ["fp"]).select("conv_id", "turn")


@query(f"WITH {DOCS_SQL} SELECT min(doc_id) AS doc_id, count(*) AS copies FROM d GROUP BY text")
def exact_text_first_wins(spark, sf_dir):
    """U4: exact texts, first wins, with the copies each stands for."""
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"))
    copies = d.groupBy("key").agg(F.count("*").alias("copies"))
    return dedup.first_wins(d, F.col("key"), ["doc_id"]).join(copies, "key").select("doc_id", "copies")


@query(f"WITH {DOCS_SQL}, u AS (SELECT text, CASE WHEN domain = 'code' THEN 0 ELSE 1 END AS prio, doc_id FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY prio, doc_id) AS k FROM u) SELECT doc_id, prio FROM r WHERE k = 1")
def priority_union_dedup(spark, sf_dir):
    """A union in which the first source wins."""
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"), "domain")
    return dedup.prefer([d.where("domain = 'code'"), d.where("domain <> 'code'")], F.col("key"), ["doc_id"]).select("doc_id", F.col("__source").alias("prio"))


@query("WITH t AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE n_chars % 300 END AS task_id FROM documents) SELECT task_id, min(doc_id) AS doc_id FROM t GROUP BY task_id")
def task_id_dedup(spark, sf_dir):
    """First row of each task, null being a task."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 0, F.col("n_chars") % 300).alias("task_id"))
    return dedup.first_wins(t, F.col("task_id"), ["doc_id"]).select("task_id", "doc_id")


@query("WITH p AS (SELECT doc_id, unnest(['textbook','qa','lecture','tutorial','knowledge_card']) AS fmt FROM documents) SELECT fmt, count(*) AS pending, CAST(sum(doc_id) AS BIGINT) AS ids FROM p WHERE NOT (doc_id % 3 = 0 AND fmt IN ('qa','lecture')) GROUP BY fmt")
def completed_pairs_antijoin(spark, sf_dir):
    """Documents by formats, less completed pairs."""
    formats = F.explode(F.array(*[F.lit(x) for x in ("textbook", "qa", "lecture", "tutorial", "knowledge_card")])).alias("fmt")
    pairs = table(spark, sf_dir, "documents").select("doc_id", formats)
    done = pairs.where("doc_id % 3 = 0 and fmt in ('qa', 'lecture')").select(F.col("doc_id").cast("string").alias("doc_id"), "fmt")
    return dedup.pending(pairs, done, ["doc_id", "fmt"]).groupBy("fmt").agg(F.count("*").alias("pending"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND text NOT IN (SELECT text FROM conversations)")
def done_ids_resume(spark, sf_dir):
    """Ids done under another key type, and texts already written."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = dedup.pending(d, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("doc_id")), ["doc_id"])
    return dedup.pending(left, table(spark, sf_dir, "conversations").select("text"), ["text"]).select("doc_id")


@query(f"WITH {DOCS_SQL}, r AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || doc_id), doc_id) AS k FROM d) SELECT doc_id, domain FROM r WHERE k <= CASE domain WHEN 'math' THEN 40 WHEN 'code' THEN 60 ELSE 25 END")
def stratified_quota(spark, sf_dir):
    """A quota of each domain in seeded order."""
    most = F.when(F.col("domain") == "math", 40).when(F.col("domain") == "code", 60).otherwise(25)
    return sampling.quota(docs(spark, sf_dir).select("doc_id", "domain"), ["domain"], most, hash_order(42, F.col("doc_id")), F.col("doc_id"))


@query("WITH r AS (SELECT event_type AS domain, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT domain, count(*) AS n, round(avg(value), 6) AS mean_loss FROM r WHERE i % greatest(1, n // 200) = 0 AND i < greatest(1, n // 200) * 200 GROUP BY domain")
def systematic_sample(spark, sf_dir):
    """A systematic sample of each domain and its mean."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("domain"), "value")
    return sampling.systematic(e, 200, ["event_id"], ["domain"]).groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_loss"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, i >= n - greatest(1, CAST(floor(n * 0.01) AS BIGINT)) AS is_val FROM r")
def md5_val_split(spark, sf_dir):
    """The last percent by md5 is validation."""
    return sampling.validation_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT url, CAST(row_number() OVER (ORDER BY md5('42:' || url), url) - 1 AS INT) AS idx FROM (SELECT DISTINCT url FROM pages) QUALIFY idx < 120")
def seeded_file_sample(spark, sf_dir):
    """Files in seeded order, the first 120."""
    return sampling.top(table(spark, sf_dir, "pages").select("url").distinct(), 120, hash_order(42, F.col("url")), F.col("url")).select("url", "idx")


@query(
    "WITH s AS (SELECT CAST(substr(source, 4) AS INT) AS shard, source AS path, CAST(sum(length(text)) AS BIGINT) AS n FROM documents GROUP BY source), o AS (SELECT *, CAST('0x' || left(md5(path), 8) AS BIGINT) % (n - 2048) AS o FROM s WHERE n > 2048), "
    "g AS (SELECT shard, unnest(CASE WHEN shard % 2 = 1 THEN list_reverse(range(o, n - 2048, 2048)) ELSE range(o, n - 2048, 2048) END) AS start, generate_subscripts(range(o, n - 2048, 2048), 1) - 1 AS place FROM o) SELECT shard, CAST(place AS INT) AS place, start FROM g"
)
def farm_starts(spark, sf_dir):
    """Sequence starts of shards from a hashed offset, odd shards backwards."""
    shards = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("n")).select(F.substring("source", 4, 9).cast("int").alias("shard"), F.col("source").alias("path"), "n")
    return sampling.window_starts(shards, F.col("path"), F.col("n"))


@query("SELECT o_orderkey, CASE WHEN (row_number() OVER (ORDER BY o_orderkey) - 1) % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM orders")
def alternating_split(spark, sf_dir):
    """Rows in turn to two sides."""
    return sampling.alternate(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("WITH b AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 10) AS BIGINT) AS batch FROM documents) SELECT batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM b GROUP BY batch")
def fixed_batches(spark, sf_dir):
    """Batches of fixed size in order."""
    b = sampling.batches(table(spark, sf_dir, "documents").select("doc_id"), 10, ["doc_id"])
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(f"WITH {DOCS_SQL}, u AS (SELECT doc_id, 0 AS side, row_number() OVER (ORDER BY doc_id) AS i FROM d WHERE domain = 'code' UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY doc_id) FROM d WHERE domain IN ('math', 'web')) SELECT doc_id, side, row_number() OVER (ORDER BY i, side) - 1 AS place FROM u")
def interleave_1to1(spark, sf_dir):
    """Two tables in turn, then the longer one's tail."""
    d = docs(spark, sf_dir).select("doc_id", "domain")
    return sampling.interleaved(d.where("domain = 'code'").drop("domain"), d.where("domain in ('math', 'web')").drop("domain"), ["doc_id"]).select("doc_id", "side", "place")


@query("WITH c AS (SELECT doc_id, unnest(range(1, 4)) AS copy FROM documents) SELECT doc_id, CAST(copy AS INT) AS copy, row_number() OVER (ORDER BY md5('42:' || copy || ':' || doc_id)) - 1 AS place FROM c")
def replicate_shuffle(spark, sf_dir):
    """Copies in a seeded global order."""
    return _replicated(table(spark, sf_dir, "documents"))


@query()
def replicate_shuffle_all(spark, sf_dir):
    """The same, under the name its brute-force test knows."""
    return _replicated(table(spark, sf_dir, "documents"))


def _replicated(d):
    c = sampling.replicated(d.select("doc_id"), 3, "doc_id")
    return row_numbers(c, ["place_key"], "place").select("doc_id", "copy", "place")


@query("SELECT sum(CASE WHEN length(trim(text)) >= 50 THEN 1 ELSE 0 END)::BIGINT AS stripped, sum(CASE WHEN length(trim(text)) > 50 THEN 1 ELSE 0 END)::BIGINT AS loaded, sum(CASE WHEN length(text) >= 50 THEN 1 ELSE 0 END)::BIGINT AS plain, sum(CASE WHEN text <> '' THEN 1 ELSE 0 END)::BIGINT AS nonempty, sum(CASE WHEN length(left(text, 50000)) >= 20 THEN 1 ELSE 0 END)::BIGINT AS truncated, sum(CASE WHEN length(text) BETWEEN 200 AND 3000 AND regexp_matches(text, '[?=:]') AND doc_id % 5 >= 2 THEN 1 ELSE 0 END)::BIGINT AS math, sum(CASE WHEN length(text) BETWEEN 200 AND 3000 AND regexp_matches(text, '[?=:]') AND doc_id % 5 >= 3 THEN 1 ELSE 0 END)::BIGINT AS hard FROM documents")
def length_gates(spark, sf_dir):
    """F1 F2 F3 F4 F7 P-3: how many rows each gate passes."""
    t, score = F.col("text"), F.col("doc_id") % 5
    math = quality.length_gate(t, "math") & t.rlike("[?=:]")
    flags = {"stripped": quality.length_gate(t, "stripped"), "loaded": quality.length_gate(t, "loaded"), "plain": quality.length_gate(t, "plain"), "nonempty": t != "", "truncated": quality.truncated(t).isNotNull(), "math": math & quality.at_least(score, 2), "hard": math & quality.at_least(score, 3)}
    return table(spark, sf_dir, "documents").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()])


@query("SELECT conv_id, turn, left(text, 200) AS head, right(text, 400) AS tail FROM conversations WHERE length(text) >= 40 AND length(text) <= 1500")
def prefix_windows(spark, sf_dir):
    """F9 P-1 P-2: bounded texts with their first and last characters."""
    return table(spark, sf_dir, "conversations").where(F.length("text").between(40, 1500)).select("conv_id", "turn", T.prefix(F.col("text"), 200).alias("head"), T.suffix(F.col("text"), 400).alias("tail"))


@query("WITH l AS (SELECT 'p' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders), h AS (SELECT 'p' || l_orderkey AS path, CAST(floor(round(sum(l_extendedprice), 2)) AS BIGINT) AS size FROM lineitem GROUP BY l_orderkey) SELECT l.path, l.size FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.path = l.path AND l.size > 0 AND h.size >= 0.99 * l.size)")
def manifest_pending(spark, sf_dir):
    """Listed files without a complete local one."""
    listing = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey")).alias("path"), F.floor("o_totalprice").cast("long").alias("size"))
    local = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.floor(F.round(F.sum("l_extendedprice"), 2)).cast("long").alias("size")).select(F.concat(F.lit("p"), F.col("l_orderkey")).alias("path"), "size")
    return audit.missing_files(listing, local)


@query("WITH m AS (SELECT CASE WHEN page_id % 7 = 0 THEN 'directory' ELSE 'file' END AS type, 'data/train-' || page_id || CASE WHEN page_id % 5 = 0 THEN '.json' ELSE '.parquet' END AS path FROM pages) SELECT path FROM m WHERE type = 'file' AND path LIKE '%.parquet' AND path LIKE 'data/train-1%' ORDER BY path LIMIT 30")
def hub_listing(spark, sf_dir):
    """A listing's files below a pattern, the first in order."""
    from corpusmill.sources.files import listed

    page = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("data/train-"), F.col("page_id"), F.when(F.col("page_id") % 5 == 0, ".json").otherwise(".parquet"))
    manifest = page.select(F.when(F.col("page_id") % 7 == 0, "directory").otherwise("file").alias("type"), name.alias("path"))
    return listed(manifest, "data/train-1*", 30).select("path")


@query("SELECT CASE WHEN o_totalprice > 0 AND (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END) > 0 THEN CASE WHEN o_custkey * 100.0 >= 0.98 * o_totalprice THEN 'ok' ELSE 'fail' END ELSE CASE WHEN o_custkey * 100.0 > 10000 THEN 'ok' ELSE 'fail' END END AS status, count(*) AS files FROM orders GROUP BY 1")
def file_completeness(spark, sf_dir):
    """Files by completeness."""
    o = table(spark, sf_dir, "orders")
    ok = quality.complete(F.col("o_custkey") * 100.0, F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice")), 0.98, 10_000)
    return o.select(F.when(ok, "ok").otherwise("fail").alias("status")).groupBy("status").agg(F.count("*").alias("files"))


@query("SELECT sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words, count(*) AS texts FROM (SELECT DISTINCT text FROM conversations)")
def word_count_estimate(spark, sf_dir):
    """Words over distinct texts."""
    return table(spark, sf_dir, "conversations").select("text").distinct().agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.count("*").alias("texts"))
