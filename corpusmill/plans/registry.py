"""Registration of queries and their SQL, and what the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Sources stand for four domains.
DOMAINS = ("web", "math", "code", "synth")
DOMAIN_SQL = "(['web','math','code','synth'])[CAST(substr(source, 4) AS INT) % 4 + 1]"
DOCS_SQL = f"d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars, {DOMAIN_SQL} AS domain FROM documents)"
TOKENS_SQL = (
    DOCS_SQL
    + r""", w AS (SELECT doc_id, domain, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')) AS word,
      generate_subscripts(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> ''), 1) AS i FROM d),
    tok AS (SELECT doc_id, domain, i, CAST('0x' || left(md5(word), 4) AS INT) % 49152 AS id FROM w)"""
)


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their domain; null texts are empty."""
    domain = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.substring("source", 4, 9).cast("int") % 4 + 1)
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("domain", domain)
