"""Readers and writers of corpus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators.order import row_numbers


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_column(spark: SparkSession, paths: list[str] | str, column: str = "text") -> DataFrame:
    """One text column of Parquet files, unreadable files skipped; with the file and its row order."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(F.col(column).alias("text"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_ord"))


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: str, mode: str = "strict", required: str | None = None, missing: str = "fail") -> DataFrame:
    """JSON lines with a declared schema.

    ``strict`` fails on a bad line, ``tolerant`` drops it, ``blank`` also skips blank lines before parsing.
    Missing files fail, or are skipped where asked.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if missing == "skip":
        paths = [p for p in paths if _exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], schema)
    if mode == "blank":
        lines = spark.read.text(paths).where(F.trim("value") != "")
        df = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    else:
        df = spark.read.schema(schema).option("mode", "FAILFAST" if mode == "strict" else "DROPMALFORMED").json(paths)
    return df.where(F.col(required).isNotNull()) if required else df


def load(spark: SparkSession, source: str, max_docs: int | None = None) -> DataFrame:
    """Texts of a ``.parquet`` or ``.jsonl`` source longer than 50 characters once stripped, the first so many."""
    if source.endswith(".parquet"):
        df = spark.read.parquet(source).select(F.col("text").cast("string").alias("text"))
    elif source.endswith(".jsonl"):
        df = spark.read.schema("text string").json(source)
    else:
        raise ValueError(f"neither .parquet nor .jsonl: {source}")
    kept = df.where(F.length(strip(F.col("text"))) > 50).withColumn("row_ord", F.monotonically_increasing_id())
    return kept if max_docs is None else kept.orderBy("row_ord").limit(max_docs)


def listed(manifest: DataFrame, pattern: str = "", most: int | None = None, train_only: bool = True) -> DataFrame:
    """Parquet files of a hub listing ``type, path, size`` below a pattern's fixed part, in path order."""
    kept = manifest.where((F.col("type") == "file") & F.col("path").endswith(".parquet") & F.col("path").startswith(pattern.split("*")[0]))
    kept = kept.where(F.contains(F.col("path"), F.lit("train-"))) if train_only else kept
    return kept.orderBy("path") if most is None else kept.orderBy("path").limit(most)


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of a folder, from file metadata without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_shards(df: DataFrame, path: str, order: list[str], size: int = 1000) -> None:
    """Shards of so many rows in order, the last one shorter."""
    row_numbers(df, order, "__i").withColumn("shard", F.floor(F.col("__i") / size)).drop("__i").write.partitionBy("shard").mode("overwrite").parquet(path)


def write_by_format(df: DataFrame, path: str, column: str = "format_type") -> None:
    """JSON lines appended in a folder for each format."""
    df.write.partitionBy(column).mode("append").json(path)


def next_index(spark: SparkSession, path: str) -> int:
    """One more than the largest number among existing shard names; 0 for none."""
    import re

    if not _exists(spark, path):
        return 0
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    return max((int(m[1]) for n in names if (m := re.search(r"(\d+)\D*$", n))), default=-1) + 1
