"""Tokens: the stub tokenizer, packing, chunks, and training examples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.order import running_total
from corpusmill.session import materialize

VOCABULARY, LENGTH, IGNORE = 49_152, 2048, -100


def once(c: Column) -> Column:
    """A column computed once a row: a generator of one element, which the optimizer doesn't copy into its users."""
    return F.explode(F.array(c))


def stub_tokens(c: Column) -> Column:
    """Ids without a vocabulary: blank-separated words, four hex digits of their md5."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\r\f]+"), lambda x: x != "")
    return F.transform(words, lambda x: F.pmod(F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("int"), F.lit(VOCABULARY)))


def tokenized(df: DataFrame, vocabulary: str, text: str = "text", name: str = "tokens") -> DataFrame:
    """Ids by a ``tokenizers`` file, in Arrow batches, without special tokens or truncation."""
    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)  # once a task
        for texts in parts:
            yield pd.Series([x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return df.withColumn(name, encode(F.col(text)))


def packed(df: DataFrame, order: list[str], by: list[str] | None = None, length: int = LENGTH, shard: int | None = None, keep_tail: bool = False) -> DataFrame:
    """One stream for each group, cut into sequences of ``length``; ``shard`` cuts the stream before.

    A document's place is a running total; it gives its slice to each sequence it touches, and a sequence joins its
    slices in order.  The tail (of each shard) is dropped as the readers do, unless kept.
    """
    by = by or []
    # Tokens are made once and joined to their places; the running total sees keys and lengths only.
    held = materialize(df.withColumn("__n", F.size("tokens")).where("__n > 0").withColumn("__row", F.monotonically_increasing_id()), "tokens")
    places = running_total(held.select("__row", "__n", *dict.fromkeys([*by, *order])), [*order, "__row"], F.col("__n"), "__at", by)
    placed = held.select("__row", "__n", "tokens", *by).join(places.select("__row", "__at"), "__row")
    if shard is None:
        cell, first = F.col("__at"), F.floor(F.col("__at") / length)
        last = F.floor((F.col("__at") + F.col("__n") - 1) / length)
        pieces = placed.withColumn("seq_id", F.explode(F.sequence(first, last))).withColumn("__from", F.col("seq_id") * length)
        pieces, keys, bound = pieces, ["seq_id"], F.lit(length)
    else:
        per = -(-shard // length)  # cells of a shard, the last one short
        cell = lambda at: F.floor(at / shard) * per + F.floor((at % shard) / length)
        pieces = placed.withColumn("__cell", F.explode(F.sequence(cell(F.col("__at")), cell(F.col("__at") + F.col("__n") - 1))))
        pieces = pieces.withColumn("shard", F.floor(F.col("__cell") / per)).withColumn("seq_id", F.col("__cell") % per)
        pieces = pieces.withColumn("__from", F.col("shard") * shard + F.col("seq_id") * length)
        keys, bound = ["shard", "seq_id"], F.least(F.lit(length), F.lit(shard) - F.col("seq_id") * length)
    pieces = pieces.withColumn("__lo", F.greatest(F.col("__from"), F.col("__at"))).withColumn("__hi", F.least(F.col("__from") + bound, F.col("__at") + F.col("__n")))
    own = F.slice("tokens", (F.col("__lo") - F.col("__at") + 1).cast("int"), (F.col("__hi") - F.col("__lo")).cast("int"))
    whole = pieces.groupBy(*by, *keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__lo"), own.alias("t")))), lambda x: x["t"])).alias("tokens"))
    return whole if keep_tail else whole.where(F.size("tokens") == length)


def chunks(tokens: Column, length: int = LENGTH, pad: int = 0) -> Column:
    """A document's own chunks, the last one padded; none of an empty document."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(length))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.concat(F.slice(tokens, s + 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), s + length - n))))


def windows(tokens: Column, step: int = 512) -> Column:
    """Overlapping evaluation windows of ``step`` + 1 tokens."""
    n = F.size(tokens)
    starts = F.when(n > 1, F.sequence(F.lit(0), n - 2, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, step + 1))


def example(prompt: Column, response: Column, length: int = LENGTH) -> Column:
    """``input_ids, labels`` of at most ``length``: the prompt is cut from the front; if that isn't enough it goes
    and the response is cut at the end.  Prompt labels are ignored."""
    over = F.size(prompt) + F.size(response) - length
    kept = F.when(over <= 0, prompt).when(over >= F.size(prompt), F.array().cast("array<int>")).otherwise(F.slice(prompt, over + 1, F.greatest(F.lit(1), F.size(prompt))))
    answer = F.when((over > 0) & (over >= F.size(prompt)), F.slice(response, 1, length)).otherwise(response)
    return F.struct(F.concat(kept, answer).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), F.size(kept)), answer).alias("labels"))


def collated(tokens: Column, pad: int, length: int = LENGTH) -> Column:
    """The last ``length`` values, padded at the end."""
    tail = F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - length + 1), length)
    return F.concat(tail, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(tokens))))


def trains(labels: Column) -> Column:
    """Whether any label counts."""
    return F.exists(labels, lambda x: x != IGNORE)


def answer_span(labels: Column) -> Column:
    """First and last place (from 0) of labels that count; null if none does."""
    places = F.filter(F.transform(labels, lambda x, i: F.when(x != IGNORE, i)), lambda x: x.isNotNull())
    return F.when(F.size(places) > 0, F.struct(F.array_min(places).alias("first"), F.array_max(places).alias("last")))


def masked_mean(values: Column, labels: Column) -> Column:
    """Mean of the values whose label counts; null if none does."""
    kept = F.filter(F.zip_with(values, labels, lambda v, m: F.when(m != IGNORE, v)), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))
