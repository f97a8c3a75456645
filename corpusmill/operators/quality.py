"""Length and quality gates, and the tier classifier (a design of this library)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

#: Character bounds of the gates by use; None is open.
GATES = {"stripped": (50, None), "loaded": (51, None), "plain": (50, None), "web": (400, 6000), "math": (200, 3000), "math_sft": (150, 2500), "grpo": (30, 2000), "judge": (20, None)}


def length_gate(c: Column, use: str) -> Column:
    """Whether a text passes a gate; ``plain`` doesn't strip."""
    low, high = GATES[use]
    n = F.length(c if use == "plain" else strip(c))
    passed = n >= low if high is None else n.between(low, high)
    return F.coalesce(passed, F.lit(False))


def at_least(score: Column, least: float) -> Column:
    """A threshold that neither null nor NaN passes."""
    return F.coalesce(~F.isnan(score.cast("double")) & (score >= least), F.lit(False))


def composite(*scores: Column) -> Column:
    """The sum of scores, null as 0."""
    total = F.lit(0.0)
    for s in scores:
        total = total + F.coalesce(s.cast("double"), F.lit(0.0))
    return total


def truncated(c: Column, most: int = 50_000, least: int = 20) -> Column:
    """First cut to ``most`` characters, then null below ``least``."""
    cut = F.substring(c, 1, most)
    return F.when(F.length(cut) >= least, cut)


def finite(*values: Column) -> Column:
    """Whether all values are numbers and none is infinite."""
    ok = F.lit(True)
    for v in values:
        v = v.cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return ok


def all_or_nothing(df, ok: Column):
    """The table if every row passes; raises before anything is written if one doesn't."""
    bad = df.where(~F.coalesce(ok, F.lit(False))).limit(1).count()
    if bad:
        raise ValueError("a row that mustn't be written")
    return df


def complete(actual: Column, expected: Column, share: float = 0.98, least: int = 10_000_000) -> Column:
    """Whether a file is complete: by share of its expected size, else by a least size."""
    return F.when(expected > 0, actual >= share * expected).otherwise(actual > least)


def classify(c: Column) -> Column:
    """``ok, reason, q_score, tier``; the first failing rule is the reason."""
    n = F.length(c)
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / n
    lines = F.split(c, "\n")
    line_share = F.size(F.array_distinct(lines)) / F.size(lines)
    words = F.split(c, " ")
    word_share = F.size(F.array_distinct(words)) / F.size(words)
    # Measured once a row; the rules read the measures.
    measures = F.array(F.struct(n.alias("n"), letters.alias("letters"), line_share.alias("line_share"), word_share.alias("word_share"), (n / F.size(words)).alias("mean_word")))

    def judged(m: Column) -> Column:
        reason = (
            F.when(m["n"].isNull() | (m["n"] < 50), "too_short").when(m["n"] > 50_000, "too_long").when(m["letters"] < 0.5, "low_alpha")
            .when(m["line_share"] < 0.5, "repetitive").when(m["word_share"] < 0.15, "low_diversity").otherwise("ok")
        )
        tier = F.when((m["mean_word"] >= 7.5) | (m["n"] > 6000), "hard").when((m["mean_word"] >= 6.0) | (m["n"] > 2000), "medium").otherwise("easy")
        return F.struct((reason == "ok").alias("ok"), reason.alias("reason"), (m["letters"] * 0.5 + m["line_share"] * 0.2 + m["word_share"] * 0.3).alias("q_score"), tier.alias("tier"))

    return F.element_at(F.transform(measures, judged), 1)
