import random

import pytest

#: Every text case that the operators must define: null, empty, blank, short, repeated, long, odd characters.
ODD = [None, "", " ", "\n\t", "one", "two words", "a b c d", "x" * 40_000, "Ünï 😀 ça va  bien ", "call +1 (456) 555-2186 now", "a@b.co a@b.co+c@d.ef"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, null texts, repeated rows, ties, very long texts, and columns whose names clash with inner ones."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(ODD)]
    rows += [(5, "two words", "en", "s2"), (5, "other text here", "en", "s2"), (None, "no id here at all today", "en", "s1"), (None, None, None, None)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 400]))), "de", f"s{i % 3}") for i in range(30)]
    rows += rows[-5:]
    clash = "doc_id long, text string, lang string, source string, row long, node long, size string, score double, place int, m int, token string, tokens string, spans string, n_chars long"
    return spark.createDataFrame([(*r, 1, 2, "s", 0.5, 3, 4, "t", "u", "v", len(r[1] or "")) for r in rows], clash).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
