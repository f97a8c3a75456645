"""All queries over the provided tables and their SQL, by name."""

from __future__ import annotations

from corpusmill.plans import corpus, training
from corpusmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "training"]
