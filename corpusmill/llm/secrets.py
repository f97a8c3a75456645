"""Secrets by grammar inference.

Format matches are the labelled credentials.  For each kind a sample of at most ``SAMPLE`` distinct ones (the
first by hash; the documented bound of the fit) becomes a prefix tree over character classes, whose states are
merged where their outgoing and ending frequencies agree within the Hoeffding bound, red-blue order, folding
subtrees so that the automaton stays deterministic.  Every maximal run of 6 or more characters of
``A-Za-z0-9+/_.=-`` outside the format matches, however long, is scored by its mean log-likelihood a character
under each automaton and becomes a further span if it is as likely as nearly all credentials of that kind; a run
that isn't is scored without the dots at its ends, then in its parts between dots.

The sample and the automata have fixed bounds; all texts and all candidates are scanned and scored.  Credentials
of any length train: the first ``DEPTH`` characters make the tree, the next ones, to ``FIT`` in all, are counted on
the merged automaton.

Defined results: a null text is empty; null or repeated ``doc_id`` values give a row each; an empty table gives
no row; a kind without credentials has no automaton and adds nothing.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.spans import SPANS, digests

KINDS = ("assign", "access", "hex")
SAMPLE, CONFIDENCE, TAIL, FLOOR = 384, 0.05, 0.02, 1e-4
LEAST, DEPTH, FIT = 6, 256, 4096

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.IGNORECASE | re.ASCII)
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_CLASSES = str.maketrans({c: "0" if c.isdigit() else "a" if c in "abcdef" else "z" if c.islower() else "A" if c in "ABCDEF" else "Z" for c in string.ascii_letters + string.digits})
_END = "$"
_UNMET = math.log(FLOOR)

Span = tuple[int, int, int]


def base_matches(text: str | None) -> list[tuple[int, int, int, str]]:
    """Format matches: (start, kind, end, credential) by start, then kind."""
    if not text:
        return []
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def classes(word: str) -> str:
    """A word's characters by class: digit 0, a-f a, other lower-case letters z, A-F A, other capitals Z, signs as they are."""
    return word.translate(_CLASSES)


class Automaton:
    """A probabilistic deterministic automaton merged from a prefix tree."""

    def __init__(self, words: list[str], confidence: float = CONFIDENCE):
        self.count: list[int] = [0]  # words through a state
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[Counter] = [Counter()]  # words that leave by each class, or end
        self.slack = math.sqrt(0.5 * math.log(2 / confidence))
        for w in words:
            self._add(classes(w))
        self._merge_all()
        for w in words:
            if len(w) > DEPTH:
                self._count_rest(classes(w))
        self.steps = [{c: (math.log(max(x / n, FLOOR)), to.get(c)) for c, x in seen.items()} for n, seen, to in zip(self.count, self.seen, self.next)]
        own = sorted(self.score(w) for w in words)
        self.least = own[int(TAIL * len(own))] - 0.05 if own else math.inf

    def _add(self, word: str) -> None:
        state = 0
        self.count[0] += 1
        for c in word[:DEPTH]:
            self.seen[state][c] += 1
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                self.count.append(0)
                self.seen.append(Counter())
            state = self.next[state][c]
            self.count[state] += 1
        if len(word) <= DEPTH:
            self.seen[state][_END] += 1

    def _count_rest(self, word: str) -> None:
        """Counts what is beyond the tree's depth; a step that no state has leads back to its state."""
        state = 0
        for c in word[:DEPTH]:
            state = self.next[state][c]
        for c in word[DEPTH:]:
            self.seen[state][c] += 1
            state = self.next[state].setdefault(c, state)
            self.count[state] += 1
        if len(word) < FIT:
            self.seen[state][_END] += 1

    def _alike(self, a: int, b: int) -> bool:
        """Whether all frequencies below two states agree; a loop, as trees can be deep."""
        todo, met = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in met:
                continue
            met.add((a, b))
            n, m = self.count[a], self.count[b]
            if not n or not m:
                continue
            bound = self.slack * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a][c] / n - self.seen[b][c] / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Adds a tree to a state, and its branches to that state's."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.seen[a].update(self.seen[b])
            for c, x in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], x))
                else:
                    self.next[a][c] = x

    def _merge_all(self) -> None:
        red = [0]
        while True:
            own = set(red)
            blue = next(((r, c, x) for r in red for c, x in sorted(self.next[r].items()) if x not in own), None)
            if blue is None:
                self.states = len(red)
                return
            parent, c, x = blue
            for r in red:
                if self._alike(r, x):
                    self.next[parent][c] = r
                    self._fold(r, x)
                    break
            else:
                red.append(x)

    def score(self, word: str) -> float:
        """Mean log-likelihood a character, the end included; what a state never met has a slight likelihood and stays there."""
        return self._total(classes(word), -math.inf) / (len(word) + 1)

    def margin(self, shape: str) -> float:
        """How far the score of a word of these classes is above the least of a credential; negative if below."""
        return self._total(shape, self.least * (len(shape) + 1)) / (len(shape) + 1) - self.least

    def _total(self, shape: str, enough: float) -> float:
        """Log-likelihood of a word; no step adds to it, so it ends once it is under ``enough``."""
        state, total = 0, 0.0
        for c in shape:
            p, state = self.steps[state].get(c, (_UNMET, state))
            total += p
            if total < enough:
                return -math.inf
        return total + self.steps[state].get(_END, (_UNMET, state))[0]


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[int, Automaton]:
    """Automata by kind, from a bounded sample of the distinct credentials that formats find."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = {(k, v[:FIT]) for t in b.column(0) for _, k, _, v in base_matches(t.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([v for _, v in got], pa.string())], names=["kind", "value"])

    values = docs.select(F.col("text").cast("string")).mapInArrow(labelled, "kind int, value string").distinct()
    parts = [values.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample) for k in range(len(KINDS))]
    held = defaultdict(list)
    for r in parts[0].unionByName(parts[1]).unionByName(parts[2]).collect():  # at most three samples
        held[r["kind"]].append(r["value"])
    return {k: Automaton(sorted(v)) for k, v in held.items()}


class Judge:
    """The kind of a word by the automata, kept for the short words that texts repeat."""

    def __init__(self, automata: dict[int, Automaton]):
        self.automata = automata
        self.memo: dict[str, tuple[float, int]] = {}

    def margin(self, word: str) -> tuple[float, int]:
        """The best automaton's margin, negative if none accepts the word, and its kind."""
        if len(word) > 32:
            return self._margin(word)
        out = self.memo.get(word)
        if out is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            out = self.memo[word] = self._margin(word)
        return out

    def _margin(self, word: str) -> tuple[float, int]:
        shape = classes(word)
        best, kind = max(((a.margin(shape), -k) for k, a in self.automata.items()), default=(-1.0, 0))
        return best, -kind

    def spans(self, text: str, start: int, stop: int) -> list[Span]:
        """The run with or without the dots at its ends, as is likelier, else its parts between dots."""
        if stop - start < LEAST:
            return []
        word = text[start:stop]
        margin, kind = self.margin(word)
        if "." not in word:
            return [(start, kind, stop)] if margin >= 0 else []
        inner = word.strip(".")
        at = start + word.find(inner)
        if LEAST <= len(inner) < len(word) and (own := self.margin(inner))[0] > margin:
            (margin, kind), start, stop = own, at, at + len(inner)
        if margin >= 0:
            return [(start, kind, stop)]
        out = []
        for part in inner.split("."):
            if len(part) >= LEAST and (own := self.margin(part))[0] >= 0:
                out.append((at, own[1], at + len(part)))
            at += len(part) + 1
        return out


def spans_of(text: str | None, judge: Judge) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a text."""
    base = [(s, k, e) for s, k, e, _ in base_matches(text)]
    more, at = [], 0
    for m in _CANDIDATE.finditer(text or "") if judge.automata else ():
        start, stop = m.span()
        while at < len(base) and base[at][2] <= start:
            at += 1
        for k in range(at, len(base)):
            if base[k][0] >= stop:
                break
            more += judge.spans(text, start, base[k][0])
            start = max(start, base[k][2])
        more += judge.spans(text, start, stop)
    return base, sorted(base + more)


def detect(docs: DataFrame, automata: dict[int, Automaton] | None = None) -> DataFrame:
    """``doc_id, base, spans`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs) if automata is None else automata)  # bounded by the sample
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    shown = lambda spans: [{"start": s, "kind": k, "stop": e} for s, k, e in spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for b in batches:
            found = [spans_of(t.as_py(), judge) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shown(x) for x, _ in found], kind), pa.array([shown(x) for _, x in found], kind)], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id long, base {SPANS}, spans {SPANS}")


def op3_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *digests(F.col("base"), F.col("spans"), KINDS))
