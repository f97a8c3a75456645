"""Word-memoised encoding with public BPE vocabularies.

Both vocabularies split a text into pre-tokens before any merge, and a single space between two non-blank
characters is always a pre-token boundary.  A text is cut at such spaces, each distinct piece goes through the
``tokenizers`` model once per Python worker, and a document's ids are its pieces' ids in order: the same ids as
encoding the whole text, without repeating the merges.  Pieces with characters outside plain Latin text, texts in
which spaces stand beside other blanks, and texts that hold an added token of the vocabulary (``<|endoftext|>``), go
through the library's whole pipeline instead.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

from corpusmill.llm.memos import claim

#: Entries a worker's memo holds before it starts anew, and the longest piece it keeps: some 180 MB at most; a bound on
#: memory, not on what is encoded.
MEMO_ENTRIES, MEMO_LENGTH = 900_000, 32

#: The pre-token patterns of the two vocabularies, as their files state them.
_BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Pieces the memo takes apart itself: printable Latin text with inner line ends.
_PLAIN = regex.compile(r"[\x21-\x7e¡-ɏ]+(?:\n[\x21-\x7e¡-ɏ]+)*")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def vocabulary_path(name: str) -> str:
    """Where the installed public tokenizers keep a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes whole texts to little-endian unsigned 16-bit ids (both vocabularies have fewer than 65,536)."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids don't fit unsigned 16 bits")
        with open(path, encoding="utf-8") as f:
            self.by_word = bool(json.load(f)["model"].get("end_of_word_suffix"))
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.any_case = any(t.normalized for t in added)
        # A text without the character that all added tokens begin with holds none; no letter, as case changes letters.
        firsts = {a[:1] for a in self.added}
        self.first = firsts.pop() if len(firsts) == 1 and not "".join(firsts).isalpha() else ""
        # Whether lower case is all that the normalizer does to plain Latin characters, among which no mark combines.
        self.lowers = self.by_word and all(self.tokenizer.normalizer.normalize_str(chr(c)) == chr(c).lower() for r in (range(0x21, 0x7F), range(0xA1, 0x250)) for c in r)
        self.entries = entries
        self.letters = dict(enumerate(_byte_letters()))
        self.raw = [i.to_bytes(2, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.memo: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Ids by the library's own pipeline over the whole text."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _has_added(self, text: str) -> bool:
        """Whether an added token of the vocabulary may stand in a text."""
        if self.first and self.first not in text:
            return False
        if any(a in text for a in self.added):
            return True
        return self.any_case and any(a.lower() in text.lower() for a in self.added)

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.parts.get(part)
        if ids is None:
            mapped = part.translate(self.letters) if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.raw[t.id] for t in self.model.tokenize(mapped)])
            if len(part) <= MEMO_LENGTH:
                self.parts[part] = ids
        return ids

    def _pieces(self, words: list[str]) -> list[bytes | None]:
        """Ids of pieces between spaces; long ones aren't kept."""
        memo, long = self.memo, {}
        if len(memo) + len(self.parts) > self.entries:
            memo.clear()
            self.parts.clear()
        for w in set(words).difference(memo):
            (memo if len(w) <= MEMO_LENGTH else long)[w] = self._piece(w)
        return [memo[w] if w in memo else long[w] for w in words] if long else list(map(memo.__getitem__, words))

    def _piece(self, piece: str) -> bytes | None:
        """Ids of what stands between two spaces; None if a blank beside a space forbids the cut."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if (not self.first or self.first in piece) and self._has_added(piece):
            return self.whole(" " + piece)
        space = "" if self.by_word else " "
        letters, end = (piece, "") if piece.isalpha() else (piece[:-1], piece[-1])
        if letters.isalpha() and end in ".,;:!?" and (letters.isascii() or _PLAIN.fullmatch(letters)):
            if self.by_word:
                letters = letters.lower() if self.lowers or letters.isascii() else self.tokenizer.normalizer.normalize_str(letters)
            # A lower-cased letter may gain a mark, which is no letter.
            if letters.isalpha():
                return self._part(space + letters) + self._part(end) if end else self._part(space + letters)
        if _PLAIN.fullmatch(piece) is None:
            return self.whole(" " + piece)
        if self.by_word:
            plain = piece.lower() if self.lowers and "\n" not in piece else self.tokenizer.normalizer.normalize_str(piece)
            return b"".join([self._part(p) for p in _WORD_PATTERN.findall(plain)])
        return b"".join([self._part(p) for p in _BYTE_PATTERN.findall(" " + piece)])

    def count_after_space(self, words: list[str]) -> int | None:
        """Ids of pieces that follow spaces, in number; None if they can't be cut there."""
        found = self._pieces(words)
        return None if None in found else sum(map(len, found)) // 2

    def encode(self, text: str | None) -> bytes:
        """The ids of one whole text; null is the empty text."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or first[-1].isspace() or self._has_added(text):
            return self.whole(text)
        if self.by_word:  # a first piece is encoded like others, as spaces leave no trace
            found = self._pieces([first, *rest])
            return self.whole(text) if None in found else b"".join(found)
        found = self._pieces(rest)
        return self.whole(text) if None in found else self.whole(first) + b"".join(found)


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of a vocabulary file."""
    return claim(f"encoder {path}", lambda: PieceEncoder(path))
