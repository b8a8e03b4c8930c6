"""Tokenizer calls for Arrow batches: encode each distinct piece once.

The public BPE tokenizers cut a text into pieces before they merge, so the ids
of a text are the ids of its pieces in a row.  A bounded cache maps pieces to
ids; a batch is then one dictionary lookup per piece and one array gather.

Texts of Latin-1 characters are cut by the tokenizer file's own pattern, with its
character classes written out, and a new piece goes to the file's BPE model.
Other texts are cut at white space only (where every pre-tokenizer cuts) and
their pieces go through the whole tokenizer.  Texts with an added token, or with
U+001C..U+001F (which Python calls white space and the tokenizers don't), go to
the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

__all__ = ["PieceEncoder", "encoder"]

CACHE_PIECES = 500_000   # pieces kept between batches
CACHE_IDS = 8_000_000
_AMBIGUOUS = ("\0", "\x1c", "\x1d", "\x1e", "\x1f")
_SPACED_PIECES = re.compile(r"\s*\S+|\s+")


def _latin(kind: str) -> str:
    """The Latin-1 characters of a Unicode category, for a character class."""
    return "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == kind)


# The pre-tokenizer patterns of the two kinds of file, with \\p{L}
# and \\p{N} written out for Latin-1.
_L, _N = _latin("L"), _latin("N")
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
_WORD_PATTERN = _CONTRACTIONS + rf"|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"
_BYTE_PATTERN = _CONTRACTIONS + rf"| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as themselves,
    the others as U+0100 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class _Index(dict):
    """Piece to number; unseen pieces are numbered and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.lowers = (json.load(f)["normalizer"] or {}).get("type") == "Sequence"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = _AMBIGUOUS + tuple(added)    # texts with one of these are not cut
        self.keeps_space = not self.lowers
        self.pattern = re.compile(_BYTE_PATTERN if self.keeps_space else _WORD_PATTERN)
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(0, dtype=np.uint32)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text; those for the whole tokenizer start with NUL."""
        if not any(c in text for c in self.whole):
            try:
                text.encode("latin-1")
                return self.pattern.findall(text.lower() if self.lowers else text)
            except UnicodeEncodeError:
                return ["\0" + p for p in (_SPACED_PIECES.findall(text) if self.keeps_space else text.split())]
        return ["\0" + text]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.index) > CACHE_PIECES or len(self.flat) > CACHE_IDS:
            self._reset()
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                pieces += self._pieces(text)
            ends[i + 1] = len(pieces)
        at = np.array(list(map(self.index.__getitem__, pieces)), dtype=np.int64)
        if self.index.new:
            self._learn()
        size = self.size[at] if len(at) else np.zeros(0, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])] if len(at) else self.flat[:0]
        return ids, np.diff(total[ends])

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        whole = [p[1:] for p in new if p[0] == "\0"]
        by_tokenizer = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)) if whole else iter(())
        encoded = [next(by_tokenizer).ids if p[0] == "\0" else
                   [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(_LETTERS))] for p in new]
        size = np.fromiter(map(len, encoded), dtype=np.int64, count=len(new))
        flat = np.fromiter((x for ids in encoded for x in ids), dtype=np.uint32, count=int(size.sum()))
        start = len(self.flat) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.flat = np.concatenate([self.flat, flat])
        self.start = np.concatenate([self.start, start])
        self.size = np.concatenate([self.size, size])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer file (loaded once per process)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
