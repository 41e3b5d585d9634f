"""Token ids of whole texts, pre-token by pre-token with a bounded cache.

The vocabulary drops white space and never joins across pre-tokens, so a text's ids are those of its runs of letters, its
digits and its runs of marks in a row. A process keeps the ids of those it has met; words with letters beyond Latin are
cut by the tokenizer itself, and texts for which this does not hold are encoded whole.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata
from functools import partial
from itertools import compress

import numpy as np

CACHED_WORDS = 250_000  # pre-tokens a process keeps before it drops the rarer ones, about 200 bytes each
_STATE = "_spanferry_word_ids"  # state that outlives a task in a reused Python worker
# White space to str.split() but not to the tokenizer.
_UNUSUAL = ("\x1c", "\x1d", "\x1e", "\x1f")
# Below this, lower case and composition are those of single letters, so words can be cut as the tokenizer cuts them.
_PLAIN_END = "\u0130"
_LETTERS, _DIGITS = (
    "".join(chr(c) for c in range(ord(_PLAIN_END)) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"
)
_PRE_TOKENS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+").findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in shown else spare))
        spare += byte not in shown
    return letters


class WordIds(dict):
    """Pre-token to its row in ``starts`` and ``counts``, which point into ``pool``; it is encoded when first asked for.

    When there are too many, those that several texts used stay, up to half; most words of a corpus come once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        # Per pre-token: its place in the pool, its length there, and how many texts used it lately.
        self.starts, self.counts, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.fresh: tuple[list[int], list[int]] = [], []  # ids and their number, of pre-tokens not yet in the pool

    def _trim(self) -> None:
        uses = self.uses[: len(self)]
        often = np.flatnonzero(uses > 1)
        kept = np.sort(often[np.argsort(-uses[often], kind="stable")[: CACHED_WORDS // 2]])
        stays = np.zeros(len(self), bool)
        stays[kept] = True
        words = list(compress(self, stays.tolist()))
        counts = self.counts[kept]
        ends = np.cumsum(counts)
        self.used = int(counts.sum())
        self.pool = self.pool[np.repeat(self.starts[kept] - ends + counts, counts) + np.arange(self.used)]
        self.starts, self.counts, self.uses = ends - counts, counts, uses[kept] // 2
        self.clear()
        self.update(zip(words, range(len(words))))

    def __missing__(self, piece: str) -> int:
        if piece.isascii() and piece.isprintable():
            ids = [t.id for t in self.model.tokenize(piece)]
        elif max(piece) < _PLAIN_END:
            ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in piece.encode()]))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        self.fresh[0].extend(ids)
        self.fresh[1].append(len(ids))
        row = self[piece] = len(self)
        return row

    def _store_fresh(self) -> None:
        ids, counts = self.fresh
        if not counts:
            return
        to, used = len(self), self.used + len(ids)
        if to > len(self.starts):
            more = np.zeros(to // 2 + (1 << 14), np.int64)
            self.starts, self.counts, self.uses = (np.concatenate([x, more]) for x in (self.starts, self.counts, self.uses))
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(used // 2 + (1 << 16), np.uint32)])
        self.pool[self.used : used] = ids
        self.counts[to - len(counts) : to] = counts
        self.starts[to - len(counts) : to] = self.used + np.cumsum(counts) - counts
        self.used, self.fresh = used, ([], [])

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or max(text) < _PLAIN_END:
            return _PRE_TOKENS(text.lower())
        pieces = []
        for word in text.split():
            if word.isascii() or max(word) < _PLAIN_END:
                pieces += _PRE_TOKENS(word.lower())
            else:
                pieces.append(word)
        return pieces

    def ids(self, text: str) -> np.ndarray:
        """The text's ids as unsigned 32-bit numbers."""
        if any(c in text for c in _UNUSUAL) or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self) > CACHED_WORDS:
            self._trim()
        pieces = self._pieces(text)
        if not pieces:
            return np.zeros(0, np.uint32)
        rows = np.fromiter(map(partial(dict.__getitem__, self), pieces), np.int64, len(pieces))
        self._store_fresh()
        self.uses[rows] += 1
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.starts[rows] - ends + counts, counts) + np.arange(ends[-1])]


def word_ids(path: str) -> WordIds:
    """This process's cache for the vocabulary at ``path``."""
    state = sys.modules.setdefault(_STATE, types.ModuleType(_STATE)).__dict__
    if path not in state:
        state[path] = WordIds(path)
    return state[path]
