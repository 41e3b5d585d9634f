"""Edit-aware token counts: a segment tree of pre-tokens per document.

Byte-level vocabularies merge inside pre-tokens only, so a text's count is the sum over its pre-tokens. A document's tree
has blocks of consecutive pre-tokens as leaves, with characters and tokens of each, and their sums above. An edit descends
to the block it touches, encodes from a little before the edit until pre-token borders fall in with the old ones again,
and updates sums on the way to the root; the rest of the document is neither encoded nor read.

All trees of a partition are built and edited where the documents are; nothing is shuffled.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

BLOCK = 64  # pre-tokens of a leaf
LOOK_AHEAD = 3  # code points past its end that can decide a pre-token: the rest of a contraction
CACHED_PIECES = 1_000_000
_STATE = "_spanferry_piece_counts"


class PieceCounts(dict):
    """Tokens of each pre-token; encoded when first asked for."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        super().__init__()
        with open(path, "rb") as held:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held)}
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)


def piece_counts(path: str) -> PieceCounts:
    """This process's cache for the ranks at ``path``; it outlives a task in a reused worker and is bounded."""
    state = sys.modules.setdefault(_STATE, types.ModuleType(_STATE)).__dict__
    held = state.get(path)
    if held is None or len(held) > CACHED_PIECES:
        held = state[path] = PieceCounts(path)
    return held


class TokenTree:
    """Sums of characters and tokens over blocks of pre-tokens; node 1 is the root, leaf ``i`` is node ``size + i``.

    Only sums are kept. The borders of pre-tokens inside a block come from its text when an edit asks for them.
    """

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        self.chars, self.tokens = ([0] * self.size + x + [0] * (self.size - len(x)) for x in (chars, tokens))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def of(cls, text: str, counts: PieceCounts) -> TokenTree:
        pieces = counts.pieces(text)
        tokens = list(map(counts.__getitem__, pieces))
        cuts = range(0, len(pieces), BLOCK)
        return cls([sum(map(len, pieces[a : a + BLOCK])) for a in cuts], [sum(tokens[a : a + BLOCK]) for a in cuts])

    @property
    def count(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one that holds any, past the end) and where it begins."""
        node, begin = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while node < self.size:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def replace(self, first: int, last: int, pieces: list[tuple[int, int]]) -> None:
        """Put ``pieces`` (characters, tokens of each) in the place of leaves ``first`` to ``last``.

        They are spread over those leaves and only the sums above them change; more than a few blocks a leaf would
        hold make the tree be laid out anew, from sums alone.
        """
        share = max(-(-len(pieces) // (last - first + 1)), 1)
        if share > 4 * BLOCK:
            cut = [pieces[a : a + BLOCK] for a in range(0, len(pieces), BLOCK)]
            chars, tokens = ([sum(p[i] for p in c) for c in cut] for i in (0, 1))
            head, tail = slice(self.size, self.size + first), slice(self.size + last + 1, None)
            self.__init__(self.chars[head] + chars + self.chars[tail], self.tokens[head] + tokens + self.tokens[tail])
            return
        nodes = set()
        for k, leaf in enumerate(range(first, last + 1)):
            mine = pieces[k * share : (k + 1) * share]
            self.chars[self.size + leaf] = sum(c for c, _ in mine)
            self.tokens[self.size + leaf] = sum(t for _, t in mine)
            nodes.add((self.size + leaf) // 2)
        while nodes - {0}:
            for i in nodes:
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            nodes = {i // 2 for i in nodes} - {0}

    def edit(self, text: str, at: int, removed: int, added: str, counts: PieceCounts) -> tuple[str, int]:
        """Replace ``removed`` characters of ``text`` at ``at`` by ``added``: the new text, and how many were encoded again.

        Blocks that end ``LOOK_AHEAD`` or more before the edit stay. Behind it, the first old block border at which a
        new pre-token begins ends the work: from there on both texts, and so their pre-tokens, are the same.
        """
        at = min(max(at, 0), len(text))
        removed = min(max(removed, 0), len(text) - at)
        new = text[:at] + added + text[at + removed :]
        if not text:
            self.__dict__.update(TokenTree.of(new, counts).__dict__)
            return new, len(new)
        first, begin = self.find(max(at - LOOK_AHEAD, 0))
        last, border, shift = first, begin + self.chars[self.size + first], len(added) - removed
        pieces, encoded = [], 0
        for found in counts.pattern.finditer(new, begin):
            spot = found.start()
            while border < max(spot - shift, at + removed) and border < len(text):
                last += 1
                border += self.chars[self.size + last]
            if spot >= at + len(added) and spot - shift == border:
                break
            piece = found.group()
            pieces.append((len(piece), counts[piece]))
            encoded += len(piece)
        else:
            while border < len(text):
                last += 1
                border += self.chars[self.size + last]
        self.replace(first, last, pieces)
        return new, encoded


def count_edited(
    docs: DataFrame, path: str, text: str = "text", edits: str = "edits", keep: tuple[str, ...] = ("doc_id",), trees: bool = False
) -> DataFrame:
    """Token counts before and after edits: ``keep``, ``n_tokens``, ``edited_tokens``, ``edited_chars``, ``encoded_chars``.

    ``edits`` is an ``array<struct<at int, removed int, added string>>`` applied in order, places in code points of the
    text as it then is; places outside are moved inside. ``edited_tokens`` is the count of the edited text, of which only
    ``encoded_chars`` were encoded after the first count. With ``trees`` also ``tree``: token sums by node, root at 1.
    Null texts count as empty, null edits as none; repeated rows each have a row; an empty table gives none.
    """
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    fields += [T.StructField(c, T.LongType()) for c in ("n_tokens", "edited_tokens", "edited_chars", "encoded_chars")]
    if trees:
        fields.append(T.StructField("tree", T.ArrayType(T.LongType(), False)))
    names = [f.name for f in fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = piece_counts(path)
            rows: list[list[int]] = []
            sums = []
            for value, changes in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                now = value.as_py() or ""
                tree = TokenTree.of(now, counts)
                before, encoded = tree.count, 0
                for change in changes.as_py() or []:
                    now, n = tree.edit(now, change["at"] or 0, change["removed"] or 0, change["added"] or "", counts)
                    encoded += n
                rows.append([before, tree.count, len(now), encoded])
                sums.append(tree.tokens if trees else None)
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(x, pa.int64()) for x in np.array(rows, np.int64).reshape(-1, 4).T]
            if trees:
                columns.append(pa.array(sums, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*keep, F.col(text), F.col(edits)).mapInArrow(count, T.StructType(fields))
