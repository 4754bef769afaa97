"""Whole-text encoding with a ``tokenizers`` file, through a bounded cache of word encodings.

A text is cut only where both kinds of pre-tokenizer used here always cut: at a
single space between two characters that are not white space.  Each piece is
encoded by the tokenizer itself (once per worker while it stays in the cache),
so the ids equal those of encoding the whole text.

Arrow kernels cut and number the words of a slice of texts, every distinct word
is looked up once, and one gather puts the ids of all texts together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import shingles

CACHE_WORDS = 700_000
#: Text bytes encoded at a time (at least one text).
SLICE_BYTES = 4 << 20
#: New words encoded together, with a mark between them that is a token of its own.
TOGETHER = 48
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: First bytes of white space (and of some other characters, told apart by a look at the character).
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class _Table:
    """Ids of known words, one after another; word 0 is the mark at the end of a text (no ids when there is none)."""

    def __init__(self, end_id: int | None):
        self.number: dict[str, int] = {}
        self.flat, self.begin, self.size = (np.zeros(1 << 10, k) for k in ("<u4", np.int64, np.int64))
        self.words, self.used = 1, 0
        if end_id is not None:
            self.flat[0], self.size[0], self.used = end_id, 1, 1

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(words, range(self.words, self.words + len(words))))
        n, m = self.words + len(words), self.used + len(ids)
        self.flat, self.begin, self.size = self._room(self.flat, m), self._room(self.begin, n), self._room(self.size, n)
        self.flat[self.used:m] = ids
        self.size[self.words:n] = size
        self.begin[self.words:n] = self.used + np.cumsum(size) - size
        self.words, self.used = n, m


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``flat[begin:begin + size]``, one after another."""
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(begin - end + size, size)]


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, each text followed by ``end_id``.

    ``spaced``: the space before a word belongs to its encoding (byte-level
    BPE); otherwise white space is dropped by the tokenizer.
    """

    def __init__(self, path: str, end_id: int | None = None, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = self.tokenizer.encode("a b", add_special_tokens=False).ids != (
            self.tokenizer.encode("a", add_special_tokens=False).ids + self.tokenizer.encode("b", add_special_tokens=False).ids)
        self.mark = "\n" if self.spaced else "\x1f"
        ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else None
        self.before = " " if self.spaced else ""
        self.rest, self.head = _Table(end_id), _Table(end_id)
        self.most = cache_words

    def _each(self, words: list[str], before: str) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([before + w for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in got]

    def _fresh(self, words: list[str], before: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """New words (in another order), all their ids and how many each has.

        Many words go into one call, cut at the mark (white space or a control character, which neither merges with its
        neighbours nor occurs in these words).
        """
        plain = [] if self.mark_id is None or self.spaced and not before else [
            w for w in words if w and self.mark not in w and "<|" not in w]
        order = words if not plain else [w for w in words if not w or self.mark in w or "<|" in w]
        ids = self._each(order, before)
        size = [len(x) for x in ids]
        between = self.mark + before if self.spaced else f" {self.mark} "
        groups = [plain[a:a + TOGETHER] for a in range(0, len(plain), TOGETHER)]
        got = self.tokenizer.encode_batch_fast([before + between.join(g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, got):
            x = np.array(e.ids, "<u4")
            cut = np.flatnonzero(x == self.mark_id)
            if len(cut) == len(g) - 1:
                ids.append(np.delete(x, cut))
                size += (np.diff(np.concatenate([[-1], cut, [len(x)]])) - 1).tolist()
            else:
                one = self._each(g, before)
                ids += one
                size += [len(y) for y in one]
        return order + plain, np.concatenate([np.zeros(0, "<u4"), *ids]), np.array(size, np.int64)

    def _known(self, table: _Table, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of ``words`` (all different) begin, how many they are, and the row of ids they lie in.

        New words stay in the cache while there is room (frequent words come early).
        """
        find = table.number.get
        at = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return table.begin[at], table.size[at], table.flat
        names, ids, size = self._fresh([words[i] for i in new], before)
        keep = min(max(self.most - table.words, 0), len(names))
        place = {w: i for i, w in enumerate(names)}
        mine = np.fromiter((place[words[i]] for i in new), np.int64, len(new))
        begin, many = table.begin[at], table.size[at]
        begin[new], many[new] = table.used + (np.cumsum(size) - size)[mine], size[mine]
        cut = int(size[:keep].sum())
        table.add(names[:keep], ids[:cut], size[:keep])
        return begin, many, np.concatenate([table.flat[:table.used], ids[cut:]])

    def _joined(self, words: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as words, and where each text begins (+ total); ``first``: first word of each text (+ total)."""
        coded = words.dictionary_encode()
        begin, size, flat = self._known(self.rest, coded.dictionary.to_pylist(), self.before)
        code = coded.indices.to_numpy()
        begin, size = begin[code], size[code]
        if self.spaced:  # nothing stands before a text's first word
            heads = words.take(pa.array(first[:-1])).dictionary_encode()
            b, n, other = self._known(self.head, heads.dictionary.to_pylist(), "")
            own = heads.indices.to_numpy()
            begin[first[:-1]], size[first[:-1]] = b[own] + len(flat), n[own]
            flat = np.concatenate([flat, other])
        begin, size = np.insert(begin, first[1:], self.rest.begin[0]), np.insert(size, first[1:], self.rest.size[0])
        ends = np.concatenate([[0], np.cumsum(size)])
        return _gather(flat, begin, size), ends[first + np.arange(len(first))]

    @staticmethod
    def _odd(words: pa.Array) -> np.ndarray:
        """Which words are empty or begin or end with white space."""
        raw, offsets = shingles.text_buffers(words)
        a, b = offsets[:-1], offsets[1:]
        blank = a == b
        some = np.flatnonzero(~blank)
        tail = raw[b[some] - 1]
        maybe = some[_MAYBE_SPACE[raw[a[some]]] | _MAYBE_SPACE[tail] | (tail >= 128)]
        for i, w in zip(maybe.tolist(), words.take(pa.array(maybe)).to_pylist()):
            blank[i] = w[0].isspace() or w[-1].isspace()
        return blank

    def encode(self, col: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a string column (NULL counts as empty)."""
        col = pc.fill_null(col.cast(pa.large_string()), "")
        parts = pc.split_pattern(col, " ")
        words, first = parts.flatten(), parts.offsets.to_numpy()
        first = first - first[0]
        coded = words.dictionary_encode()
        bad = np.add.reduceat(self._odd(coded.dictionary)[coded.indices.to_numpy()], first[:-1], dtype=np.int64) > 0 \
            if len(col) else np.zeros(0, bool)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(col)
        for rows in (np.flatnonzero(~bad), np.flatnonzero(bad)):
            if not len(rows):
                continue
            if bad[rows[0]]:  # more than single spaces between words: cut only at the safe places
                cut = [_CUT.split(t) for t in col.take(pa.array(rows)).to_pylist()]
                own = pa.array([w for c in cut for w in c], pa.large_string())
                start = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
            elif len(rows) == len(col):
                own, start = words, first
            else:
                own = parts.take(pa.array(rows)).flatten()
                start = np.concatenate([[0], np.cumsum(np.diff(first)[rows])])
            ids, begin = self._joined(own, start)
            for i, a, b in zip(rows.tolist(), begin[:-1].tolist(), begin[1:].tolist()):
                out[i] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None = None) -> WordEncoder:
    """One encoder per worker process, file and end id."""
    return WordEncoder(path, end_id)


def encoded(path: str, col: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ids of every text) for slices of a text column."""
    enc = encoder(path, end_id)
    for a, b in shingles.slices(shingles.text_buffers(col)[1], SLICE_BYTES):
        yield a, enc.encode(col.slice(a, b - a))
