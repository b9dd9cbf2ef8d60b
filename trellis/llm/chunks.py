"""Tokenisation memoised on space-delimited chunks.

A tokenizer that splits a text by a pattern and encodes each match separately
gives the same ids if the text is first cut before any single space that has a
non-space character on both sides: no match of the pattern crosses such a cut.
Most chunks repeat, so a bounded dictionary replaces most of the work.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Entries of a worker's memo, which keeps twice as many: memory is bounded.
MEMO_CHUNKS = 400_000
MEMO_PIECES = 200_000
#: Longer keys are not kept.
MEMO_LENGTH = 64


class _Awkward(Exception):
    """The chunk touches other white space, so it is no safe cut."""


class _Memo(dict):
    """Values by key, made when missing.  A full memo becomes the old one, and what is asked for again is taken over."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) > MEMO_LENGTH:
            return value
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class PatternEncoder:
    """Ids of a text, given the ids of each match of ``pattern``.

    The pattern must take a run of letters, with the space before it, as one
    match, and a mark of ``MARKS`` after it as another: such chunks skip the
    pattern.
    """

    MARKS = frozenset(".,;:!?")

    def __init__(self, pattern: str, encode_piece: Callable[[str], tuple], pack: Callable = tuple):
        self._find = regex.compile(pattern).findall
        self._pieces = _Memo(encode_piece, MEMO_PIECES)
        self._pack, self._encode_piece = pack, encode_piece
        self._marks = {m: pack(encode_piece(m)) for m in self.MARKS}
        self._chunks = _Memo(self._chunk, MEMO_CHUNKS)

    def _whole(self, text: str):
        pieces = self._pieces
        return self._pack([i for m in self._find(text) for i in pieces[m]])

    def _chunk(self, chunk: str):
        if chunk.isalpha():
            return self._pack(self._encode_piece(" " + chunk))
        if chunk[-1:] in self.MARKS and chunk[:-1].isalpha():
            return self._chunks[chunk[:-1]] + self._marks[chunk[-1]]
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Awkward
        return self._whole(" " + chunk)

    def parts(self, text: str) -> list:
        """Packed ids of consecutive parts of the text."""
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return [self._whole(text)]
        try:
            return [self._whole(head), *map(self._chunks.__getitem__, rest)]
        except _Awkward:
            return [self._whole(text)]
