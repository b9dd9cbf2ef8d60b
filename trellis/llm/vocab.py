"""Encoders over files of the tokenizers library, with memoised pieces."""

from __future__ import annotations

import json
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

from trellis.llm.chunks import MEMO_CHUNKS, MEMO_PIECES, PatternEncoder, _Memo

#: Pattern of the library's byte-level pre-tokenizer (fixed value of the format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


def _bytes_of(ids) -> bytes:
    return array("H", ids).tobytes()


class _Whole:
    """The whole tokenizer, for texts that hold one of its added tokens: those are cut out before all else."""

    def __init__(self, path: str):
        self._whole = Tokenizer.from_file(path)
        self._added = tuple(t.content for t in self._whole.get_added_tokens_decoder().values())
        if any(t.normalized for t in self._whole.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has added tokens of normalised text")

    def _library(self, text: str) -> bytes:
        return _bytes_of(self._whole.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bool:
        return not any(t in text for t in self._added)


class ByteLevelEncoder(_Whole):
    """Little-endian 16-bit ids of texts by a byte-level BPE file, as the library gives them without special tokens."""

    def __init__(self, path: str):
        super().__init__(path)
        back = {c: b for b, c in _byte_chars().items()}
        vocabulary = self._whole.get_vocab(with_added_tokens=False)
        # ids rise with the merges, so they are the ranks of a merge table; tests compare both libraries
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in self._added}
        if max(ranks.values(), default=0) >= 1 << 16:
            raise ValueError(f"{path} has ids over 16 bits")
        self._fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not self._plain(text):
            return self._library(text)
        try:
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()
        except ValueError:  # a run of white space that is too long for its pattern engine
            return self._library(text)


class WordEncoder(_Whole):
    """Little-endian 16-bit ids by a word-level BPE file that lowers case and drops white space.

    Cutting at spaces is safe as no word holds one.  ASCII chunks are cut by the
    file's pattern here, words of Latin letters, with or without a mark after them, go
    straight to the model; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__(path)
        rest, (merge, ids) = self._library, self._merges()

        def piece(text: str) -> bytes:
            pairs = (text if text.isascii() else text.encode("utf-8").decode("latin-1")).encode("utf-16-be")
            return _bytes_of([ids[r] for r in merge(pairs[:-2] + b"\1" + pairs[-1:])])

        pieces = _Memo(piece, MEMO_PIECES)
        find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+").findall

        marks = {m: rest(m) for m in PatternEncoder.MARKS}

        def chunk(text: str) -> bytes:
            plain = text.isascii()
            if text.isalpha() and (plain or max(text) <= "ÿ"):  # letters up to U+00FF are composed and lower one to one
                return piece(text.lower())
            if text[-1:] in marks and text[:-1].isalpha() and (plain or max(text) <= "ÿ"):
                return self._chunks[text[:-1]] + marks[text[-1]]
            if plain:  # printable ASCII bytes are their own symbols
                return b"".join([pieces[p] if p.isprintable() else rest(p) for p in find(text.lower())])
            return rest(text)

        self._chunks = _Memo(chunk, MEMO_CHUNKS)

    def _merges(self) -> tuple:
        """The file's merges as a rank table over pairs (0, byte), or (1, byte) at a word's end, and the id of each rank."""
        model, back = json.loads(self._whole.to_str())["model"], {c: b for b, c in _byte_chars().items()}
        suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]

        def pairs(token: str) -> bytes:
            raw = bytes(back[c] for c in token.removesuffix(suffix))
            out = bytearray(b for c in raw for b in (0, c))
            out[-2] = int(token.endswith(suffix))
            return bytes(out)

        tokens = [c + end for end in ("", suffix) for c in _byte_chars().values()]
        tokens += [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        tokens = list(dict.fromkeys(tokens))
        ranks = {pairs(t): k for k, t in enumerate(tokens)}
        table = tiktoken.Encoding("pairs", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
        return table._core_bpe.encode_single_piece, [vocabulary[t] for t in tokens]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._chunks.__getitem__, text.split(" "))) if self._plain(text) else self._library(text)


_made: dict[tuple, object] = {}


def encoder(kind: type, path: str):
    """One encoder for each file in a Python worker."""
    if (kind, path) not in _made:
        _made.clear()
        _made[kind, path] = kind(path)
    return _made[kind, path]


def release() -> None:
    """Forget the encoder: stages that encode nothing run in the same workers."""
    _made.clear()
