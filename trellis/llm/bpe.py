"""Operator 1: byte-level BPE encoding and decoding by finite-state machines.

Encoding.  A token sequence is the BPE encoding of a byte string exactly if each
adjacent pair of its tokens is (the boundary between them survives all merges).
So the prefixes of a string have one encoding each, and the last tokens of the
prefixes are found left to right by a non-deterministic transducer whose states
are (bytes since a boundary, token before the boundary).  ``Transducer``
determinises it lazily: a state is the ordered set of live hypotheses, each with
the tokens that it has not emitted yet; a transition emits the longest common
prefix of these, so output lags the input by no more than the bytes in which
all but one hypothesis die.  States and transitions are kept in a bounded cache.

Decoding.  ``StreamingDecoder`` joins token bytes with an incremental UTF-8 state
machine: bytes of a character may come from several tokens and several calls.

Defined results: a null or empty text has no tokens and decodes to nothing; rows
repeat as they come; columns of the input other than the two named don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trellis.llm.chunks import PatternEncoder
from trellis.llm.scratch import tuned

#: Determinised states that are kept before the cache is emptied.
MAX_STATES = 300_000
_INFINITY = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """What the ranks say of pairs of tokens, and a trie of the tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._spines: tuple[dict, dict] = {}, {}
        #: By node << 8 | byte; node 0 is the root.
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = i

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The pair whose merge makes the token; None if merges never make it."""
        if token not in self._halves:
            parts = merged(token, self.ranks, below=self.ranks[token])
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: bytes) -> bool:
        return len(token) == 1 or self.halves(token) is not None

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at one edge of the token while it is made, latest first: part, from when, until when."""
        known = self._spines[side]
        if token not in known:
            out, until, part = [], _INFINITY, token
            while True:
                split = self.halves(part) if len(part) > 1 else None
                out.append((part, self.ranks[part] if split else -1, until))
                if split is None:
                    break
                part, until = split[side], self.ranks[part]
            known[token] = out
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the boundary between tokens a and b survives; a is -1 at the start."""
        after = self.tokens[b]
        return self.reachable(after) and (a < 0 or self._survives(self.tokens[a], after))

    def _survives(self, a: bytes, b: bytes) -> bool:
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, x_from, x_until), (y, y_from, y_until) = left[i], right[j]
            rank = self.ranks.get(x + y)
            # of equal ranks the leftmost merges first
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_from > y_from:
                i += 1
            elif y_from > -1:
                j += 1
            else:
                return True


def merged(data: bytes, ranks: dict[bytes, int], below: int = _INFINITY) -> list[bytes]:
    """Plain BPE: merge the pair of the lowest rank, leftmost first, while it is under ``below``."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], _INFINITY), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Bytes in, token ids out; see the module's text.

    A hypothesis is (node of the trie that the bytes since the boundary reach,
    token before the boundary, ids held back); the last one of a state stands at
    its boundary, so its ids complete the output at the end.
    """

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self._merges, self._max, self._fits = merges, max_states, {}
        self._reset()

    def _reset(self) -> None:
        self._states: dict[tuple, dict] = {}
        self._fits.clear()
        self._start = self._row(((0, -1, ()),))

    def _row(self, live: tuple) -> dict:
        """Transitions of a state by byte: (row of the next state, emitted ids); at -1 the hypotheses."""
        row = self._states.get(live)
        if row is None:
            row = self._states[live] = {-1: live}
        return row

    def _determinise(self, row: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        merges, fits = self._merges, self._fits
        child, token_at, inner = merges.child, merges.token_at, merges.inner
        live, boundary, emptied = [], None, False
        for node, before, held in row[-1]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                live.append((node, before, held))
                emptied = emptied or not held
            if boundary is None and (token := token_at[node]) >= 0:
                pair = (before, token)
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = merges.fits(before, token)
                if fit:
                    boundary = (0, token, (*held, token))
        live.append(boundary)
        emitted = ()
        if not emptied:
            common, first = 0, live[0][2]
            least = min(len(h) for _, _, h in live)
            while common < least and all(h[common] == first[common] for _, _, h in live):
                common += 1
            if common:
                emitted = first[:common]
                live = [(node, before, held[common:]) for node, before, held in live]
        move = row[byte] = self._row(tuple(live)), emitted
        return move

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Emit ids while bytes arrive, then what is held at the end."""
        row = self._start
        for byte in data:
            row, ids = row.get(byte) or self._determinise(row, byte)
            yield from ids
        yield from row[-1][-1][2]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        known = self._merges.ranks.get(piece)
        if known is not None:
            return (known,)
        if len(self._states) > self._max:
            self._reset()
        row, out = self._start, []
        for byte in piece:
            move = row.get(byte) or self._determinise(row, byte)
            row = move[0]
            if move[1]:
                out += move[1]
        out += row[-1][-1][2]
        return tuple(out)


class StreamingDecoder:
    """Text of a stream of ids; an ill-formed sequence becomes U+FFFD."""

    def __init__(self, vocabulary: dict[int, bytes]):
        self._bytes = vocabulary
        self._texts = [None] * (max(vocabulary, default=-1) + 1)
        for i, token in vocabulary.items():
            try:
                self._texts[i] = token.decode("utf-8")
            except UnicodeDecodeError:
                pass
        self.reset()

    def reset(self) -> None:
        self._open, self._need, self._low, self._high = bytearray(), 0, 0x80, 0xBF

    def _byte(self, b: int) -> str:
        """One step of the state machine: continuation bytes still needed and the range of the next."""
        if self._need:
            if self._low <= b <= self._high:
                self._open.append(b)
                self._need, self._low, self._high = self._need - 1, 0x80, 0xBF
                if self._need:
                    return ""
                text = self._open.decode("utf-8")
                self._open.clear()
                return text
            self.reset()
            return "�" + self._byte(b)
        if b < 0x80:
            return chr(b)
        if 0xC2 <= b <= 0xDF:
            self._need = 1
        elif 0xE0 <= b <= 0xEF:
            self._need, self._low, self._high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            self._need, self._low, self._high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        else:
            return "�"
        self._open.append(b)
        return ""

    def feed(self, ids: list[int]) -> str:
        """Text that is complete after these ids."""
        texts = self._texts
        parts = list(map(texts.__getitem__, ids))
        if self._need or None in parts:
            for k, part in enumerate(parts):
                if part is None or self._need:
                    parts[k] = "".join(map(self._byte, self._bytes[ids[k]]))
        return "".join(parts)

    def finish(self) -> str:
        rest = "�" if self._need else ""
        self.reset()
        return rest


class Codec:
    """Encoder and decoder of one vocabulary, made once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        machine = Transducer(Merges(ranks))
        self._encoder = PatternEncoder(pattern, lambda piece: machine.encode(piece.encode("utf-8")))
        self._decoder = StreamingDecoder({i: t for t, i in ranks.items()})

    def encode(self, text: str) -> list[int]:
        return [i for part in self._encoder.parts(text) for i in part]

    def decode(self, ids: list[int]) -> str:
        self._decoder.reset()
        return self._decoder.feed(ids) + self._decoder.finish()


_codecs: dict[tuple, Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    """``ranks`` is a broadcast vocabulary: its size is that of the file, whatever the input's."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of each row's whole text."""
    spark = tuned(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text string) of each row's ids; null ids give an empty text."""
    spark = tuned(tokens.sparkSession)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id_col, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Ids stay in the worker, so only digests leave it; no shuffle.
    """
    spark = tuned(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = _codec(ranks, pattern)
        decimal = list(map(str, range(max(ranks.value.values()) + 1)))
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
