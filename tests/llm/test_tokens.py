"""Operators 1, 3 and 10 against the public libraries and plain round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from trellis.llm import bpe, eliasfano, packing

MULTI, BYTE, WORD = (P.path(f) for f in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "\n\n", "Hello, world.", "  two  spaces\t\ttabs \n", "it's don't we'll I'D", "Straße İstanbul ΣΟΦΟΣ ﬁ",
    "é combining ̇", "日本語 テキスト 123 4567", "👩‍👩‍👧 emoji <|endoftext|> </w>", "a" * 5000, "word " * 3000, "x y　z\x1c\x85q",
    "erhahendatat onble.\nErthly wh&&& 'so' ... (x)", "Hello, world.", "ǅ ŉ ß ſ K Å", "end ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "a", "b", "a"][i % 4], "clash", 1) for i, t in enumerate(TEXTS)]
    extra = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()
    rows += [(1000 + r.doc_id, r.text, r.source, "x", 2) for r in extra] + [rows[4], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, n int").repartition(3)


def test_transducer_equals_tiktoken_pieces():
    ranks = bpe.read_ranks(MULTI)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, rng, tokens = bpe.Transducer(bpe.Merges(ranks), max_states=500), random.Random(5), list(ranks)
    for k in range(3000):
        piece = [
            bytes(rng.choice(b"aeionrst ") for _ in range(rng.randint(1, 40))),
            rng.randbytes(rng.randint(1, 20)),
            b"".join(rng.choice(tokens) for _ in range(4)),
        ][k % 3]
        expected = tuple(own._core_bpe.encode_single_piece(piece))
        assert machine.encode(piece) == expected
        if piece not in ranks:
            assert tuple(machine.stream(iter(piece))) == expected


def test_decoder_follows_the_standard_on_any_split():
    rng = random.Random(3)
    for _ in range(500):
        data = rng.randbytes(12) + "é日👧".encode() + rng.randbytes(3)
        decoder = bpe.StreamingDecoder({i: bytes((i,)) for i in range(256)})
        cut = rng.randint(0, len(data))
        assert decoder.feed(list(data[:cut])) + decoder.feed(list(data[cut:])) + decoder.finish() == data.decode("utf-8", "replace")


def test_op1_round_trip(docs):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    expected = []
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, MULTI, P.PATTERN).collect())) == sorted(expected)
    texts = bpe.decode(bpe.encode(docs, MULTI, P.PATTERN), MULTI, P.PATTERN)
    assert sorted(map(tuple, texts.collect())) == sorted((r.doc_id, r.text or "") for r in docs.collect())


def test_elias_fano_select():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 10**9), (1000, 3), (5000, 10**7), (300, 1 << 50)):
        x = np.sort(rng.integers(0, top, n))
        coded = eliasfano.EliasFano.of(x)
        again, at = eliasfano.EliasFano.read(memoryview(coded.to_bytes()), 0)
        assert at == len(coded.to_bytes()) and again.all().tolist() == x.tolist()
        assert [again[i] for i in range(n)] == x.tolist()
        if n == 5000:
            assert len(coded.to_bytes()) * 8 < n * (2 + np.log2(top / n) + 2)


def test_byte_level_merges_equal_the_library():
    from trellis.llm.vocab import ByteLevelEncoder, _byte_chars

    coder, library, rng = ByteLevelEncoder(BYTE), Tokenizer.from_file(BYTE), random.Random(9)
    for k in range(20_000):
        piece = "".join(rng.choice("etaoinsrhldcuéß日 ABC'.,0 ") for _ in range(rng.randint(1, 30)))
        expected = library.encode(piece, add_special_tokens=False).ids
        assert coder.encode(piece) == np.array(expected, "<u2").tobytes(), piece
    for text in (" " * 300_000 + "a", "\n \n" * 100_000, "a" * 300_000, "!?" * 100_000, "1" * 300_000):
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert len(_byte_chars()) == 256


def test_word_chunks_equal_the_library():
    from trellis.llm.vocab import WordEncoder

    coder, library, rng = WordEncoder(WORD), Tokenizer.from_file(WORD), random.Random(4)
    alphabet = "etaoinsr'tsdlmEé\u0301ßÿ日0129.,;:!?()-_&\x00\x1c\x7f\x85\u00a0\t\n   "
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), repr(text)


def test_op10_round_trip(docs, spark):
    coder, start, expected = Tokenizer.from_file(BYTE), 0, []
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    for r in rows:
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, eliasfano.round_trip(docs, BYTE, 0).collect())) == sorted(expected)
    assert eliasfano.round_trip(docs.limit(0), BYTE, 0).collect() == []
    hot = spark.createDataFrame([(5, "same text")] * 400 + [(i, f"t {i}") for i in range(20)], "doc_id long, text string").repartition(3)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in eliasfano.round_trip(hot, BYTE, 0).collect())
    assert [d for _, d, _, _ in found] == [*range(5), *[5] * 401, *range(6, 20)] and [a + n for a, _, n, _ in found][:-1] == [a for a, *_ in found][1:]
    nulls = spark.createDataFrame([(None, "b"), (3, "a"), (-2, None)], "doc_id long, text string")
    assert sorted((r.start, r.doc_id) for r in eliasfano.round_trip(nulls, BYTE, 0).collect()) == [(0, None), (2, -2), (3, 3)]


@pytest.mark.parametrize("targets", [None, {"a": 5, "b": 1}])
def test_op3_packs_every_id_once(docs, targets):
    coder = Tokenizer.from_file(WORD)
    whole = defaultdict(list)
    for r in docs.collect():
        whole[r.doc_id].append([*coder.encode(r.text or "", add_special_tokens=False).ids, 2])
    pieces = packing.pack(docs, WORD, 2, targets, with_ids=True, window_sequences=2).collect()
    line = sorted((p.sequence_id * 4096 + p.offset, p.length) for p in pieces)
    total = sum(len(x) for v in whole.values() for x in v)
    assert [a for a, _ in line] == np.cumsum([0, *(n for _, n in line[:-1])]).tolist() and sum(n for _, n in line) == total
    assert all(p.offset + p.length <= 4096 for p in pieces)
    got = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        got[p.doc_id] += [p]
    for d, parts in whole.items():
        spans = Ids = [(p.start, p.length, tuple(p.ids)) for p in got[d]]
        expected = sorted(tuple(x[s : s + n]) for x in {tuple(y) for y in parts} for s, n, _ in Ids)
        assert {i for _, _, i in spans} <= set(expected) and sum(n for _, n, _ in spans) == sum(map(len, parts))


def test_schedule_fills_windows_to_targets():
    rng = random.Random(1)
    plan = packing.Schedule([1000, 5000, 10], [1, 4, 2], 70)
    parts = [[plan.served(q, r + 1) - plan.served(q, r) for q in range(3)] for r in range(86)]
    assert parts[0] == [12, 48, 10] and all(abs(a - 14) <= 1 and abs(b - 56) <= 1 and c == 0 for a, b, c in parts[1:70])
    for _ in range(30):  # against a plain loop that serves unit credits
        lengths, weights = [rng.randint(1, 3000) for _ in range(rng.randint(1, 9))], [rng.randint(1, 50) for _ in range(9)]
        plan = packing.Schedule(lengths, weights[: len(lengths)], 97)
        served, r = [0] * len(lengths), 0
        while served != lengths:
            new = [plan.served(q, r + 1) for q in range(len(lengths))]
            gave = [b - a for a, b in zip(served, new, strict=True)]
            left = [q for q in range(len(lengths)) if new[q] < lengths[q]]
            assert abs(sum(new) - min((r + 1) * 97, sum(lengths))) <= len(lengths)  # every window is full, but for what is carried
            for q in left:  # those that remain are served in proportion, deficits carried
                for p in left:
                    assert abs(new[q] / weights[q] - new[p] / weights[p]) <= 1 / weights[q] + 1 / weights[p] + 1e-6
            assert all(g >= 0 for g in gave)
            served, r = new, r + 1
        seen = sorted((place, end - start) for q, n in enumerate(plan.lengths) for start, end, place in plan.runs(q, 0, n))
        assert [p for p, _ in seen] == np.cumsum([0, *(n for _, n in seen[:-1])]).tolist() and sum(n for _, n in seen) == sum(lengths)


@pytest.mark.parametrize("targets", [None, {"s7": 50, "s8": 3, "": 4}])
def test_op3_keeps_a_queue_for_each_of_many_sources(spark, monkeypatch, targets):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randint(0, 900), f"s{rng.randint(0, 30)}" if i % 9 else None) for i in range(200)]
    docs = spark.createDataFrame([*rows, (3, None, ""), (3, "one", "s7")], "doc_id long, text string, source string").repartition(3)
    pack = lambda: sorted(map(tuple, packing.pack(docs, WORD, 2, targets, 0.7, sequence=512, window_sequences=2).collect()), key=str)
    few = pack()
    monkeypatch.setattr(packing, "MAX_QUEUES", 8)
    monkeypatch.setattr(packing, "MAX_BROADCAST_ROWS", 8)
    assert pack() == few


def test_op3_empty(docs):
    assert packing.pack(docs.limit(0), WORD, 2).collect() == []
