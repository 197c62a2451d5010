import base64
import hashlib
import random
import struct
import zlib
from itertools import count

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from loomql.llm import byte_bpe, packing

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, id string, length int, rank string"
TEXTS = [None, "", " ", "Hello world", "it's  1234\n\n x", "é漢字 \x1c\x85 ǅ Σίσυφος İstanbul", "<|endoftext|> end", "a" * 20_000, " " * 30_000 + "x", "one two " * 9000, "😀👍🏽 ok"]


def test_byte_bpe_parts(monkeypatch):
    rng = random.Random(1)
    enc = byte_bpe.encoding(RANKS)
    monkeypatch.setattr(byte_bpe, "PART", 7)
    monkeypatch.setattr(byte_bpe, "LONG_BLANK", 0)
    monkeypatch.setattr(byte_bpe, "BLANKS", byte_bpe.re.compile(f"[{byte_bpe.WHITE}]{{3,}}"))
    monkeypatch.setattr(byte_bpe.parts, "__defaults__", (7,))
    letters = [" ", "\n", "a", "b", "é", "1", "'s", "!", "\t", "   ", "漢", "\x1c", "\x85", "\xa0", "​", "'"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        got = byte_bpe.encode(RANKS, text)
        assert got == enc.encode_ordinary(text) and byte_bpe.decode(RANKS, got) == text.encode()


def merges(text):
    """The ids of one piece by the definition: the pair of least rank merges, the first of them first, until none is left."""
    ranks = dict(zip((base64.b64decode(line.split()[0]) for line in open(RANKS, "rb")), count()))
    parts = [bytes([b]) for b in text.encode()]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_merges_by_definition():
    enc = byte_bpe.encoding(RANKS, byte_bpe.WHOLE)
    for text in ("internationalisation", "   \n\n  \t ", "aaaaaaaaaaaaaaa", "\n" * 40, " " * 500):
        assert merges(text) == enc.encode_ordinary(text)


def test_byte_bpe(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(3, "twice", "x", 1, "y"), (3, "twice", "x", 1, "y"), (None, "no id", "x", 1, "y")]
    enc = byte_bpe.encoding(RANKS)
    got = byte_bpe.encode_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for i, t, *_ in rows:
        # The library runs out of stack on so long a blank: there its last character goes with the word, and the others are one piece.
        ids = enc.encode_ordinary(t or "") if not (t or "").startswith(" " * 20_000) else merges(" " * 29_999) + enc.encode_ordinary(" x")
        want.append((i, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_bpe.encode_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_character_of_the_fast_path():
    tok = Tokenizer.from_file(WORDS)
    words = packing.Words(packing.tokenizer(WORDS))
    for s in ("hello <|endoftext|> there", "<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|", "x<|endoftext|><|startoftext|>y é"):
        assert packing.encode(words, s).tolist() == tok.encode(s, add_special_tokens=False).ids, s
    for c in range(0x180):
        for s in (chr(c), f"a{chr(c)}b", f"1{chr(c)}!", chr(c) * 3, f" {chr(c)}'s", f"{chr(c)}é"):
            assert packing.encode(words, s).tolist() == tok.encode(s, add_special_tokens=False).ids, (c, s)
    rng = random.Random(3)
    for _ in range(4000):
        s = "".join(chr(rng.randrange(0x180)) if rng.random() < 0.3 else rng.choice("'stvdml  eE1") for _ in range(rng.randint(0, 25)))
        assert packing.encode(words, s).tolist() == tok.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [16, 4096])
def test_packing(spark, size):
    rng = random.Random(size)
    texts = TEXTS + ["w " * rng.randint(0, 60) for _ in range(300)] + ["same words here"] * 200
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    tok = Tokenizer.from_file(WORDS)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    got = packing.packed_documents(spark.createDataFrame(rows, SCHEMA), size=size, ids=True).collect()
    seen, places = {i: [] for i in ids}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(seen[r.doc_id]) and r.length == len(r.ids) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        seen[r.doc_id] += r.ids
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == ids
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= size
    total = sum(map(len, ids.values()))
    assert len(places) <= -(-total // size) * 1.05 + 1


def test_patterns():
    rng = random.Random(0)
    for _ in range(200):
        size = rng.choice([1, 7, 64])
        counts = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(1, 20))}
        found = packing.patterns(counts, size)
        back = {}
        for content, n in found:
            assert sum(length * times for length, times in content) <= size and n > 0
            for length, times in content:
                back[length] = back.get(length, 0) + times * n
        assert back == counts and len(found) <= 2 * len(counts) + 1
    assert packing.patterns({}, 64) == []


def test_repeats_and_no_rows(spark):
    rows = [(1, "a b", "x", 1, "y")] * 3 + [(None, "a b", "x", 1, "y")] * 2
    got = packing.packed_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and len({(r.sequence_id, r.offset) for r in got}) == 5
    assert packing.packed_documents(spark.createDataFrame([], SCHEMA)).collect() == []
