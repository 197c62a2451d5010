"""Packing token sequences: shortest-pack-first over the histogram of lengths.

A document's tokens are cut into pieces of at most the sequence length. The pieces' lengths
make a histogram with one count for each length, however many documents there are. Lengths are
placed longest first, each into the emptiest packs that it fits; packs with one content are
one pattern with a count, so a step moves counts and not documents. Every step splits at most
one pattern and opens at most one, so there are at most two patterns a length: that bounds
both the driver's work and the broadcast table of slots. Pieces find their slot by their rank
among the pieces of their length.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import giving_back, tasks, written

SEQUENCE, END = 4096, 2
#: Distinct words whose ids a Python worker remembers.
WORDS = 1 << 19
#: In these blocks lower-casing and composing by Python and by the tokenizer agree character by character (a test tries them all).
OUTSIDE = re.compile("[^\t-\r\x1c-įĲ-ſ]")
#: What the tokenizer's splitting pattern matches within them: fixed values of the vocabulary file.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+|_")
#: Characters that the two engines put in different classes go to the tokenizer whole.
ODD = re.compile("[\x1c-\x1f\x85\xaa\xb2\xb3\xb9\xba\xbc-\xbe_]")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker, as the file has it: strings of its added tokens in a text become their ids."""
    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones as they are, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Split word to its ids as little-endian unsigned 32-bit numbers; what is missing goes to the tokenizer's merges."""

    LETTERS = byte_letters()

    def __init__(self, tok: Tokenizer):
        self.tok, self.model = tok, tok.model
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        # Texts that hold an added token's string, in whatever case, go to the tokenizer whole.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.LETTERS)
        made = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(word) < 100:
            self[word] = made
        return made


def encode(words: Words, text: str) -> np.ndarray:
    """The ids of a text without special tokens, as the tokenizer gives them for the whole text."""
    if OUTSIDE.search(text) or ODD.search(text) or (words.added and words.added.search(text)):
        return np.array(words.tok.encode(text, add_special_tokens=False).ids, "<u4")
    found = SPLIT.findall(unicodedata.normalize("NFC", text).lower())
    return np.frombuffer(b"".join(map(words.__getitem__, found)), "<u4")


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end: int | None = END, ids: bool = False) -> DataFrame:
    """Rows of a document's pieces: id, start, length, ids_crc32, doc_tokens, text_hash, and ids if asked for.

    Pieces are full sequences from the start on, and what is left. With ``end`` None a document without tokens has no piece.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, text_crc long{', ids array<int>' if ids else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer(path if "/" in path else SparkFiles.get(path)))
        tail = np.array([] if end is None else [end], "<u4")
        for batch in batches:
            rows, own = [], []
            for i, text in enumerate(batch.column(1)):
                got = np.concatenate([encode(words, text.as_py() or ""), tail])
                whole = zlib.crc32(got)
                for at in range(0, len(got), size):
                    part = got[at : at + size]
                    rows.append((i, at, len(part), zlib.crc32(part), len(got), whole))
                    if ids:
                        own.append(part.astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            out = {"id": batch.column(0).take(pa.array(cols[0], pa.int64()))}
            out |= {n: pa.array(c, pa.int64()) for n, c in zip(("start", "length", "ids_crc32", "doc_tokens", "text_crc"), cols[1:], strict=True)}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(own, pa.list_(pa.int32()))} if ids else {}))

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(giving_back(run), schema)


def patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), count), ...]: shortest-pack-first on counts of lengths from 1 to ``size``.

    A length goes into the emptiest packs first while it fits there: as many pieces to each as the pack takes, if there are
    enough for all packs of the pattern, and one at least; then as many to an empty pack as fit, until none are left.
    """
    heap: list[tuple[int, int, tuple, int]] = []  # used, number, content, count
    done, number = [], 0
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left and heap and heap[0][0] + length <= size:
            used, _, content, count = heapq.heappop(heap)
            # As many of this length as the pack takes, if there are enough for every pack of the pattern.
            times = max(1, min((size - used) // length, left // count))
            taken = min(count, left)
            if count > taken:
                number += 1
                heapq.heappush(heap, (used, number, content, count - taken))
            grown.append((used + times * length, (*content, (length, times)), taken))
            left -= taken * times
        if left:
            most = size // length
            if left >= most:
                grown.append((most * length, ((length, most),), left // most))
            if left % most:
                grown.append((left % most * length, ((length, left % most),), 1))
        for used, content, count in grown:
            number += 1
            if used == size:
                done.append((content, count))
            else:
                heapq.heappush(heap, (used, number, content, count))
    return done + [(content, count) for _, _, content, count in heap]


def slots(found: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, sequences, offset) of each place in each pattern."""
    out, ranks, base = [], {}, 0
    for content, count in found:
        offset = 0
        for length, times in content:
            begin = ranks.get(length, 0)
            ranks[length] = begin + times * count
            out.append((length, begin, begin + times * count - 1, base, count, offset))
            offset += length * times
        base += count
    return out


def ranked(rows: DataFrame, spread: int) -> DataFrame:
    """Number the pieces of each length from 0, in ``spread`` parts by identifier, so that a common length isn't one task's."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "start"), F.lit(spread)).cast("int"))
    counts = rows.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("id", "start", "text_crc", "ids_crc32")
    return rows.withColumn("nth", F.row_number().over(within)).join(counts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("part", "nth", "before")


def pack(rows: DataFrame, size: int = SEQUENCE, spread: int = 64) -> DataFrame:
    """Give each piece its sequence_id and offset. ``rows`` has a row for each piece, as ``pieces`` makes them, written down.

    The histogram has at most ``size`` counts. Which of several equal lengths gets which slot goes by identifier; repeated rows each get a slot of their own.
    """
    spark = rows.sparkSession
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    by_length: dict[int, list] = {}
    for length, *slot in sorted(slots(patterns(histogram, size))):
        by_length.setdefault(length, []).append(tuple(slot))
    table = spark.createDataFrame(list(by_length.items()), "length long, slots array<struct<low:long,high:long,base:long,packs:long,begin:long>>")
    # The last slot that begins at or before the rank: one row a piece, however many slots its length has.
    slot = F.element_at(F.filter("slots", lambda x: x["low"] <= F.col("rank")), -1)
    here = F.col("rank") - F.col("slot.low")
    return (
        ranked(rows, spread)
        .join(F.broadcast(table), "length")  # at most two patterns for each length, whatever the input
        .withColumn("slot", slot)
        .withColumn("sequence_id", F.col("slot.base") + here % F.col("slot.packs"))
        .withColumn("offset", F.col("slot.begin") + F.floor(here / F.col("slot.packs")) * F.col("length"))
        .drop("rank", "slots", "slot")
    )


def packed_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A null or empty text has the end id alone. Rows stand alone: repeated rows and null identifiers
    are packed as often as they occur. Other columns play no part. No rows give no rows.
    """
    rows = written(pieces(docs, path, id_col, text_col, size, ids=ids), "pieces")
    return pack(rows, size, max(64, tasks(docs.sparkSession))).drop("text_crc").withColumnRenamed("id", id_col)
