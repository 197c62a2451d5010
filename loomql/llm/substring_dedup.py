"""Substring deduplication: repeats of ``WINDOW`` words, found through fixed-block anchors.

Every window holds at least one whole block of its document's grid of ``BLOCK``-word blocks. So if
a window occurs twice, the block inside the one occurs in the other, at any offset. The job:

1. Documents are gathered in batches of some megabytes, each a compressed row of a written table.
2. Each batch sends its rolling ``BLOCK``-word hashes, sorted and without repeats, dealt by hash
   range into buckets; the hashes of its grid blocks, the index, are marked. A bucket finds the
   hashes that occur more than once and answers each batch with a bit for each of its blocks.
3. Documents with such anchors go on. The hits are extended word by word: every window around
   an anchor is compared, by 128 bits of two independent hashes, with those of all documents, again by hash range. A
   bucket answers with a bit for each distinct window: whether the batch holds the earliest one.
4. Consecutive windows that aren't the earliest make up the maximal repeats; their words go.

A batch sends a hash once however often it occurs there, and no pairs of places are formed, so a
passage in a third of all documents costs no more than any other. Step 2 is a filter: its hashes
are short, and a false hit only costs work in step 3.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, giving_back, written

WINDOW, BLOCK = 20, 10
#: Bytes of words in a batch; words whose hashes share a bucket, about; and the fewest buckets. A message goes from every batch to every
#: bucket, so over ``STEADY`` bytes of texts the first two grow with the root of the input, and messages shrink no further, up to ``GROWN`` times.
BATCH, SHARE, BUCKETS = 6 << 20, 4_000_000, 64
STEADY, GROWN = 30e9, 8
#: Distinct words whose hashes a Python worker remembers.
VOCABULARY = 1 << 16
#: Places whose rolling hashes are made at a time.
PIECE = 1 << 16
#: Odd factors of the rolling hashes and their finishing.
FIRST, SECOND, MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class WordHashes(dict):
    """Word to two independent hashes of 64 bits, one after the other."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= VOCABULARY:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h


def rolling(words: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for at in range(0, n, PIECE):
        h = out[at : at + PIECE]
        for i in range(1, size):
            h *= factor
            h += words[at + i : at + i + len(h)]
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
    return out


def pack_texts(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))


def unpack_texts(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def laid_out(texts: list[bytes], hashes: WordHashes, rows: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a batch one after another, the first or both of each in a row, and where each text begins. One text's words are held at a time."""
    first = np.cumsum([0, *(t.count(b" ") + bool(t) for t in texts)], dtype=np.int64)
    flat = np.empty((rows, first[-1]), np.uint64)
    for i, text in enumerate(texts):
        own = np.frombuffer(b"".join(map(hashes.__getitem__, text.split())), np.uint64)
        for row in range(rows):
            flat[row, first[i] : first[i + 1]] = own[row::2]
    return flat, first


def starts(first: np.ndarray, size: int, step: int) -> np.ndarray:
    """Places from which ``size`` words of one text follow, every ``step`` from the text's own start."""
    sizes = np.diff(first)
    counts = np.maximum(0, (sizes - size) // step + 1)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first[:-1], counts) + within * step


def whole(first: np.ndarray, size: int) -> np.ndarray:
    """Of each place from which ``size`` words follow in the batch: whether they are of one text."""
    out = np.ones(max(0, first[-1] - size + 1), bool)
    for i in range(1, size):  # the places i words before a text's end
        at = first[1:] - i
        out[at[(at >= first[:-1]) & (at < len(out))]] = False
    return out


def thin(values: np.ndarray) -> bytes:
    """Sorted integers below 2**32, as the gaps' low halves and their compressed high halves."""
    gaps = np.diff(values.astype(np.int64, copy=False), prepend=0)
    return (gaps & 0xFFFF).astype("<u2").tobytes() + zstandard.compress((gaps >> 16).astype("<u2").tobytes(), 1)


def thick(blob: bytes, n: int) -> np.ndarray:
    high = np.frombuffer(zstandard.decompress(blob[2 * n :], max_output_size=2 * n), "<u2").astype(np.int64) if n else np.empty(0, np.int64)
    return np.cumsum((high << 16) + np.frombuffer(blob[: 2 * n], "<u2")).astype(np.uint32)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def planes(values: np.ndarray) -> bytes:
    """Integers of one width, compressed byte plane by byte plane: high bytes are nearly all alike."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unplanes(blob: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(blob, max_output_size=n * width), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).reshape(n)


def dealt(h: np.ndarray, depth: int) -> np.ndarray:
    """The bucket of a hash is its first ``depth`` bits."""
    return (h >> np.uint64(64 - depth)).astype(np.int64)


# Step 1: batches


def placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, hash, text) with ids as longs in the identifiers' order, null as null; and for identifiers that aren't integers, what id stands for what."""
    rows = docs.select(F.col(id_col).alias("own"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return rows.select(F.col("own").cast("long").alias("id"), "hash", "text"), None
    ordered = rows.select("own").filter("own is not null").distinct().repartitionByRange("own").sortWithinPartitions("own")
    names = written(ordered.select("own", F.monotonically_increasing_id().alias("id")), "identifiers")
    return rows.join(names, "own", "left").select("id", "hash", "text"), names


def grown(rows: DataFrame) -> float:
    """How many times larger than usual batches and buckets are, by the bytes of all texts."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(GROWN, max(1.0, (total / STEADY) ** 0.5))


def batches_of(rows: DataFrame, full_at: float) -> DataFrame:
    """(batch, texts, docs): each text is its words joined by one space, each doc (id, hash, n_words, sha)."""
    schema = "batch long, texts binary, docs array<struct<id:long, hash:long, n_words:long, sha:string>>"
    kind = pa.list_(pa.struct([("id", pa.int64()), ("hash", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, meta, size = [], [], 0
        names = count(TaskContext.get().partitionId() << 32)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"batch": [next(names)], "texts": [pack_texts(texts)], "docs": pa.array([meta], kind)})

        for batch in rows:
            ids, marks, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for i in range(len(ids)):
                words = (column[i].as_py() or b"").split()
                text = b" ".join(words)
                texts.append(text)
                meta.append((ids[i], marks[i], len(words), hashlib.sha256(text).hexdigest()))
                size += len(text) + 1
                if size >= full_at:
                    yield full()
                    texts, meta, size = [], [], 0
        if texts:
            yield full()

    return written(rows.mapInArrow(giving_back(run), schema), "batches")


# Step 2: anchors


def grid(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and hashes of a batch's grid blocks."""
    at = starts(first, BLOCK, BLOCK)
    return at, rolling(flat[0], BLOCK, FIRST)[at]


def sent(texts: list[bytes], hashes: WordHashes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's distinct rolling hashes, sorted: the bucket's bits and 32 more; is each of a grid block; does it repeat in the batch.

    The mark of a grid block is sorted along as the lowest bit, so that no order of the hashes is held beside them.
    """
    flat, first = laid_out(texts, hashes, 1)
    h = rolling(flat[0], BLOCK, FIRST)
    h >>= np.uint64(32 - depth)
    h <<= np.uint64(1)
    h[starts(first, BLOCK, BLOCK)] |= np.uint64(1)
    h = h[whole(first, BLOCK)]
    h.sort()
    last = np.ones(len(h), bool)
    last[:-1] = h[1:] >> np.uint64(1) != h[:-1] >> np.uint64(1)
    again = ~last[np.concatenate(([True], last[:-1]))] if len(h) else last
    h = h[last]
    anchor = (h & np.uint64(1)).astype(bool)
    h >>= np.uint64(1)
    return h, anchor, again


def probes(batches: DataFrame, depth: int) -> DataFrame:
    """(bucket, batch, n, data): a batch's distinct rolling hashes of a bucket, with two bits each: is it of a grid block, does it repeat."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                h, anchor, again = sent(unpack_texts(blob.as_py()), hashes, depth)
                if not len(h):
                    continue
                cut = [0, *(np.flatnonzero(np.diff(h >> np.uint64(32))) + 1).tolist(), len(h)]
                out = []
                for low, high in pairwise(cut):
                    value = (h[low:high] & np.uint64(0xFFFFFFFF)).view(np.int64)
                    out.append((int(h[low]) >> 32, len(value), thin(value), bits(np.concatenate((anchor[low:high], again[low:high])))))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(cols[0], pa.int64()), "batch": [name.as_py()] * len(out), "n": pa.array(cols[1], pa.int64()), "data": pa.array(cols[2], pa.binary()), "marks": pa.array(cols[3], pa.binary())})

    return batches.select("batch", "texts").mapInArrow(giving_back(run), "bucket long, batch long, n long, data binary, marks binary")


ANSWER = "batch long, bucket long, hits binary"


def anchors(sent: DataFrame) -> DataFrame:
    """(batch, bucket, hits): a bit for each grid-block hash of the batch in the bucket, in order: it occurs elsewhere too."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_pylist()
        values = [thick(b.as_py(), n) for b, n in zip(group["data"], sizes, strict=True)]
        both = [flags(b.as_py(), 2 * n) for b, n in zip(group["marks"], sizes, strict=True)]
        # A hash that repeats in its batch counts twice; those that repeat anywhere meet in the order of all.
        every = np.concatenate([*values, *(v[f[n:]] for v, f, n in zip(values, both, sizes, strict=True))])
        every.sort()
        repeats = every[1:][every[1:] == every[:-1]]
        del every
        found, names = [], []
        for name, v, f, n in zip(group["batch"].to_pylist(), values, both, sizes, strict=True):
            marked = v[f[:n]]
            place = np.searchsorted(repeats, marked)
            hit = np.zeros(len(marked), bool)
            there = place < len(repeats)
            hit[there] = repeats[place[there]] == marked[there]
            if hit.any():
                names.append(name)
                found.append(bits(hit))
        return pa.table({"batch": pa.array(names, pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()] * len(names), pa.int64()), "hits": pa.array(found, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, ANSWER)


def gathered(answers: DataFrame) -> DataFrame:
    """A batch's answers in one row; it has one from each bucket at most."""
    return answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "hits")).alias("answers"))


def answered(distinct: np.ndarray, bucket: np.ndarray, answers: list[dict]) -> np.ndarray:
    """Bits for a batch's distinct hashes, sorted, from its buckets' answers; false where there is none."""
    out = np.zeros(len(distinct), bool)
    for a in answers:
        low, high = np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1])
        out[low:high] = flags(a["hits"], high - low)
    return out


def candidates(batches: DataFrame, answers: DataFrame, depth: int) -> DataFrame:
    """(batch, texts, docs) of the documents with anchors; docs: (id, hash, anchors), the last a bit for each grid block."""
    schema = "batch long, texts binary, docs array<struct<id:long, hash:long, anchors:binary>>"
    kind = pa.list_(pa.struct([("id", pa.int64()), ("hash", pa.int64()), ("anchors", pa.binary())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            for name, blob, docs, got in zip(*(batch.column(i) for i in range(4)), strict=True):
                texts, docs = unpack_texts(blob.as_py()), docs.as_py()
                flat, first = laid_out(texts, hashes, 1)
                at, h = grid(flat, first)
                del flat
                distinct, inverse = np.unique(h >> np.uint64(32 - depth), return_inverse=True)
                hit = answered(distinct, (distinct >> np.uint64(32)).astype(np.int64), got.as_py())[inverse]
                low = np.searchsorted(at, first)
                keep = [i for i in range(len(texts)) if hit[low[i] : low[i + 1]].any()]
                if keep:
                    meta = [(docs[i]["id"], docs[i]["hash"], bits(hit[low[i] : low[i + 1]])) for i in keep]
                    yield pa.RecordBatch.from_pydict({"batch": pa.array([name.as_py()], pa.int64()), "texts": [pack_texts([texts[i] for i in keep])], "docs": pa.array([meta], kind)})

    joined = batches.select("batch", "texts", F.transform("docs", lambda d: F.struct(d["id"].alias("id"), d["hash"].alias("hash"))).alias("docs")).join(gathered(answers), "batch")
    return written(joined.mapInArrow(giving_back(run), schema), "candidates")


# Step 3: windows around the anchors


class Windows:
    """The windows of a candidate batch that hold an anchor, in the order of (hash, id, start); a null id comes after all others."""

    def __init__(self, texts: list[bytes], docs: list[dict], hashes: WordHashes):
        flat, self.first = laid_out(texts, hashes)
        blocks = np.diff(self.first) // BLOCK
        hit = np.concatenate([flags(d["anchors"], n) for d, n in zip(docs, blocks, strict=True)])
        at = starts(self.first, BLOCK, BLOCK)
        begin, at = np.repeat(self.first[:-1], blocks)[hit], at[hit]
        near = np.zeros(max(0, self.first[-1] - WINDOW + 1), bool)
        for i in range(BLOCK):  # a window's first whole block begins so many words after it
            place = at - i
            near[place[(place >= begin) & (place < len(near))]] = True
        near &= whole(self.first, WINDOW)
        self.at = np.flatnonzero(near)
        doc = np.searchsorted(self.first, self.at, side="right") - 1
        self.start = (self.at - self.first[doc]).astype(np.uint32)
        self.id = np.array([d["id"] or 0 for d in docs], np.int64)[doc]
        self.none = np.array([d["id"] is None for d in docs], np.uint8)[doc]
        del doc
        self.h = rolling(flat[0], WINDOW, FIRST)[self.at]
        self.g = rolling(flat[1], WINDOW, SECOND)[self.at]
        del flat
        order = np.lexsort((self.start, self.id, self.none, self.g, self.h))
        for name in ("at", "start", "id", "none", "h", "g"):  # one at a time
            setattr(self, name, getattr(self, name)[order])
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.h[1:] != self.h[:-1]) | (self.g[1:] != self.g[:-1])
        self.head = np.flatnonzero(fresh)  # each distinct window's earliest place in the batch
        self.group = np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)


def window_rows(found: DataFrame, depth: int) -> DataFrame:
    """(bucket, batch, size, h, g, i, n, s): a batch's distinct windows of a bucket, each with its earliest place there."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            for name, blob, docs in zip(*(batch.column(i) for i in range(3)), strict=True):
                w = Windows(unpack_texts(blob.as_py()), docs.as_py(), hashes)
                h, g, ids, none, s = w.h[w.head], w.g[w.head], w.id[w.head], w.none[w.head], w.start[w.head]
                del w
                bucket = dealt(h, depth)
                cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(h)]
                out = [(int(bucket[low]), high - low, *(planes(x[low:high]) for x in (h, g, ids, none, s))) for low, high in pairwise(cut) if low < high]
                cols = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(cols[0], pa.int64()), "batch": pa.array([name.as_py()] * len(out), pa.int64()), "size": pa.array(cols[1], pa.int64())} | {k: pa.array(c, pa.binary()) for k, c in zip("hgins", cols[2:], strict=True)})

    return found.select("batch", "texts", "docs").mapInArrow(giving_back(run), "bucket long, batch long, size long, h binary, g binary, i binary, n binary, s binary")


def earliest(sent: DataFrame) -> DataFrame:
    """(batch, bucket, hits): a bit for each distinct window of the batch in the bucket: no earlier place has it."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group["size"].to_pylist()
        h, g, ids, none, s = (np.concatenate([unplanes(b.as_py(), kind, n) for b, n in zip(group[k], sizes, strict=True)]) for k, kind in (("h", "<u8"), ("g", "<u8"), ("i", "<i8"), ("n", "<u1"), ("s", "<u4")))
        order = np.lexsort((s, ids, none, g, h))
        new, other = np.ones(len(order), bool), np.ones(len(order), bool)  # another window, another place than the one before
        for columns, differs in (((h, g), new), ((ids, none, s), other)):
            same = np.ones(len(order) - 1, bool)
            for x in columns:
                x = x[order]
                same &= x[1:] == x[:-1]
            differs[1:] = ~same
        # The rows of a window's earliest place come first, so before them there is no other place since the window began.
        others = np.cumsum(other & ~new, dtype=np.uint32)
        first = np.empty(len(order), bool)
        first[order] = others == others[new][np.cumsum(new, dtype=np.uint32) - np.uint32(1)]
        cut = np.cumsum(sizes)[:-1]
        return pa.table({"batch": group["batch"], "bucket": group["bucket"], "hits": pa.array([bits(x) for x in np.split(first, cut)], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, ANSWER)


# Step 4: what goes


def cleaned(found: DataFrame, answers: DataFrame, depth: int, texts: bool) -> DataFrame:
    """(id, hash, n_removed, kept_sha256, removed spans as arrays of first word and words, kept text if asked for) of documents that lose words."""
    schema = "id long, hash long, n_removed long, kept_sha256 string, spans array<struct<start:long, words:long>>" + (", kept string" if texts else "")
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            for blob, docs, got in zip(*(batch.column(i) for i in range(3)), strict=True):
                split, docs = unpack_texts(blob.as_py()), docs.as_py()
                w = Windows(split, docs, hashes)
                h = w.h[w.head]
                first = answered(h, dealt(h, depth), got.as_py())
                head = w.head[w.group]
                stays = first[w.group] & (w.id == w.id[head]) & (w.none == w.none[head]) & (w.start == w.start[head])
                gone = w.at[~stays]
                edge = np.zeros(w.first[-1] + 1, np.int32)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + WINDOW, -1)
                removed = np.cumsum(edge[:-1]) > 0
                out = []
                for i, text in enumerate(split):
                    mask = removed[w.first[i] : w.first[i + 1]]
                    if mask.any():
                        words = text.split()
                        kept = b" ".join([words[j] for j in np.flatnonzero(~mask)])
                        turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                        row = (docs[i]["id"], docs[i]["hash"], int(mask.sum()), hashlib.sha256(kept).hexdigest(), [(int(a), int(b - a)) for a, b in turns.reshape(-1, 2)])
                        out.append((*row, kept.decode()) if texts else row)
                cols = list(zip(*out, strict=True)) or [[]] * 6
                kinds = {"id": pa.int64(), "hash": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": spans_kind} | ({"kept": pa.string()} if texts else {})
                yield pa.RecordBatch.from_pydict({k: pa.array(c, kind) for (k, kind), c in zip(kinds.items(), cols, strict=False)})

    joined = found.join(gathered(answers), "batch").select("texts", "docs", "answers")
    return joined.mapInArrow(giving_back(run), schema).dropDuplicates(["id", "hash"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """All documents (id, hash, n_words, sha), ``cleaned``'s row for those that lose words, and ``placed``'s names.

    A row is known by its identifier (null: after all others) and its text's hash. Rows that repeat both count as one place and lose the
    same words; of two texts under one identifier the earlier start counts as earlier. Identifiers may be of any type that Spark orders;
    texts are dealt once more by those that aren't integers.
    """
    rows, names = placed(docs, id_col, text_col)
    times = grown(rows)
    batches = batches_of(rows, BATCH * times)
    everyone = written(batches.select(F.explode("docs").alias("d")).select("d.*"), "words")
    total = everyone.agg(F.sum("n_words")).first()[0] or 0
    depth = (max(BUCKETS, math.ceil(total / (SHARE * times))) - 1).bit_length()
    marked = written(anchors(probes(batches, depth)), "anchors")
    found = candidates(batches, marked, depth)
    discard(batches, marked)
    first = written(earliest(window_rows(found, depth)), "earliest")
    gone = written(cleaned(found, first, depth, texts), "cleaned")
    discard(found, first)
    return everyone, gone, names


def same_place(a: DataFrame, b: DataFrame) -> Column:
    """A row's identifier and hash, nulls being equal: as plain keys, so that both sides can be dealt by them."""
    return a["id"].eqNullSafe(b["id"]) & (a["hash"] == b["hash"])


def substring_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept_sha256, and the removed spans (first word, words).

    A null text has no words, and one of fewer than ``WINDOW`` words loses none. Nulls, repeats and ties of identifiers: see
    ``repeats``. Other columns play no part, whatever their names. No rows give no rows.
    """
    everyone, gone, names = repeats(docs, id_col, text_col)
    rows = everyone.join(gone, same_place(everyone, gone), "left").select(
        everyone["id"], "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans"
    )
    if names is None:
        return rows.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept_sha256", "spans")
    return rows.join(names, "id", "left").select(F.col("own").alias(id_col), "n_words", "n_removed", "kept_sha256", "spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated words, all columns and rows: a text that loses words becomes its other words joined by one space; other texts stay as they are.

    Nulls, repeats and ties: see ``repeats``. No rows give no rows.
    """
    _, gone, names = repeats(docs, id_col, text_col, texts=True)
    gone = gone.select("id", "hash", "kept")
    own = gone.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id"), "hash", "kept") if names is None else gone.join(names, "id", "left").select(F.col("own").alias("id"), "hash", "kept")
    joined = docs.join(own, docs[id_col].eqNullSafe(own["id"]) & (F.xxhash64(docs[text_col]) == own["hash"]), "left")
    return joined.select(*[F.coalesce(own["kept"], docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])
