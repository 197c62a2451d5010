"""Near-duplicates by SimHash: fingerprints linked at two or fewer differing bits.

Links are found by deletion variants. A fingerprint is cut into two halves; of two that
differ in at most two bits, one half differs in at most one bit. Each half is indexed under
its 32 variants with one bit left out, so such halves share a variant. An equality join on the
variants gives candidates and the whole fingerprints verify them.

Only distinct fingerprints are indexed: copies never meet. The members of a variant that more than
``BUCKET`` distinct fingerprints share are indexed again, under it and the variants of the other half's
halves, one of which differs in at most one bit by the same reasoning; and so on down to single bits, where no more than
some hundred fingerprints can share all variants. So a variant in a third of all fingerprints
is split within the method and loses no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import settled, taken_out, tasks, written

WORDS, SEED, DISTANCE = 3, 42, 2
#: Shingles hashed and counted at a time in a long text.
BLOCK = 1 << 16
#: The most fingerprints of a variant that are joined with each other.
BUCKET = 256
#: The most words of a bitmap of keys.
BITMAP = 1 << 18


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of 64-bit words. Bytes add up without overflow for 255 rows at a time, many of them at once."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    return bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a UTF-8 text; 0 without words."""
    found = text.lower().split()  # ASCII letters and white space only, as the text is bytes
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)), np.uint64)
        ones += bit_counts(h[:, None])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, hash, fp) for each row: a hash of its text, and the fingerprint's 64 bits as a signed long. Null texts count as empty: 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "hash": batch.column(1), "fp": pa.array(fps.view(np.int64))})

    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, hash long, fp long")


def variants(rows: DataFrame, width: int) -> DataFrame:
    """(key, rest, fp): ``width`` rows for each row, whose ``rest`` has ``width`` bits to be indexed under ``key``.

    The new key is a hash of the old one, the half that is indexed, the bit left out and its other bits; the other half is left as rest.
    A clash of hashes only costs a comparison.
    """
    half = width // 2
    low = (1 << half) - 1
    rest, j = F.col("rest"), F.col("j")
    parts = F.shiftrightunsigned(rest, half).bitwiseAND(F.lit(low)), rest.bitwiseAND(F.lit(low))
    first = j < half
    masks = F.array(*[F.lit(low ^ (1 << b)).cast("long") for b in range(half)])
    cut = F.when(first, parts[0]).otherwise(parts[1]).bitwiseAND(F.element_at(masks, (j % half + 1).cast("int")))
    spread = rows.select("key", "rest", "fp", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    return spread.select(F.xxhash64("key", j, cut).alias("key"), F.when(first, parts[1]).otherwise(parts[0]).alias("rest"), "fp")


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key, a hash, is among ``keys``, a table that holds each once.

    A bitmap of the keys sifts the rows before they are dealt by key. It has at most ``BITMAP`` words of 64 bits, which bounds its
    broadcast; with more keys than that sifts it only lets more rows through to the join that decides.
    """
    words = 1 << max(10, min(BITMAP.bit_length() - 1, (keys.count() // 4).bit_length()))
    word, bit = F.col("key").bitwiseAND(F.lit(words - 1)), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 50) & 63 AS int))")
    bitmap = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    may = rows.withColumn("word", word).join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")
    return may.join(keys, "key")  # an inner join keeps its place; a semi join is moved before the sifting by the optimizer


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: every pair within ``DISTANCE`` bits, each once."""
    dealt = fps.repartition(tasks(fps.sparkSession))  # a file of few bytes holds many fingerprints, each of which makes 64 rows
    rows, width, found = dealt.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp"), 64, []
    near = differing(F.col("a"), F.col("b")) <= DISTANCE
    while True:
        indexed = variants(rows, width)
        # Counts are combined before they are shuffled; a variant of two has its pair in its least and greatest.
        shared = indexed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        shared = written(shared.filter("n > 1"), "variants")
        width //= 2
        cold = F.col("n") <= BUCKET if width > 1 else F.lit(True)
        found.append(shared.filter("n = 2").filter(near).select("a", "b"))
        crowd = shared.filter("n > 2").filter(cold).select("key")
        if not crowd.isEmpty():
            members = written(among(indexed, crowd).select("key", "fp"), "members")
            left, right = members.select("key", F.col("fp").alias("a")), members.select("key", F.col("fp").alias("b"))
            found.append(left.join(right, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b"))
        hot = shared.filter(~cold).select("key")
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        rows = written(among(indexed, hot), "hot-variants")


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, fp, root, component_id) for each row."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    rooted = written(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(least, "root"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest identifier reachable over links. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows fall together; a null
    identifier gets its component's smallest one, null only if there is none. Columns other than
    the two play no part, whatever their names. No rows give no rows.
    """
    rows = settled(lambda: placed(docs, id_col, text_col).select("id", "fp", "component_id"), "groups")
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", place: Callable[[DataFrame, str, str], DataFrame] = placed) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each component, that with the smallest identifier (null: after all others).

    Of rows with that identifier one stays, that whose text hashes lowest. ``place`` gives (id, hash, root) of each row, root being
    its component: by fingerprints, unless another is given. No rows give no rows; clashing column names do no harm.
    """
    rows = settled(lambda: place(docs, id_col, text_col).select("id", "hash", "root"), "placed")
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least")).select("root", F.col("least.id").alias("keep"), F.col("least.hash").alias("text"))
    fates = rows.join(least, "root").select("id", "hash", (F.col("id").eqNullSafe(F.col("keep")) & (F.col("hash") == F.col("text"))).alias("kept"))
    return taken_out(docs, fates, id_col, text_col)
