"""Near copies by SimHash over shingles of five words: texts linked at a Jaccard similarity of 0.8 or more.

Two bits of 64 are far too near for such copies, so fingerprints have more bits, cut into segments (``Shape``). A pair is a candidate
if one segment differs by at most one bit: segments are indexed under variants with one bit left out, and an
equality join on the variants gives candidates. A bit that differs is nearly always one that is nearly undecided in
both texts, so only a quarter of a segment's bits, the least decided ones, are left out in turn. Segments are as wide as it takes
that texts which only clash rarely meet, and as many as it takes that a pair at 0.8 is missed in one case of ninety; at 0.85 in
one of a thousand. For up to half a million texts these are 24 segments of 16 bits, 96 variants a text. Sizes and whole
fingerprints sift the candidates, and the shingles of both texts decide each.

Only distinct sets of shingles (nodes) are compared. A variant of more than ``BUCKET`` nodes is not joined with itself.
First each node of such crowds is compared with the most central one that it meets in the largest of them. Where that leaves several components in a
variant, the shingles of its nodes are counted: nodes that share a rare one, in at most ``BUCKET`` nodes, are compared. Any other pair
has in common no more shingles than the common ones of either, and that is too few for nearly all texts that are changed too much to be linked
with the centre. Where it isn't, those outside a variant's largest component are compared with growing samples of the variant, and
with all of it in the end. So a crowd of copies costs a few comparisons each, and no candidate pair of different components is passed
over that can be alike. The variants that few share come last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, giving_back, tasks, written
from .simhash import SEED, among, bit_counts, differing, near_dedup

WORDS, ALIKE = 5, 0.8
#: By a segment's width, the probability that it is alike in a pair at ``ALIKE`` but for one of the bits that are left out in turn:
#: simulated for sums of very many shingles, whose correlation is 2 * 0.8 / 1.8.
SHARED = {16: 0.171, 20: 0.104, 24: 0.061, 28: 0.036, 32: 0.0204}
#: The share of pairs at ``ALIKE`` that may be missed, and the probability that one of their bits differs.
MISSED, APART = 0.011, math.acos(2 * ALIKE / (1 + ALIKE)) / math.pi
#: Shingles whose bits are counted at a time; pairs of one node that go to a task together; texts whose sketches a task holds at a time.
BLOCK, SHARE, ROWS = 1 << 14, 64, 512
#: The most nodes of a variant or shingle that are joined with each other; of a larger variant, those compared in the first round after the central one, and the growth from round to round.
BUCKET, SAMPLE, GROWTH = 32, 16, 64
#: So many of a node's largest variants show it their central nodes.
MET = 4
#: The most keys that are broadcast.
SENT = 1 << 17
#: Texts of a crowd whose shingles a task counts, if there are fewer than tasks can share.
TEXTS = 128
MIX = np.uint64(0xD6E8FEB86659FD93)


class Shape:
    """A fingerprint's segments for ``n`` texts."""

    def __init__(self, n: int):
        self.width = next((w for w in SHARED if w << (w - 1) >= n), max(SHARED))  # about four texts a variant by chance
        self.weak = self.width // 4
        self.segments = math.ceil(math.log(MISSED) / math.log(1 - SHARED[self.width]))
        self.longs = -(-self.segments * self.width // 64)
        rng = np.random.default_rng(SEED)
        self.flips, factors = (rng.integers(0, 1 << 64, self.longs, np.uint64) for _ in range(2))
        self.factors = factors | np.uint64(1)


def most(bits: int) -> int:
    """So many of a number of bits differ at most in a pair at ``ALIKE``: 3.6 deviations over the mean."""
    return math.ceil(bits * APART + 3.6 * (bits * APART * (1 - APART)) ** 0.5)


def shingles(text: bytes, words: int = WORDS) -> set[bytes]:
    """The runs of ``words`` words, ASCII letters in lower case; all words of a shorter text; none without words."""
    found = text.lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def hashes(text: bytes) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text)), np.uint64))


def condensed(text: bytes, shape: Shape) -> tuple[int, int, np.ndarray, np.ndarray]:
    """A digest of the set of shingles, its size, the words of its fingerprint, and words that mark its segments' least decided bits; zeros without words."""
    h = hashes(text)
    if not len(h):
        return 0, 0, np.zeros(shape.longs, np.int64), np.zeros(shape.longs, np.int64)
    ones = np.zeros(64 * shape.longs, np.int64)
    for at in range(0, len(h), BLOCK):
        z = (h[at : at + BLOCK, None] ^ shape.flips) * shape.factors
        z ^= z >> np.uint64(32)
        z *= MIX
        z ^= z >> np.uint64(29)
        ones += bit_counts(z)
    over = 2 * ones - len(h)
    rows, width = shape.segments, shape.width
    least = np.argsort(np.abs(over[: rows * width]).reshape(rows, width), axis=1, kind="stable")[:, : shape.weak]
    weak = np.zeros(len(over), bool)
    weak[np.arange(rows)[:, None] * width + least] = True
    bits, weak = (np.packbits(x, bitorder="little").view(np.int64) for x in (over > 0, weak))
    return xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h), bits, weak


def unfolded(bits: np.ndarray, weak: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The variants of fingerprints, one a row, in the rows' order, and how many each row has."""
    width, n = shape.width, shape.segments * shape.width
    bits, weak = (np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")[:, :n] for x in (bits, weak))
    segments = bits.reshape(-1, shape.segments, width) @ (1 << np.arange(width))
    row, at = np.nonzero(weak)
    return (at << width) | segments[row, at // width] & ~(1 << at % width), np.bincount(row, minlength=len(bits))


def sketch(text: bytes, shape: Shape) -> tuple[int, int, list[int], list[int]]:
    """A digest of the set of shingles, its size, the words of its fingerprint, and its variants; 0, 0 and none without words."""
    node, size, bits, weak = condensed(text, shape)
    return node, size, bits.tolist(), unfolded(bits[None], weak[None], shape)[0].tolist()


def sketches(docs: DataFrame, id_col: str, text_col: str, shape: Shape) -> DataFrame:
    """(id, hash, node, size, bits, weak) for each row: a hash of its text, and what ``condensed`` gives. Null texts count as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            found = [condensed(t.as_py() or b"", shape) for t in batch.column(2).cast(pa.binary())]
            nodes = np.array([f[0] for f in found], np.uint64).view(np.int64)
            cols = {"node": pa.array(nodes), "size": pa.array([f[1] for f in found], pa.int64())} | {name: pa.array([f[i] for f in found], pa.list_(pa.int64())) for i, name in ((2, "bits"), (3, "weak"))}
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "hash": batch.column(1)} | cols)

    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))
    return rows.mapInArrow(giving_back(run), f"id {kind}, hash long, node long, size long, bits array<long>, weak array<long>")


def variants(nodes: DataFrame, shape: Shape) -> DataFrame:
    """A row for each variant (key) of each node, with the columns of ``nodes`` but bits and weak, which it is made of.

    Nodes are dealt in the short form, an eighth of their variants or less, and unfolded where they are needed. Spark takes the rows
    for as few as the nodes: joined with themselves they need a hint, so as not to be broadcast.
    """
    kept = [f for f in nodes.schema if f.name not in ("bits", "weak")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            keys, counts = unfolded(*(batch.column(c).flatten().to_numpy().reshape(len(batch), -1) for c in ("bits", "weak")), shape)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {"keys": pa.ListArray.from_arrays(offsets, pa.array(keys))})

    names = [f.name for f in kept]
    dealt = nodes.select(*names, "bits", "weak").repartition(tasks(nodes.sparkSession))  # a file of few bytes holds many nodes
    lists = dealt.mapInArrow(giving_back(run), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "keys array<long>"]))
    return lists.select(F.explode("keys").alias("key"), *names)


def texts_of(used: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of each node that is used; texts are sifted before they are dealt."""
    wanted = written(nodes.join(used, "node", "left_semi").select(F.col("hash").alias("key"), "node"), "wanted-texts")
    return among(texts.withColumnRenamed("hash", "key"), wanted).dropDuplicates(["node"]).select("node", "text")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (a, b) whose texts' shingles are alike. Whole fingerprints sift them first; a node with many pairs is dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            good = []
            for a, ta, tb in zip(batch.column(0), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                if a.as_py() != last:
                    last, own = a.as_py(), shingles(ta.as_py() or b"")
                good.append(similarity(own, shingles(tb.as_py() or b"")) >= ALIKE)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    whole = lambda name: nodes.select(F.col("node").alias(name), F.col("bits").alias(f"{name}_bits"))
    apart = sum((differing(F.col("a_bits")[i], F.col("b_bits")[i]) for i in range(1, shape.longs)), differing(F.col("a_bits")[0], F.col("b_bits")[0]))
    pairs = written(pairs.join(whole("a"), "a").join(whole("b"), "b").filter(apart <= most(64 * shape.longs)).select("a", "b"), "sifted-pairs")
    if pairs.isEmpty():
        return pairs
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = written(texts_of(used, nodes, texts), "compared-texts")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("long").alias("k"))
    left = held.withColumnRenamed("node", "a").join(shares, "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("share"), F.col("text").alias("ta"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "k").alias("share"))
    right = dealt.join(held.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    links = written(right.join(left, ["a", "share"]).select("a", "b", "ta", "tb").mapInArrow(giving_back(run), "a long, b long"), "links")
    discard(held, pairs)
    return links


def near(left: str, right: str) -> Column:
    """Whether two nodes can be alike by their sizes and the first words of their fingerprints."""
    a, b = F.col(f"{left}size"), F.col(f"{right}size")
    return (F.least(a, b) >= F.greatest(a, b) * F.lit(ALIKE) - 1e-6) & (differing(F.col(f"{left}word"), F.col(f"{right}word")) <= most(64))


def enough(left: str, right: str) -> Column:
    """Whether two nodes of a crowd, whose shingles were counted, can be alike by their common shingles alone."""
    return F.least(f"{left}common", f"{right}common") >= (F.col(f"{left}size") + F.col(f"{right}size")) * F.lit(ALIKE / (1 + ALIKE)) - 1e-6


def paired(rows: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """The pairs (a, b), a the smaller, of nodes that share a key and can be alike, if the condition on ``l`` and ``r`` holds too.

    Rows that are joined with themselves keep their names, so that Spark deals them once for both sides.
    """
    ordered = [F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")]
    return rows.alias("l").join(other.alias("r"), F.col("l.key") == F.col("r.key")).filter(condition & near("l.", "r.")).select(*ordered)


#: Of rows that are joined with themselves, each pair once; and of nodes in different components.
SMALLER = "l.node < r.node"
PARTED = "l.root <> r.root"


def stars(roots: DataFrame) -> DataFrame:
    """What was found before, as edges."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def rooted(rows: DataFrame, roots: DataFrame, name: str, root: str) -> DataFrame:
    """``rows`` with a column ``root``: the component of the node in column ``name``."""
    of = roots.select(F.col("node").alias(name), F.col("root").alias(root))
    return rows.join(of, name, "left").withColumn(root, F.coalesce(root, name))


def rare_shingles(crowd: DataFrame, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the shingles in at most ``BUCKET`` nodes of a crowd, which has a column node: (key, node) of those in more than one, and (node, rare), their number, of nodes with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                keys = hashes(text.as_py() or b"").view(np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "node": pa.array(np.full(len(keys), node.as_py()))})

    dealt = texts_of(crowd, nodes, texts).repartition(min(tasks(nodes.sparkSession), 1 + crowd.count() // TEXTS))
    each = written(dealt.mapInArrow(giving_back(run), "key long, node long"), "crowd-shingles")
    counts = each.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    counts = written(counts.filter(F.col("n") <= BUCKET), "rare-shingles")
    few = written(among(each, counts.filter("n > 1").select("key")).select("key", "node"), "shared-shingles")
    rare = counts.filter("n = 1").select("node").unionByName(few.select("node")).groupBy("node").agg(F.count("*").alias("rare"))
    return few, rare


def crowd_roots(members: DataFrame, nodes: DataFrame, texts: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame | None]:
    """(node, root) of the components within crowded variants; ``members`` has key, node, size, word and n, the key's count.

    If the shingles of some nodes were counted, (node, size, common) of these too: those with a rare one in common have been compared.
    """
    by = F.struct("weight", "node")
    largest = F.slice(F.sort_array(F.collect_list(F.struct("n", "key")), False), 1, MET)  # of at most as many variants as a text has
    central = members.groupBy("node").agg(F.sum("n").alias("weight"), *[F.first(c).alias(c) for c in ("size", "word")], largest.alias("largest"))
    pivots = members.join(central.select("node", "weight"), "node").groupBy("key").agg(*[F.max_by(c, by).alias(f"p_{c}") for c in ("node", "size", "word", "weight")])
    # Of the central nodes that a node meets in its largest variants it is compared with the heaviest; the others' turn comes if they are in other components then.
    met = central.select(F.explode("largest.key").alias("key"), "node", "size", "word").join(pivots, "key").filter((F.col("node") != F.col("p_node")) & near("", "p_"))
    heaviest = met.groupBy("node").agg(F.max_by("p_node", F.struct("p_weight", "p_node")).alias("p_node"))
    pairs = heaviest.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
    done = roots = counted = parted = live = None
    limit, last = SAMPLE, False
    while True:
        pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if live is not None:
            discard(live)
        more = verified(pairs, nodes, texts, shape)
        done = pairs if done is None else written(done.unionByName(pairs), "pairs")
        roots = written(components(more if roots is None else stars(roots).unionByName(more)), "roots")
        if last:
            return roots, counted
        if parted is None:
            rows = rooted(members, roots, "node", "root").join(roots.groupBy("root").agg(F.count("*").alias("others")), "root", "left")
            top = F.max(F.struct(F.coalesce("others", F.lit(1)), "root")).alias("top")
            mixed = rows.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), top, F.min("size").alias("least")).filter("r <> s")
        if counted is None:
            live = written(rows.join(mixed, "key", "left_semi"), "mixed-crowds")
            if live.isEmpty():
                return roots, counted
            crowd = written(live.select("node", "size", "word", "root").distinct(), "crowd-nodes")
            few, rare = rare_shingles(crowd, nodes, texts)
            counted = crowd.join(rare, "node", "left").select("node", "size", (F.col("size") - F.coalesce("rare", F.lit(0))).alias("common"))
            counted = written(counted, "counted-nodes")
            # Two texts that are alike have in common this share of either's shingles; a text with fewer common ones only has links by rare ones.
            able = counted.filter(F.col("common") >= F.col("size") * F.lit(ALIKE) - 1e-6).select("node", "common")
            members = written(live.select("key", "node", "size", "word", "n").join(able, "node"), "able-crowds")
            few = few.join(crowd, "node")
            pairs = paired(few, few, F.expr(f"{SMALLER} AND {PARTED}")).distinct()
            continue
        if parted is None:
            # Rows stay that have enough in common with the smallest that they can be alike with in the variant, whose largest component is kept.
            able = F.col("common") >= (F.col("size") + F.greatest("least", F.col("size") * F.lit(ALIKE))) * F.lit(ALIKE / (1 + ALIKE)) - 1e-5
            parted = rows.join(mixed.select("key", F.col("top.root").alias("top"), "least"), "key").filter(able)
            members = written(parted.select("key", "node", "size", "word", "n", "common", "top"), "parted-crowds")
        live = written(rooted(rooted(members, roots, "node", "root"), roots, "top", "main"), "mixed-crowds")
        most_nodes = live.filter("root <> main").agg(F.max("n")).first()[0]
        if most_nodes is None:
            return roots, counted
        # A node's lot is the same in all variants, so that those it shares with others choose much the same nodes.
        lot = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
        some = live.filter(lot * F.col("n") < (limit << 20)).select("key", "node", "size", "word", "root", "common")
        pairs = paired(live.filter("root <> main"), some, enough("l.", "r.") & F.expr(PARTED)).distinct()
        limit, last = limit * GROWTH, limit >= most_nodes  # a round that takes all is the last


def links(nodes: DataFrame, texts: DataFrame, shape: Shape) -> DataFrame:
    """(node, root) of every node with a link. ``nodes`` has node, hash, size, bits and weak; ``texts`` hash and text."""
    light = nodes.select("node", "size", F.col("bits")[0].alias("word"), "bits", "weak")
    counts = variants(nodes.select("bits", "weak"), shape).groupBy("key").agg(F.count("*").alias("n"))
    hot = written(counts.filter(F.col("n") > BUCKET), "hot-variants")
    if hot.isEmpty():
        rows = variants(light, shape).hint("merge")
        pairs = paired(rows, rows, F.expr(SMALLER))
        return written(components(verified(written(pairs.distinct(), "pairs"), nodes, texts, shape)), "roots")
    crowds = written(variants(light, shape).join(F.broadcast(hot) if hot.count() <= SENT else hot.hint("merge"), "key"), "crowds")
    roots, counted = crowd_roots(crowds, nodes, texts, shape)
    discard(crowds)
    # Crowds first: what they have linked need not be compared again under the variants that few share, nor what was counted and has too little in common.
    known = rooted(light, roots, "node", "root")
    condition = F.expr(f"{SMALLER} AND {PARTED}")
    if counted is not None:
        known = known.join(counted.select("node", "common"), "node", "left")
        condition &= F.col("l.common").isNull() | F.col("r.common").isNull() | enough("l.", "r.")
    cold = variants(known, shape).join(hot, "key", "left_anti").hint("merge")
    pairs = written(paired(cold, cold, condition).distinct(), "pairs")
    return written(components(stars(roots).unionByName(verified(pairs, nodes, texts, shape))), "roots")


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, root) for each row."""
    shape = Shape(docs.count())
    rows = written(sketches(docs, id_col, text_col, shape), "sketches")
    nodes = rows.groupBy("node").agg(F.min("hash").alias("hash"), *[F.first(c).alias(c) for c in ("size", "bits", "weak")])
    nodes = written(nodes, "nodes")
    sketched, rows = rows, written(rows.select("id", "hash", "node"), "places")
    discard(sketched)
    roots = links(nodes, docs.select(F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")), shape)
    return rows.join(rooted(nodes.select("node"), roots, "node", "root"), "node").select("id", "hash", "root")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component of near copies the one with its smallest identifier.

    Null and empty texts are copies of each other. For null identifiers, repeats and column names see ``near_dedup``.
    """
    return near_dedup(docs, id_col, text_col, placed)
