"""Exact top-k by inner product over M-trees.

Rows are dealt by a hash of their identifier into parts of bounded size, each an M-tree of pages. An
inner product becomes a distance: with M the largest norm of a part, (x, sqrt(M^2 - |x|^2))
and (q, 0) are the nearer the larger q.x is. Routing objects of the upper level stand over
those of pages; a page keeps its routing object's distance to the parent, its covering radius
and the least distance in it, and an entry its distance to its page's routing object. Bounds
by the triangle inequality on these stored distances decide, first without computing anything, which
pages and entries a query can still need. Queries go through a tree in blocks, best first: each query
begins with the pages of its own smallest bounds, and the block takes the others in the order of the smallest
bound that any of its queries has there, so that most of the k best are known early.

Every block of queries meets every part, as an exact search of stated queries has to. Each tree is dealt once, and
light blocks of queries are sent to it; sorted behind it, they pass by while the tree is held, and
what comes back is k rows for each query and part.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import tasks, written

#: Rows of a part, at least and at most, and queries of a block, about; entries of a page; pages that each query sees first.
PART, LARGEST, QUERIES, PAGE, EARLY = 16_384, 65_536, 1024, 64, 2
#: Distances carry rounding errors far below this share.
SLACK = 1e-9
#: Products up to this are exact in doubles.
EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a long; null if the vector or a component is null, not finite or beyond a long."""
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).try_cast("long"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.when(~F.exists(parts, lambda x: x.isNull()), parts))


def to_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_bytes(blob: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(blob)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the further component that gives all of them one norm."""
    return np.hstack([x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))[:, None]])


def build(ids: np.ndarray, x: np.ndarray, page: int = PAGE) -> dict[str, np.ndarray]:
    """An M-tree of two levels above its entries, in arrays; entries are ordered by page."""
    order = np.lexsort((ids, *x.T[::-1]))  # rows that come in another order make the same tree
    ids, x = ids[order], x[order]
    largest = float((x.astype(float) ** 2).sum(axis=1).max())
    y = lifted(x.astype(float), largest)
    n = len(ids)
    rng = np.random.default_rng(n)
    upper = y[rng.choice(n, min(n, max(1, round((n / page) ** 0.5))), replace=False)]
    to_upper = distances(y, upper)
    over = to_upper.argmin(axis=1)
    rows, pivots, parents, entry, low, high, ends = [], [], [], [], [], [], []
    for t in range(len(upper)):
        mine = np.flatnonzero(over == t)
        if not len(mine):
            continue
        lower = mine[rng.choice(len(mine), max(1, len(mine) // page), replace=False)]
        d = distances(y[mine], y[lower])
        near = d.argmin(axis=1)
        for p in range(len(lower)):
            at = np.flatnonzero(near == p)
            at = at[np.argsort(d[at, p], kind="stable")]
            for cut in range(0, len(at), page):  # a page that overflows is cut into rings around its routing object
                part = at[cut : cut + page]
                rows.append(mine[part])
                entry.append(d[part, p])
                pivots.append(lower[p])
                parents.append(t)
                low.append(d[part, p].min())
                high.append(d[part, p].max())
                ends.append(len(part))
    rows = np.concatenate(rows)
    pivots, parents = np.array(pivots), np.array(parents)
    return {
        "ids": ids[rows], "x": x[rows], "largest": np.array(largest), "upper": upper, "pivots": y[pivots], "parents": parents,
        "to_parent": to_upper[pivots, parents], "entry": np.concatenate(entry), "low": np.array(low), "high": np.array(high), "ends": np.cumsum(ends),
    }


def search(tree: dict[str, np.ndarray], qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and identifiers of each query's k best in a tree (-1 rows are short), and the number of products computed."""
    ids, x, largest = tree["ids"], tree["x"], float(tree["largest"])
    norms = (q.astype(float) ** 2).sum(axis=1)
    kind = float if max(float(norms.max()), largest) < EXACT else np.int64
    x, q = x.astype(kind), q.astype(kind)
    n, none = len(q), np.iinfo(np.int64).min
    best, who = np.full((n, k), none, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
    reach = np.full(n, np.inf)  # the distance of the k-th best so far
    lift = np.hstack([q.astype(float), np.zeros((n, 1))])
    slack = SLACK * (np.sqrt(norms) + largest**0.5 + 1)
    bound = np.abs(distances(lift, tree["upper"])[:, tree["parents"]] - tree["to_parent"])  # at least so far from the page's routing object
    far = distances(lift, tree["upper"])[:, tree["parents"]] + tree["to_parent"]  # at most
    bound = np.maximum(np.maximum(bound - tree["high"], tree["low"] - far), 0)
    begins, count = np.concatenate(([0], tree["ends"][:-1])), 0

    def visit(page: int, rows: np.ndarray) -> None:
        nonlocal count
        rows = rows[bound[rows, page] <= reach[rows] + slack[rows]]
        if not len(rows):
            return
        d = distances(lift[rows], tree["pivots"][page : page + 1])[:, 0]
        there = (d - tree["high"][page] <= reach[rows] + slack[rows]) & (tree["low"][page] - d <= reach[rows] + slack[rows])
        rows, d = rows[there], d[there]
        if not len(rows):
            return
        at = np.arange(begins[page], tree["ends"][page])
        needed = np.abs(d[:, None] - tree["entry"][at]) <= (reach[rows] + slack[rows])[:, None]
        at = at[needed.any(axis=0)]
        got = (q[rows] @ x[at].T).astype(np.int64)
        count += got.size
        own = qids[rows][:, None] == ids[at]
        better = ((got >= best[rows, -1:]) & ~own).any(axis=1)
        rows, got, own = rows[better], got[better], own[better]
        if not len(rows):
            return
        got[own] = none
        scores = np.hstack([best[rows], got])
        names = np.hstack([who[rows], np.where(own, np.iinfo(np.int64).max, ids[at])])
        order = np.lexsort((names, -(scores.astype(float)) if kind is float else ~scores), axis=1)[:, :k]
        best[rows], who[rows] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(names, order, axis=1)
        full = best[rows, -1] > none
        reach[rows[full]] = np.sqrt(np.maximum(norms[rows[full]] + largest - 2.0 * best[rows[full], -1], 0))

    early = min(EARLY, bound.shape[1])
    order = np.argpartition(bound, early - 1, axis=1)[:, :early] if early < bound.shape[1] else np.argsort(bound, axis=1)
    for turn in range(early):
        for page in np.unique(order[:, turn]):
            visit(page, np.flatnonzero(order[:, turn] == page))
    seen = np.zeros(bound.shape, bool)
    np.put_along_axis(seen, order, True, axis=1)
    for page in np.argsort(bound.min(axis=0)):
        visit(page, np.flatnonzero(~seen[:, page]))
    return best, who, count


def packed(rows: DataFrame, keys: list[str], tree: bool) -> DataFrame:
    """One row for each key: its vectors as an M-tree, or as plain arrays."""
    schema = rows.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", data binary"

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        x = group["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        data = to_bytes(**(build(ids, x) if tree else {"ids": ids, "x": x}))
        return pa.table({k: [v.as_py()] for k, v in zip(keys, key, strict=True)} | {"data": [data]}).cast(pa.schema([(k, pa.int32()) for k in keys] + [("data", pa.binary())]))

    return rows.groupBy(*keys).applyInArrow(run, schema)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", part: int | None = None, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products with all rows but its own, ties to the smaller identifier.

    Vectors are ``quantised``. Rows without an identifier, and vectors that are null or empty or hold a component that is null, not
    finite or beyond a long, take no part. Vectors meet those of their own length. Rows that repeat an identifier are candidates each,
    none for their own query, which is asked once, with the largest vector if they differ. No rows give no rows. Parts are as large
    as gives each task two, within bounds, unless ``part`` says how large: queries are sent to every part, so fewer are better.
    """
    spark = rows.sparkSession
    clean = rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    clean = written(clean.filter("id is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v")), "vectors")
    n, asked = clean.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    part = part or min(LARGEST, max(PART, n // (2 * tasks(spark))))
    parts, blocks = max(1, -(-n // part)), max(1, -(-(asked or 0) // block))
    trees = packed(clean.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).select("dim", "part", "id", "v"), ["dim", "part"], True)
    queries = clean.filter("asks").groupBy("dim", "id").agg(F.max("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    queries = packed(queries.select("dim", "block", "id", "v"), ["dim", "block"], False)
    asked_of = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    sent = trees.select("dim", "part", F.lit(False).alias("asks"), "data").unionByName(queries.select("dim", asked_of, F.lit(True).alias("asks"), "data"))
    sent = sent.repartition("dim", "part").sortWithinPartitions("dim", "part", "asks")  # a tree comes before its queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, {}
        for batch in batches:
            for dim, number, asks, data in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                if not asks:
                    held, tree = (dim, number), from_bytes(data.as_py())
                elif held == (dim, number):  # else no vector of that length is in the part
                    q = from_bytes(data.as_py())
                    best, who, _ = search(tree, q["ids"], q["x"], k)
                    row, col = np.nonzero(who < np.iinfo(np.int64).max)
                    yield pa.RecordBatch.from_pydict({"query_id": q["ids"][row], "vec_id": who[row, col], "score": best[row, col]})

    found = sent.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
