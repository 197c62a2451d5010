import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomql.llm import metric_search as ms

SCHEMA = "vec_id long, embedding array<float>, id string, score int, dim string"


def plain(rows, k):
    clean = []
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v):
            clean.append((key, [math.floor(64 * float(np.float32(x))) for x in v]))
    asked = {}
    for key, v in clean:
        if key % 20 == 0 and (key not in asked or v > asked[key]):
            asked[key] = v
    out = []
    for key, q in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in clean if i != key and len(v) == len(q))
        out += [(key, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_against_plain_version(spark, monkeypatch):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(700, 760)] + [(760, [0.0] * 6), (780, [1.0, 2.0]), (781, [3.0, 4.0]), (800, [9.0] * 3)]
    rows += [(None, [1.0] * 6), (820, None), (840, []), (860, [1.0, None] + [0.0] * 4), (880, [float("nan")] * 6), (900, [float("inf")] * 6), (901, [-float("inf")] * 6), (20, [2.0] * 6), (40, [30.0] * 6)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    for part, block in ((10_000, 1000), (60, 7)):
        got = ms.top_k(frame, F.col("vec_id") % 20 == 0, part=part, block=block).collect()
        assert sorted(map(tuple, got)) == plain(rows, 20)
    few = ms.top_k(frame.filter("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, few.collect())) == plain([r for r in rows if r[0] is not None and r[0] < 5], 20)


def test_bounds_save_work():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-3, 4, (500, 8)) + c for c in rng.integers(-400, 400, (16, 8))]).astype(np.int64)
    ids = np.arange(len(x))
    best, who, count = ms.search(ms.build(ids, x), ids[::20], x[::20], 20)
    g = x[::20] @ x.T
    g[np.arange(len(g)), ids[::20]] = np.iinfo(np.int64).min
    order = np.lexsort((np.broadcast_to(ids, g.shape), ~g), axis=1)[:, :20]
    assert (who == order).all() and count < 0.5 * len(x) * len(g)


def test_large_components():
    x = np.array([[1 << 28, 3], [1 << 28, 2], [(1 << 28) + 1, -5]])
    best, who, _ = ms.search(ms.build(np.arange(3), x), np.array([9]), x[:1], 2)
    assert best.tolist() == [sorted((x @ x[0]).tolist())[::-1][:2]]


def test_no_rows(spark):
    assert ms.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
