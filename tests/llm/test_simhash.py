import random
import re

import xxhash
from pyspark.sql import functions as F

from loomql.llm import simhash

SCHEMA = "doc_id long, text string, id string, fp long, component_id string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprint():
    for text in ("", " \t\n", "One", "one two", "a b c", "É B c\x0bd A b C", "x y z w " * 40, "w" * 100_000):
        assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint(b"A b C d") == simhash.fingerprint(b"a B c D")


def test_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(900)]
    texts = [None, "", "  ", "one", "One", "a b c d e f g"]
    for _ in range(60):
        words = list(base)
        words[rng.randrange(900)] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(words))
    rows = [(i * 3 % 67, t, "x", 1, "y") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "one", "x", 1, "y"), (None, "alone in the world", "x", 1, "y")]
    fps = [plain(r[1]) for r in rows]
    root = roots(set(fps))
    assert len(set(root.values())) < len(set(fps))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    got = simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((tuple(g) for g in got), key=key) == sorted(want, key=key)
    kept = simhash.near_dedup(spark.createDataFrame(rows, SCHEMA))
    alone = [r for r, f in zip(rows, fps) if root[f] not in least]  # no identifier in its component: stays all the same
    key = lambda r: (r is None, r or 0)
    assert len(alone) == 1 and sorted((r.doc_id for r in kept.collect()), key=key) == sorted([*least.values(), None], key=key) and kept.columns == SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")


def test_links_of_crowded_and_common_variants(spark, monkeypatch):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    values |= {rng.getrandbits(64) for _ in range(50)} | {0, 1, 1 << 63, (1 << 64) - 1}
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    want = roots(values)
    for bucket in (1, 2, 10_000):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = {(r.node, r.root) for r in simhash.components(simhash.links(signed)).collect()}
        of = {n % (1 << 64): r for n, r in found}
        for a in values:
            for b in values:
                assert (want[a] == want[b]) == (of.get(a, a) == of.get(b, b))


def test_two_texts_under_one_identifier(spark):
    rows = [(3, "alone here", "x", 1, "y"), (5, "alone here", "x", 1, "y"), (5, "quite another text", "x", 1, "y"), (5, "quite another text", "x", 1, "y")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, "alone here"), (5, "quite another text")]


def test_rows_without_identifier_stay(spark):
    rows = [(None, "one two three four five six"), (None, "quite another text of its own"), (None, "quite another text of its own"), (7, None), (8, "")]
    kept = simhash.near_dedup(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("7", None), ("None", "one two three four five six"), ("None", "quite another text of its own")]


def test_clashing_names(spark):
    schema = "doc_id string, text string, root long, hash string, kept boolean, row int, key int, node string"
    rows = [("a", "one two three", 1, "h", True, 2, 3, "n"), ("b", "one two three", 1, "h", True, 2, 3, "n"), ("b", "one two three", 1, "h", True, 2, 3, "n")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in kept.collect()] == rows[:1]


def test_no_rows(spark):
    assert simhash.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    got = simhash.near_groups(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns[:3] == ["doc_id", "fingerprint", "component_id"]


def test_rows_are_sifted_before_they_are_dealt(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("key"), F.col("id").alias("fp"))
    keys = rows.filter("fp % 1000 = 0").select("key").localCheckpoint()
    kept, threshold = simhash.among(rows, keys), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as with keys that are too many to be sent to all
    try:
        joins = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert len(joins) == 2 and "(key#" in joins[0] and "(word#" in joins[1]  # the outer one comes first
        assert sorted(r.fp for r in kept.collect()) == list(range(0, 200_000, 1000))
    finally:
        spark.conf.set(threshold, before)
