import hashlib
import random
import re
import tracemalloc
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomql.llm import substring_dedup as sd
from loomql.llm.shared import HANDED, giving_back, settled, written

SCHEMA = "doc_id long, text string, hash string, id int, kept string"


def plain(rows):
    """(doc_id, text) to (words, removed words, kept digest); windows at one place of one doc_id are no copies of each other."""
    least = {}
    split = [((i is None, i or 0), (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            least[k] = min(least.get(k, (i, s)), (i, s))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if least[tuple(w[s : s + 20])] < (i, s):
                gone[s : s + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((None if i[0] else i[1], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n, v=400: [f"w{rng.randint(0, v)}" for _ in range(n)]
    passages = [words(n) for n in (19, 20, 21, 25, 39, 60)]
    rows = []
    for i in range(120):
        parts = [words(rng.randint(0, 70)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts.insert(rng.randint(0, 3), p)
        rows.append((i * 7 % 121, rng.choice([" ", "\n", " \t"]).join(x for p in parts for x in p)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "same " * 300), (204, rows[3][1]), (205, rows[3][1] + " more"), rows[5], rows[5], (5000, "é ü " * 45), (None, rows[8][1]), (None, "short")]
    return rows


@pytest.mark.parametrize("batch", [sd.BATCH, 2000, 1])
def test_against_plain_version(spark, monkeypatch, batch):
    monkeypatch.setattr(sd, "BATCH", batch)
    rows = corpus(batch)
    got = sd.substring_groups(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got), key=key) == sorted(plain(rows), key=key)
    assert all(sum(s.words for s in g.spans or []) == g.n_removed for g in got)


def test_two_texts_of_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b + " " + a), (2, b)]
    got = sd.substring_groups(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)).collect()
    assert sorted((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got) == sorted(plain(rows))


def test_texts_after_removal(spark):
    rows = corpus(9)[:60]
    frame = sd.substring_dedup(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA))
    want = {r[0]: p for r, p in zip(rows, plain(rows))}
    before = dict(rows)
    assert frame.columns == ["doc_id", "text", "hash", "id", "kept"]
    for r in frame.collect():
        assert r.text == before[r.doc_id] if not want[r.doc_id][2] else hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]


def test_identifiers_of_any_size_and_type(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    rows = [((1 << 63) - 1, words[0]), (-(1 << 63), words[1]), (None, words[0] + " " + words[1]), (0, words[1]), ((1 << 63) - 1, words[0])]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    for schema in (SCHEMA, SCHEMA.replace("doc_id long", "doc_id string"), SCHEMA.replace("doc_id long", "doc_id decimal(20,0)")):
        names = {i: i for i, _ in rows}
        if "doc_id string" in schema:
            names = {(1 << 63) - 1: "c", -(1 << 63): "a", None: None, 0: "b"}
        elif "decimal" in schema:
            names = {i: i if i is None else Decimal(i) for i in names}
        frame = spark.createDataFrame([(names[i], t, "x", 1, "y") for i, t in rows], schema)
        got = [(g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in sd.substring_groups(frame).collect()]
        back = {v: k for k, v in names.items()}
        assert sorted(((back[g[0]], *g[1:]) for g in got), key=key) == sorted(plain(rows), key=key)
        assert sum(len((r.text or "").split()) for r in sd.substring_dedup(frame).collect()) == sum(g[1] - g[2] for g in got)


def test_no_rows(spark):
    assert sd.substring_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_memory_of_a_batch():
    """Bytes held at once for each word of a batch: by its hashes, and by its windows if all of them hold an anchor."""
    text = b" ".join(b"w%d" % (i % 500) for i in range(2000))
    texts, hashes = [text] * 100, sd.WordHashes()
    docs = [{"id": i, "hash": 0, "anchors": sd.bits(np.ones(200, bool))} for i in range(100)]
    sd.laid_out(texts, hashes)
    for make, most in ((lambda: sd.laid_out(texts, hashes), 24), (lambda: sd.Windows(texts, docs, hashes), 100)):
        tracemalloc.start()
        made = make()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made and peak < most * 200_000


def test_rows_go_to_python_in_parts(spark):
    rows = spark.range(4000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 60).alias("text")).coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [len(b)], "bytes": [b.nbytes]})

    for made in (written(rows.mapInArrow(run, "rows long, bytes long"), "parts"), settled(lambda: rows.mapInArrow(run, "rows long, bytes long"), "parts")):
        got = made.collect()
        assert sum(r.rows for r in got) == 4000 and max(r.bytes for r in got) < HANDED + 10_000
        assert spark.conf.get(key, None) is None


def test_freed_memory_goes_back():
    """What a worker still has when its next task begins, after one that freed many small objects below one that stays."""

    def held():
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024

    def run(batches):
        for _ in batches:
            before = held()
            much = [bytes(600) for _ in range(200_000)]
            kept.append(bytes(600))
            del much
            yield pa.RecordBatch.from_pydict({"before": [before]})

    kept = []
    [first] = [b["before"][0].as_py() for b in giving_back(run)(iter([None]))]
    assert held() < first + 40
