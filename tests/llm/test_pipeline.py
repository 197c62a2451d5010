"""The pipeline's stages, each against a plain version on what the stage before kept."""

import hashlib
import os
import re
import time

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from loomql.llm import queries, simhash
from loomql.llm.shared import read_table, written
from tests.llm.test_near_copies import plain as near_copies
from tests.llm.test_simhash import plain as fingerprint
from tests.llm.test_substring_dedup import plain as removed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        out.append((docs, written(stage(spark, docs, SF), "stage")))
        docs = out[-1][1]
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages(stages, spark):
    first = read_table(spark, SF, "documents")
    assert all(after.columns == first.columns for _, after in stages[:4])
    before, after = (texts(f) for f in stages[0])
    scores = {r.doc_id: r.predicted for r in queries.op9_quality(spark, SF).collect()}
    assert after == {k: t for k, t in before.items() if scores[k] == 1}

    before, after = (texts(f) for f in stages[1])
    least = {}
    for k, t in before.items():
        c = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        least[c] = min(least.get(c, k), k)
    assert after == {k: before[k] for k in least.values()}

    before, after = (texts(f) for f in stages[2])
    assert after == {k: before[k] for k in near_copies(before)}

    before, after = (texts(f) for f in stages[3])
    want = {k: (n, h) for k, _, n, h in removed(list(before.items()))}
    assert set(after) == set(before) and all(after[k] == before[k] if not want[k][0] else hashlib.sha256(after[k].encode()).hexdigest() == want[k][1] for k in after)

    packed = stages[4][1].collect()
    assert {r.doc_id for r in packed} == set(after) and sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_run(stages, spark):
    assert cp.run(spark, SF).count() == stages[4][1].count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeats, clashing columns and none for the size, through all stages; and an empty table."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    prose = real.filter("length(text) > 300").orderBy("doc_id").first().text
    rows = [(None, None), (None, ""), (None, prose + " and more"), (900, prose + " and more"), (900, prose + " and more"), (901, long), (901, long), (902, " \n"), ((1 << 63) - 1, long + " end")]
    schema = "doc_id long, text string"
    docs = real.unionByName(spark.createDataFrame(rows, schema)).selectExpr("doc_id", "text", "'a' AS id", "2 AS hash", "true AS kept", "'n' AS node", "1.5D AS root")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (str(r.doc_id), r.text or "")
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == docs.columns and all((r.id, r.hash, r.kept, r.node, r.root) == ("a", 2, True, "n", 1.5) for r in out.collect())
        assert stage(spark, frame.limit(0), str(tmp_path)).collect() == []
    exact = sorted(map(key, cp.drop_exact_copies(spark, frame, "").collect()))
    assert len(exact) == len({t for _, t in exact}) and ("900", prose + " and more") in exact and ("901", long) in exact and ("902", " \n") in exact
    near = {key(r) for r in cp.drop_near_copies(spark, frame, "").collect()}
    assert (str((1 << 63) - 1), long + " end") not in near and ("901", long) in near and len([k for k in near if k[0] == "901"]) == 1
    cut = [key(r) for r in cp.cut_repeats(spark, frame, "").collect()]
    assert len(cut) == frame.count() and sum(len(t.split()) for k, t in cut if k == str((1 << 63) - 1)) < 20
    assert cp.pack_sequences(spark, frame.limit(0), "").collect() == [] and cp.pack_sequences(spark, frame, "").select("doc_id").filter("doc_id = 901").count() >= 2
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_near_copies_go(spark):
    words = [f"w{i}" for i in range(3000)]
    whole = fingerprint(" ".join(words))
    copies = (" ".join([*words[:i], "new", *words[i + 1 :]]) for i in range(3000))
    copy = next(c for c in copies if 0 < (fingerprint(c) ^ whole).bit_count() <= 2)
    rows = [(5, " ".join(words)), (7, copy), (9, " ".join(words[::-1]))]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 9]


def test_heaps_are_given_back_before_each_stage(spark, monkeypatch):
    calls = []

    def stage(session, docs, sf_dir):
        beans = session._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        calls.append(sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()))
        return docs

    docs = read_table(spark, SF, "documents")
    assert cp.afresh(stage)(spark, docs, SF) is docs
    assert cp.afresh(stage)(spark, docs, SF) is docs
    assert calls[1] > calls[0]

    class Given(Exception):
        pass

    def given(session):
        raise Given

    monkeypatch.setattr(cp, "give_back_heap", given)
    for _, stage in cp.STAGES:
        with pytest.raises(Given):
            stage(spark, docs, SF)


def test_shuffle_files_of_a_written_step_go(spark):
    folders = [d.getAbsolutePath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    rows, before = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), shuffled()
    table, end = written(rows, "counts"), time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == rows.count() == 1000
