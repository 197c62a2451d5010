import hashlib
import re

from loomql.llm.exact_dedup import exact_dedup, exact_groups

SCHEMA = "doc_id long, text string, digest string, run int, id string, rows long"


def test_against_plain_version(spark):
    texts = [None, "", " ", "\t\n", "a  b", "a b", "a\x0bb ", "a b ", "long " * 50_000, "a b"] * 7
    rows = [(i, t, "d", 1, "i", 2) for i, t in enumerate(texts)] + [(5, "a b", "d", 1, "i", 2), (5, "a b", "e", 1, "i", 2), (None, "a b", "d", 1, "i", 2), (None, "only", "d", 1, "i", 2)]
    clean = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for r, c in zip(rows, clean):
        groups.setdefault(c, []).append(r[0])
    got = exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = []
    for r, c in zip(rows, clean):
        known = [x for x in groups[c] if x is not None]
        want.append((r[0], min(known) if known else None, len(groups[c]), hashlib.sha256(c.encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=key) == sorted(want, key=key)
    kept = [g for g in got if g.kept]
    assert len(kept) == len(groups) and all(g.doc_id == g.keep_id for g in kept)
    frame = exact_dedup(spark.createDataFrame(rows, SCHEMA))
    assert frame.columns == ["doc_id", "text", "digest", "run", "id", "rows"] and frame.count() == len(groups)


def test_no_rows(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
