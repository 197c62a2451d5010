import math
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomql.llm import language, licence_texts, licences, quality
from loomql.llm.shared import fitting_rows, read_table

SF = "/root/testdata/sf0.01"


def test_network_against_plain_convolution():
    rng = np.random.default_rng(1)
    model = {"w": rng.standard_normal((quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), "b": rng.standard_normal(quality.FILTERS).astype(np.float32), "u": rng.standard_normal(2 * quality.FILTERS), "c": np.array([0.3])}
    texts = [b"", b"a", bytes(rng.integers(0, 256, 255, np.uint8)), bytes(rng.integers(0, 256, 256, np.uint8)), bytes(rng.integers(0, 256, 5000, np.uint8))]
    got = quality.score(model, texts)
    for text, p in zip(texts, got):
        n = -(-(len(text) + quality.WIDTH - 1) // quality.STRIDE)
        data = (bytes(quality.WIDTH - 1) + text).ljust(n * quality.STRIDE, b"\0")
        out = []
        for s in range(n):  # the last filter places look into the next stride
            part = (data + bytes(quality.WIDTH))[s * quality.STRIDE : (s + 1) * quality.STRIDE + quality.WIDTH]
            out.append(np.max([sum(model["w"][j][part[i + j]] for j in range(quality.WIDTH)) for i in range(quality.STRIDE)], axis=0))
        top = np.maximum(np.array(out) + model["b"], 0)
        chunks = np.array([np.maximum(top[i], top[min(i + 1, n - 1)]) for i in range(n)])
        want = quality.sigmoid(np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)]) @ model["u"] + model["c"])
        assert abs(p - want[0]) < 1e-4


def test_quality_on_held_out_labels(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    found = quality.quality_scores(docs, labels)
    held = found.join(labels, "doc_id").filter("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.97
    clean = held[held.quality == 1]
    assert (clean.predicted == 1).mean() > 0.98 and found.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.limit(50).collect())
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == found.filter("predicted = 1").count()


def test_quality_edge_rows(spark):
    labels = read_table(spark, SF, "labels")
    docs = read_table(spark, SF, "documents").withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    odd = spark.createDataFrame([(10**6, None, "x", 1), (10**6, "", "x", 1), (None, "z" * 100_000, "x", 1), (None, "\x00", "x", 1)], "doc_id long, text string, score string, id int")
    rows = quality.quality_scores(docs.select("doc_id", "text", "score", "id").unionByName(odd), labels).filter("doc_id is null or doc_id = 1000000").collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.quality_scores(odd, labels.limit(0)).filter("score = 0.5").count() == 4
    assert quality.quality_scores(odd.limit(0), labels).collect() == []


def test_language(spark):
    pages, docs = read_table(spark, SF, "pages"), read_table(spark, SF, "documents")
    got = language.identify(pages.withColumn("host", F.lit(1)).withColumn("p0", F.lit(2)), language.train(docs))
    both = got.join(pages.withColumn("truth", F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)), "page_id").toPandas()
    assert len(both) == pages.count() and (both.lang == both.truth).mean() > 0.98
    schema = "page_id long, url string, html string"
    german = "<p>" + "Heit der und schen die beunger ist nicht für auf den sich mit ein dem " * 3
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (2, "::", ""), (None, "http://x.example.fr/", '<html lang="fr">'), (4, "http://y.de/a", german)], schema)
    rows = language.identify(odd, language.train(docs)).collect()
    assert len(rows) == 5 and all(r.lang in ("de", "en", "es", "fr") and 0 < r.probability <= 1 for r in rows)
    assert next(r for r in rows if r.page_id == 4).lang == "de" and next(r for r in rows if r.page_id is None).declared == "fr"
    assert language.identify(odd.limit(0), language.train(docs)).collect() == []
    assert all(r.lang is None for r in language.identify(odd, language.train(docs.limit(0))).collect())


def test_language_of_documents(spark):
    pages, docs = read_table(spark, SF, "pages"), read_table(spark, SF, "documents")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6, "", "xx", "s", 0), (None, "der die das und ist nicht " * 9, "xx", "s", 0)], docs.schema)
    got = language.identify_all(pages, docs.unionByName(extra))
    both = got.join(docs.withColumnRenamed("lang", "truth"), "doc_id").toPandas()
    assert got.count() == docs.count() + pages.count() + 3 and len(both) == docs.count() and (both.lang == both.truth).mean() > 0.98


def test_page_parts():
    assert language.page_parts("https://u:p@WWW.A.example.com:8080/x?y", '<HTML class=a LANG="de-AT"><script>if(a<b)</script><p>A&amp;B<!-- c --></p>') == ("www.a.example.com", "de", "   A&B  ")
    assert language.page_parts("no address", "") == ("", "none", "")
    assert language.page_parts(None, "1 < 2 and <b>3</b> <script>x") == ("", "none", "1 < 2 and  3   ")
    assert language.page_parts(None, '<html><p lang="fr"><html lang=de>')[1] == "none" and language.page_parts(None, "<html data-lang=fr xml:lang='pt-BR'>")[1] == "pt"
    assert language.page_parts(None, "\u0130<style>a</STYLE >b<!-- c")[2] == "\u0130 b "


@pytest.mark.parametrize("part", ["<script>", "<!--", "<html ", "<", "</script", "<html lang=", "\u0130<template "])
def test_broken_markup_in_linear_time(part):
    page = part * (10_000_000 // len(part))
    began = time.perf_counter()
    language.page_parts("http://a.b/", page)
    assert time.perf_counter() - began < 1


def fused(rows, model):
    """The posterior of each (id, host, declared, text) by hand."""
    names, table = model
    n = len(names)
    soft = lambda z: (lambda e: [x / sum(e) for x in e])([math.exp(x - max(z)) for x in z])
    w, p, keys = [], [], []
    for _, host, declared, text in rows:
        cells = language.trigrams(text)
        z = [sum(table[i][c] for c in cells) for i in range(n)]
        w.append([(x - max(z)) * min(1, language.EVIDENCE / max(1, len(cells))) for x in z])
        p.append(soft(w[-1]))
        labels = host.split(".")
        own = 3 if ".".join(labels[-2:]) in language.SECOND_LEVEL else 2
        keys.append((host, ".".join(labels[-own:]), labels[-1] if len(labels) > 1 else "", declared))
    total = [sum(x[i] for x in p) + language.ADDED for i in range(n)]
    over = [x / sum(total) for x in total]
    out = []
    for r in range(len(rows)):
        z = []
        for i in range(n):
            same = lambda k: [p[j][i] for j in range(len(rows)) if keys[j][k] == keys[r][k]]  # noqa: B023, E731
            of_domain = (sum(same(1)) - p[r][i] + language.DOMAIN_WEIGHT * over[i]) / (len(same(1)) - 1 + language.DOMAIN_WEIGHT)
            of_host = (sum(same(0)) - p[r][i] + language.HOST_WEIGHT * of_domain) / (len(same(0)) - 1 + language.HOST_WEIGHT)
            z.append(w[r][i] + sum(math.log((sum(same(k)) + language.ADDED) / total[i]) for k in (2, 3)) + math.log(max(of_host, 1e-9)))
        q = soft(z)
        out.append((rows[r][0], names[q.index(max(q))], max(q)))
    return out


def test_fusion_against_plain_version(spark):
    model = language.fit(["the and of to in the and", "der die das und ist die der", "el la que de los la el"], ["en", "de", "es"])
    rows = [(1, "a.example.co.uk", "en", "the and of"), (2, "a.example.co.uk", "en", "zzz"), (3, "b.example.co.uk", "none", ""), (4, "c.other.co.uk", "none", "der die das"), (5, "x.de", "de", "the"), (6, "y.de", "de", "die der und"), (7, "", "none", ""), (8, "x.museum", "none", "la que"), (8, "x.museum", "none", "la que"), (9, "x.xn--p1ai", "es", "qq")]
    pages = spark.createDataFrame([(i, f"http://{h}/p" if h else None, (f"<html lang={d}>" if d != "none" else "") + t) for i, h, d, t in rows], "page_id long, url string, html string")
    got = sorted((r.page_id, r.lang, r.probability) for r in language.identify(pages, model).collect())
    want = sorted(fused([(i, h, d, (" " if d != "none" else "") + t) for i, h, d, t in rows], model))
    assert [g[:2] for g in got] == [w[:2] for w in want] and max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 1e-9
    alike = language.fit(["ab", "ab"], ["y", "x"])  # nothing tells the languages apart: the first in order
    assert {r.lang for r in language.identify(pages, alike).collect()} == {"x"}


def test_language_on_documents_left_out(spark):
    docs = read_table(spark, SF, "documents")
    left_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = language.identify(docs.filter(left_out), language.train(docs.filter(~left_out)), "doc_id", "source", "text", language.document_parts)
    both = got.join(docs.withColumnRenamed("lang", "truth"), "doc_id").toPandas()
    assert len(both) > 300 and (both.lang == both.truth).mean() > 0.98 and (both.text_lang == both.truth).mean() > 0.97


def test_fitting_rows_are_bounded(spark):
    rows = [(i % 5, f"text {i} of its own") for i in range(5000)] + [(7, "x" * 2000), (8, None), (9, "")]
    frame = spark.createDataFrame(rows, "id long, text string")
    got = fitting_rows(frame, "id", "text", 1600)
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4, 9]
    assert len(fitting_rows(frame, "id", "text", 30 * 16)) == 6 and sum(len(r.text) for r in fitting_rows(frame, "id", "text", 40)) <= 40
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(3, 0)] * 50, "doc_id long, quality int")
    docs = spark.createDataFrame([(i % 9, f"text {i}") for i in range(900)], "doc_id long, text string")
    assert quality.quality_scores(docs, labels, sample=1).count() == 900


def test_licences(spark):
    docs = read_table(spark, SF, "documents")
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    model = licences.train(docs)
    got = {r.doc_id: {f.family for f in r.findings if f.confirmed} for r in licences.findings(docs, model=model).collect()}
    for d in docs.collect():
        assert got[d.doc_id] == {v for k, v in lines.items() if k in d.text}
    extra = [(1, "Intro\n\n" + t, "x") for ts in licence_texts.TEXTS.values() for t in ts] + [(1, f"Intro\n\nReleased under the {n}.", "x") for ns in licence_texts.NAMES.values() for n in ns]
    extra += [(2, t, "x") for t in licence_texts.TALK] + [(3, None, "x"), (3, "", "x"), (None, "\n\n", "x"), (4, "word " * 100_000, "x")]
    families = [f for f, ts in licence_texts.TEXTS.items() for _ in ts] + [f for f, ns in licence_texts.NAMES.items() for _ in ns]
    rows = licences.findings(spark.createDataFrame([(i if d == 1 else -d if d else None, t, x) for i, (d, t, x) in enumerate(extra)], "doc_id long, text string, findings string"), model=model).collect()
    assert len(rows) == len(extra)
    for r in rows:
        good = {(f.paragraph, f.family) for f in r.findings if f.confirmed}
        assert (1, families[r.doc_id]) in good if r.doc_id is not None and r.doc_id >= 0 else not good, (r, extra[r.doc_id or 0])
    assert licences.scan(docs.limit(0)).collect() == []
