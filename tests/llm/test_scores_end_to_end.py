"""The classifier queries against plain versions of them, on small tables with every odd row."""

import math
import zlib

import numpy as np
import pytest
import zstandard

from codeloom.llm import quality, toxicity
from codeloom.llm.sampling import labelled
from tests_llm_corpus import labelled_corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("scores"))
    corpus = labelled_corpus(260)
    rows = [(i, t, 1, "x") for i, (t, _, _) in enumerate(corpus)]
    rows += [(899, "a", 1, "x"), (900, None, 1, "x"), (901, "", 1, "x"), (902, " \n", 1, "x"), (903, "あ @$$ " * 3000, 1, "x"), (None, "no id", 1, "x"), (5, corpus[5][0], 1, "x"), (5, "another text of one id", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score int, y string").write.parquet(f"{root}/documents.parquet")
    labels = [(i, q, x) for i, (_, q, x) in enumerate(corpus) if i % 7] + [(7000, 1, 1), (None, 1, 1), (3, None, None), (8, 1, 0), (8, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{root}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/none/labels.parquet")
    return root, rows


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def check(got, rows, scores, threshold):
    assert len(got) == len(rows)
    want = sorted((repr((i, held_out(i))), s) for (i, *_), s in zip(rows, scores))
    have = sorted((repr((r.doc_id, r.held_out)), r.score) for r in got)
    assert [k for k, _ in have] == [k for k, _ in want]
    assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-4)
    assert all(r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in got)


def plain_toxicity(model, text):
    """One window and one step at a time."""
    net, words = model.net, toxicity.words(text or "")
    h, best = toxicity.HIDDEN, -math.inf if words else model.lowest
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(words):
        starts.append(starts[-1] + toxicity.STRIDE)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for a in starts if words else ():
        window = words[a : a + toxicity.WINDOW]
        of = toxicity.layout(window)
        x = net.embed(model.tables.inputs(of), of)
        states = np.zeros((len(window), 2 * h))
        for i in (0, 1):
            s = np.zeros(h)
            for k in range(len(window)) if i == 0 else reversed(range(len(window))):
                g = x[k] @ net.p[f"wx{i}"] + net.p[f"b{i}"]
                wh = net.p[f"wh{i}"]
                z, r = sigmoid(g[:h] + s @ wh[:, :h]), sigmoid(g[h : 2 * h] + s @ wh[:, h : 2 * h])
                c = np.tanh(g[2 * h :] + (r * s) @ wh[:, 2 * h :])
                s = s + z * (c - s)
                states[k, i * h : i * h + h] = s
        weight = np.exp(np.tanh(states @ net.p["u"]) @ net.p["v"])
        pooled = (weight / weight.sum()) @ states
        best = max(best, float(pooled @ net.p["w"] + net.p["c"][0]))
    w = model.calibration
    return 1 / (1 + math.exp(-max(-30, min(30, w[0] * best + w[1] * math.log(len(starts)) + w[2]))))


def test_toxicity_query_equals_a_plain_network(spark, tables):
    root, rows = tables
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(*labelled(docs, labels, "toxic", toxicity.PER_CLASS))
    got = toxicity.op2_toxicity(spark, root).collect()
    check(got, rows, [plain_toxicity(model, t) for _, t, *_ in rows], toxicity.THRESHOLD)
    assert len(model.score(["a", "", "b c"])) == 3  # fewer characters than the longest n-gram
    assert {r.doc_id: r.predicted for r in got}[900] == {r.doc_id: r.predicted for r in got}[901] == 0
    assert toxicity.op2_toxicity(spark, f"{root}/none").count() == 0


def test_quality_query_equals_plain_compression(spark, tables):
    root, rows = tables
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(*labelled(docs, labels, "quality", quality.PER_CLASS))

    def size(text, d=None):
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False).compress(text)) if text else 0

    scores = []
    for _, t, *_ in rows:
        t = (t or "").encode()
        n, b, g, p = len(t), size(t, model.dicts[0]), size(t, model.dicts[1]), size(t)
        d, length = (b - g) / max(n, 1), math.log1p(n)
        x = np.array([d, (b - g) / max(b + g, 1), d * length, g / max(n, 1), p / max(n, 1), length])
        x = np.clip((x - model.mean) / model.scale, -8, 8)
        scores.append(1 / (1 + math.exp(-max(-30, min(30, float(x @ model.w[:-1] + model.w[-1]))))))
    check(quality.op5_quality(spark, root).collect(), rows, scores, quality.THRESHOLD)
    assert quality.op5_quality(spark, f"{root}/none").count() == 0


def test_samples_take_one_text_and_label_an_id(spark, tables):
    root, _ = tables
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    rows, rate = labelled(docs, labels, "toxic", 10)
    assert len(rows) == 20 and sum(y for _, y in rows) == 10 and 0.2 < rate < 0.5
    every, _ = labelled(docs, labels, "toxic", 10_000)
    assert len([t for t, _ in every if t == "another text of one id"]) + len([t for t, _ in every if t == labelled_corpus(260)[5][0]]) <= 1
