"""The pipeline's stages, each held against a plain version of its decision on its own input, and the run as a whole."""

import random

import pytest

import corpus_pipeline
from codeloom.llm import decontaminate, mixing, pii, toxicity
from codeloom.llm.common import materialize, table
from test_python_ops import classes_by_brute_force, edit_distance
from tests_llm_corpus import labelled_corpus

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with toxic ones, copies, near copies, leaked items, personal data, empty texts, repeated ids and a clashing column."""
    root, r = str(tmp_path_factory.mktemp("pipe")), random.Random(4)
    corpus = labelled_corpus(150)
    items = ["The quick harbour master counts eleven crates before the tide", "Seven grey engines idle beside the northern grain silo at noon"]
    texts = [t for t, _, _ in corpus]
    clean = [t for t, _, x in corpus if not x]
    for i in range(12):
        base = clean[i].split()
        base[r.randrange(len(base))] = "changed"
        texts += [" ".join(base), clean[i + 20] + f" mail me at user{i}@mail.com or 10.0.0.{i}", clean[i + 40][:40] + " " + items[i % 2].upper().replace("E", "e", 1) + " " + clean[i + 40][40:]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t), "k") for i, t in enumerate(texts)]
    rows += [(500, None, "en", "s1", None, "k"), (501, "", "en", "s1", 0, "k"), (502, "  ", "en", "s2", 2, "k"), (0, texts[0], "en", "s0", 1, "k"), (1, "one id with two texts is two documents here", "en", "s1", 1, "k"), (None, "a row without an id stays", "en", "s1", 1, "k")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, (_, q, x) in enumerate(corpus)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs, steps = table(spark, root, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, root), "test-stage")
        steps[name] = (docs, out)
        docs = out
    return root, steps


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_toxicity_keeps_what_scores_below_the_threshold(spark, small):
    before, after = small[1]["toxicity"]
    model = toxicity.fitted(before, table(spark, small[0], "labels"))
    assert rows(after) == [(i, t) for i, t in rows(before) if model.score([t or ""])[0] < toxicity.THRESHOLD]
    gone = [t for i, t in rows(before) if (i, t) not in rows(after)]
    assert gone and sum("zorg" in t for t in gone) / len(gone) > 0.85 and sum("zorg" in (t or "") for _, t in rows(after)) < 4


def test_dedup_keeps_one_of_each_class(small):
    before, after = small[1]["dedup"]
    every = rows(before)
    # Rows are named by their places here, so that repeated ids do not mix.
    classes = classes_by_brute_force([(k, t) for k, (_, t) in enumerate(every)])
    members = {}
    for k, n, c in classes:
        members.setdefault(c if n else ("alone", k), []).append(k)
    low = lambda k: (every[k][0] is None, every[k][0] or 0)
    kept = rows(after)
    assert len(kept) == len(members) < len(every)
    for group in members.values():
        ids = [every[k] for k in group if low(k) == min(map(low, group))]
        assert sum(x in kept for x in set(ids)) == 1 or len(group) == 1 and ids[0] in kept


def test_decontamination_by_edit_distance(spark, small):
    before, after = small[1]["decontaminate"]
    items = [decontaminate.normal(r.text) for r in table(spark, small[0], "benchmark").collect()]
    leaks = lambda t: any(edit_distance(i, decontaminate.normal(t)) <= decontaminate.budget(len(i)) for i in items) if t and t.strip() else False
    assert rows(after) == [(i, t) for i, t in rows(before) if not leaks(t)] and len(rows(after)) < len(rows(before))


def test_pii_replaces_every_span(small):
    before, after = small[1]["pii"]
    assert after.count() == before.count()
    spans = {(r.doc_id, r.text): sorted((s.start, -s.end, k) for k in pii.PATTERNS for s in r[f"s_{k}"]) for r in pii.find(before, keep=("doc_id", "text")).collect()}
    want = []
    for (i, t), found in spans.items():
        out, pos = "", 0
        for start, back, kind in found:
            if start >= pos:
                out += t[pos:start] + f"<{kind.upper()}>"
            pos = max(pos, -back)
        want.append((i, out + t[pos:] if found else t))
    assert rows(after) == sorted(want, key=repr) and not any("@mail.com" in (t or "") for _, t in rows(after))


def test_mixing_takes_what_its_targets_allow(small):
    before, after = small[1]["mixing"]
    got = after.collect()
    taken = {}
    for r in got:
        assert 0 < r.taken <= 3 * r["size"] and r["size"] == len([w for w in (r.text or "").split()]) and r.key == "k"
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in mixing.targets(mixing.sizes(before)).collect():
        assert taken.get(r.source, 0) == pytest.approx(r.target, abs=60)  # rows that are equal share the rest


def test_stages_return_the_columns_of_documents(spark, small):
    for name, (before, after) in small[1].items():
        assert after.columns[: len(before.columns)] == before.columns, name
    assert sorted(map(tuple, corpus_pipeline.run(spark, small[0]).collect()), key=repr) == sorted(map(tuple, small[1]["mixing"][1].collect()), key=repr)


def test_run_on_given_tables(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(0 < r.taken <= 3 * r["size"] for r in out)
