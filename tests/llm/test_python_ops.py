"""WARC, media, classifiers, decontamination and the n-gram join on small tables and edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codeloom.llm import decontaminate, media, ngram_join, quality, toxicity, warc
from codeloom.llm.common import new_path
from tests_llm_corpus import labelled_corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# ---- WARC


def test_warc_round_trip(spark):
    html = ["<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n", "", None, "é😀\n", "same", "same", "same", "tail\r", "x" * 300_000]
    rows = [(i, f"http://h/{i}\r\nX: y" if i else None, t) for i, t in enumerate(html)]
    rows += [(4, "http://again", "same"), (20, "http://twice", "dup"), (20, "http://twice", "dup"), (None, "http://null", "dup")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload")
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path, chunk_bytes=1000)
    found = warc.read_archives(spark, path)
    got = warc.assemble(found).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.metadata.page_id, []).append(r.response)
    for i in (0, 3, 7, 8):
        assert by[i][0].record_type == "response" and bytes(by[i][0].payload) == html[i].encode()
    assert [by[i][0].record_type for i in (5, 6)] == ["revisit", "response"] and all(r.record_type == "revisit" for r in by[4])
    assert by[5][0].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode() and by[5][0].payload_bytes == 4
    assert [r.record_type for r in by[20]] == ["response", "response"] and by[None][0].record_type == "revisit"
    assert by[1][0].record_type == "revisit" and by[2][0].record_type == "response"  # empty payloads are equal too
    ids = [r.record_id for r in found.collect()]
    assert len(ids) == len(set(ids)) == 3 * len(rows)
    empty = new_path(spark, "warc-empty")
    warc.write_archives(pages.limit(0), empty)


def test_warc_keeps_the_urls_of_one_id_and_payload(spark, tmp_path):
    rows = [(1, "http://a", "x"), (1, "http://b", "x"), (1, None, "x"), (0, "http://c", "x"), (2, "http://d", "y" * 5), (2, "http://d", "y" * 5), (None, "http://e", "y" * 5)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = warc.read_archives(spark, path)
    got = sorted((-1 if r.metadata.page_id is None else r.metadata.page_id, r.response.target_uri, r.response.record_type) for r in warc.assemble(found).collect())
    assert got == [(-1, "http://e", "revisit"), (0, "http://c", "revisit"), (1, "about:blank", "response"), (1, "http://a", "response"), (1, "http://b", "response"), (2, "http://d", "response"), (2, "http://d", "response")]
    named = {r.record_id: r.target_uri for r in found.collect()}
    assert {named[r.refers_to] for r in found.filter("record_type = 'revisit'").collect()} == {"http://b", "http://d"}
    import gzip
    import pathlib

    # Every record is a member of its own, and the files are plain gzip.
    for f in pathlib.Path(path).glob("part-*"):
        data = f.read_bytes()
        records, left = 0, data
        while left:
            z = zlib.decompressobj(31)
            assert z.decompress(left).startswith(b"WARC/1.1") and z.eof
            records, left = records + 1, z.unused_data
        assert records % 3 == 0 and gzip.decompress(data).count(b"WARC/1.1") == records


def test_warc_members_of_16_mb(spark, tmp_path):
    rows = [(i, "http://big", c * n) for i, (c, n) in enumerate([("a", (1 << 24) + 5), ("b", 3), ("c", 1 << 24)])]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, chunk_bytes=1)
    got = {r.page_id: r.payload_bytes for r in warc.assemble(warc.read_archives(spark, path, False)).select("metadata.page_id", "response.payload_bytes").collect()}
    assert got == {i: len(t) for i, _, t in rows}


def test_warc_parser_reads_members_and_plain_files():
    one = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    import gzip

    for data in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        assert [b for _, b in warc.parse(data)] == [b"abcd"] * 3
    with pytest.raises(ValueError):
        list(warc.parse(one[:-8]))


# ---- media


def test_media_round_trip_and_resize(spark):
    texts = [None, "", "a" * 64, "a" * 65, "é😀" * 1000, "x" * 100_000]
    got = {r.doc_id: r for r in media.features(media.store(docs(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-64:]) and np.lib.format.read_array(__import__("io").BytesIO(r.tile)).shape == (16, 16)
    assert (got[0].dhash, got[0].media_sha256) == (got[1].dhash, got[1].media_sha256)


def test_media_is_stored_and_read_back(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "x" * 1000)]
    df = docs(spark, rows).selectExpr("*", "1 AS media", "2 AS tile", "3 AS n_bytes")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = media.op9_media_columns(spark, str(tmp_path))
    assert "Scan parquet" in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, out.collect()), key=repr)
    assert len(got) == 4 and got[0] == got[1] and {r[1] for r in got} == {3, 0, 1000}
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op9_media_columns(spark, f"{tmp_path}/none").count() == 0


def test_media_formats():
    r = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (64, 64), (7, 130)):
        grey, colour = r.integers(0, 256, (h, w), dtype=np.uint8), r.integers(0, 256, (h, w, 3), dtype=np.uint8)
        for data, want in ((media.encode_pgm(grey), grey), (media.encode_bmp(grey), grey), (media.encode_ppm(colour), colour), (media.encode_bmp(colour), colour)):
            assert (media.decode(data) == want).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]] and media.decode(b"P2 2 1 255 7 200").tolist() == [[7, 200]]
    for bad in (b"", b"GIF", b"P9\n1 1\n"):
        with pytest.raises(ValueError):
            media.decode(bad)
    image = r.integers(0, 256, (48, 36), dtype=np.uint8)
    assert np.allclose(media.resize_area(image, 4, 3), image.reshape(4, 12, 3, 12).mean(axis=(1, 3)))
    assert np.allclose(media.resize_area(image, 5, 7).mean(), image.mean())


# ---- classifiers


def test_quality_on_held_out_text():
    rows = labelled_corpus()
    model = quality.fit([(t, q) for t, q, _ in rows[:300]], 0.75)
    s = model.score([t.encode() for t, _, _ in rows[300:]])
    assert ((s >= quality.THRESHOLD) == np.array([q for _, q, _ in rows[300:]])).mean() > 0.95
    assert 0 <= model.score([b""])[0] <= 1
    assert (quality.fit([("a", 1)] * 10, 0.9).score([b"x", b""]) == 0.9).all()


def test_toxicity_on_held_out_text_and_gradient():
    rows = labelled_corpus()
    model = toxicity.fit([(t, x) for t, _, x in rows[:300]], 1 / 3)
    s = model.score([t for t, _, _ in rows[300:]])
    assert ((s >= 0.5) == np.array([x for _, _, x in rows[300:]])).mean() > 0.95
    assert len(model.score(["", " \n", "あ" * 50_000])) == 3
    assert (toxicity.fit([("a", 1)] * 10, 0.2).score(["x", ""]) == 0.2).all()
    net, r = toxicity.Network(1), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = r.normal(size=(5, 3, toxicity.INPUTS)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    loss = lambda: float((w * (np.logaddexp(0, z := net.forward(net.gates(x.reshape(15, -1)), np.arange(15).reshape(5, 3), mask).astype(float)) - y * z)).sum())
    grad = net.gradient(x, mask, y, w)
    for name in net.p:
        at = tuple(0 for _ in net.p[name].shape)
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(grad[name][at], rel=0.02, abs=2e-3), name
    old, x[1, 0, 5] = x[1, 0, 5], x[1, 0, 5] + 1e-2
    up = loss()
    x[1, 0, 5] = old - 1e-2
    assert (up - loss()) / 2e-2 == pytest.approx(grad["x"][1, 0, 5], rel=0.02, abs=2e-3)


def test_toxicity_learns_its_embeddings():
    words = ["abc", "abd", "x", "f*ck", "abc"]
    layout = toxicity.layout(words)
    net, r = toxicity.Network(1), np.random.default_rng(2)
    net.e = {k: v.astype(np.float64) for k, v in net.e.items()}
    static, d = r.normal(size=(5, 4)), r.normal(size=(5, toxicity.INPUTS))
    grad = net.embedding_gradient(layout, d)
    x = net.embed(static, layout)
    assert (x[0, 4:] == x[4, 4:]).all() and not (x[0, 4:] == x[1, 4:]).all()
    for name, row in (("word", layout[0][0] >> 4), ("gram", layout[1][0] >> 4)):
        net.e[name][row, 2] += 1e-3
        up = (net.embed(static, layout) * d).sum()
        net.e[name][row, 2] -= 2e-3
        assert (up - (net.embed(static, layout) * d).sum()) / 2e-3 == pytest.approx(grad[name][row, 2], rel=1e-4)
        net.e[name][row, 2] += 1e-3
    assert toxicity.words("You f*ck! (a$$) don't, sh!t.") == ["you", "f*ck", "a$$", "don't", "sh!t"]


def test_toxicity_windows_cover_all_words():
    n = np.array([0, 1, 39, 40, 41, 72, 73, 1000])
    doc, first, size = toxicity.windows(n)
    base = np.cumsum(n) - n
    for d, k in enumerate(n):
        seen = set()
        for f, s in zip(first[doc == d] - base[d], size[doc == d]):
            seen |= set(range(f, f + s))
        assert seen == set(range(k)) and (doc == d).sum() >= 1


def test_scores_handle_nulls_and_empty_tables(spark):
    df = docs(spark, [(None, None), (1, ""), (1, "x"), (2, "y" * 30_000)]).selectExpr("*", "1 AS score")
    for module in (quality, toxicity):
        out = module.score(df, module.Model(None, 0.5) if module is quality else module.Model(0.5))
        assert out.count() == 4 and module.score(df.limit(0), module.Model(*([None, 0.5] if module is quality else [0.5]))).count() == 0
    assert toxicity.reject(df, toxicity.Model(0.4)).count() == 4 and toxicity.reject(df, toxicity.Model(0.6)).count() == 0


# ---- decontamination


def edit_distance(a, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontaminate_finds_all_within_budget(spark):
    r = random.Random(5)
    items = [(i, "".join(r.choice("abcde ") for _ in range(r.randint(1, 90)))) for i in range(12)] + [(50, None), (51, "  "), (52, "Same Item"), (53, "same\n item")]
    texts = [None, "", " "]
    for _ in range(60):
        body = list("".join(r.choice("abcde ") for _ in range(r.randint(0, 200))))
        item = list(r.choice(items[:12])[1])
        for _ in range(r.randint(0, 6)):
            if item:
                item[r.randrange(len(item))] = r.choice(["x", "", "ab"])
        at = r.randint(0, len(body))
        texts.append("".join(body[:at] + item + body[at:]).upper())
    texts.append("some SAME   item here")
    df = docs(spark, list(enumerate(texts)))
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.find(df, it).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, s in items:
            s = decontaminate.normal(s or "")
            if t and s and (d := edit_distance(s, decontaminate.normal(t))) <= decontaminate.budget(len(s)):
                want[i, j] = d
    assert got == want
    assert {(x.doc_id, x.item_id): x.distance for x in decontaminate.find(df, it, chars=100).collect()} == want
    kept = decontaminate.clean(df, it)
    assert kept.schema == df.schema and {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.find(df.limit(0), it).count() == 0 and decontaminate.find(df, it.limit(0)).count() == 0


# ---- n-gram join

FOLD = dict(zip(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "abcdefghijklmnopqrstuvwxyz"))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes_by_brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets))


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta rho sigma tau phi chi psi".split())
    rows, passage = [], [f"p{i}" for i in range(60)]
    for _ in range(25):
        base = [word() + str(r.randint(0, 9)) for _ in range(r.choice([3, 5, 6, 8, 9, 11, 13, 20, 60, 150]))]
        if r.random() < 0.5:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(r.choice([1, 2, 4, 30])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t) if r.random() < 0.7 else "\t".join(t).upper())
    rows += [None, "", " \n", "one", "one", "ONE two", "É x", "é x", "word " * 5000]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("all_pairs,split", [(24, 100_000), (3, 100_000), (3, 9)])
def test_join_equals_brute_force(spark, monkeypatch, all_pairs, split):
    # Short lists are made long by a small bound and are split, so that stars and their second look are tried too.
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", all_pairs)
    rows = corpus()
    df = docs(spark, rows).selectExpr("*", "1 AS sid", "2 AS n")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, split).collect())
    assert got == classes_by_brute_force(rows)


def asked(monkeypatch):
    """Numbers of pairs that are verified from now on."""
    counts, plain = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda texts, reps, pairs: (counts.append(pairs.count()), plain(texts, reps, pairs))[1])
    return counts


@pytest.mark.parametrize("split", [100_000, 40])
def test_join_of_near_copies_needs_stars_and_not_all_pairs(spark, monkeypatch, split):
    counts = asked(monkeypatch)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"own{i}", *base[i % 190 + 1 :]])) for i in range(800)]
    got = ngram_join.classes(docs(spark, rows), split).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]
    assert sum(counts) < 5000


def test_join_of_rows_without_ids_or_with_one_id(spark, monkeypatch):
    counts = asked(monkeypatch)
    base = [f"w{i}" for i in range(100)]
    near = lambda i, tag: " ".join([*base[: i % 90], f"{tag}{i}", *base[i % 90 + 1 :]])
    rows = [(None, near(i, "a")) for i in range(1000)] + [(5, near(i, "b")) for i in range(1000)] + [(None, f"alone {i} x y z other") for i in range(30)] + [(9, "alone 3 x y z other")]
    got = ngram_join.classes(docs(spark, rows)).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(None, 5, 1000), (5, 5, 1000), (None, None, 29), (None, 9, 1), (9, 9, 1)}
    assert sum(counts) < 10_000


def test_join_subsets_cover_every_linked_pair_of_small_sets():
    for n in range(1, 15):
        for m in range(n, 15):
            for both in range(n + 1):
                if 100 * both >= 75 * (n + m - both):
                    assert any(c in ngram_join.subset_sizes(m) and c <= both for c in ngram_join.subset_sizes(n)), (n, m, both)


def test_join_long_texts_are_hashed_as_a_whole(monkeypatch):
    text = (" ".join(f"w{i}" for i in range(3000)) + "\n" + "z" * 500 + " end").encode()
    (want,) = ngram_join.shingle_sets([text])
    monkeypatch.setattr(ngram_join, "PIECE", 97)
    (got,) = ngram_join.shingle_sets([text])
    assert (want == got).all() and len(want) == 2998


def test_join_keep_one_and_empty(spark):
    long = " ".join(map(str, range(30)))
    df = docs(spark, [(5, long), (3, long + " x"), (3, long + " x"), (9, "other words"), (8, None), (7, "")])
    out = ngram_join.keep_one(df)
    assert out.schema == df.schema and sorted(r.doc_id for r in out.collect()) == [3, 7, 8, 9]
    assert ngram_join.classes(df.limit(0)).count() == 0


def test_join_keep_one_tells_rows_of_one_id_apart(spark):
    a, b = " ".join(map(str, range(30))), " ".join(map(str, range(100, 130)))
    rows = [(1, a), (2, a + " x"), (2, b), (None, b + " y"), (None, "only null"), (None, "only null"), (5, ""), (5, None), (6, "Twice"), (6, "twice")]
    df = docs(spark, rows).selectExpr("*", "1 AS _d", "2 AS _sid", "3 AS root")
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, "only null"), (5, ""), (5, None), (6, "Twice")], key=repr)


def test_join_numbers_digests_in_order():
    names = [bytes([1] * 8 + [i] * 8) for i in (3, 1, 2, 1)] + [bytes([0] * 16)]
    for some in (names, names[1:2] + names[3:]):
        found, number = ngram_join._numbered(b"".join(some))
        assert [x.tobytes() for x in found] == sorted(set(some)) and [found[i].tobytes() for i in number] == some
