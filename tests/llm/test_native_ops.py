"""URL filters, chat formatting, mixing and personal data on small tables and edge cases."""

import hashlib
import re

import pytest

from codeloom.llm import chat, mixing, pii, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# ---- URL filters


def judged(spark, urls, rules=url_filter.RULES):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    r = spark.createDataFrame(rules, "host string, path string, action string")
    return {x.page_id: tuple(x)[1:] for x in url_filter.judge(pages, r).collect()}


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


URLS = [
    "https://a.example.com/en/7", "http://example.com/en/8", "http://EXAMPLE.net/de/8?x", "http://net/de/9", "http://xnet/de/9", "http://org/es", "http://b.org/es/#y", None, "", "no url",
    "http://", "http:///en/", "ftp://com?x=/en/", "http://com/en/://com", "http://.com/en/", "http://com./en/", "http://É.com/en/\n7", "http://example.com:80/en/7",
]


def test_url_filter_matches_plain_rules(spark):
    got = judged(spark, URLS)
    assert got == {i: plain(u, url_filter.RULES) for i, u in enumerate(URLS)}


def test_url_filter_ties_repeats_and_empty(spark):
    both = [("com", "/", "allow"), ("com", "/", "block"), ("com", "", "allow")]
    assert judged(spark, ["http://x.com/a"], both)[0][2:] == ("com/", "block")
    pages = spark.createDataFrame([(1, "http://com/en/"), (1, "http://com/en/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    assert sorted(str(r.page_id) for r in url_filter.judge(pages, rules).collect()) == ["1", "1", "None"]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert url_filter.judge(pages, rules.limit(0)).filter("verdict = 'allow'").count() == 3


# ---- chat formatting


def test_chat_round_trip(spark):
    odd = "<|im_end|>\\<|x <\\| \\\\ <\\~ <"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (1, 2, "assistant", ""), (2, None, None, "x"), (2, 5, "a\nb\\n<\\~", "y\n"), (None, 0, "user", "|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat.read_back(out.formatted).alias("back")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("user", odd), ("assistant", odd), ("assistant", ""), ("assistant", "")]
    assert [(t.role, t.text) for t in got[2].back] == [("", "x"), ("a\nb\\n<\\~", "y\n")]
    assert [(t.role, t.text) for t in got[None].back] == [("user", "|")]
    assert got[1].formatted.count(chat.START) == 2 and got[1].formatted.count(chat.CONT) == 2
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- mixing


def test_targets_are_filled_by_weight(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    size, weight = {"a": 10, "b": 100, "c": 1000, "d": 0, None: 5}, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    total, want, open_ = 1115.0, {}, set(size)
    while True:  # the excess is shared again until no target is above its cap
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        want |= {s: 3.0 * size[s] for s in full}
        open_ -= full
        if not full or not open_:
            want |= {s: share[s] for s in open_}
            break
    assert got == pytest.approx(want)


def test_mix_takes_exact_budgets(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 3}" if i % 10 else None) for i in range(400)] + [(7, "w w", "s1"), (7, "w w", "s1"), (None, "w", "s0"), (500, None, "s0"), (501, "", "s2")]
    df = docs(spark, rows)
    a = mixing.mix(df, range_rows=8).collect()
    assert len(a) == len(rows)
    by = {}
    for r in a:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert sum(r.taken for r in rs) == rs[0].budget == pytest.approx(rs[0].target, abs=1)
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, a)) == sorted(map(key, mixing.mix(df, range_rows=100_000).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_take_agrees_with_mix_on_rows_with_any_columns(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 3}" if i % 10 else None) for i in range(400)] + [(None, "w", "s0"), (500, None, "s0"), (501, "", "s2")]
    df = docs(spark, rows)
    want = sorted(((r.doc_id, r.source, r["size"], r.taken) for r in mixing.mix(df, range_rows=8).collect()), key=repr)
    clash = df.selectExpr("*", "1 AS key", "2 AS size", "3 AS cut", "4 AS _s", "5 AS target", "6 AS _row")
    out = mixing.take(clash, range_rows=8)
    assert sorted(((r._row.doc_id, r._row.source, r["size"], r.taken) for r in out.collect()), key=repr) == want
    assert {r._row.key for r in out.collect()} == {1}
    # Rows that are equal at a cut share what is left.
    same = docs(spark, [(1, "w w w", "a")] * 6 + [(2, "w", "b")] * 50)
    got = [(r._row.source, r.taken, r.target) for r in mixing.take(same).collect()]
    for source in "ab":
        assert len({t for s, t, _ in got if s == source}) == 1
    assert mixing.take(df.limit(0)).count() == 0


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(k, m[0])] for k, p in PLAIN.items()}


TEXTS = [
    None, "", "nothing", "a@b.com_x@y.z a@b..c @ a@b x.y%+@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 5" * 3,
    "+1 (555) 123-4567 +44.20.7946.0958. +1 2 +123456789012345678 +(1) 2345678", "été 4111111111111111 naïve a@b.co 😀 +1 555 123 4567", '😀 token = "0123456789abcdef0123456789abcdef" x',
    "1" * 20000 + " 4111111111111111", "a" * 20000 + "@" + "b." * 5000 + "c", "1 " * 9000, "a@b.c " * 3000, "+1" + " " * 5000 + "x",
]


def test_pii_base_spans_match_plain_patterns(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)]).selectExpr("*", "doc_id AS _t", "1 AS c_email")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in enumerate(TEXTS):
        for kind, spans in base_spans(t).items():
            assert [(s.start, s.end) for s in got[i][f"s_{kind}"] if s.base] == spans, (i, kind)
    assert got[8].s_secret and pii.find(df.limit(0)).count() == 0


def test_pii_redact_keeps_rows_and_columns(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)] + [(1, "mail a@b.com now", None)] * 2)
    out = pii.redact(df)
    assert out.schema == df.schema and out.count() == df.count()
    got = [r.text for r in out.filter("doc_id = 1 AND text <> ''").collect()]
    assert got == ["mail <EMAIL> now"] * 2
    assert out.filter("doc_id = 0").first().text is None


def test_em_tells_reliable_labelers_from_others():
    counts = [((1, 1, 1, 1, 1, 0), 80), ((-1, 0, 0, -1, -1, 0), 60), ((1, 0, 0, 1, 1, 0), 40), ((-1, 0, 0, 1, -1, -1), 20)]
    prior, table = pii.reliabilities(counts)
    assert pii.posterior(counts[0][0], prior, table) > 0.9 > 0.1 > pii.posterior(counts[1][0], prior, table)


def test_chat_digest_of_a_plain_conversation(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    text = "".join(f"{t.role}\n{t.text}\n" for t in out.select(chat.read_back(out.formatted).alias("b")).first().b)
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
