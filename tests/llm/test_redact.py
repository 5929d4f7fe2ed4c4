"""Redaction of overlapping spans."""

import re

from codeloom.llm import pii

TEXTS = ["10.0.0.26 4111 1111 1111 1111", "x 10.0.0.26 4111 1111 1111 1111 y a@b.co", "4111111111111111 then +1 555 123 4567", "none", " ".join(f"u{i}@mail.com 10.0.0.{i % 256}" for i in range(700))]
DOC = "doc_id long, text string, lang string, source string, n_chars int"


def test_every_detected_character_is_replaced(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], DOC)
    found = {r.doc_id: r for r in pii.find(df).collect()}
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    for i, t in enumerate(TEXTS):
        spans = sorted((s.start, -s.end, k) for k in pii.PATTERNS for s in found[i][f"s_{k}"])
        out, pos = "", 0
        for start, back, kind in spans:
            if start >= pos:
                out += t[pos:start] + f"<{kind.upper()}>"
            pos = max(pos, -back)
        assert got[i].text == out + t[pos:] and got[i].n_chars == len(got[i].text)
    assert {(s.start, s.end) for s in found[0].s_ip} and (7, 29) in {(s.start, s.end) for s in found[0].s_card}
    assert not re.search(r"\d", got[0].text)
