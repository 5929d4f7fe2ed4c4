"""Personal data by weak supervision, with DataFrame and SQL functions only.

1. Candidates: leftmost non-overlapping matches of one pattern for each kind, with code-point offsets. A text is split at
   its matches; the lengths of parts and matches give the offsets.
2. Base spans: candidates that pass their kind's check (octets, Luhn, number of digits). They are always kept.
3. Labelers vote +1, -1 or 0 on every candidate: the format check, a gazetteer of cue words before the span, its
   separators, its neighbours, its length, and repeated digits.
4. Expectation maximisation estimates each labeler's reliability for each kind. It runs on the counts of vote patterns,
   which are at most 3 to the number of labelers whatever the size of the corpus.
5. A naive Bayes classifier over features of the span and its surroundings is trained on the estimated labels of all
   candidates and decides which candidates besides the base spans are personal data.

The patterns are written with possessive loops and guards so that Java matches them without recursion and in linear time;
they find the same matches as the plain patterns given beside them.

Defined cases: a null text is empty and has no spans; texts of any length are searched whole; repeated rows give equal
rows; a table without candidates gives rows without spans; an empty table gives an empty result; other columns may have any
name and stay untouched in redact().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

#: Kinds in output order. The plain patterns: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
#: ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), card [0-9]([\x20-]?[0-9])+, phone \+[0-9][\x20().0-9-]+[0-9].
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api_key|apikey|access_key)\s{0,3}[=:]\s{0,3}\"[^\"\s]{8,}+\"",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a pattern to be worth trying; each is implied by a match.
HINTS = {"email": ("@", None), "ip": (None, r"[0-9]\.[0-9]"), "card": (None, r"[0-9][\x20-]?[0-9]"), "phone": ("+", None), "secret": ('"', None)}
#: The gazetteer: cue words that stand before personal data of a kind.
CUES = {
    "email": "mail|e-mail|email|contact|write|address|kontakt|correo|courriel",
    "ip": "ip|host|server|address|client|login|from",
    "card": "card|visa|mastercard|amex|credit|account|iban|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|contact|telefon|telefono|telephone",
    "secret": "token|key|secret|password|api",
}
LABELERS = ("check", "cue", "separators", "neighbours", "length", "repeats")
FEATURES = ("f_len", "f_left", "f_right", "f_digits", "f_check", "f_marks")
#: Spans handled by one inner fold; keeps the appends of very long texts cheap.
CHUNK = 256
LEFT, RIGHT = 24, 8
EM_STEPS = 30




def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when((n - i) % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _check(text: Column, kind: str) -> Column:
    """The format check that makes a candidate of a base kind a base span."""
    n = F.length(_digits(text))
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": F.when(n.between(13, 19), _luhn(_digits(text))).otherwise(False),
        "phone": n.between(9, 15),
        "secret": text.rlike(r"[0-9]") & (F.length(text) >= 24),
    }[kind]


def _side(c: Column) -> Column:
    """Class of a neighbouring character: e none, s white space, a letter or digit, p other."""
    return F.when(c == "", "e").when(c.rlike(r"^\s$"), "s").when(c.rlike(r"^[\p{L}\p{N}]$"), "a").otherwise("p")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _judged(s: Column, kind: str) -> Column:
    """A candidate with its votes and features."""
    text, n = s["text"], F.length(s["text"])
    nd = F.length(_digits(text))
    ok = _check(text, kind)
    before, after = _side(F.right(s["left"], F.lit(1))), _side(F.left(s["right"], F.lit(1)))
    marks = F.length(F.regexp_replace(text, "[A-Za-z0-9]", ""))
    usual = {"email": n.between(6, 64), "ip": n.between(7, 15), "card": nd.isin(15, 16), "phone": nd.between(10, 13), "secret": n.between(24, 120)}[kind]
    odd = {"email": n > 254, "ip": n > 15, "card": ~nd.between(12, 19), "phone": ~nd.between(8, 15), "secret": n > 400}[kind]
    shaped = {
        "email": text.rlike(r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$"),
        "ip": marks == 3,
        "card": text.rlike(r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{4}$"),
        "phone": text.rlike(r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{2,4}"),
        "secret": text.rlike(r"\"[0-9a-fA-F]{16,}\"$"),
    }[kind]
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), ok.alias("ok"),
        _vote(ok, ~ok).alias("check"),
        _vote(F.lower(s["left"]).rlike(rf"\b(?:{CUES[kind]})\b"), F.lit(False)).alias("cue"),
        _vote(shaped, F.lit(False)).alias("separators"),
        _vote((before != "a") & (after != "a"), (before == "a") | (after == "a")).alias("neighbours"),
        _vote(usual, odd).alias("length"),
        _vote(F.lit(False), text.rlike(r"([0-9])\1{5,}")).alias("repeats"),
        F.concat(F.lit(f"{kind}:len:"), F.least(F.lit(30), (n / 2).cast("int")).cast("string")).alias("f_len"),
        F.concat(F.lit(f"{kind}:left:"), before).alias("f_left"),
        F.concat(F.lit(f"{kind}:right:"), after).alias("f_right"),
        F.concat(F.lit(f"{kind}:digits:"), F.least(F.lit(24), nd).cast("string")).alias("f_digits"),
        F.concat(F.lit(f"{kind}:check:"), ok.cast("string")).alias("f_check"),
        F.concat(F.lit(f"{kind}:marks:"), F.least(F.lit(8), marks).cast("string")).alias("f_marks"),
    )


# Spark gives a lambda as many values as it has parameters, so what it needs besides is bound by a function around it.
def _judge_as(kind: str) -> Callable[[Column], Column]:
    return lambda s: _judged(s, kind)


def _slicer(pairs: Column) -> Callable[[Column], Column]:
    return lambda i: F.slice(pairs, i * CHUNK + 1, CHUNK)


def _tell(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _place(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind).alias("kind"))


def _decide(kind: str, prior: float, odds: dict[str, float]) -> Callable[[Column], Column]:
    def keep(c: Column) -> Column:
        value = F.lit(prior)
        for f in FEATURES:
            value = value + _lookup({k: v for k, v in odds.items() if k.startswith(f"{kind}:{f[2:]}:")}, c[f])
        return (c["ok"] & F.lit(kind in BASE)) | (value > 0)

    return keep


def _marked(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), (c["ok"] & F.lit(kind in BASE)).alias("base"))


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and, for each kind, an array c_KIND of its candidates with votes and features."""
    rows = docs.select(*(F.col(f"`{k}`") for k in keep), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    pair = "array<struct<m:string,p:string,n:string>>"
    span = "array<struct<start:int,end:int,text:string,left:string,right:string>>"
    cut = {}
    for kind, pattern in PATTERNS.items():
        # Part i stands before match i, part i + 1 after it.
        parts = F.split(t, pattern, -1)
        two = F.zip_with(F.regexp_extract_all(t, F.lit(pattern), 0), parts, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        three = F.zip_with(two, F.slice(parts, 2, 2147483647), lambda x, n: F.struct(x["m"].alias("m"), F.coalesce(x["p"], F.lit("")).alias("p"), n.alias("n")))
        part, regex = HINTS[kind]
        hint = F.instr(t, part) > 0 if part else t.rlike(regex)
        cut[f"p_{kind}"] = F.when(hint, F.filter(three, lambda x: x["m"].isNotNull())).otherwise(F.array().cast(pair))
    rows = rows.withColumns(cut).drop("_t")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"), F.right(x["p"], F.lit(LEFT)).alias("left"), F.left(x["n"], F.lit(RIGHT)).alias("right"))
        return F.struct(end.alias("pos"), F.array_append(acc["spans"], one).alias("spans"))

    def chunk(acc: Column, c: Column) -> Column:
        # Appending copies an array, so spans are folded in chunks, each of which starts where the last one ended.
        begin = F.struct(F.coalesce(F.try_element_at(acc, F.lit(-1))["pos"], F.lit(0)).alias("pos"), F.array().cast(span).alias("spans"))
        return F.array_append(acc, F.aggregate(c, begin, step))

    out = {}
    for kind in PATTERNS:
        pairs = F.col(f"p_{kind}")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), _slicer(pairs))
        folded = F.aggregate(chunks, F.array().cast(f"array<struct<pos:int,spans:{span}>>"), chunk)
        spans = F.flatten(F.transform(folded, lambda x: x["spans"]))
        out[f"c_{kind}"] = F.when(F.size(pairs) > 0, F.transform(spans, _judge_as(kind))).otherwise(F.array())
    return rows.select(*(F.col(f"`{k}`") for k in keep), *(c.alias(k) for k, c in out.items()))


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c"))


def _every(found: DataFrame) -> DataFrame:
    """kind and the fields of every candidate."""
    return found.select(F.explode(F.concat(*(F.transform(f"c_{k}", _named(k)) for k in PATTERNS))).alias("x")).select("x.kind", "x.c.*")


def patterns(found: DataFrame) -> dict[str, list[tuple[tuple[int, ...], int]]]:
    """For each kind the distinct vote patterns and how often each occurs: at most 3 to the number of labelers."""
    out: dict[str, list] = {kind: [] for kind in PATTERNS}
    for r in _every(found).groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.kind].append((tuple(r[v] for v in LABELERS), r.n))
    return {kind: sorted(rows) for kind, rows in out.items()}


def reliabilities(counts: list[tuple[tuple[int, ...], int]], steps: int = EM_STEPS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Prior and, for each labeler and vote, its probability given clean and given personal, by expectation maximisation.

    Starts from the share of positive votes, with one pseudo-count a vote.
    """
    post = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v, _ in counts}
    prior, table = 0.5, []
    for _ in range(steps):
        total = [2.0, 2.0]
        for v, n in counts:
            total[0] += n * (1 - post[v])
            total[1] += n * post[v]
        prior = total[1] / (total[0] + total[1])
        table = []
        for i in range(len(LABELERS)):
            seen = {x: [1.0, 1.0] for x in (-1, 0, 1)}
            for v, n in counts:
                seen[v[i]][0] += n * (1 - post[v])
                seen[v[i]][1] += n * post[v]
            sums = [sum(s[y] for s in seen.values()) for y in (0, 1)]
            table.append({x: (s[0] / sums[0], s[1] / sums[1]) for x, s in seen.items()})
        post = {v: posterior(v, prior, table) for v, _ in counts}
    return prior, table


def posterior(votes: tuple[int, ...], prior: float, table: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for t, v in zip(table, votes))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _lookup(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)), key), F.lit(0.0))


def train(found: DataFrame) -> dict[str, tuple[float, dict[str, float]]]:
    """For each kind the prior log-odds and those of each feature value, from the labels that the labelers' votes suggest."""
    counts = patterns(found)
    fits = {kind: reliabilities(seen) for kind, seen in counts.items() if seen}
    votes = lambda kind, v: f"{kind}{','.join(map(str, v))}"
    label = {votes(kind, v): posterior(v, *fits[kind]) for kind in fits for v, _ in counts[kind]}
    rows = _every(found).withColumn("y", _lookup(label, F.concat("kind", F.concat_ws(",", *(F.col(v).cast("string") for v in LABELERS)))))
    rows = rows.select("kind", "y", F.explode(F.array(*FEATURES)).alias("f")).groupBy("kind", "f").agg(F.sum("y").alias("yes"), F.count(F.lit(1)).alias("n"))
    # The values of a feature are few by construction: lengths and counts are cut off.
    sums = sorted((r.kind, r.f, r.yes, r.n) for r in rows.collect())
    out = {}
    for kind in fits:
        n = sum(k for _, k in counts[kind])
        yes = sum(k * label[votes(kind, v)] for v, k in counts[kind])
        odds = {f: math.log((a + 1) / (yes + 2)) - math.log((k - a + 1) / (n - yes + 2)) for x, f, a, k in sums if x == kind}
        out[kind] = (math.log((yes + 1) / (n - yes + 1)), odds)
    return out


def spans(found: DataFrame, model: dict[str, tuple[float, dict[str, float]]]) -> DataFrame:
    """found with s_KIND: arrays of start, end and base, whether the span passed its kind's check."""
    out = {}
    for kind in PATTERNS:
        keep = _decide(kind, *model.get(kind, (0.0, {})))
        out[f"s_{kind}"] = F.transform(F.filter(f"c_{kind}", keep), _marked(kind))
    return found.select(*(c for c in found.columns if not c.startswith("c_")), *(c.alias(k) for k, c in out.items()))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All spans of every row: the kept columns and s_KIND for each kind."""
    found = materialize(candidates(docs, text, keep), "pii-candidates")
    return spans(found, train(found))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; n_chars follows if it is there.

    Rows are numbered in a copy of the table, which carries each text along with its candidates, so no join is needed. Where
    spans overlap, their union is replaced, by the kind of the one that starts first (then the longer).
    """
    names = docs.columns
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    found = materialize(candidates(rows, "text", ("_row",)), "pii-candidates")
    got = spans(found, train(found))
    every = F.concat(*(F.transform(f"s_{k}", _place(k)) for k in PATTERNS))
    got = got.select("_row", F.array_sort(every).alias("_all"))

    # Spans are taken in chunks, each with its own piece of the text, so a text with many spans is not copied for each of them.
    def chunk(acc: Column, c: Column) -> Column:
        end = F.greatest(acc["pos"], F.array_max(F.transform(c, lambda s: -s["back"])))
        piece = F.left(acc["rest"], end - acc["pos"])

        def put(inner: Column, s: Column) -> Column:
            text = F.substring(piece, inner["pos"] - acc["pos"] + 1, s["start"] - inner["pos"])
            out = F.when(s["start"] >= inner["pos"], F.array_append(inner["out"], F.concat(text, F.lit("<"), F.upper(s["kind"]), F.lit(">")))).otherwise(inner["out"])
            return F.struct(F.greatest(inner["pos"], -s["back"]).alias("pos"), out.alias("out"))

        done = F.aggregate(c, F.struct(acc["pos"].alias("pos"), F.array().cast("array<string>").alias("out")), put)
        rest = F.substring(acc["rest"], end - acc["pos"] + 1, F.length(acc["rest"]))
        return F.struct(end.alias("pos"), rest.alias("rest"), F.array_append(acc["out"], F.array_join(done["out"], "")).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / CHUNK).cast("int")), _slicer(F.col("_all")))
    begin = F.struct(F.lit(0).alias("pos"), F.col("_row.text").alias("rest"), F.array().cast("array<string>").alias("out"))
    got = got.withColumn("_done", F.when(F.size("_all") > 0, F.aggregate(chunks, begin, chunk)))
    got = got.withColumn("_new", F.when(F.col("_done").isNull(), F.col("_row.text")).otherwise(F.concat(F.array_join("_done.out", ""), F.col("_done.rest"))))
    value = {"text": F.col("_new")} | ({"n_chars": F.when(F.col("_done").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast(docs.schema["n_chars"].dataType))} if "n_chars" in names else {})
    return got.select(*((value[n] if n in value else F.col(f"_row.`{n}`")).alias(n) for n in names))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    got = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*(F.transform(F.filter(f"s_{k}", lambda s: s["base"]), _tell(k)) for k in BASE))
    return got.select(
        "doc_id", *(F.size(F.filter(f"s_{k}", lambda s: s["base"])).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(*(F.transform(f"s_{k}", _tell(k)) for k in PATTERNS)), ",").alias("spans"),
    )
