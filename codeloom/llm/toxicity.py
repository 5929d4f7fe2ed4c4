"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs. A word gives a vector of two learned parts and four statistics. Learned are an embedding of the word and the mean
embedding of its character 3- to 5-grams with its ends marked; both tables are hashed and trained with the network. The
statistics are the log-odds of the word and the largest, smallest and mean log-odds of its n-grams, by counting documents.
Characters that mask letters (@ $ * # and ! within a word) belong to words.

Network. A GRU in each direction reads a window of words; attention pools the states; a linear layer gives the logit. It is
trained by back-propagation through time on the windows of labelled documents: of a toxic document on the window with the
highest logit so far, of a clean one on its highest and one other.

Scoring. Windows of 40 words start every 32 words, so they overlap and cover every word. A document's score is that of its
highest window, calibrated on its logit and the number of windows, at the base rate of all labels that may be used.

The statistics, the network and the calibration are fitted on different parts of the sample (two, two and one of five
documents of a class), so none trusts what its own documents made.

Defined cases: a null or empty text, or one of white space only, has the logit of the lowest document that the calibration has seen; texts
of any length are scored whole; repeated rows get equal scores; without labels of both classes all scores are the base
rate; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import held_out, slices
from codeloom.llm.quality import logistic
from codeloom.llm.sampling import labelled

#: Bound of the sample: documents of each class.
PER_CLASS = 1500
WINDOW, STRIDE = 40, 32
HIDDEN, ATTENTION = 8, 8
#: Bits of the hashed tables.
WORD_BITS, GRAM_BITS = 18, 18
GRAMS = (3, 4, 5)
#: Statistics of a word, length of each of its two embeddings, and bits of their hashed tables.
STATISTICS, EMBEDDING, EMBEDDING_BITS = 4, 6, 14
INPUTS = STATISTICS + 2 * EMBEDDING
#: Words whose inputs a worker keeps; beyond that it starts anew.
CACHE_WORDS = 100_000
#: Words whose n-grams are laid out at a time.
CHUNK_WORDS = 10_000
THRESHOLD = 0.5
_WORDS = re.compile(r"[\w@$*#]+(?:[!'][\w@$*#]+)*").findall


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def _word_hash(vocabulary: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) & ((1 << WORD_BITS) - 1) for w in vocabulary), np.int64, len(vocabulary))


def _grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all character n-grams by their first position, their validity, and where each word starts."""
    marked = [f"\x02{w}\x03" for w in vocabulary]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint32)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
    hashes, valid = np.zeros((len(GRAMS), len(codes)), np.int32), np.zeros((len(GRAMS), len(codes)), bool)
    h = np.zeros(len(codes), np.uint32)
    for k in range(max(GRAMS)):
        n = max(0, len(codes) - k)  # a chunk may be shorter than the longest n-gram
        h[:n] = h[:n] * np.uint32(0x01000193) + codes[k:]
        if k + 1 in GRAMS:
            mixed = (h ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            hashes[GRAMS.index(k + 1)] = mixed >> np.uint32(32 - GRAM_BITS)
            valid[GRAMS.index(k + 1)] = left >= k + 1
    return hashes, valid, starts


def layout(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, the hashes of its n-grams laid end to end, and where those of each word begin and end."""
    own, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a in range(0, len(vocabulary), CHUNK_WORDS):
        hashes, valid, starts = _grams(vocabulary[a : a + CHUNK_WORDS])
        own.append(hashes.T[valid.T])
        count.append(np.add.reduceat(valid.sum(axis=0), starts))
    return _word_hash(vocabulary), np.concatenate(own), np.append(0, np.cumsum(np.concatenate(count)))


def _part(of: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The layout of some words."""
    word, grams, begin = of
    n = begin[rows + 1] - begin[rows]
    end = np.cumsum(n)
    at = np.arange(end[-1] if len(end) else 0) + np.repeat(begin[rows] - end + n, n)
    return word[rows], grams[at], np.append(0, end)


class Tables:
    """Log-odds of words and of character n-grams."""

    def __init__(self, docs: list[np.ndarray], of: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray):
        """docs: the distinct words of each document as places in the vocabulary, whose layout is given."""
        count = np.zeros((2, 1 << WORD_BITS), np.float32), np.zeros((2, 1 << GRAM_BITS), np.float32)
        word_ids, grams, begin = of
        for d, label in zip(docs, y):
            if len(d):
                count[0][int(label)][np.unique(word_ids[d])] += 1
                count[1][int(label)][np.unique(np.concatenate([grams[begin[i] : begin[i + 1]] for i in d]))] += 1
        n = np.bincount(y.astype(int), minlength=2)
        self.word, self.gram = (self._odds(c, n) for c in count)

    @staticmethod
    def _odds(count: np.ndarray, n: np.ndarray) -> np.ndarray:
        seen = count.sum(axis=0)
        odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
        return (odds * seen / (seen + 4) / 3).astype(np.float32)

    def inputs(self, of: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The statistics of words, whose layout is given."""
        word, grams, begin = of
        out = np.zeros((len(word), STATISTICS), np.float32)
        if len(word):
            # Every word has an n-gram, as its marked ends make it three characters long at least.
            v = self.gram[grams]
            out[:, 0] = self.word[word]
            out[:, 1] = np.maximum.reduceat(v, begin[:-1])
            out[:, 2] = np.minimum.reduceat(v, begin[:-1])
            out[:, 3] = np.add.reduceat(v, begin[:-1]) / np.diff(begin)
        return out


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents laid end to end: each window's document, first word and number of words. None is left out."""
    n = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, np.repeat(np.cumsum(lengths) - lengths, n) + k * STRIDE, np.clip(lengths[doc] - k * STRIDE, 0, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sums(rows: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of d by number."""
    return np.stack([np.bincount(rows, c, size) for c in d.T], axis=1)


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        h, d, a = HIDDEN, INPUTS, ATTENTION
        make = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        # Gates in the order update, reset, candidate; index 0 reads forwards and 1 backwards.
        self.p = {f"{n}{i}": x for i in (0, 1) for n, x in (("wx", make(d, 3 * h)), ("wh", make(h, 3 * h)), ("b", np.zeros(3 * h, np.float32)))}
        self.p |= {"u": make(2 * h, a), "v": make(a, 1)[:, 0], "w": make(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32)}
        self.e = {n: (0.1 * r.normal(size=(1 << EMBEDDING_BITS, EMBEDDING))).astype(np.float32) for n in ("word", "gram")}

    def embed(self, statistics: np.ndarray, of: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The inputs of words, whose layout is given: statistics, embedding, mean embedding of n-grams."""
        word, grams, begin = of
        if not len(word):
            return np.zeros((0, INPUTS), np.float32)
        mean = np.add.reduceat(self.e["gram"][grams >> (GRAM_BITS - EMBEDDING_BITS)], begin[:-1]) / np.diff(begin)[:, None]
        return np.concatenate([statistics, self.e["word"][word >> (WORD_BITS - EMBEDDING_BITS)], mean], axis=1).astype(statistics.dtype, copy=False)

    def embedding_gradient(self, of: tuple[np.ndarray, np.ndarray, np.ndarray], d: np.ndarray) -> dict[str, np.ndarray]:
        """By both tables, from d by the inputs of words."""
        word, grams, begin = of
        n, size = np.diff(begin), 1 << EMBEDDING_BITS
        return {
            "word": _sums(word >> (WORD_BITS - EMBEDDING_BITS), d[:, STATISTICS : STATISTICS + EMBEDDING], size),
            "gram": _sums(grams >> (GRAM_BITS - EMBEDDING_BITS), np.repeat(d[:, STATISTICS + EMBEDDING :] / n[:, None], n, axis=0), size),
        }

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the inputs add to the gates, for each direction; made once for each word of a vocabulary."""
        return tuple(x @ self.p[f"wx{i}"] + self.p[f"b{i}"] for i in (0, 1))

    def forward(self, gates: tuple[np.ndarray, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: for each direction a row for each word; at: the words, time by window, as mask."""
        h, t, n = HIDDEN, *mask.shape
        states, kept = np.empty((t, n, 2 * h), np.float32), []
        full = mask.all(axis=1)
        for i in (0, 1):
            s = np.zeros((n, h), np.float32)
            wzr, wc = (np.ascontiguousarray(x) for x in (self.p[f"wh{i}"][:, : 2 * h], self.p[f"wh{i}"][:, 2 * h :]))
            for k in range(t) if i == 0 else range(t - 1, -1, -1):
                g = gates[i][at[k]]
                zr = s @ wzr
                zr += g[:, : 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                rs = zr[:, h:] * s
                c = rs @ wc
                c += g[:, 2 * h :]
                np.tanh(c, out=c)
                new = c - s
                new *= zr[:, :h]
                new += s
                if not full[k]:
                    new = np.where(mask[k][:, None], new, s)
                if keep:
                    kept.append((i, k, s, zr, rs, c))
                states[k, :, i * h : i * h + h] = s = new
        e = np.tanh(states @ self.p["u"])
        score = np.where(mask, e @ self.p["v"], -1e9)
        score -= score.max(axis=0)
        a = np.exp(score) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnd->nd", a, states)
        logit = pooled @ self.p["w"] + self.p["c"]
        return (logit, (states, kept, e, a, pooled)) if keep else logit

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss by all parameters, and by x. x: time by window by inputs."""
        h, (t, n) = HIDDEN, mask.shape
        gates = self.gates(x.reshape(t * n, -1))
        logit, (states, kept, e, a, pooled) = self.forward(gates, np.arange(t * n).reshape(t, n), mask, keep=True)
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        g["x"] = np.zeros_like(x)
        d = ((_sigmoid(logit) - y) * weight).astype(np.float32)
        g["w"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["w"]
        da = np.einsum("nd,tnd->tn", dp, states)
        ds = a[:, :, None] * dp
        dscore = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", dscore, e)
        de = dscore[:, :, None] * p["v"] * (1 - e * e)
        g["u"] = np.einsum("tnd,tna->da", states, de)
        ds = ds + de @ p["u"].T
        carry = [np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)]
        for i, k, s, zr, rs, c in reversed(kept):
            z, r, m = zr[:, :h], zr[:, h:], mask[k][:, None]
            total = carry[i] + ds[k, :, i * h : i * h + h]
            dn = total * m
            dc = dn * z * (1 - c * c)
            dz = dn * (c - s) * z * (1 - z)
            wh = p[f"wh{i}"]
            drs = dc @ wh[:, 2 * h :].T
            dr = drs * s * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], axis=1)
            g[f"wx{i}"] += x[k].T @ dg
            g["x"][k] += dg @ p[f"wx{i}"].T
            g[f"b{i}"] += dg.sum(axis=0)
            g[f"wh{i}"][:, : 2 * h] += s.T @ dg[:, : 2 * h]
            g[f"wh{i}"][:, 2 * h :] += rs.T @ dc
            carry[i] = total * ~m + dn * (1 - z) + drs * r + dg[:, : 2 * h] @ wh[:, : 2 * h].T
        return g


class Model:
    def __init__(self, rate: float):
        self.rate, self.tables, self.net, self.calibration, self.lowest = rate, None, None, None, 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "known")}

    def _ids(self, docs: list[list[str]]) -> np.ndarray:
        """Numbers of all words, whose gates are in self.known; number 0 is padding."""
        if "at" not in self.__dict__ or len(self.at) > CACHE_WORDS:
            self.at, self.known = {}, [np.repeat(g, 1024, axis=0) for g in self.net.gates(np.zeros((1, INPUTS), np.float32))]
        at, new, out = self.at, [], []
        for d in docs:
            try:
                out.extend([at[w] for w in d])
            except KeyError:
                for w in d:
                    if w not in at:
                        at[w] = len(at) + 1
                        new.append(w)
                out.extend([at[w] for w in d])
        if new:
            while len(at) >= len(self.known[0]):  # room is doubled, so that growth copies little
                self.known = [np.concatenate([g, np.zeros_like(g)]) for g in self.known]
            for a in range(0, len(new), CHUNK_WORDS):
                of = layout(new[a : a + CHUNK_WORDS])
                first = len(at) + 1 - len(new) + a
                for known, g in zip(self.known, self.net.gates(self.net.embed(self.tables.inputs(of), of))):
                    known[first : first + len(g)] = g
        return np.array(out, np.int64)

    def logits(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the highest window's logit, and its number of windows."""
        best, count = np.full(len(docs), -np.inf), np.zeros(len(docs), np.int64)
        step = 256
        for a in range(0, len(docs), step):
            part = docs[a : a + step]
            ids = np.concatenate([[0], self._ids(part)])
            doc, first, n = windows(np.array(list(map(len, part)), np.int64))
            for b in range(0, len(doc), 1024):
                f, m = first[b : b + 1024], n[b : b + 1024]
                mask = np.arange(WINDOW)[:, None] < m
                at = ids[np.where(mask, f + 1 + np.arange(WINDOW)[:, None], 0)]
                np.maximum.at(best, a + doc[b : b + 1024], self.net.forward(self.known, at, mask))
            count[a : a + step] = np.bincount(doc, minlength=len(part))
        return best, count

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.rate)
        docs = [words(t) for t in texts]
        logit, n = self.logits(docs)
        # A text without words says nothing toxic: it is as low as the lowest document of the calibration.
        logit = np.where([not d for d in docs], self.lowest, logit)
        x = np.column_stack([logit, np.log(n)])
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration[:2] + self.calibration[2], -30, 30)))


def fit(rows: list[tuple[str, int]], rate: float, rounds: int = 3, epochs: int = 5, batch: int = 128, seed: int = 5) -> Model:
    model = Model(rate)
    y = np.array([k for _, k in rows], np.float32)
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        return model
    places: dict[str, int] = {}  # each distinct word is kept once
    docs = [np.fromiter((places.setdefault(w, len(places)) for w in words(t)), np.int32) for t, _ in rows]
    of = layout(list(places))
    rank = np.zeros(len(y), np.int64)
    for k in (0, 1):
        rank[y == k] = np.arange((y == k).sum())
    turn = rank % 5
    counted, kept = turn < 2, turn == 4
    model.tables = Tables([np.unique(d) for d, c in zip(docs, counted) if c], of, y[counted])
    model.net = net = Network(seed)
    statistics = model.tables.inputs(of)
    del places
    own, label = [d for d, c in zip(docs, (turn == 2) | (turn == 3)) if c], y[(turn == 2) | (turn == 3)]
    # Word 0 is padding, which the masks hide.
    ids = np.concatenate([np.zeros(1, np.int32), *(d + 1 for d in own)])
    doc, first, n = windows(np.array(list(map(len, own)), np.int64))
    step = np.arange(WINDOW)[:, None]
    place = lambda i: np.where(step < n[i], first[i] + 1 + step, 0)
    padded = np.concatenate([np.zeros((1, INPUTS), np.float32), np.zeros((len(statistics), INPUTS), np.float32)])

    def inputs() -> np.ndarray:
        for a in range(0, len(statistics), CHUNK_WORDS):
            rows = np.arange(a, min(a + CHUNK_WORDS, len(statistics)))
            padded[1 + rows] = net.embed(statistics[rows], _part(of, rows))
        return padded

    def values() -> np.ndarray:
        gates = net.gates(inputs())
        return np.concatenate([net.forward(gates, ids[place(i)], step < n[i]) for i in np.array_split(np.arange(len(doc)), -(-len(doc) // 4096))])

    rng = np.random.default_rng(seed)
    plain = np.concatenate([[0], statistics[:, :2].sum(axis=1)])
    value = np.concatenate([plain[ids[place(np.arange(b, min(b + 8192, len(doc))))]].max(axis=0) for b in range(0, len(doc), 8192)])
    moment, square, t = {}, {}, 0
    for turn in range(rounds):
        if turn:
            value = values()
        order = np.lexsort((-value, doc))
        top = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
        clean = np.flatnonzero(label[doc] == 0)
        other = rng.choice(clean, min(len(clean), len(top)), replace=False)
        chosen = np.concatenate([top, other])
        target = label[doc[chosen]]
        weight = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum())) * len(chosen)
        for _ in range(epochs if turn else 2 * epochs):
            for i in np.array_split(rng.permutation(len(chosen)), -(-len(chosen) // batch)):
                k = chosen[i]
                used, back = np.unique(ids[place(k)], return_inverse=True)
                known = used[used > 0] - 1
                some = _part(of, known)
                x = np.zeros((len(used), INPUTS), np.float32)
                x[used > 0] = net.embed(statistics[known], some)
                g = net.gradient(x[back.reshape(WINDOW, -1)], step < n[k], target[i], weight[i] / len(i))
                dx = _sums(back.ravel(), g.pop("x").reshape(-1, INPUTS), len(x))
                t += 1
                # Embeddings of rare words move slowly, or they would learn their few documents by heart.
                for table, grads, pace in ((net.p, g, 0.02), (net.e, net.embedding_gradient(some, dx[used > 0]), 0.002)):
                    for name, d in grads.items():
                        d = d + 1e-4 * table[name]
                        moment[name] = 0.9 * moment.get(name, 0.0) + 0.1 * d
                        square[name] = 0.99 * square.get(name, 0.0) + 0.01 * d * d
                        table[name] -= (pace * moment[name] / (1 - 0.9**t) / (np.sqrt(square[name] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    del ids, doc, first, n, padded, of, statistics, own, docs, moment, square
    unseen = [text for (text, _), k in zip(rows, kept) if k]
    seen = [model.logits([words(t) for t in unseen[a : a + 64]]) for a in range(0, len(unseen), 64)]
    logit, count = (np.concatenate(x) for x in zip(*seen))
    share, model.lowest = y[kept].mean(), float(logit.min())
    model.calibration = logistic(np.column_stack([logit, np.log(count)]), y[kept], np.where(y[kept] == 1, rate / share, (1 - rate) / (1 - share)), ridge=0.05)
    del model.at, model.known
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*labelled(docs, labels, "toxic", PER_CLASS))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay. Rows are judged where they are, without a join."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [x or "" for x in b.column(names.index("text")).to_pylist()]
            yield b.filter(pa.array(model.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
