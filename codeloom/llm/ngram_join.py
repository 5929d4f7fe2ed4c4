"""N-gram Jaccard join: a size-aware heavy-light self-join of sets of 5-word shingles, exact at its threshold.

Two documents link if 100 * |A and B| >= 75 * |A or B|. Every document gets the smallest doc_id that links reach.

1. Sets. Words are lower-cased (A-Z), shingles are 64-bit hashes; equal sets are one node, named by a digest (sid). The same
   pass counts in how many documents each shingle occurs. Names are 128-bit digests.
2. Light sets (few shingles) enumerate fixed-size subsets: linked sets of at most s shingles share a subset of
   ceil(0.75 s). Heavy sets scan inverted lists of their prefixes: in an order with frequent shingles last, linked sets
   share one of the first n - ceil(0.75 n) + 1; for a partner of known size m they share one within the first
   n - ceil(3/7 (n + m)) + 1 of each, so entries carry their place. Both kinds of keys go into the same lists. The boundary
   between light and heavy is where the number of subsets exceeds the expected cost of scanning lists.
3. Lists of up to ALL_PAIRS sets give all pairs that sizes and places allow. Longer lists give a star first, around the set
   in which the shingle stands first: that is the one with the fewest rare shingles of its own. The list of a shingle of more
   than SPLIT documents is dealt to parts by its members' names, each with a star of its own.
4. The best partner of each set is verified exactly. What links is merged. In long lists that still hold several classes one
   member of each class meets the first of the list, round by round until none links, so parts of a split list come together.
   Pairs within a merged class need no look; pairs across classes, from short lists and from long ones that still hold
   several, are verified exactly too. So no link between different texts is lost, and large groups of near copies cost stars
   instead of all pairs.
5. Classes come from alternating large-star and small-star steps on the links until all are stars, with each round written
   to the shared folder; neighbours of a hub meet its least one by broadcast. A set is known there by its smallest doc_id and
   its name, so the root of a class holds its answer. Nothing about documents is gathered on the driver besides counts and
   the most frequent shingles, which are a bounded list and only order the prefixes.

Defined cases: a null, empty or white text has 0 shingles and links with nothing, itself included in its class; fewer than
5 words make one shingle; repeated rows and equal sets are in one class; rows with a null doc_id link like others, and have
the smallest non-null doc_id of their class or null; texts of rows that share an id, or have none, are found by their sets and not by
their ids; texts of any length are read whole; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import materialize, meet, slices, small
from codeloom.work import all_stars

WORDS = 5
#: The threshold as a fraction of whole numbers.
NUM, DEN = 75, 100
#: Shingles in more documents than this go last in the order of prefixes, most frequent last of all; at most so many.
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: Lists up to this length give all pairs at once.
ALL_PAIRS = 24
#: Documents of a shingle above which its list is split.
SPLIT = 100_000
#: Shingles gathered by a task before it sends them on, and shingles that one bucket of lists should hold.
FLUSH, PER_BUCKET = 1_000_000, 1_500_000
#: A set is hot if it has more than this part of all rows, so there are fewer than that many hot sets.
HOT = 10_000
#: Ids that may be broadcast; their bytes are checked too.
MOST_IDS = 1_000_000
#: Pairs, and bytes of texts, that one group of the verification should hold.
PER_GROUP, GROUP_BYTES = 200, 16 << 20
PIECE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word of a piece of text. A word's hash does not depend on where it stands."""
    b = np.frombuffer(data, np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64) + np.uint64(1)
    up, down = _powers(max(len(b) + 1, PIECE + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(b)])])
    return mix((total[end] - total[start]) * down[start]), start


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space (or at its end)."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(w, at, at + PIECE) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [i for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(w, at + PIECE)) >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def _shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    if not len(w):
        return w
    k = min(len(w), WORDS)
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h + w[j : j + n] * _STEPS[j]
    return np.unique(mix(h))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of each text, in order. Short texts are hashed many at a time."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > PIECE // 2:
            yield _shingles(np.concatenate([_word_hashes(p)[0] for p in _pieces(texts[i])]))
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) <= PIECE // 2 and size + len(texts[j]) < PIECE:
            size += len(texts[j]) + 1
            j += 1
        w, start = _word_hashes(b"\n".join(texts[i:j]))
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[i:j]])])
        cut = np.searchsorted(start, first)
        for a, b in zip(cut[:-1], cut[1:]):
            yield _shingles(w[a:b])
        i = j


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _numbered(names: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests in order, and of each of the given ones its number."""
    high, low = np.frombuffer(names, ">u8").reshape(-1, 2).astype(np.uint64).T
    _, first, number = np.unique(high, return_index=True, return_inverse=True)
    if (low[first][number] == low).all():
        return np.frombuffer(names, "V16")[first], number
    order = np.lexsort((low, high))
    new = np.concatenate([[True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return np.frombuffer(names, "V16")[order[new]], number


def least_overlap(n: int) -> int:
    """How many shingles a set of n shares at least with any set that it links with."""
    return -(-NUM * n // DEN)


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + 1


def subset_sizes(n: int) -> list[int]:
    """Sizes of subsets that a light set enumerates: one for each size that the larger of two linked sets can have."""
    return sorted({c for s in range(n, DEN * n // NUM + 1) if (c := least_overlap(s)) <= n})


def boundary(list_length: float) -> int:
    """The largest size for which enumerating subsets is no dearer than scanning the lists of a prefix."""
    best = 0
    for n in range(1, 65):  # subsets outgrow any list long before
        if sum(math.comb(n, c) for c in subset_sizes(n)) <= prefix_length(n) * (1 + list_length):
            best = n
    return best


def _subset_keys(s: np.ndarray) -> np.ndarray:
    keys = []
    for c in subset_sizes(len(s)):
        rows = np.array(list(combinations(range(len(s)), c)))
        keys.append(mix(np.add.reduce(mix(s[rows] ^ np.uint64(c * 0x51ED270B)), axis=1, dtype=np.uint64) + np.uint64(c)))
    return np.concatenate(keys)


def _buckets(total: int) -> int:
    return min(20, max(3, math.ceil(math.log2(max(1, total) / PER_BUCKET + 1))))


class _Order:
    """The order of prefixes: shingles that are not frequent by hash, then frequent ones by count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        at = np.argsort(keys)
        self.keys, self.counts, self.bits = keys[at], counts[at], bits

    def prefix(self, s: np.ndarray, k: int) -> np.ndarray:
        if not len(self.keys):
            return s[:k]
        key = s >> np.uint64(32 - self.bits)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        often = np.where(self.keys[at] == key, self.counts[at], 0)
        if not often[:k].any():
            return s[:k]
        return s[np.argsort(often, kind="stable")[:k]]

    def parts(self, keys: np.ndarray, split: int) -> np.ndarray:
        """Into how many parts the list of each key is split, if it has more than `split` documents; 0 for one that stays whole."""
        if not len(self.keys) or self.counts.max() <= split:
            return np.zeros(len(keys), np.int64)
        key = keys >> np.uint64(32 - self.bits)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        count = np.where(self.keys[at] == key, self.counts[at], 0)
        return np.where(count > split, -(-count // split) * 2, 0)


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted 64-bit keys: the buckets, where each begins, and the 32 bits that tell keys of a bucket apart."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    low = ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    names, first = np.unique(bucket, return_index=True)
    return names, np.append(first, len(keys)), low


def _first_pass(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, sid, n, bytes of every row; and key, df of every frequent shingle; and sums for the cost of lists."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "keys", "counts", "doc_id", "sid", "n", "bytes"]
        kinds = [pa.list_(t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64())]
        state = {"turn": 0}
        sets, seen, ids, sids, sizes, lengths = [], set(), [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            turn = state["turn"] = state["turn"] + 1
            # The documents of a flush go to a bucket of their own with a negative name.
            mark = -1 - (zlib.crc32(b"".join(x or b"" for x in sids[:64]) + b"%d" % turn) & 0xFFFF)
            empty = pa.array([None], pa.binary())
            rows = [pa.array([mark], pa.int32()), empty, empty, *(pa.array([x], t) for x, t in zip((ids, sids, sizes, lengths), kinds))]
            yield pa.RecordBatch.from_arrays(rows, names)
            if sets:
                keys, counts = np.unique(np.concatenate(sets), return_counts=True)
                where, first, low = _split(keys, bits)
                counts = np.minimum(counts, 65535).astype(np.uint16)
                cut = list(zip(first[:-1], first[1:]))
                blank = [pa.array([None] * len(where), t) for t in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([low[a:b].tobytes() for a, b in cut]), pa.array([counts[a:b].tobytes() for a, b in cut]), *blank], names)
            for x in (sets, seen, ids, sids, sizes, lengths):
                x.clear()

        held = 0
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for doc_id, text, s in zip(batch.column(0).to_pylist(), texts, shingle_sets(texts)):
                sid = set_digest(s) if len(s) else None
                ids.append(doc_id)
                sids.append(sid)
                sizes.append(len(s))
                lengths.append(len(text))
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    sets.append(s)
                    held += len(s)
                if held >= FLUSH or len(ids) >= 50_000:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        names = ["doc_id", "sid", "n", "bytes", "key", "df"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        if bucket < 0:
            cols = [pa.array([y for x in table.column(c).to_pylist() for y in x], t) for c, t in zip(names, kinds)]
            n = len(cols[0])
            return pa.Table.from_arrays([*cols, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()]).astype(np.int64)
        at = np.argsort(low, kind="stable")
        low, counts = low[at], counts[at]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        df = np.add.reduceat(counts, first)
        often = df > FREQUENT
        keys = (np.int64(bucket) << np.int64(32)) | low[first][often].astype(np.int64)
        # Two rows of sums, marked by negative keys: how often a shingle occurs, and how long the list is that it meets.
        keys = np.concatenate([keys, [-1, -2]])
        df = np.concatenate([df[often], [df.sum(), (df * np.minimum(df, FREQUENT)).sum()]])
        return pa.Table.from_arrays([*(pa.nulls(len(keys), t) for t in kinds), pa.array(keys, pa.int64()), pa.array(df, pa.int64())], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sent = rows.mapInArrow(send, "bucket int, keys binary, counts binary, doc_id array<long>, sid array<binary>, n array<long>, bytes array<long>")
    got = sent.groupBy("bucket").applyInArrow(gather, "doc_id long, sid binary, n long, bytes long, key long, df long")
    return materialize(got, "join-first")


def _lists(docs: DataFrame, order: _Order, light: int, split: int) -> DataFrame:
    """kind 0: pairs (a, b) of short lists; -1: stars (a, b) of long ones, both with the number of lists; -2: members (a) of
    long lists (key) with size n and place."""
    held_order = docs.sparkSession.sparkContext.broadcast((order.keys, order.counts, order.bits))
    bits = order.bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*held_order.value)
        keys, places, owners, sizes, seen = [], [], [], [], set()

        def flush() -> Iterator[pa.RecordBatch]:
            k = np.concatenate(keys)
            count = list(map(len, keys))
            names = np.frombuffer(b"".join(owners), "V16")
            o, n, p = np.repeat(np.arange(len(owners)), count), np.repeat(np.array(sizes, np.uint32), count), np.concatenate(places)
            at = np.argsort(k, kind="stable")
            k, o, n, p = k[at], o[at], n[at], p[at]
            of = order.parts(k, split)
            parts = np.zeros(len(k), np.int32)
            if of.any():
                # Parts of a list go by what is left of their members' names, and to groups of their own by their keys.
                salt = mix(np.frombuffer(b"".join(owners), "<u8")[1::2][o].copy())
                parts = np.where(of > 0, 1 + (mix(k) + salt % np.maximum(of, 1).astype(np.uint64)) % np.uint64(1 << 30), 0).astype(np.int32)
            for part in np.unique(parts):
                own = np.flatnonzero(parts == part) if len(parts) and parts.any() else slice(None)
                where, first, low = _split(k[own], bits)
                cut = list(zip(first[:-1], first[1:]))
                out = [pa.array(where, pa.int32()), pa.array(np.full(len(where), part), pa.int32())]
                out += [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (low, names[o[own]], n[own], p[own])]
                yield pa.RecordBatch.from_arrays(out, ["bucket", "part", "keys", "sids", "sizes", "places"])
            for x in (keys, places, owners, sizes, seen):
                x.clear()

        held = 0
        for batch in slices(batches):
            for s in shingle_sets(batch.column(0).to_pylist()):
                n = len(s)
                if not n or (sid := set_digest(s)) in seen:
                    continue
                seen.add(sid)
                own, at = [], []
                if n <= light:
                    own.append(_subset_keys(s))
                    at.append(np.zeros(len(own[-1]), np.uint32))
                if n > light or DEN * n // NUM > light:
                    own.append(order.prefix(s, prefix_length(n)))
                    at.append(np.arange(1, len(own[-1]) + 1, dtype=np.uint32))
                keys.append(np.concatenate(own))
                places.append(np.concatenate(at))
                owners.append(sid)
                sizes.append(n)
                held += len(keys[-1])
                if held >= FLUSH // 2:
                    yield from flush()
                    held = 0
        if keys:
            yield from flush()

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, part = key[0].as_py(), key[1].as_py()
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        k, n, p = read("keys", np.uint32), read("sizes", np.uint32).astype(np.int64), read("places", np.uint32).astype(np.int64)
        names, o = _numbered(b"".join(table.column("sids").to_pylist()))
        at = np.lexsort((p, o, k))
        k, o, n, p = k[at], o[at], n[at], p[at]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
        k, o, n, p = k[new], o[new], n[new], p[new]
        if not part:
            # A member whose shingle stands too far back for the smallest set of the list that could link with it is dropped.
            scale = np.int64(1 << 31)
            by_size = np.sort(k.astype(np.int64) * scale + n)
            least = by_size[np.searchsorted(by_size, k.astype(np.int64) * scale - (-NUM * n // DEN))] % scale
            keep = p <= _place_most(n, least)
            k, o, n, p = k[keep], o[keep], n[keep], p[keep]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(k)))
        short = (length <= ALL_PAIRS) & (not part)  # what is left of a split list is long as a whole
        parts = []
        for size in np.unique(length[(length > 1) & short]):
            rows = first[length == size]
            i, j = np.triu_indices(size, 1)
            i, j = (rows[:, None] + i).ravel(), (rows[:, None] + j).ravel()
            fit = (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])) & (p[i] <= _place_most(n[i], n[j])) & (p[j] <= _place_most(n[j], n[i]))
            parts.append((i[fit], j[fit], 0))
        m = np.flatnonzero(np.repeat(~short, length))
        if len(m):
            # A star in each size class: sets whose sizes differ by a third cannot link.
            band = np.floor(np.log(n[m]) / math.log(DEN / NUM)).astype(np.int64)
            again = np.lexsort((o[m], p[m], band, k[m]))
            at, band = m[again], band[again]
            begin = np.concatenate([[True], (k[at][1:] != k[at][:-1]) | (band[1:] != band[:-1])])
            pivot = at[np.flatnonzero(begin)[np.cumsum(begin) - 1]]
            other = pivot != at
            parts.append((pivot[other], at[other], -1))
        cols = [[np.zeros(0, np.int64)] for _ in range(7)]

        def put(*values: np.ndarray) -> None:
            for c, x in zip(cols, values):
                c.append(x)

        for kind in (0, -1):
            found = [x for x in parts if x[2] == kind and len(x[0])]
            if found:
                i, j = (np.concatenate([x[c] for x in found]) for c in (0, 1))
                a, b = np.minimum(o[i], o[j]), np.maximum(o[i], o[j])
                at = np.lexsort((b, a))
                a, b = a[at], b[at]
                start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                shared = np.diff(np.append(start, len(a)))
                none = np.zeros(len(start), np.int64)
                put(a[start], b[start], shared, none + kind, none - 1, none, none)
        if len(m):
            none = np.zeros(len(m), np.int64)
            put(o[m], o[m], none, none - 2, (np.int64(bucket) << np.int64(32)) | k[m].astype(np.int64), n[m], p[m])
        a, b, *rest = (np.concatenate(c).astype(np.int64) for c in cols)
        called = [pa.array(names[x].astype(object), pa.binary()) if len(x) else pa.nulls(0, pa.binary()) for x in (a, b)]
        return pa.Table.from_arrays([*called, *map(pa.array, rest)], ["a", "b", "shared", "kind", "key", "n", "place"])

    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sent = rows.mapInArrow(send, "bucket int, part int, keys binary, sids binary, sizes binary, places binary")
    got = sent.groupBy("bucket", "part").applyInArrow(meet, "a binary, b binary, shared long, kind long, key long, n long, place long")
    return materialize(got, "join-lists")


def _place_most(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The last place at which a set of n must share a shingle with a set of m that it links with."""
    return n - (-(-NUM * (n + m) // (NUM + DEN))) + 1


class _Texts:
    """Texts of sets, found by the id of a document; a set whose id is null or on several rows is found by its name instead."""

    def __init__(self, docs: DataFrame, rows: DataFrame) -> None:
        """rows: doc_id and sid of every document, written."""
        self._docs = docs
        twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_t"))
        self._twice = materialize(twice, "join-shared-ids")
        self._by_name = None if self._twice.isEmpty() else self._named()

    def _named(self) -> DataFrame:
        doc_id = F.col("_row.doc_id").cast("long")
        odd = self._docs.select(F.struct("doc_id", "text").alias("_row")).join(small(self._twice, MOST_IDS), doc_id.eqNullSafe(F.col("_t")), "left_semi")
        named = _with_sid(odd.select("_row.*")).filter("_sid IS NOT NULL").groupBy(F.col("_sid").alias("_s")).agg(F.min("_row.text").alias("text"))
        return materialize(named.select("_s", F.col("text").cast("binary").alias("text")), "join-named-texts")

    def of(self, need: DataFrame) -> DataFrame:
        """g, a, sid, rep, first and text of the written rows `need`."""
        columns = ("g", "a", "sid", "rep", "first", "text")
        texts = self._docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("binary").alias("text"))
        # Only texts that take part are moved: the ids are broadcast while they are few, and filter the scan otherwise.
        ids = need.select("rep").distinct()
        if self._by_name is None:
            texts = texts.join(small(ids, MOST_IDS), F.col("_d") == F.col("rep"), "left_semi")
            return small(need, MOST_IDS).join(texts, F.col("rep") == F.col("_d")).select(*columns)
        twice = small(self._twice, MOST_IDS)
        one = materialize(need.join(twice, F.col("rep").eqNullSafe(F.col("_t")), "left_anti"), "join-need-one")
        texts = texts.join(small(one.select("rep").distinct(), MOST_IDS), F.col("_d") == F.col("rep"), "left_semi")
        by_id = small(one, MOST_IDS).join(texts, F.col("rep") == F.col("_d")).select(*columns)
        several = need.join(twice, F.col("rep").eqNullSafe(F.col("_t")), "left_semi")
        return by_id.unionByName(several.join(self._by_name, F.col("sid") == F.col("_s")).select(*columns))


def _verify(texts: _Texts, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, exactly, as x and y: texts come together in groups of about PER_GROUP pairs or GROUP_BYTES."""
    named = lambda c: reps.select(F.col("sid").alias(f"_{c}"), F.col("rep").alias(f"rep_{c}"), F.col("bytes").alias(f"bytes_{c}"))
    pairs = pairs.select("a", "b").join(named("a"), F.col("a") == F.col("_a")).join(named("b"), F.col("b") == F.col("_b")).drop("_a", "_b")
    pairs = materialize(pairs, "join-asked")
    cost = F.greatest(F.count(F.lit(1)) / PER_GROUP, F.sum(F.col("bytes_a") + F.col("bytes_b")) / GROUP_BYTES)
    groups = max(1, math.ceil(pairs.agg(cost).first()[0] or 0))
    # A set with many partners is spread over groups by its partners' hashes.
    many = pairs.groupBy("a").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PER_GROUP, F.sum("bytes_b") / GROUP_BYTES)).alias("salts")).filter("salts > 1").withColumnRenamed("a", "_a")
    pairs = pairs.join(small(many), F.col("a") == F.col("_a"), "left").drop("_a")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))
    pairs = pairs.withColumn("g", F.pmod(F.xxhash64("a", salt), F.lit(groups)))
    need = pairs.select("g", "a", F.col("b").alias("sid"), F.col("rep_b").alias("rep"), F.lit(False).alias("first"))
    need = materialize(need.unionByName(pairs.select("g", "a", F.col("a").alias("sid"), F.col("rep_a").alias("rep"), F.lit(True).alias("first")).distinct()), "join-need")
    rows = texts.of(need)

    def look(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, sid, rep, first = (table.column(c).to_pylist() for c in ("a", "sid", "rep", "first"))
        sets: dict[bytes, np.ndarray] = {}
        for s, x in zip(sid, shingle_sets(table.column("text").to_pylist())):
            sets[s] = x
        ids = dict(zip(sid, rep))
        out = set()
        for p, s, f in zip(a, sid, first):
            if not f and (p, s) not in out and p in sets and s in sets:
                both = len(np.intersect1d(sets[p], sets[s], assume_unique=True))
                if DEN * both >= NUM * (len(sets[p]) + len(sets[s]) - both):
                    out.add((p, s))
        cols = [pa.array(c, t) for c, t in zip(zip(*((ids[p], p, ids[s], s) for p, s in out)), (pa.int64(), pa.binary()) * 2)] or [pa.nulls(0, t) for t in (pa.int64(), pa.binary()) * 2]
        return pa.Table.from_arrays(cols, ["rep_a", "a", "rep_b", "b"])

    found = rows.groupBy("g").applyInArrow(look, "rep_a long, a binary, rep_b long, b binary")
    node = lambda c: F.struct(F.col(f"rep_{c}").isNull().alias("none"), F.col(f"rep_{c}").alias("rep"), F.col(c).alias("sid"))
    return materialize(found.select(node("a").alias("x"), node("b").alias("y")), "join-links")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (x, y) but the smallest of each component, which is the root of the others.

    Large-star and small-star steps alternate. They end when each node has one edge to a node that has none; their number follows the logarithm of the size.
    """

    def least_met(pairs: DataFrame) -> DataFrame:
        """Written pairs (u, v) and the smallest v of each u, m. A hub's many pairs stay where they are (see common.meet)."""
        least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        return meet(pairs, least, ["u"], "n", F.col("v"), "_m").select("u", "v", F.col("_m.m").alias("m"))

    edges = materialize(edges.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc")
    while not all_stars(edges):
        # Large star: of all neighbours, the larger ones move to the smallest.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_met(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: the smaller neighbours and the node itself move to the smallest.
        joined = least_met(materialize(large, "cc-large"))
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(edges, "cc")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Links (x, y) with what is known of classes, as edges."""
    return links.unionByName(roots.select(F.col("node").alias("x"), F.col("root").alias("y")))


def _heads(long: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of long lists: the first member of each class of a list with the first one of the whole list.

    long: key, a, p, n and class ra of members of lists that hold several classes, written. A pair for each class, list and
    band of sizes, so near copies that ended in several classes, as in the parts of a split list, meet without all pairs.
    """
    band = F.floor(F.log("n") / math.log(DEN / NUM))
    first = long.groupBy("key", band.alias("band"), "ra").agg(F.min(F.struct("p", "a")).alias("m"))
    first = materialize(first, "join-heads")
    whole = materialize(first.groupBy("key", "band").agg(F.min("m").alias("w"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "join-head")
    met = meet(first, whole, ["key", "band"], "rows", F.col("m"), "h", "inner").select(F.col("m.a").alias("x"), F.col("h.w.a").alias("y")).filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _classes(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, n, sid and root (none, rep, sid) of every row of docs; sid and root are null without shingles."""
    # About as many shingles as words; this only sets the number of buckets.
    total = docs.select(F.sum(F.octet_length("text") / 6)).first()[0] or 0
    bits = _buckets(int(total))
    first = _first_pass(docs, bits)
    rows = first.filter("key is null").select("doc_id", "sid", "n", "bytes")
    sums = {r.key: r.s for r in first.filter("key < 0").groupBy("key").agg(F.sum("df").alias("s")).collect()}
    light = boundary(sums.get(-2, 0) / max(1, sums.get(-1, 0)))
    # Frequent shingles only order the prefixes, so a bounded list of them is enough for any corpus.
    often = first.filter("key >= 0").select("key", "df").orderBy(F.desc("df"), "key").limit(MOST_FREQUENT).toArrow()
    order = _Order(often.column("key").to_numpy().astype(np.uint64), often.column("df").to_numpy(), bits)
    lists = _lists(docs, order, light, split)
    texts = _Texts(docs, rows)
    reps = materialize(rows.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "join-reps")

    pairs = materialize(lists.filter("kind >= -1").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("kind").alias("kind")), "join-pairs")

    # One partner for each set first: the one with most in common.
    either = pairs.select("shared", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
    best = either.groupBy("e.x").agg(F.max(F.struct("shared", "e.y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()
    best = materialize(best, "join-best")
    links = _verify(texts, reps, best)
    roots = components(links)
    label = lambda df, c, roots: df.join(roots.select(F.col("node.sid").alias("_n"), F.col("root.sid").alias(f"r{c}")), F.col(c) == F.col("_n"), "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c)).drop("_n")
    unasked = lambda df, asked: df.join(asked.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    # Long lists that still hold several classes: one member of each class meets the first of the list, until none links.
    members, asked = lists.filter("kind = -2").select("key", "a", F.col("place").alias("p"), "n"), best
    while True:
        long = materialize(label(members, "a", roots), "join-long")
        mixed = long.groupBy("key").agg(F.min("ra").alias("x"), F.max("ra").alias("y"), F.count(F.lit(1)).alias("m")).filter("x <> y")
        long = materialize(meet(long, materialize(mixed.select("key", "m"), "join-mixed-keys"), ["key"], "m", F.col("a"), "_k", "inner").drop("_k"), "join-mixed")
        heads = materialize(unasked(_heads(long), asked), "join-heads-asked")
        more = None if heads.isEmpty() else _verify(texts, reps, heads)
        asked = asked.unionByName(heads)
        if more is None or more.isEmpty():
            break
        roots, members = components(_merged(roots, more)), long.drop("ra")
    # Then all pairs across classes.
    across = label(label(pairs.filter("kind = 0").select("a", "b"), "a", roots), "b", roots).filter("ra <> rb").select("a", "b")
    other = long.select(F.col("key").alias("_k"), F.col("a").alias("b"), F.col("p").alias("pb"), F.col("n").alias("nb"), F.col("ra").alias("rb"))
    last = f"1 - ceil({NUM} * (n + nb) / {NUM + DEN}.0)"
    fits = F.expr(f"a < b AND ra <> rb AND {DEN} * least(n, nb) >= {NUM} * greatest(n, nb) AND p <= n + {last} AND pb <= nb + {last}")
    across = across.unionByName(long.join(other, (F.col("key") == F.col("_k")) & fits).select("a", "b")).distinct()
    across = materialize(unasked(across, asked), "join-across")
    if not across.isEmpty():
        more = _verify(texts, reps, across)
        if not more.isEmpty():
            roots = components(_merged(roots, more))

    # The root is the smallest node, and its doc_id the smallest of the class.
    named = reps.join(roots.select(F.col("node.sid").alias("_n"), "root"), F.col("sid") == F.col("_n"), "left")
    named = named.select(F.col("sid").alias("_s"), F.coalesce("root", F.struct(F.col("rep").isNull().alias("none"), "rep", "sid")).alias("root"), "rows")
    # Sets of one of HOT rows or more, of which there are HOT at most, do not move their copies; the others meet by shuffle.
    often = max(1, (reps.agg(F.sum("rows")).first()[0] or 0) // HOT)
    named = materialize(named, "join-named")
    hot = F.broadcast(named.filter(F.col("rows") > often).select("_s", "root"))
    same = F.col("sid") == F.col("_s")
    cold = rows.join(hot, same, "left_anti").join(named.filter(F.col("rows") <= often).select("_s", "root"), same, "left")
    return rows.join(hot, same).unionByName(cold).select("doc_id", "n", "sid", "root")


def classes(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    out = _classes(docs, split)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNotNull(), F.col("root.rep")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_sid(docs: DataFrame) -> DataFrame:
    """_row, a struct of all columns of docs, and the name of its set, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names = [set_digest(s) if len(s) else None for s in shingle_sets([x or b"" for x in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary())], ["_row", "_sid"])

    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("_row", docs.schema), T.StructField("_sid", T.BinaryType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one with the smallest id. Texts without shingles all stay.

    A document is a row: of rows that share an id, each stays or goes with its own class. Where the smallest id of a class is
    on several of its rows, or all its ids are null, the smallest set of shingles stays, and of equal sets the smallest text.
    """
    found = materialize(_classes(docs), "join-classes")
    kept = found.filter("sid is null OR (doc_id <=> root.rep AND sid = root.sid)").select(F.col("doc_id").alias("_d"), F.col("sid").alias("_s"))
    # Most ids are on one row; only rows whose id is on several, or null, are told apart by their sets.
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_t"))
    twice = small(materialize(twice, "join-twice"), MOST_IDS)
    ids = kept.join(twice, F.col("_d").eqNullSafe(F.col("_t")), "left_anti").select("_d")
    nested = docs.select(F.struct("*").alias("_row"))  # columns of docs may have any name
    out = nested.join(small(materialize(ids, "join-kept"), MOST_IDS), F.col("_row.doc_id") == F.col("_d"), "left_semi").select("_row.*")
    if twice.isEmpty():
        return out
    rows = _with_sid(nested.join(twice, F.col("_row.doc_id").eqNullSafe(F.col("_t")), "left_semi").select("_row.*"))
    one = kept.filter("_s is not null").select("_s", "_d").distinct()
    one = rows.filter("_sid is not null").join(one, (F.col("_sid") == F.col("_s")) & F.col("_row.doc_id").eqNullSafe(F.col("_d"))).groupBy("_sid").agg(F.min_by("_row", "_row.text").alias("_row"))
    return out.unionByName(one.select("_row.*")).unionByName(rows.filter("_sid is null").select("_row.*"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
