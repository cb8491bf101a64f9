"""MinHash near-duplicate detection by a signature-coordinate inverted join.

A document's set holds its distinct shingles of `size` words (the whole sequence
where there are fewer words). Documents with equal sets are one class, a node of the
graph of links, named by 64 bits of the set's hash. Each class has a signature of
COORDINATES min-hashes, and is posted under (coordinate, value) pairs. Two sets as
similar as the threshold agree in at least MATCHES coordinates but for a chance below
1e-7 a pair, so that they share one of the first COORDINATES - MATCHES + 1 postings in
any order that is the same for all: rare values come first (the prefix), frequent ones
are skipped by all classes that have enough others. Within a posting list, agreements
are counted over all coordinates from 4 bits of each (which misses none), and pairs of
MATCHES or more are candidates. Every link that is used is confirmed on the full sets.

A list of m near copies isn't turned into its m * m / 2 pairs: first every class is
held against the first fitting member of its lists (a star), and components of the
confirmed links are formed. What then still shares a list with another component is
joined once more, this time on the sets themselves: by the rarest of their shingles,
so many that two sets of the wanted similarity must share one, by sizes, by how many
shingles can still agree after the shared one, and by MATCHES of the signatures,
which are counted for these pairs only. Documents that share a template,
but differ in more than a fifth of their shingles, share none of these, and are no
pair at all. Of the pairs that are left one for each two components is confirmed
first, then all that still lie across components. So each candidate pair is either
confirmed, refuted, or within one component already. Lists of more than LIST members
are worked in parts; stars of more than LIST members have their centre repeated for
each part; nothing unbounded is in one task.

Defined results: null and empty texts, and rows without an id, are linked with
nothing (component_id is the own id, or null). Ids may be of any type that has an
order. Rows that share an id are linked by their texts only; near_duplicates keeps
every row, deduplicate one row of each group, that of the smallest id, and all rows
without an id or words. Columns other than id and text aren't read, whatever they
are called.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

COORDINATES, MISS, LIST, CENTRES, HOT_SHARE, HOT_LEAST, CACHE, SMALL_IDS, HOT_SHINGLES, COMPARED = 64, 1e-7, 1 << 15, 32, 1e-4, 64, 300_000, 500_000, 500_000, 1 << 24
_rng = np.random.default_rng(20_240_101)
_A = _rng.integers(1 << 62, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_C = _rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache
def matches_needed(threshold: float, k: int = COORDINATES, miss: float = MISS) -> int:
    """The most agreements that pairs at the threshold reach but for a chance of `miss`."""
    total, t = 0.0, 0
    while t < k:
        total += math.comb(k, t) * threshold**t * (1 - threshold) ** (k - t)
        if total > miss:
            return max(1, t)
        t += 1
    return k


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = common.lower_ascii(text).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) >= CACHE:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    x = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        x += h[j : j + n]
        x *= _C[j % 64]
        x ^= x >> np.uint64(29)
    x *= _C[63]
    x ^= x >> np.uint64(32)
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES min-hashes of 32 bits."""
    out = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 2048):
        x = s[a : a + 2048, None] * _A + _B
        np.minimum(out, x.min(axis=0), out)
    return (out >> np.uint64(32)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


_ONES = np.uint64(0x1111111111111111)


def _agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many 4-bit values agree, for rows of packed bytes as 64-bit words: of the last axis."""
    if a.size < 1 << 14 and a.ndim == 2:  # fewer calls
        x = a ^ b
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        return np.uint8(COORDINATES) - np.bitwise_count(x & _ONES).sum(axis=-1, dtype=np.uint8)
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.uint8)
    for k in range(a.shape[-1]):
        x = a[..., k] ^ b[..., k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        out += np.bitwise_count(x & _ONES)
    return np.uint8(COORDINATES) - out


def _describe(size: int):
    def make():
        def one(i, h, text):
            s = shingle_set(text, size)
            return i, h, len(s), xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None, signature(s).tobytes() if len(s) else None

        return one

    return make


def _binary(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= least
            return pa.RecordBatch.from_pydict({"code": pa.array(codes[some]), "n": pa.array(counts[some])})

        for batch in batches:
            held.append(_coded(batch.column(0)).ravel())
            n += len(held[-1])
            if n > 4_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _coded(column: pa.Array) -> np.ndarray:
    sig = _binary(column, 4 * COORDINATES).view(np.uint32)
    return sig.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)


def _post(codes: np.ndarray, counts: np.ndarray, prefix: int):
    """Postings of each class under its rarest coordinates; codes and counts: the frequent ones, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _coded(batch.column(1))
            if len(codes):
                at = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
                seen = np.where(codes[at] == x, counts[at], 0)
                order = np.argsort(seen, axis=1, kind="stable")[:, :prefix]
                x, seen = np.take_along_axis(x, order, 1), np.take_along_axis(seen, order, 1)
            else:
                x = x[:, :prefix]
                seen = np.zeros_like(x)
            sig = _binary(batch.column(1), 4 * COORDINATES).view(np.uint32)
            nib = ((sig ^ (sig >> 8) ^ (sig >> 16)) & 15).astype(np.uint8)
            packed = nib[:, : COORDINATES // 2] | (nib[:, COORDINATES // 2 :] << 4)
            rep = np.repeat(batch.column(0).to_numpy(), x.shape[1])
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES // 2), len(rep), [None, pa.py_buffer(np.repeat(packed, x.shape[1], axis=0).tobytes())]).cast(pa.binary())
            parts = seen.ravel() // LIST + 1
            part = np.where(parts > 1, (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts, -1)
            yield pa.RecordBatch.from_pydict({"code": pa.array(x.ravel()), "part": pa.array(part.astype(np.int32)), "rep": pa.array(rep), "bits": rows})

    return run


def _runs(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple]:
    """Rows of one list at a time, for lists of two and more rows or with a part number, as (whether it is all of a list or part, keys, ..., bits); a list of more than `most` rows comes in parts. The first two columns are the list's key, the last is bits."""
    rest: list[np.ndarray] | None = None
    cut = False  # whether earlier rows of the list at hand have been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]] + [_binary(batch.columns[-1], COORDINATES // 2)]
        if rest is not None:
            now = [np.concatenate([a, b]) for a, b in zip(rest, now)]
        k1, k2 = now[0], now[1]
        edges = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(k1)]])
        long = ends[:-1] - starts[:-1] > 1
        if most:
            long |= k2[starts[:-1]] >= 0
            long[:1] |= cut
        for k in np.flatnonzero(long):
            yield not (cut and k == 0), *(c[starts[k] : ends[k]] for c in now)
        last = int(starts[-1])
        cut = cut and last == 0
        rest = [c[last:] for c in now]
        while most and len(rest[0]) > most:  # the next rows may belong to it too
            yield False, *(c[:most] for c in rest)
            rest, cut = [c[most:] for c in rest], True
    if rest is not None and len(rest[0]) and (len(rest[0]) > 1 or cut or most and rest[1][0] >= 0):
        yield not cut, *rest


def _promising(lists: Iterator[tuple], need: int) -> Iterator[tuple]:
    """The lists without those short whole ones of which no two members agree often enough: most, held against themselves many at once."""

    def flush() -> Iterator[tuple]:
        sizes = np.array([len(x[3]) for x in held])
        words = np.ascontiguousarray(np.concatenate([x[4] for x in held])).view(np.uint64)
        ends, of = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(held)), sizes)
        some, at, d = np.zeros(len(held), bool), np.arange(len(words)), 1
        while len(at := at[at + d < ends[at]]):
            some[of[at[_agreements(words[at], words[at + d]) >= need]]] = True
            d += 1
        yield from (held[k] for k in np.flatnonzero(some))

    held: list[tuple] = []
    rows = 0
    for x in lists:
        if not x[0] or x[2][0] >= 0 or len(x[3]) > 64:
            yield x
            continue
        held.append(x)
        rows += len(x[3])
        if rows > 20_000:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def _stars(need: int):
    """Per list: (centre, member, agreements) pairs, and the rows that have a candidate partner in it."""

    def one(rep: np.ndarray, bits: np.ndarray, whole: bool):
        codes = np.ascontiguousarray(bits).view(np.uint64)
        m = len(rep)
        paired = np.zeros(m, bool)
        pairs = []
        left = np.arange(m)
        for _ in range(CENTRES if m > 64 else m):
            if len(left) < 2:
                break
            c = left[0]
            n = _agreements(codes[left[1:]], codes[c])
            hit = n >= need
            if hit.any():
                got = left[1:][hit]
                paired[c] = paired[got] = True
                pairs.append((np.full(len(got), rep[c]), rep[got], n[hit]))
            left = left[1:][~hit]
        if not whole:  # a partner may be in another part of the list
            paired[:] = True
            return pairs, paired
        # what no centre reached may pair among itself, or with the members that a centre took; a centre that took none has no partner
        rest = np.flatnonzero(~paired) if paired.any() else left if len(left) > 1 else left[:0]
        if not len(rest):
            return pairs, paired
        if len(rest) * m > COMPARED:  # not worth finding out
            paired[rest] = True
            return pairs, paired
        others = paired.copy()
        others[left] = True
        others = np.flatnonzero(others)
        step = max(1, (1 << 18) // max(1, len(others)))
        for a in range(0, len(rest), step):
            r = rest[a : a + step]
            close = _agreements(codes[r][:, None], codes[others][None]) >= need
            close &= r[:, None] != others
            paired[r] |= close.any(axis=1)
        return pairs, paired

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["kind", "code", "u", "w", "n"])

        for whole, code, part, rep, bits in _promising(_runs(batches, LIST), need):
            pairs, paired = one(rep, bits, whole and part[0] < 0)
            for u, w, n in pairs:
                differ = u != w
                k = int(differ.sum())
                if k:
                    out.append((np.zeros(k, np.int32), np.full(k, code[0]), np.minimum(u, w)[differ], np.maximum(u, w)[differ], n[differ].astype(np.int64)))
                    size += k
            if paired.any():
                k = int(paired.sum())
                out.append((np.ones(k, np.int32), np.full(k, code[0]), rep[paired], rep[paired], np.zeros(k, np.int64)))
                size += k
            if size > 20_000:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingle_set(t, size).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["rep", "root", "shingles"])

    return run


def _agreeing(need: int):
    """Pairs whose signatures agree in enough coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_binary(batch.column(c), 4 * COORDINATES).view(np.uint32) for c in ("sig_u", "sig_w"))
                yield batch.select(["u", "w", "ru", "rw", "bound"]).filter(pa.array((a == b).sum(axis=1) >= need))

    return run


def _common_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of two and more sets of a part, and how many."""
    held, n = [], 0

    def flush():
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"code": pa.array(codes[counts > 1].view(np.int64)), "n": pa.array(counts[counts > 1])})

    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(np.frombuffer(x, np.uint64))
            n += len(held[-1])
        if n > 4_000_000:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _prefixes(codes: np.ndarray, counts: np.ndarray, percent: int):
    """Each set under its rarest shingles, so many that two similar sets share one: code, rep, root, size, and the place in the set's order. codes and counts: the frequent shingles, sorted; all others are rarer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, root, raw in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(codes, x), max(0, len(codes) - 1))
                seen = np.where(codes[at] == x, counts[at], 0) if len(codes) else np.zeros(len(x), np.int64)
                k = len(x) - -(-percent * len(x) // 100) + 1
                x = x[np.argsort(seen, kind="stable")[:k]]  # of equal counts the smaller hash first
                out.append((x.view(np.int64), np.full(k, rep), np.full(k, root), np.full(k, len(seen)), np.arange(k)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["code", "rep", "root", "size", "place"])

    return run


def _confirm(size: int, percent: int):
    """Rows (centre, part, member, text), a centre's own row first: pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []  # rows that share the centre's id are all of it
        for batch in batches:
            us, ws = [], []
            for u, part, w, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingle_set(text, size)
                if (u, part) != at:
                    at, centres = (u, part), []
                if u == w:
                    centres.append(s)
                elif any(similar(c, s, percent) for c in centres):
                    us.append(u)
                    ws.append(w)
            yield pa.RecordBatch.from_pydict({"a": pa.array(us, pa.int64()), "b": pa.array(ws, pa.int64())})

    return run


class _Job:
    """One detection: what it wrote, and its steps."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs = docs.withColumn("h", F.xxhash64("text"))
        self.size, self.percent, self.spark = size, percent, docs.sparkSession
        self.need = matches_needed(percent / 100)
        self.places: list[str] = []

    def keep(self, df: DataFrame, kind: str, rows: int = 20_000) -> DataFrame:
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        df, place = common.keep(df, kind)
        common.bounded_batches(self.spark)
        self.places.append(place)
        return df

    def texts(self, wanted: DataFrame, n: int) -> DataFrame:
        """wanted, with a column id of classes and n rows, with the text of a document of each class."""
        wanted = F.broadcast(wanted) if n <= SMALL_IDS else wanted  # at most 10 MB
        found = wanted.join(self.classes.select(F.col("rep").alias("id"), F.col("one.doc_id").alias("doc_id"), F.col("one.h").alias("h")), "id")
        return self.docs.join(F.broadcast(found) if n <= SMALL_IDS else found, ["doc_id", "h"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, w) that full sets confirm, as (a, b). Each centre's text goes once to each part of its star."""
        by = pairs.groupBy("u").agg(F.count("*").alias("n")).select("u", (F.col("n") / LIST).cast("int").alias("parts"))
        spread = pairs.join(by, "u").select("u", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("w"), F.col("parts") + 1)).otherwise(0).cast("int").alias("part"), F.col("w").alias("id"))
        to = self.keep(spread.union(spread.select("u", "part", F.col("u").alias("id")).distinct()), "pairs")
        n = to.count()
        if not n:
            return self.spark.createDataFrame([], "a long, b long")
        rows = self.texts(to, n).select("u", "part", F.col("id").alias("w"), "text")
        rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("u") != F.col("w"), "w")
        return self.keep(common.map_batches(rows, _confirm(self.size, self.percent), "a long, b long"), "links", common.BATCH_ROWS).distinct()

    def run(self) -> DataFrame:
        """One row a document: doc_id, h, n, rep, node (the component's class), and one: the (doc_id, h) of the component's smallest id."""
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        docs = common.map_rows(self.docs.select("doc_id", "h", "text"), _describe(self.size), f"doc_id {kind}, h long, n long, rep long, sig binary")
        described = self.keep(docs, "described", common.BATCH_ROWS)
        linked = described.where("doc_id is not null and n > 0")
        self.classes = self.keep(linked.groupBy("rep").agg(F.min(F.struct("doc_id", "h")).alias("one"), F.first("sig").alias("sig")), "classes")
        lasting = self.places[:]
        classes = self.classes.count()
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20_000)
        hot = max(HOT_LEAST, int(classes * HOT_SHARE))
        often = self.classes.select("sig").mapInArrow(_frequent(2), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= hot).toArrow().sort_by("code")
        codes, counts = (often[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("code", "n"))  # at most COORDINATES / HOT_SHARE
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)
        posted = self.classes.select("rep", "sig").mapInArrow(_post(codes, counts, COORDINATES - self.need + 1), "code long, part int, rep long, bits binary")
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20_000)
        found = self.keep(posted.repartition("code", "part").sortWithinPartitions("code", "part", "rep").mapInArrow(_stars(self.need), "kind int, code long, u long, w long, n long"), "stars")
        pairs = found.where("kind = 0").select("u", "w", "n")
        chosen = pairs.groupBy("w").agg(F.min("u").alias("first"), F.min_by("u", F.struct(-F.col("n"), F.col("u"))).alias("best"))
        tried = self.keep(chosen.select(F.explode(F.array_distinct(F.array("first", "best"))).alias("u"), "w"), "tried")
        links = self.links(tried)
        roots, place = graph.components(links)
        left = self.across(found.where("kind = 1").select("code", F.col("u").alias("rep")), graph.with_roots(roots), tried)
        if left is not None:
            for every in (False, True):
                pairs = left
                if every:  # what lies across components still
                    to = graph.with_roots(roots)
                    for x in ("u", "w"):
                        pairs = pairs.join(to.select(F.col("node").alias(x), F.col("root").alias(f"{x}_now")), x, "left")
                    pairs = pairs.where(F.coalesce("u_now", "u") != F.coalesce("w_now", "w")).select("u", "w")
                else:
                    pairs = pairs.groupBy("ru", "rw").agg(F.min_by(F.struct("u", "w"), F.struct(-F.col("bound"), "u", "w")).alias("p")).select("p.u", "p.w")
                more = self.links(pairs)
                if not more.isEmpty():
                    links = links.union(more)
                    self.places.append(place)
                    roots, place = graph.components(links)
        for p in self.places:
            if p not in lasting:
                common.drop_folder(self.spark, p)
        to = graph.with_roots(roots)
        least = to.join(self.classes.select(F.col("rep").alias("node"), "one"), "node").groupBy("root").agg(F.min("one").alias("top"))
        of = to.join(least, "root").select(F.col("node").alias("rep"), "root", "top")
        node = described.select("doc_id", "h", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")).join(self.classes.select("rep", "one"), "rep", "left").join(of, "rep", "left")
        return node.select("doc_id", "h", "n", F.coalesce("root", "rep").alias("node"), F.coalesce("top", "one").alias("one"))

    def across(self, live: DataFrame, roots: DataFrame, tried: DataFrame) -> DataFrame | None:
        """Untried candidate pairs of different components, from the classes that share a list with another component: u, w, their components, and how many shingles can agree. Joined on the rarest shingles of their sets."""
        rows = live.join(roots, F.col("rep") == F.col("node"), "left").select("code", "rep", F.coalesce("root", "rep").alias("root"))
        mixed = rows.groupBy("code").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("code")
        wanted = self.keep(rows.join(mixed, "code", "left_semi").select(F.col("rep").alias("id"), "root").distinct(), "live")
        n = wanted.count()
        if not n:
            return None
        texts = self.texts(wanted, n).select(F.col("id").alias("rep"), "root", "text")
        sets = self.keep(common.map_batches(texts, _sets(self.size), "rep long, root long, shingles binary").dropDuplicates(["rep"]), "sets", common.BATCH_ROWS)
        total = sets.agg(F.sum(F.octet_length("shingles") / 8).cast("long")).first()[0] or 0
        often = common.map_batches(sets.select("shingles"), _common_shingles, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, total // HOT_SHINGLES)).toArrow()  # at most HOT_SHINGLES
        codes, counts = (often[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("code", "n"))
        codes = codes.view(np.uint64)
        by = np.argsort(codes)
        posted = self.keep(common.map_batches(sets, _prefixes(codes[by], counts[by], self.percent), "code long, rep long, root long, size long, place long"), "prefixes", common.BATCH_ROWS)
        shared = posted.groupBy("code").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("code")
        posted = posted.join(shared, "code", "left_semi")
        a, b = (posted.select("code", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "root", "size", "place"))) for x in "ab")
        p = self.percent
        bound = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))  # the shared shingle and all after it
        pairs = a.join(b, "code").where("rep_a < rep_b AND root_a != root_b").where((100 * F.least("size_a", "size_b") >= p * F.greatest("size_a", "size_b")) & ((100 + p) * bound >= p * (F.col("size_a") + F.col("size_b"))))
        pairs = pairs.groupBy(F.col("rep_a").alias("u"), F.col("rep_b").alias("w")).agg(F.max(bound).alias("bound"), F.least(F.first("root_a"), F.first("root_b")).alias("ru"), F.greatest(F.first("root_a"), F.first("root_b")).alias("rw"))
        for x in ("u", "w"):
            pairs = pairs.join(self.classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}")), x)
        pairs = common.map_batches(pairs.select("u", "w", "ru", "rw", "bound", "sig_u", "sig_w"), _agreeing(self.need), "u long, w long, ru long, rw long, bound long")
        left = self.keep(pairs.join(tried, ["u", "w"], "left_anti"), "across")
        return None if left.isEmpty() else left


def _found(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    return _Job(common.texts(docs, id_col, text_col), size, percent).run()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id it reaches by links of at least `percent` similarity), kept (whether it is that one)."""
    found = _found(docs, id_col, text_col, size, percent)
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("one.doc_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all its columns, with one document of each group; rows without an id or words stay."""
    found = _found(docs, id_col, text_col, size, percent).where("node is not null")
    i, h = f"i_{uuid.uuid4().hex}", f"h_{uuid.uuid4().hex}"  # names that no table has
    same = F.struct("doc_id", "h") == F.col("one")
    gone = found.where(~same).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    again = found.where(same).groupBy(F.col("doc_id").alias(i), F.col("h").alias(h)).count().where("count > 1").select(i, h)
    rows = docs.withColumn(h, F.xxhash64(F.col(f"`{text_col}`"))).withColumn(i, F.col(f"`{id_col}`"))
    rest = rows.join(gone, [i, h], "left_anti")
    if not again.isEmpty():  # equal rows of one id
        rest = rest.join(again, [i, h], "left_anti").unionByName(rest.join(again, [i, h], "left_semi").dropDuplicates([i, h]))
    return rest.select(*(F.col(f"`{c}`") for c in docs.columns))
