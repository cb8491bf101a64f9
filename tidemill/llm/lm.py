"""Language-model scores by a weighted backoff automaton.

States are word histories of the training texts, arcs their seen continuations with
smoothed log probabilities, and a failure arc leads from each history to the one
without its first word, at the weight that the seen continuations leave. A text's
score is that of one traversal from left to right that carries the state
(Automaton.traverse, all texts of a block in step): where a state has no arc for the next word, its failure arc is
taken and its weight added, until some state has one; the start has one for all words.

All n-grams of up to `order` words are counted over all training texts; none is left
out. Their number grows with the corpus, so that they are never whole in one place:

1. Texts are read into blocks of about BLOCK_BYTES, numbered word by word and written
   to the shared folder; nothing is shuffled for that, and what follows starts there.
2. Each chunk of blocks hands its distinct n-grams, as sorted keys with their training
   counts and which of its blocks hold them, to ranges of keys. A range adds up what all
   chunks hold and answers each in the order in which it asked. Keys are hashes of whole
   n-grams, so that ranges are even whatever word, history or text is frequent: an n-gram
   comes once from a chunk at most. For each n-gram one block is told to count it.
3. Each block counts, of the n-grams it was told to, how many continue each history;
   the ranges add these up, again by the history's own key, and answer.
4. Each block builds the part of the automaton that its n-grams make, and traverses
   its texts. Every arc or failure arc that a text of the block takes is in that part.

Chunks and ranges exchange a row each with each. Both are as many as memory demands: a
range's keys are in memory at once, a chunk's blocks one at a time and all else of it
compressed. With many blocks a chunk has CHUNK_BLOCKS of them, so that at 30 GB a row
still holds more than a thousand n-grams, and tasks work several chunks or ranges one by one.

Smoothing is interpolated absolute discounting: for a history h seen C(h) times, with
T(h) distinct continuations, P(w | h) = (max(c(hw) - D, 0) + D T(h) P(w | h')) / C(h),
with h' the history without its first word; so D T(h) / C(h) is the failure arc's
weight. D = n1 / (n1 + 2 n2) for each order, from the counts of counts. What unigrams
lose is the probability of an unknown word, a single symbol. Each history's
probabilities sum to 1 over all known words, the end and the unknown word. N-grams
are told apart by their length and by hashes of so many bits that less than one pair
of different ones is expected to be taken for one, in all (bits_for).

Defined results: null and empty texts consist of the end only; without training
texts every word is unknown and has probability 1; equal rows are scored one by
one; other columns aren't read; of no texts there are no rows.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES, RANGE_KEYS, ORDER, MOST_PARTITIONS = 6 << 20, 1_500_000, 3, 20_000
CHUNK_BLOCKS, LEAST_CHUNKS = 8, 64  # chunks grow up to so many blocks (by half more at most) once there are so many of them
SLICES, HELD_BYTES, SHARED = 16, 32 << 20, 1 << 20  # a chunk's keys are merged in so many slices, beyond so many bytes they wait in a file; its answers are shared out by so many
END = b"\x20"  # no word holds a blank
START = 0  # a text's start, as a word of a block


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and one end."""
    return [*common.lower_ascii(text).split(), END]


def pack(x: np.ndarray) -> bytes:
    """Numbers of 0 and more: bytes of the same weight side by side, compressed."""
    x = np.asarray(x).astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return np.array([len(x), width], "<i8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n, width = np.frombuffer(raw[:16], "<i8").tolist()
    body = pa.decompress(raw[16:], decompressed_size=n * width, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by their distances."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


class _Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (history ^ (history >> np.uint64(31))) * _M1 + word
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


_START_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"", 1))
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))


def bits_for(n: int) -> int:
    """Bits of keys for n n-grams: so many that less than one pair of different ones is expected to share a key, in all; 56 at least, 64 at most."""
    return min(64, max(56, 2 * n.bit_length() + 2))


def _key(hashed: np.ndarray, order: int, last_is_end: np.ndarray, bits: int) -> np.ndarray:
    """The last three bits hold the n-gram's length (1 to 4, less one) and whether it ends a text."""
    return (hashed >> np.uint64(67 - bits) << np.uint64(3)) | np.uint64((order - 1) << 1) | last_is_end.astype(np.uint64)


BLOCKS = "block string, ids array<{kind}>, tokens long, sizes binary, train binary, x binary, words binary"


def blocks_of(rows: DataFrame) -> tuple[DataFrame, str]:
    """The kept table of blocks from rows (doc_id, text, train), and its place. A block's name is made where it is written: only those of committed tasks are in the table."""
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids, sizes, train, parts, size = _Numbers(), [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            x = place[np.concatenate(parts)]
            values = [[f"{uuid.uuid4().hex}"], pa.array([ids], pa.list_(id_type)), pa.array([len(x)], pa.int64()), [pack(sizes)], [pack(np.array(train, np.int64))], [pack(x)], [pack_keys(hashes[order])]]
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.string() if isinstance(v[0], str) else pa.binary()) for v in values], names=["block", "ids", "tokens", "sizes", "train", "x", "words"])

        for batch in batches:
            for i, text, yes in zip(*(c.to_pylist() for c in batch.columns)):
                got = words_of(text)
                parts.append(np.fromiter(map(seen.__getitem__, got), np.int64, len(got)))
                ids.append(i)
                sizes.append(len(got))
                train.append(bool(yes))
                size += len(text or "") + 16
                if size >= BLOCK_BYTES:
                    yield flush()
                    seen, ids, sizes, train, parts, size = _Numbers(), [], [], [], [], 0
        if ids:
            yield flush()

    return common.keep(common.map_batches(rows.select("doc_id", "text", "train"), run, BLOCKS.format(kind=kind.simpleString())), "blocks")


def _order(x: np.ndarray) -> np.ndarray:
    """A stable argsort of numbers from 0 up: sorting leading bits with the places behind them is much faster."""
    if not len(x):
        return np.zeros(0, np.int64)
    x = x.astype(np.uint64, copy=False)
    low, high = int(x.min()), int(x.max())
    places = len(x).bit_length()
    drop = max(0, (high - low).bit_length() + places - 64)
    by = np.sort((x - np.uint64(low)) >> np.uint64(drop) << np.uint64(places) | np.arange(len(x), dtype=np.uint64))
    by = (by & np.uint64((1 << places) - 1)).astype(np.int64)
    if drop:
        y = x[by]
        if (y[1:] < y[:-1]).any():  # different numbers of the same leading bits
            return np.argsort(x, kind="stable")
    return by


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, a place of each, and which of them is at each place."""
    by = _order(codes)
    codes = codes[by]
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    inverse = np.empty(len(codes), np.int32)
    inverse[by] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return codes[new], by[new], inverse


class Block:
    """A block's n-grams. Words are numbered from 1; START stands before each text."""

    def __init__(self, sizes: bytes, train: bytes, x: bytes, words: bytes, order: int, bits: int = 64):
        self.sizes = unpack(sizes).astype(np.int64)
        self.hashes = np.concatenate([[_START_HASH], unpack_keys(words)])
        x = unpack(x).astype(np.int64) + 1
        self.width, texts = len(self.hashes), len(self.sizes)
        first = np.cumsum(np.concatenate([[0], self.sizes[:-1] + 1]))
        self.first = first
        y = np.zeros(len(x) + texts, np.int64)
        real = np.ones(len(y), bool)
        real[first] = False
        y[real] = x
        at = np.arange(len(y)) - np.repeat(first, self.sizes + 1)  # place within the text, START's is 0
        learned = np.repeat(unpack(train).astype(bool), self.sizes + 1)
        self.y, self.real = y, real
        self.end = int(np.searchsorted(self.hashes[1:], _END_HASH)) + 1
        # by order: keys, own training counts, numbers of history, suffix and last word; and of the n-gram that ends at each place
        self.keys, self.own, self.history, self.suffix, self.last = [_key(self.hashes, 1, np.arange(self.width) == self.end, bits)], [np.bincount(y[learned], minlength=self.width)], [None], [None], [np.arange(self.width)]
        self.grams = [y]
        gram, hashed = y, self.hashes
        for k in range(2, order + 1):
            where = np.flatnonzero(at >= k - 1)
            codes, one, inverse = _distinct(gram[where - 1].astype(np.int64) * self.width + y[where])
            history, last = (codes // self.width).astype(np.int32), (codes % self.width).astype(np.int32)
            self.suffix.append(gram[where[one]])
            self.history.append(history)
            self.last.append(last)
            hashed = _mix(hashed[history], self.hashes[last])
            self.keys.append(_key(hashed, k, last == self.end, bits))
            self.own.append(np.bincount(inverse[learned[where]], minlength=len(codes)))
            gram = np.zeros(len(y), np.int32)  # no state is long enough to ask where there is none
            gram[where] = inverse
            self.grams.append(gram)
        self.cuts = np.cumsum([len(k) for k in self.keys])[:-1]

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, and their places before."""
        keys = np.concatenate(self.keys)
        order = _order(keys)
        return keys[order], order

    def asked(self, counts: np.ndarray) -> np.ndarray:
        """The histories, of those in all orders but the last, whose continuations aren't known from their count: none of the ended, one of those seen once."""
        keys = np.concatenate(self.keys[:-1]) if len(self.keys) > 1 else np.zeros(0, np.uint64)
        return np.flatnonzero((counts[: len(keys)] > 1) & (keys & np.uint64(1) == 0))


def range_of(keys: np.ndarray, ranges: int, bits: int = 64) -> np.ndarray:
    """Ranges of keys, in the keys' order."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def chunks_of(blocks: DataFrame, n: int) -> tuple[DataFrame, str, int]:
    """The n blocks kept with their chunk and their number in it, the place, and about how many chunks there are. Chunks are made of what is read together, without a shuffle."""
    each = min(CHUNK_BLOCKS, max(1, n // LEAST_CHUNKS))
    most, chunks = each + each // 2, -(-n // each)
    at = F.col("at").bitwiseAND((1 << 33) - 1)  # place in the partition
    numbered = blocks.coalesce(chunks).withColumn("at", F.monotonically_increasing_id())
    return *common.keep(numbered.select(F.concat_ws("-", F.shiftright("at", 33), F.floor(at / most)).alias("chunk"), (at % most).cast("int").alias("nth"), *(c for c in blocks.columns if c != "block")), "chunks"), chunks


def _parts(chunk: str, keys: np.ndarray, n: np.ndarray, who: np.ndarray, ranges: int, bits: int) -> pa.RecordBatch:
    """Sorted keys, numbers and blocks as one row for each range that has some."""
    span = range_of(keys, ranges, bits)
    starts = np.flatnonzero(np.diff(span, prepend=-1)).tolist()
    some = list(zip(span[starts].tolist(), starts, [*starts[1:], len(keys)]))
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(some), pa.string()), pa.array([r for r, _, _ in some], pa.int32()), *(pa.array([f(x[a:b]) for _, a, b in some], pa.binary()) for f, x in ((pack_keys, keys), (pack, n), (pack, who)))],
        names=["chunk", "span", "keys", "n", "who"],
    )


class _Asked:
    """What a chunk's blocks ask, until each of its n-grams is asked once for all of them."""

    def __init__(self, ranges: int, bits: int):
        self.ranges, self.bits = ranges, bits
        self.held, self.slices = tempfile.SpooledTemporaryFile(HELD_BYTES), [[] for _ in range(min(SLICES, ranges))]

    def add(self, nth: int, keys: np.ndarray, n: np.ndarray) -> None:
        """A block's sorted keys and their numbers."""
        cut = np.searchsorted(range_of(keys, self.ranges, self.bits), np.arange(len(self.slices) + 1) * self.ranges // len(self.slices)).tolist()
        for found, a, b in zip(self.slices, cut, cut[1:]):
            if a < b:
                raw = pack_keys(keys[a:b]), pack(n[a:b])
                found.append((nth, self.held.tell(), *map(len, raw)))
                self.held.write(b"".join(raw))

    def parts(self, chunk: str) -> Iterator[pa.RecordBatch]:
        with self.held:
            for found in filter(None, self.slices):
                keys, n, who = [], [], []
                for nth, at, a, b in found:
                    self.held.seek(at)
                    keys.append(unpack_keys(self.held.read(a)))
                    n.append(unpack(self.held.read(b)))
                    who.append(np.full(len(n[-1]), 1 << nth, np.uint64))
                keys, n, who = map(np.concatenate, (keys, n, who))
                order = _order(keys)
                keys = keys[order]
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                yield _parts(chunk, keys[starts], np.add.reduceat(n[order], starts), np.add.reduceat(who[order], starts), self.ranges, self.bits)


PARTS = "chunk string, span int, keys binary, n binary, who binary"
PARTS_ARROW = pa.schema([("chunk", pa.string()), ("span", pa.int32()), *((c, pa.binary()) for c in ("keys", "n", "who"))])
ANSWERS = "chunk string, span int, data binary, who binary, tag int, value long, n long, total long"
MORE = "chunk string, span int, more binary, who binary"


def _ask(order: int, ranges: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch)))
        for chunk, own in groupby(rows, key=lambda row: row["chunk"]):
            asked = _Asked(ranges, bits)
            for row in own:
                b = Block(row["sizes"], row["train"], row["x"], row["words"], order, bits)
                keys, place = b.sorted()
                asked.add(row["nth"], keys, np.concatenate(b.own)[place])
                del b, keys, place
            yield from asked.parts(chunk)

    return run


def _together(parts: pa.Table) -> tuple[pa.Table, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a range's rows: the rows in the chunks' order, their sizes, the order of all keys, where each distinct key starts in it, to which of these each belongs, and the numbers in that order."""
    parts = parts.sort_by("chunk")
    each = [unpack_keys(x.as_py()) for x in parts.column("keys")]
    sizes = [len(x) for x in each]
    keys = np.concatenate(each)
    del each
    order = _order(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    n = np.concatenate([unpack(x.as_py()) for x in parts.column("n")]).astype(np.int64)[order]
    return parts, sizes, order, np.flatnonzero(new), np.cumsum(new) - 1, n, keys


def _split(x: np.ndarray, order: np.ndarray, sizes: list[int]) -> list[bytes]:
    back = np.empty(len(x), np.int64)
    back[order] = x
    return [pack(p) for p in np.split(back, np.cumsum(sizes)[:-1])]


def _bucket(c: np.ndarray) -> np.ndarray:
    """Counts by their ten leading bits; only how many are 1 and 2 is used."""
    shift = np.maximum(0, np.frexp(c.astype(np.float64))[1] - 10)
    return (c >> shift) << shift


def _add(bits: int):
    start = _key(np.array([_START_HASH]), 1, np.array([False]), bits)[0]

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        """Answers of 2 * count + 1 where the chunk is the one to count the n-gram, else 2 * count; and counts of counts by the keys' last bits (-1 for START)."""
        parts, sizes, order, starts, of, n, keys = _together(parts)
        total = np.add.reduceat(n, starts)
        yes = n > 0
        before = np.cumsum(yes)
        teller = yes & (before - (before[starts] - yes[starts])[of] == 1)
        data = _split(total[of] * 2 + teller, order, sizes)
        one = keys[starts]
        tag = np.where(one == start, -1, (one & np.uint64(7)).astype(np.int64))
        some = total > 0
        tag, total = tag[some], total[some]
        codes, inverse, many = np.unique((tag + 1) << 56 | _bucket(total), return_inverse=True, return_counts=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, inverse, total)
        a, s = len(data), len(codes)
        return pa.table({
            "chunk": pa.array([*parts.column("chunk").to_pylist(), *[None] * s], pa.string()), "span": pa.array([*parts.column("span").to_pylist(), *[None] * s], pa.int32()),
            "data": pa.array([*data, *[None] * s], pa.binary()), "who": pa.array([*parts.column("who").to_pylist(), *[None] * s], pa.binary()),
            "tag": pa.array([*[None] * a, *((codes >> 56) - 1).tolist()], pa.int32()), "value": pa.array([*[None] * a, *(codes & ((1 << 56) - 1)).tolist()], pa.int64()), "n": pa.array([*[None] * a, *many.tolist()], pa.int64()), "total": pa.array([*[None] * a, *sums.tolist()], pa.int64()),
        })

    return run


def _add_continuations(key: tuple, parts: pa.Table) -> pa.Table:
    parts, sizes, order, starts, of, n, _ = _together(parts)
    return pa.table({"chunk": parts.column("chunk"), "span": parts.column("span"), "more": pa.array(_split(np.add.reduceat(n, starts)[of], order, sizes), pa.binary()), "who": parts.column("who")})


@dataclass
class Sums:
    """What the whole corpus says of itself: tokens, distinct words, and the discount of each order."""

    tokens: int
    vocabulary: int
    discounts: list[float]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities for counts; of an unknown word for 0."""
        if not self.tokens:
            return np.ones(len(counts))
        d = self.discounts[0]
        return np.where(counts > 0, (counts - d) / self.tokens, max(d * self.vocabulary / self.tokens, 1e-300))


def sums_of(stats: list, order: int) -> Sums:
    """From rows (tag, value, n, total)."""
    by = {k: [r for r in stats if r.tag >= 0 and r.tag >> 1 == k - 1] for k in range(1, order + 1)}
    ones, twos = ({k: sum(r.n for r in rows if r.value == v) for k, rows in by.items()} for v in (1, 2))
    return Sums(sum(r.total for r in by[1]), sum(r.n for r in by[1]), [min(0.95, max(0.05, ones[k] / (ones[k] + 2 * twos[k]))) if ones[k] else 0.5 for k in by])


class Automaton:
    """The part of the automaton that a block's n-grams make.

    States and arcs are n-grams, numbered over all orders on end. The block has numbered
    the n-grams that end at each place, so that an arc is found by its number: that of
    the state's words and the next one. A state that holds the last k words read is
    carried as k. Each arc has its log10 probability and the length of the state after
    it, each state the weight of its failure arc, which leads to the state of k - 1 words.
    """

    ALONE = 24  # so few texts are traversed one by one, more of them in step

    def __init__(self, b: Block, counts: np.ndarray, continued: np.ndarray, sums: Sums):
        by, t, order = np.split(counts, b.cuts), np.split(continued, b.cuts), len(b.keys)
        p = sums.unigram(by[0].astype(np.float64))
        chance, back, after = [p], [], []
        longest = ((by[0] > 0) & (b.last[0] != b.end) & (order > 1)).astype(np.int8)
        after.append(longest)
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(2, order + 1):
                h, s, d = b.history[k - 1], b.suffix[k - 1], sums.discounts[k - 1]
                c, total = by[k - 1].astype(np.float64), by[k - 2].astype(np.float64)
                back.append(np.log10(d * t[k - 2] / total))
                p = (np.maximum(c - d, 0) + d * t[k - 2][h] * p[s]) / total[h]
                chance.append(p)
                longest = np.where((c > 0) & (b.last[k - 1] != b.end) & (k < order), k, longest[s]).astype(np.int8)
                after.append(longest)
            self.weight = np.log10(np.concatenate(chance))
        self.seen, self.back, self.after = counts > 0, np.concatenate(back) if back else np.zeros(0), np.concatenate(after)
        self.seen[: b.width] = True  # the start has an arc for every word, unknown ones too
        offsets = np.concatenate([[0], b.cuts])
        self.arcs = np.stack([(g + o).astype(np.int32) for g, o in zip(b.grams, offsets)])  # by length of state and place
        self.first = int(order > 1 and by[0][START] > 0)

    def traverse(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probabilities of the texts whose START is at `first`: each is read once from left to right, all of them a word at a time."""
        order = np.argsort(-sizes, kind="stable")
        at, left = first[order], np.sort(sizes)
        total, state = np.zeros(len(at)), np.full(len(at), self.first, np.int64)
        arcs, places = self.arcs.ravel(), self.arcs.shape[1]
        for step in range(1, int(sizes.max(initial=0)) + 1):
            m = len(at) - int(np.searchsorted(left, step))  # texts with so many words
            if m < self.ALONE:
                for i in range(m):
                    total[i] = self._alone(int(at[i]) + step, int(at[i] + sizes[order[i]]) + 1, int(state[i]), float(total[i]))
                break
            place, k = at[:m] + step, state[:m]
            arc = arcs[k * places + place]
            stuck = np.flatnonzero(~self.seen[arc])
            while len(stuck):
                total[stuck] += self.back[arcs[(k[stuck] - 1) * places + place[stuck] - 1]]
                k[stuck] -= 1
                arc[stuck] = arcs[k[stuck] * places + place[stuck]]
                stuck = stuck[~self.seen[arc[stuck]]]
            total[:m] += self.weight[arc]
            state[:m] = self.after[arc]
        out = np.empty(len(at))
        out[order] = total
        return out

    def _alone(self, a: int, b: int, k: int, total: float) -> float:
        """The same for one text, from place a to b, in the state of k words."""
        for low in range(a, b, 1 << 16):
            high = min(b, low + (1 << 16))
            arcs = self.arcs[:, low:high]
            seen, weight, after = self.seen[arcs].tolist(), self.weight[arcs].tolist(), self.after[arcs].tolist()
            back = self.back[self.arcs[:-1, low - 1 : high - 1]].tolist()
            for i in range(high - low):
                while not seen[k][i]:
                    k -= 1
                    total += back[k][i]
                total += weight[k][i]
                k = after[k][i]
        return total


def _shares(group: pa.Table, column: str, blocks: list[int]) -> dict[int, list[bytes]]:
    """Each block's answers of a chunk in its sorted keys' order, compressed. Of a chunk that is to count an n-gram, the first block that holds it is."""
    rows, data, who = np.flatnonzero(pc.is_valid(group.column(column)).to_numpy()), group.column(column), group.column("who")
    rows = rows[np.argsort(group.column("span").take(pa.array(rows)).to_numpy(), kind="stable")].tolist()
    out, x, w, size = {nth: [] for nth in blocks}, [], [], 0
    for i in rows:
        x.append(unpack(data[i].as_py()))
        w.append(unpack(who[i].as_py()))
        size += len(x[-1])
        if size < SHARED and i != rows[-1]:
            continue
        x, w = np.concatenate(x), np.concatenate(w)
        if column == "data":
            told = x & np.uint64(1)
            x -= told
        for nth in blocks:
            mine = np.flatnonzero(w & np.uint64(1 << nth))
            own = x[mine]
            if column == "data":
                own |= told[mine] * (w[mine] & np.uint64((1 << nth) - 1) == 0)
            out[nth].append(pack(own))
        x, w, size = [], [], 0
    return out


def _given(group: pa.Table, order: int, bits: int) -> Iterator[tuple[int, int, Block, np.ndarray]]:
    """Of a chunk's blocks, one at a time: the row, the number, itself, and the answers' numbers in the order of its n-grams."""
    whole = np.flatnonzero(pc.is_valid(group.column("x")).to_numpy()).tolist()
    nth = [group.column("nth")[i].as_py() for i in whole]
    answers = _shares(group, "data", nth)
    for i, k in zip(whole, nth):
        b = Block(*(group.column(c)[i].as_py() for c in ("sizes", "train", "x", "words")), order, bits)
        answer = np.concatenate([unpack(x) for x in answers.pop(k)]).astype(np.int64)
        _, place = b.sorted()
        counts = np.empty(len(answer), np.int64)
        counts[place] = answer
        del answer, place
        yield i, k, b, counts
        del b, counts


def _ask_continuations(order: int, ranges: int, bits: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        asked = _Asked(ranges, bits)
        for _, nth, b, answer in _given(group, order, bits):
            counts, teller = answer >> 1, np.split(answer & 1, b.cuts)
            told = np.concatenate([np.bincount(b.history[k][teller[k] > 0], minlength=len(b.keys[k - 1])) for k in range(1, order)])
            which = b.asked(counts)
            keys = np.concatenate(b.keys[:-1])[which]
            by = _order(keys)
            asked.add(nth, keys[by], told[which][by])
            del b, answer, counts, teller, told, which, keys, by
        return pa.Table.from_batches(asked.parts(key[0].as_py()), PARTS_ARROW)

    return run


def _score(order: int, sums: Sums, bits: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        out, more = [], _shares(group, "more", [n for n in group.column("nth").to_pylist() if n is not None])
        for i, nth, b, answer in _given(group, order, bits):
            counts = answer >> 1
            continued = (counts > 0).astype(np.int64)  # what was seen once goes on in one way
            which = b.asked(counts)
            if more[nth]:
                place = which[_order(np.concatenate(b.keys[:-1])[which])]
                continued[place] = np.concatenate([unpack(x) for x in more.pop(nth)]).astype(np.int64)
            words = counts[: b.width].astype(np.float64)
            model = Automaton(b, counts, continued, sums)
            scores = model.traverse(b.first, b.sizes) if sums.tokens else np.zeros(len(b.sizes))
            base = np.log10((words + 1) / (sums.tokens + sums.vocabulary + 1))
            x = b.y[b.real]
            starts = np.cumsum(b.sizes) - b.sizes
            out.append(pa.table({"doc_id": group.column("ids")[i].values, "n_tokens": pa.array(b.sizes), "n_known": pa.array(np.add.reduceat((words > 0).astype(np.int64)[x], starts)), "base_score": pa.array(np.add.reduceat(base[x], starts)), "score": pa.array(scores, pa.float64())}))
            del b, answer, counts, continued, which, model, base, x
        return pa.concat_tables(out)

    return run


SCORED = "n_tokens long, n_known long, base_score double, score double"


def _let_go(spark) -> None:
    """Shuffle files of what is kept go when the driver collects its garbage: now. Twice, since what an event still holds at first would stay long."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score. training: a function from the id column to whether a text is learned from. order: 1 to 4."""
    if not 1 <= order <= 4:
        raise ValueError("n-grams of one to four words are counted")
    spark = docs.sparkSession
    rows = common.texts(docs, id_col, text_col).withColumn("train", F.coalesce(training(F.col("doc_id")), F.lit(False)))
    blocks, place = blocks_of(rows)
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens")).first()
    kind = docs.schema[id_col].dataType.simpleString()
    if not size.blocks:
        return spark.createDataFrame([], f"doc_id {kind}, {SCORED}, train_tokens long")
    blocks, _, chunks = chunks_of(blocks, size.blocks)
    common.drop_folder(spark, place)
    most = size.tokens * order * 6 // 10  # n-grams that blocks hold, about
    ranges, bits = max(1, -(-most // RANGE_KEYS)), bits_for(most)
    to_ranges, to_chunks = (min(3 * n, 512 + n // 8, MOST_PARTITIONS) for n in (ranges, chunks))  # few seldom meet in one; many are worked one by one, since each task reads from each
    parts = common.map_batches(blocks.drop("ids", "tokens"), _ask(order, ranges, bits), PARTS)
    answers, _ = common.keep(parts.repartition(to_ranges, "span").groupBy("span").applyInArrow(_add(bits), ANSWERS), "counts")
    _let_go(spark)
    stats = answers.where("chunk is null").groupBy("tag", "value").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a few thousand at most: values of more than ten bits are rounded
    sums = sums_of(stats, order)
    given = blocks.unionByName(answers.where("chunk is not null").select("chunk", "span", "data", "who"), allowMissingColumns=True).withColumn("more", F.lit(None).cast("binary"))
    if order > 1 and sums.tokens:
        parts = given.repartition(to_chunks, "chunk").groupBy("chunk").applyInArrow(_ask_continuations(order, ranges, bits), PARTS)
        more, _ = common.keep(parts.repartition(to_ranges, "span").groupBy("span").applyInArrow(_add_continuations, MORE), "continuations")
        _let_go(spark)
        given = given.unionByName(more, allowMissingColumns=True)
    found = given.repartition(to_chunks, "chunk").groupBy("chunk").applyInArrow(_score(order, sums, bits), f"doc_id {kind}, {SCORED}")
    return found.withColumn("train_tokens", F.lit(sums.tokens).cast("long"))
