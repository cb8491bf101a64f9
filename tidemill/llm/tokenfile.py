"""Token ids in files of Simple-8b words.

A word of 64 bits holds a selector of 4 bits and 60 bits of ids: selector 1 is 120
zeros, 2 to 15 are 60 x 1, 30 x 2, 20 x 3, 15 x 4, 12 x 5, 10 x 6, 8 x 7, 7 x 8,
6 x 10, 5 x 12, 4 x 15, 3 x 20, 2 x 30 and 1 x 60 bits; selector 0 is an escape
that holds the place of a larger id in the block's table of full 64-bit values.
Ids are packed greedily, in blocks of at most BLOCK ids; every block is decoded on
its own with one gather per selector.

A file: magic, blocks (ids, words, escapes as three u32, then words, then escapes,
all u64 little-endian), then the footer: block offsets, per document id, whether
the id is null, and number of ids; last the footer's length and the magic.

Documents are range-partitioned and sorted by id, so that part files are in order
of the whole; the manifest (one row a file) gives each file's first position by a
running sum over files.

Defined results: null and empty texts have the end id only; null document ids come
first; rows with equal ids are in the order of a hash of their text, so that very
many of them are still in more than one range; an empty table gives no file
and no row; document ids are whole numbers.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .warc import _stream

MAGIC, BLOCK, CACHE = b"S8BTOK01", 1 << 16, 1_000_000
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)


def _selectors(x: np.ndarray) -> np.ndarray:
    """The first selector whose width holds each id; 16 where none does."""
    return (np.searchsorted(_LIMITS, x, side="right") + 1).astype(np.uint8)


_SHORT = _selectors(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of the ids of one block."""
    x = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(x)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # the selector with most ids that fits from every place on
    bits = _SHORT[x] if int(x.max()) < len(_SHORT) else _selectors(x)
    sel = np.where(bits <= 15, 15, 0).astype(np.int8)
    for s in range(14, 0, -1):
        c = int(COUNTS[s])
        row = bits <= s
        if c > n:
            break
        have = 1  # row[i] tells whether the `have` ids from i on are narrow enough
        while have < c and len(row):
            more = min(have, c - have)
            row = row[: len(row) - more] & row[more:]
            have += more
        fits = np.flatnonzero(row)
        if not len(fits) and s < 13:
            break
        sel[fits] = s
    step = COUNTS[sel].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    chosen = sel[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s < 2:
            continue
        k = np.flatnonzero(chosen == s)
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        got = x[at[k][:, None] + np.arange(c)] << (np.arange(c, dtype=np.uint64) * np.uint64(w))
        words[k] |= np.bitwise_or.reduce(got, axis=1)
    out = np.flatnonzero(chosen == 0)
    words[out] = np.arange(len(out), dtype=np.uint64)
    return words, x[at[out]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[sel])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        if s == 1:
            continue
        to = (ends[k] - c)[:, None] + np.arange(c)
        if s == 0:
            out[to[:, 0]] = escapes[(words[k] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        else:
            out[to] = (words[k][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(w))) & np.uint64((1 << w) - 1)
    return out


class Writer:
    """One file: add(doc_id, ids) in order, then close()."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.offsets, self.docs, self.held, self.n_held, self.n_ids = [], [], [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        stop = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for a in range(0, stop, BLOCK):
            part = ids[a : min(a + BLOCK, stop)]
            words, escapes = pack(part)
            data = struct.pack("<3I", len(part), len(words), len(escapes)) + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        d = list(zip(*self.docs)) or [(), (), ()]
        foot = struct.pack("<2Q", len(self.offsets), len(self.docs)) + np.array(self.offsets, "<u8").tobytes() + np.array(d[0], "<i8").tobytes() + np.array(d[1], np.uint8).tobytes() + np.array(d[2], "<u8").tobytes()
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        self.out.close()


class Reader:
    """Blocks by number, and the documents' ids and lengths."""

    def __init__(self, f):
        self.f, size = f, f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError("no token file")
        n = struct.unpack("<Q", tail[:8])[0]
        foot = f.read_at(n, size - 16 - n)
        blocks, docs = struct.unpack_from("<2Q", foot)
        self.offsets = np.frombuffer(foot, "<u8", blocks, 16)
        self.ends = np.append(self.offsets[1:], size - 16 - n).astype(np.int64)
        p = 16 + 8 * blocks
        self.ids, self.null, self.lengths = np.frombuffer(foot, "<i8", docs, p), np.frombuffer(foot, np.uint8, docs, p + 8 * docs), np.frombuffer(foot, "<u8", docs, p + 9 * docs).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        a = int(self.offsets[k])
        data = self.f.read_at(int(self.ends[k]) - a, a)
        n, w, e = struct.unpack_from("<3I", data)
        out = unpack(np.frombuffer(data, "<u8", w, 12), np.frombuffer(data, "<u8", e, 12 + 8 * w))
        if len(out) != n:
            raise ValueError("a block is damaged")
        return out

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the file's order; holds one document and one block at a time."""
        rest, k = np.empty(0, np.uint64), 0
        for i, null, n in zip(self.ids.tolist(), self.null.tolist(), self.lengths.tolist()):
            parts = [rest]
            have = len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield None if null else i, rest[:n]
            rest = rest[n:]


class Tokenizer:
    """Ids of texts by the tokenizers library, word by word.

    For vocabularies that drop white space, lower-case and never merge across white
    space or between a letter and ASCII marks other than the apostrophe, blanks and
    line ends part a text into pieces whose ids are the text's in a row, and marks at
    a piece's end are pieces of their own. Pieces of up to 64 characters are kept once
    encoded. A vocabulary that a probe shows to be of another kind, and `whole`, have
    every text encoded at once.
    """

    TAIL = ".,;:!?*$%&#|"
    LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library, self.whole = Library.from_file(path), whole
        self.model = self.library.model
        # letters as the byte-level step writes them
        self.table = {c: "".join(chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else chr(256 + self._shift(b)) for b in c.encode()) for c in self.LETTERS}
        self.table = str.maketrans(self.table)
        self.known = _Known(self)
        probe = ["", "The worthless ones,", "naïve ÉTÉ!! ßa", "x.\ny|", "a's b1c", "ñandú;"]
        if not whole and [e.ids for e in self.library.encode_batch(probe, add_special_tokens=False)] != [np.frombuffer(x, "<u4").tolist() for x in self.encode(probe)]:
            self.whole = True  # a vocabulary of another kind

    @staticmethod
    def _shift(b: int) -> int:
        """The place of a byte among those that the byte-level alphabet moves."""
        return sum(1 for x in range(b) if not (0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or x >= 0xAE))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        if self.whole:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if len(self.known) > CACHE:
            self.known = _Known(self)
        get = self.known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


class _Known(dict):
    """Ids of pieces, encoded as they come up.

    A piece of letters goes to the model in lower case, as the earlier steps would
    hand it on; marks after a letter at a piece's end are a piece of their own; all
    else goes through every step.
    """

    def __init__(self, owner: Tokenizer):
        super().__init__({"": b""})
        self.letters, self.tail, self.table = owner.LETTERS.issuperset, owner.TAIL, owner.table
        self.last = owner.LETTERS
        self.tokenize, self.encode = owner.model.tokenize, owner.library.encode

    def __missing__(self, p: str) -> bytes:
        if self.letters(p):
            low = p.lower()
            ids = self[low] if low != p else _PACKERS[len(x)](*x) if len(x := [t.id for t in self.tokenize(p.translate(self.table))]) < 16 else np.array(x, "<u4").tobytes()
        else:
            core = p.rstrip(self.tail)
            if core and core != p and core[-1] in self.last and "<" not in p:
                ids = self[core] + self[p[len(core) :]]
            else:
                ids = np.array(self.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        if len(p) <= 64:
            self[p] = ids
        return ids


_PACKERS = [struct.Struct(f"<{k}I").pack for k in range(16)]
_tokenizers: dict[tuple, Tokenizer] = {}
MANIFEST = "part int, seq int, file string, n_ids long, n_docs long"
#: A file ends after so many ids or documents, so that neither its writer nor its footer grows; texts of a task.
ROLL_IDS, ROLL_DOCS, TASK = 1 << 26, 1 << 18, 256 << 20


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 1, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write every text, in ascending order of ids; returns the manifest: part, seq, file, n_ids, n_docs, start."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(f"`{text_col}`"))).first()[0] or 0
    tasks = max(1, total // TASK, min(total >> 24, 16 * spark.sparkContext.defaultParallelism))
    rows = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    fs, path = _stream(folder)
    fs.create_dir(path, recursive=True)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, whole)
        if key not in _tokenizers:
            _tokenizers[key] = Tokenizer(*key)
        writer, part, seq, name = None, TaskContext.get().partitionId(), 0, ""

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_ids": pa.array([writer.n_ids], pa.int64()), "n_docs": pa.array([len(writer.docs)], pa.int64())})

        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), _tokenizers[key].encode(batch.column(1).to_pylist())):
                if writer is not None and (writer.n_ids >= ROLL_IDS or len(writer.docs) >= ROLL_DOCS):
                    yield done()
                    writer, seq = None, seq + 1
                if writer is None:
                    name = f"part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.s8b"
                    writer = Writer(_stream(folder)[0].open_output_stream(f"{path}/{name}", compression=None))
                writer.add(i, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            yield done()

    common.map_batches(rows, run, MANIFEST).write.parquet(f"{folder}/manifest")
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _read(manifest: DataFrame, folder: str, schema: str, one) -> DataFrame:
    files = manifest.select("file", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4, min(20_000, manifest.count())), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _stream(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{path}/{name}") as f:
                    rows, at, held = [], start, 0
                    for i, ids in Reader(f).documents():
                        rows.append(one(i, at, ids))
                        at += len(ids)
                        held += len(ids)
                        if held > 1 << 19 or len(rows) > 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return common.map_batches(files, run, schema)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, ids array<long> from the files."""
    return _read(manifest, folder, "doc_id long, start long, ids array<long>", lambda i, at, ids: {"doc_id": i, "start": at, "ids": ids.astype(np.int64)})


def summary(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    return _read(manifest, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda i, at, ids: {"doc_id": i, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
