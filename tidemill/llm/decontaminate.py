"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test texts.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters
beyond ASCII. The patterns are all windows of `size` consecutive words of the
benchmark's items, and the automaton's alphabet is their words: its states are
beginnings of windows, and a failure arc leads from each to the longest end of it that
is one too. It is built once, level by level, as arrays in the shared folder, which
workers map into memory; about 40 bytes a window and word of it, for a benchmark of
any size. A text's words are read once, and all windows found, overlapping ones too.
Many passages are read in step: a passage of a text begins size - 1 words early, for
no window is longer, so that its state is that of the whole text. No text is shuffled.

The places of hits are in words; spans in the original text are found from the words'
offsets for the few texts with a match. A document is contaminated when it holds
windows of at least min_items items.

Defined results: null and empty texts have no words, no hits and aren't
contaminated; null or empty items have no window; equal windows of several items
count for each of them; repeated rows get one result each; an empty benchmark
leaves every document clean; a folder without the automaton is an error.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, PASSAGE = 8, 256
#: Separators become blanks, A-Z is lower-cased, all else stays.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """The item's windows; an item of fewer words is one window."""
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


class Automaton:
    """States are numbered by level; 0 is the start. Arrays only:

    words, word_ends: the alphabet's bytes on end, and where each word ends;
    codes, heads: arcs by state * words + word, sorted, and where they lead;
    fail: each state's failure arc; window: the number of the window that ends at a state, or -1;
    link: the nearest state by failure arcs at which a window ends, or 0; length: words of each window;
    item_ends, items: the numbers of each window's items; names, name_ends: the items' ids.
    """

    ARRAYS = ("words", "word_ends", "codes", "heads", "fail", "window", "link", "length", "item_ends", "items", "names", "name_ends")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.number = {w: k for k, w in enumerate(_texts(self.words, self.word_ends))}
        self.ids = [x.decode("utf-8", "surrogatepass") for x in _texts(self.names, self.name_ends)]
        self.first = np.zeros(max(1, len(self.number)), np.int64)  # arcs of the start
        k = int(np.searchsorted(self.codes, len(self.number)))
        self.first[self.codes[:k]] = self.heads[:k]
        self.ends = (self.window >= 0) | (self.link > 0)

    @staticmethod
    def build(rows: Iterator[tuple[str | None, list[bytes]]]) -> dict[str, np.ndarray]:
        """From (item, window)."""
        number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, window in rows:
            key = tuple(number.setdefault(w, len(number)) for w in window)
            of = windows.setdefault(key, set())
            if item is not None:
                of.add(item)
        names = sorted({x for of in windows.values() for x in of})
        place = {x: k for k, x in enumerate(names)}
        length = np.fromiter(map(len, windows), np.int64, len(windows))
        owners = [sorted(place[x] for x in of) for of in windows.values()]
        flat = np.fromiter((w for key in windows for w in key), np.int64, int(length.sum()))
        del windows
        start, state, base = np.cumsum(length) - length, np.zeros(len(length), np.int64), 1
        codes, levels = [], []
        for d in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > d)
            new, inverse = np.unique(state[on] * len(number) + flat[start[on] + d], return_inverse=True)
            state[on] = base + inverse
            codes.append(new)
            levels.append(np.arange(base, base + len(new)))
            base += len(new)
        codes = np.concatenate([np.zeros(0, np.int64), *codes])
        heads = np.arange(1, base)
        window = np.full(base, -1, np.int64)
        window[state] = np.arange(len(state))
        fail, link = np.zeros(base, np.int64), np.zeros(base, np.int64)
        for level in levels[1:]:
            parent, word = codes[level - 1] // len(number), codes[level - 1] % len(number)
            at, left = fail[parent], np.arange(len(level))
            while len(left):
                to = _arc(codes, heads, at[left] * len(number) + word[left])
                fail[level[left]] = to
                left = left[(to == 0) & (at[left] > 0)]
                at[left] = fail[at[left]]
            link[level] = np.where(window[fail[level]] >= 0, fail[level], link[fail[level]])
        joined = lambda parts: (np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts], dtype=np.int64))
        words, word_ends = joined(list(number))
        named, name_ends = joined([x.encode("utf-8", "surrogatepass") for x in names])
        items = np.array([x for of in owners for x in of], np.int64)
        return dict(zip(Automaton.ARRAYS, (words, word_ends, codes, heads, fail, window, link, length, np.cumsum([len(of) for of in owners], dtype=np.int64), items, named, name_ends)))

    def scan(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        """(first word, end, window) of every occurrence in each text, in no order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        n, size = len(self.number), int(self.length.max(initial=0))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not n or not sizes.sum():
            return out
        get = self.number.get
        x = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        many = -(-sizes // PASSAGE)
        text = np.repeat(np.arange(len(texts)), many)
        own = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * PASSAGE  # in words of the text
        early = np.minimum(own, size - 1)
        steps = np.minimum(PASSAGE, sizes[text] - own) + early
        by = np.argsort(-steps, kind="stable")
        place, first, steps = (begins[text] + own - early)[by], (begins[text] + own)[by], steps[by]
        left, state = steps[::-1], np.zeros(len(by), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(steps[0])):
            m = len(by) - int(np.searchsorted(left, step + 1))
            at = place[:m] + step
            word, now = x[at], state[:m]
            go = np.flatnonzero((now > 0) & (word >= 0))
            new = np.where(word >= 0, self.first[word], 0)
            s = now[go]
            while len(go):
                to = _arc(self.codes, self.heads, s * n + word[go])
                hit = to > 0
                new[go[hit]] = to[hit]
                s, go = self.fail[s[~hit]], go[~hit]
                s, go = s[s > 0], go[s > 0]
            state[:m] = new
            ended = np.flatnonzero(self.ends[new] & (at >= first[:m]))
            if len(ended):
                found.append((text[by[ended]], at[ended], new[ended]))
        for which, at, s in found:
            for t, p, q in zip(which.tolist(), (at - begins[which] + 1).tolist(), s.tolist()):
                while q > 0:
                    w = int(self.window[q])
                    if w >= 0:
                        out[t].append((p - int(self.length[w]), p, w))
                    q = int(self.link[q])
        return out

    def items_of(self, window: int) -> list[str]:
        a, b = int(self.item_ends[window - 1]) if window else 0, int(self.item_ends[window])
        return [self.ids[k] for k in self.items[a:b].tolist()]


def _texts(raw: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, at, out = raw.tobytes(), 0, []
    for e in ends.tolist():
        out.append(data[at:e])
        at = e
    return out


def _arc(codes: np.ndarray, heads: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where arcs lead; 0 where there is none."""
    if not len(codes):
        return np.zeros(len(code), np.int64)
    k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return np.where(codes[k] == code, heads[k], 0)


def _stream(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


def write_automaton(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> str:
    """Build the automaton in one task, as the benchmark is one pattern set, and write its arrays; returns their place."""
    url = common.new_folder(benchmark.sparkSession, "automaton")
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").alias("text"))

    def write(rows: Iterator[tuple[str | None, list[bytes]]]) -> str:
        fs, path = _stream(url)
        name = uuid.uuid4().hex  # of a lost attempt nothing is read
        fs.create_dir(f"{path}/{name}", recursive=True)
        for key, x in Automaton.build(rows).items():
            held = io.BytesIO()
            np.save(held, x)
            with fs.open_output_stream(f"{path}/{name}/{key}.npy", compression=None) as f:
                f.write(held.getbuffer())
        return name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"name": [write((i, w) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in windows_of(words_of(t), size))]})

    made = common.map_batches(items.coalesce(1), run, "name string").collect()
    return f"{url}/{made[0].name if made else write(iter(()))}"


_automata: dict[str, Automaton] = {}


def _automaton(url: str) -> Automaton:
    """A worker's own, kept while it is in use; the arrays are shared where they are files."""
    if url not in _automata:
        fs, path = _stream(url)
        if fs.type_name == "local":
            arrays = {k: np.load(f"{path}/{k}.npy", mmap_mode="r" if k not in ("words", "names") else None) for k in Automaton.ARRAYS}
        else:
            arrays = {k: np.load(io.BytesIO(fs.open_input_stream(f"{path}/{k}.npy").read())) for k in Automaton.ARRAYS}
        _automata.clear()
        _automata[url] = Automaton(arrays)
    return _automata[url]


def _find(texts: list[str | None], url: str) -> list[tuple[list[bytes], list[tuple[int, int]], set[str]]]:
    """Words, hit spans in words, and items of each text."""
    machine, words = _automaton(url), [words_of(t) for t in texts]
    return [(w, [(a, b) for a, b, _ in got], {x for k in {k for _, _, k in got} for x in machine.items_of(k)}) for w, got in zip(words, machine.scan(words))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in code points of the original text for merged spans in words."""
    at = [m.span() for m in _WORD.finditer(text)] if spans else []
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, min_items: int = 1) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (sorted as strings), items_sha256, contaminated, spans of the hit passages in the original text."""
    url = write_automaton(benchmark, item_col, item_text_col, size)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
    names_of = ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"]
    fields = [pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("n_items", pa.int64()), pa.field("items", pa.list_(pa.string())), pa.field("items_sha256", pa.string()), pa.field("contaminated", pa.bool_()), pa.field("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for i, text, (words, spans, items) in zip(batch.column(0).to_pylist(), texts, _find(texts, url)):
                spans, names = merged(spans), sorted(items)
                rows.append((i, len(words), sum(b - a for a, b in spans), len(names), names, hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest(), len(names) >= min_items, [{"start": a, "end": b} for a, b in original_spans(text or "", spans)]))
            yield pa.RecordBatch.from_pylist([dict(zip(names_of, r)) for r in rows], schema=pa.schema([pa.field("doc_id", batch.schema.field(0).type), *fields]))

    return common.map_batches(common.texts(docs, id_col, text_col), run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, min_items: int = 1) -> DataFrame:
    """docs, with all its columns, without the contaminated ones. Texts are scanned where they lie; nothing is shuffled."""
    url = write_automaton(benchmark, "item_id", "text", size)
    kinds, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _find(batch.column(at).to_pylist(), url)
            yield batch.filter(pa.array([len(items) < min_items for _, _, items in found], pa.bool_()))

    common.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, kinds)
