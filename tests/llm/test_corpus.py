"""Operators over the whole corpus: near-duplicates, language model, WARC, the pipeline."""

import base64
import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest

from tidemill.llm import common, graph, lm, minhash, warc

SF = "/root/testdata/sf0.001"


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = common.lower_ascii(t).split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def make_docs(seed, n=160):
    r = random.Random(seed)
    say = lambda k: [r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aeiou") for _ in range(k)]
    docs = [(k, " ".join(say(r.randint(1, 60)))) for k in range(n // 3)]
    base = [say(50) for _ in range(4)]
    for k in range(n // 3, n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice("xyz") + r.choice("uvw")
        docs.append((k, " ".join(w)))
    chain = say(60)
    for k in range(12):  # each close to the next, the ends far apart
        chain = chain[:]
        chain[k * 4 : k * 4 + 2] = ["q" + str(k), "p" + str(k)]
        docs.append((1000 + k, " ".join(chain)))
    return docs


@pytest.mark.parametrize("size, percent", [(2, 80), (5, 80)])
def test_near_duplicates(spark, size, percent):
    docs = [*make_docs(size), (2000, None), (2001, ""), (2002, "one"), (2003, "ONE "), (2004, "\n"), (None, "one"), (5, make_docs(size)[5][1]), (2005, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rep int, code int")
    want = brute_components(docs, size, percent)
    got = minhash.near_duplicates(df, size=size, percent=percent).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [(r.kept, r.component_id) for r in got if r.doc_id is None] == [(False, None)] and all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert {r.n_shingles for r in got if r.doc_id == 2002} == {1} and {r.n_shingles for r in got if r.doc_id == 2000} == {0}


def test_deduplicate(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_IDS", 0)  # the way for ids that are too many to send
    docs = [*make_docs(9), (5, make_docs(9)[5][1]), (None, "x"), (None, None), (3000, None)]
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in docs], "doc_id long, text string, source string, gone int")
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    kept = collections.Counter(r.doc_id for r in out.collect())
    want = brute_components([(i, t) for i, t in docs], 5, 80)
    assert kept == collections.Counter({i: 1 for i, c in want.items() if i == c} | {None: 2})
    assert minhash.deduplicate(df.limit(0)).count() == 0


def test_large_stars_are_split(spark, monkeypatch):
    """A hot group: near copies of one text, worked in parts."""
    monkeypatch.setattr(minhash, "LIST", 16)
    r = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    docs = []
    for k in range(150):
        w = base[:]
        for _ in range(3):
            w[r.randrange(80)] = f"v{r.randrange(1000)}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, size=2).collect()}
    assert got == brute_components(docs, 2, 80)


@pytest.mark.parametrize("size", [7, 40])
def test_lists_over_batches(size):
    """Lists come whole, or in parts that are marked, however the batches fall."""
    import pyarrow as pa

    r = random.Random(size)
    rows = sorted((r.randrange(12) // 3, -1 if r.random() < 0.8 else r.randrange(2), k) for k in range(300))
    rows = sorted(rows)
    cells = [pa.RecordBatch.from_pydict({"code": pa.array([x[0] for x in part], pa.int64()), "part": pa.array([x[1] for x in part], pa.int32()), "rep": pa.array([x[2] for x in part], pa.int64()), "bits": pa.array([bytes(32)] * len(part), pa.binary())}) for a in range(0, 300, 13) for part in [rows[a : a + 13]]]
    got = list(minhash._runs(iter(cells), size))
    seen = collections.Counter()
    for whole, code, part, rep, _ in got:
        assert len(set(zip(code.tolist(), part.tolist()))) == 1
        key = (int(code[0]), int(part[0]))
        n = sum((a, b) == key for a, b, _ in rows)
        assert whole == (len(rep) == n)
        seen.update(rep.tolist())
    assert seen == collections.Counter(k for _, _, k in rows)


@pytest.mark.parametrize("m,near", [(3, 1), (64, 5), (65, 0), (300, 0), (300, 40), (700, 200)])
def test_only_members_with_a_partner_go_on(m, near):
    """In a list, brute force says who agrees with whom; members that no centre took are no partners for that."""
    import pyarrow as pa

    need, k = 33, minhash.COORDINATES
    r = np.random.default_rng(m + near)
    nibbles = r.integers(0, 16, (m, k), dtype=np.uint8)
    for _ in range(near):  # about the threshold
        a, b = r.integers(0, m, 2)
        some = r.permutation(k)[: r.integers(need - 3, need + 6)]
        nibbles[a, some] = nibbles[b, some]
    bits = nibbles[:, : k // 2] | (nibbles[:, k // 2 :] << 4)
    batch = pa.RecordBatch.from_pydict({"code": pa.array([7] * m, pa.int64()), "part": pa.array([-1] * m, pa.int32()), "rep": pa.array(range(m), pa.int64()), "bits": pa.array([x.tobytes() for x in bits], pa.binary())})
    agree = (nibbles[:, None] == nibbles[None]).sum(axis=2)
    close = (agree >= need) & ~np.eye(m, dtype=bool)
    rows = [x for b in minhash._stars(need)(iter([batch])) for x in b.to_pylist()]
    assert sorted(x["u"] for x in rows if x["kind"] == 1) == np.flatnonzero(close.any(axis=1)).tolist()
    pairs = [x for x in rows if x["kind"] == 0]
    assert all(x["u"] < x["w"] and close[x["u"], x["w"]] and agree[x["u"], x["w"]] == x["n"] for x in pairs)
    assert bool(pairs) or m > 64 or not close.any()


def test_rows_that_share_an_id_are_linked_by_their_texts(spark):
    a, b = [" ".join(f"{x}{k}" for k in range(30)) for x in "ab"]
    docs = [(1, a), (2, b), (5, a + " z"), (5, b + " z"), (5, b + " z"), (9, "else"), (7, ""), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, size=2).collect())
    assert got == [(1, 1), (2, 2), (5, 1), (5, 2), (5, 2), (7, 7), (7, 7), (9, 9)]
    assert sorted(r.doc_id for r in minhash.deduplicate(df, size=2).collect()) == [1, 2, 7, 7, 9]
    one = spark.createDataFrame([(5, a), (5, a + " z"), (5, a)], df.schema)  # a group of one id
    assert minhash.deduplicate(one, size=2).count() == 1


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)"])
def test_ids_of_other_types_and_clashing_columns(spark, kind):
    a = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([("20", a, "x", 1, 2, 3), ("3", a + " z", "y", 1, 2, 3), ("4", "other", None, 1, 2, 3)], "doc_id string, text string, __gone_id string, h int, one int, node int").withColumn("doc_id", common.F.col("doc_id").cast(kind))
    least = "20" if kind == "string" else "3"  # text is ordered as text
    got = {str(r.doc_id): str(r.component_id) for r in minhash.near_duplicates(df, size=2).collect()}
    assert got == {"20": least, "3": least, "4": "4"}
    out = minhash.deduplicate(df, size=2)
    assert out.schema == df.schema and {str(r.doc_id) for r in out.collect()} == {least, "4"}


def test_a_shared_template_makes_no_pairs(spark, monkeypatch):
    """Documents at a similarity of 0.6 through their template: every table that is written stays linear in them."""
    sizes, keep = {}, common.keep

    def counted(df, kind):
        out = keep(df, kind)
        sizes[kind] = sizes.get(kind, 0) + out[0].count()
        return out

    monkeypatch.setattr(common, "keep", counted)
    template = " ".join(f"t{k}" for k in range(76))
    docs = [(i, f"{template} {' '.join(f'w{i}x{k}' for k in range(25))}") for i in range(600)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=2)
    assert got.where("kept").count() == 600 and got.where("doc_id != component_id").count() == 0
    assert sizes.get("across", 0) == 0 and sizes["tried"] <= 2 * 600 and sizes["prefixes"] <= 25 * 600


def test_matches_needed():
    k = minhash.matches_needed(0.8)
    assert sum(math.comb(64, t) * 0.8**t * 0.2 ** (64 - t) for t in range(k)) <= 1e-7 < sum(math.comb(64, t) * 0.8**t * 0.2 ** (64 - t) for t in range(k + 1))


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, None)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    roots, _ = graph.components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in graph.with_roots(roots).collect()}
    assert all(find(i) == c for i, c in got.items()) and {x for e in edges for x in e if e[1] is not None and e[0] != e[1]} <= set(got)


class BruteModel:
    """Interpolated absolute discounting from plain counts of word tuples, apart from the operator."""

    def __init__(self, learned, order):
        self.order, self.tokens = order, sum(map(len, learned))
        self.c = [collections.Counter() for _ in range(order + 1)]
        for words in learned:
            padded = ["<s>", *words]
            for k in range(1, order + 1):
                self.c[k].update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
        self.starts = self.c[1].pop(("<s>",), 0)
        self.follow = collections.Counter(g[:-1] for k in range(2, order + 1) for g in self.c[k])
        self.d = []
        for k in range(1, order + 1):
            n = collections.Counter(self.c[k].values())
            self.d.append(min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5)

    def p(self, history, word):
        if not history:
            n = self.c[1][word,]
            return ((n - self.d[0]) / self.tokens) if n else self.d[0] * len(self.c[1]) / self.tokens
        total = self.starts if history == ("<s>",) else self.c[len(history)][history]
        if not total:
            return self.p(history[1:], word)
        d = self.d[len(history)]
        return (max(self.c[len(history) + 1][(*history, word)] - d, 0) + d * self.follow[history] * self.p(history[1:], word)) / total

    def score(self, words):
        padded = ["<s>", *words]
        return sum(math.log10(self.p(tuple(padded[max(0, i - self.order + 1) : i]), padded[i])) for i in range(1, len(padded)))


def lm_texts(kind):
    r = random.Random(4)
    if kind == "none":
        return []
    if kind == "unlearned":  # both are held out
        return [(i, "a b") for i in range(200) if common.fold_of(i, 7) == 2]
    texts = [(k, " ".join(r.choice(["the", "a", "cat", "dog", "sat", "ran", "on", "mat"]) if r.random() < 0.8 else f"rare{r.randrange(200)}" for _ in range(r.randint(0, 40)))) for k in range(250)]
    return texts + [(900, None), (901, ""), (902, "THE Cat"), (902, "THE Cat"), (None, "the"), (903, "dog " * 3000), (904, "once only seen here"), (905, "once only seen here"), (906, "\U0001f600 \u00c9 \x00 z")]


@pytest.mark.parametrize("kind,order,size", [("all", 3, None), ("all", 3, 3000), ("all", 2, 3000), ("all", 1, None), ("all", 4, 3000), ("none", 3, None), ("unlearned", 3, None)])
def test_language_model_against_plain_counts(spark, monkeypatch, kind, order, size):
    texts = lm_texts(kind)
    if size:  # many blocks and ranges, and texts read alone and in step
        monkeypatch.setattr(lm, "BLOCK_BYTES", size)
        monkeypatch.setattr(lm, "RANGE_KEYS", 500)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, block string, span int")
    train = lambda i: common.fold(i, 7) != 2
    got = lm.score(df, train, order=order).collect()
    learned = [lm.words_of(t) for i, t in texts if i is not None and common.fold_of(i, 7) != 2]
    model = BruteModel(learned, order)
    c, n, v = model.c[1], model.tokens, len(model.c[1])
    row = lambda i, w, *more: (repr(i), len(w), sum((x,) in c for x in w), n, *(round(x, 6) for x in more))
    want = sorted(row(i, w, sum(math.log10((c[x,] + 1) / (n + v + 1)) for x in w), model.score(w) if n else 0.0) for i, t in texts for w in [lm.words_of(t)])
    have = sorted((repr(x.doc_id), x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in got)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert [y for x in have for y in x[4:]] == pytest.approx([y for x in want for y in x[4:]], abs=1e-5)
    if kind == "all":
        for history in [(), ("<s>",), (b"the",), (b"cat", b"sat"), ("<s>", b"a")]:
            if len(history) < order:
                assert sum(model.p(history, x) for (x,) in c) + model.p(history, b"?") == pytest.approx(1)


@pytest.mark.parametrize("together,least", [(16, 2), (5, 9)])
def test_language_model_exchanges_by_chunks(spark, monkeypatch, together, least):
    """Blocks and ranges grow with the input; rows for each of one with each of the other took most of the time at 6 GB."""
    texts, kept, sizes, keep = lm_texts("all"), {}, {}, common.keep

    def noted(df, kind):
        out = keep(df, kind)
        kept[kind], sizes[kind] = out[0], out[0].count()
        return out

    for name, value in (("BLOCK_BYTES", 300), ("RANGE_KEYS", 500), ("CHUNK_BLOCKS", together), ("LEAST_CHUNKS", least), ("SLICES", 3), ("HELD_BYTES", 1000), ("SHARED", 100)):
        monkeypatch.setattr(lm, name, value)
    monkeypatch.setattr(common, "keep", noted)
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").repartition(4)
    got = lm.score(df, lambda i: common.fold(i, 7) != 2).collect()
    model = BruteModel([lm.words_of(t) for i, t in texts if i is not None and common.fold_of(i, 7) != 2], 3)
    want = sorted((repr(i), model.score(lm.words_of(t))) for i, t in texts)
    have = sorted((repr(x.doc_id), x.score) for x in got)
    assert [x for x, _ in have] == [x for x, _ in want] and [y for _, y in have] == pytest.approx([y for _, y in want], abs=1e-5)
    ranges = kept["counts"].select("span").dropna().distinct().count()
    for kind in ("counts", "continuations"):
        assert 0 < 2 * kept[kind].where("span is not null").count() < sizes["blocks"] * ranges


def test_language_model_in_step_and_alone():
    r = random.Random(6)
    texts = [[r.randrange(12) for _ in range(r.choice([1, 5, 30, 200]))] for _ in range(60)]
    words = sorted({w for t in texts for w in t})
    x = np.array([w for t in texts for w in t])
    hashes = np.sort(np.array([lm._END_HASH, *range(1000, 1000 + len(words))], np.uint64))
    b = lm.Block(lm.pack(np.array([len(t) for t in texts])), lm.pack(np.ones(60)), lm.pack(x), lm.pack_keys(hashes), 3)
    counts = np.concatenate(b.own) * (np.arange(sum(map(len, b.keys))) % 3 > 0)
    counts[: b.width] = b.own[0]
    m = lm.Automaton(b, counts, np.minimum(counts, 2), lm.Sums(int(b.own[0].sum()), 12, [0.5, 0.5, 0.5]))
    in_step = m.traverse(b.first, b.sizes)
    m.ALONE = 1 << 30
    assert m.traverse(b.first, b.sizes) == pytest.approx(in_step, nan_ok=True)


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [1 << 63, 3, (1 << 64) - 1, 0], list(range(1000, 0, -1))])
def test_packed_numbers(values):
    x = np.array(values, np.uint64)
    assert lm.unpack(lm.pack(x)).tolist() == values and lm.unpack_keys(lm.pack_keys(np.sort(x))).tolist() == sorted(values)
    assert lm._order(x).tolist() == np.argsort(x, kind="stable").tolist()


def page_rows():
    return [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/3\r\nX: y", "é" * 5000), (4, None, None), (5, "u", ""), (6, "u", "<p>x</p>"), (7, "v", "\r\n\r\nWARC/1.1"), (8, "w", "q"), (8, "w", "q"), (None, "n", "lone"), (None, "n", "q")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in page_rows()], "page_id long, url string, html string, offset int").repartition(3)
    url = common.new_folder(spark, "warc")
    index = warc.write(df, url)
    got = warc.read(index, url).collect()
    top = {}
    for i, _, t in page_rows():
        top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
    want = []
    for i, _, t in page_rows():
        raw = (t or "").encode()
        response = i == top[t or ""] or i is None and top[t or ""] == -1
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else top[t or ""]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert {bytes(r.payload) for r in got if r.page_id == 3} == {("é" * 5000).encode()}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    some = warc.read(index.where("url = 'u'"), url).collect()
    assert sorted(r.page_id for r in some) == [5, 6]
    all_of = warc.write(df, common.new_folder(spark, "warc"), min_revisit=1)
    assert all_of.where("page_id in (4, 5) and record_type = 'response'").count() == 2
    empty = warc.write(df.limit(0), url2 := common.new_folder(spark, "warc"))
    assert warc.read(empty, url2).count() == 0


def test_shared_folder_is_cleaned(spark):
    df, url = common.keep(spark.range(3), "x")
    assert df.count() == 3 and os.path.isdir(common.local_path(url))
    assert common.clean(spark) > 0 and not os.path.exists(common.local_path(url)) and common.clean(spark) == 0


def test_ranges_coalesce():
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (1_000_000, 5)], gap=90) == [(0, 0, 105), (3, 1_000_000, 1_000_005)]
    assert warc.ranges([(0, 10), (10, 10)], most=15) == [(0, 0, 10), (1, 10, 20)]
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_plain_forms(spark):
    import public_tokenizers as P

    import corpus_pipeline
    from tidemill.llm import bpe, decontaminate, pii, toxicity

    docs = common.table(spark, SF, "documents")
    model = toxicity.fit(docs, common.table(spark, SF, "labels"))
    rest = {r.doc_id: r.text for r in docs.collect()}

    def score(t):
        w = toxicity.words_of(t)
        return model.score(model.evidence(w, model.passages(w)))

    rest = {i: t for i, t in rest.items() if score(t) < 0.5}
    groups = brute_components(list(rest.items()), 5, 80)
    rest = {i: t for i, t in rest.items() if groups[i] == i}
    items = [(r.item_id, decontaminate.windows_of(decontaminate.words_of(r.text))) for r in common.table(spark, SF, "benchmark").collect()]

    def hits(t):
        n = b" " + b" ".join(decontaminate.words_of(t)) + b" "
        return sum(any(b" " + b" ".join(w) + b" " in n for w in ws) for _, ws in items)

    rest = {i: t for i, t in rest.items() if not hits(t)}
    field, codec = pii.trained(), bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = {i: codec._leaf(pii.redacted(t, pii.all_spans(t, field))) for i, t in rest.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert zlib.crc32(b"1") == common.fold_of(1, 1 << 32)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns, and tables without rows."""
    import corpus_pipeline

    long = "many words here " * 3000
    rows = [(1, "some text of its own", "x", 1), (1, "some text of its own", "x", 1), (None, "some text of its own", None, 2), (2, None, "y", None), (2, "", "y", 3), (3, long, None, 4), (4, "mail me at a@b.cd", "z", 5)]
    schema = "doc_id long, text string, doc_text string, h int"
    labels = [(1, 1, 0), (4, 0, 1), (None, 1, 1)]
    for name, docs, marks, items in (("odd", rows, labels, [("q", "never seen words in any of these"), ("r", None)]), ("none", [], [], [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        # of the equal rows of id 1 one stays; rows without an id or words are in no group
        assert sorted(str(r.doc_id) for r in out) == (["1", "2", "2", "3", "4", "None"] if docs else [])
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, spark.read.parquet(f"{d}/documents.parquet"), d).columns == ["doc_id", "text", "doc_text", "h"], stage


@pytest.mark.parametrize("key", ["op1_minhash", "op2_byte_bpe", "op3_pii", "op4_toxicity", "op5_warc", "op6_token_files", "op7_language_model", "op8_decontaminate", "op9_tiff", "op10_quality"])
def test_queries_give_a_row_for_each_row(spark, key):
    from tidemill.llm import queries

    table, name = ("pages", "page_id") if key == "op5_warc" else ("documents", "doc_id")
    got = queries.QUERIES[key](spark, SF)
    ids = [r[name] for r in got.select(name).collect()]
    assert sorted(ids) == sorted(r[name] for r in common.table(spark, SF, table).select(name).collect())
