"""Operators over texts, one row each: exact forms, round trips, and odd rows."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tidemill.llm import bpe, common, decontaminate, pii, quality, tiff, tokenfile, toxicity

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "x" * 50_000), (5, " \n\t "), (6, "Zoë's naïve 🦊 test — 12.3.4.5, +1 (741) 555-3069!"), (None, "no id"), (7, "word " * 20_000), (8, "áb  c\x85d\x1ce")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that are easily got wrong, with columns whose names operators use themselves."""
    schema = "doc_id long, text string, score double, block int, ids string, words string, media string, n_chars long, lang string"
    return spark.createDataFrame([(i, t, 0.5, 1, "q", "w", "m", len(t or ""), "en") for i, t in ODD], schema)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long")


def by_row(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_bpe_tree_equals_the_library():
    import tiktoken

    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    codec, r = bpe.Codec(RANKS, P.PATTERN, leaf=5), random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab  \n\t'sdé!1 23　\x1c\x85x🦊") for _ in range(r.randint(0, 60)))
        ids = codec.encode(t)
        assert ids == plain.encode_ordinary(t) and codec.decode(ids) == t.encode()
    assert codec.joins > 1000
    long = "lorem ipsum " * 3000
    codec = bpe.Codec(RANKS, P.PATTERN, leaf=1000)
    assert codec.encode(long) == plain.encode_ordinary(long) and codec.window_chars < 100 * codec.joins


def test_bpe_join_is_associative():
    codec, t = bpe.Codec(RANKS, P.PATTERN, leaf=4), "the quick  brown\nfox's 123 jumps"
    parts = [(0, 7), (7, 19), (19, len(t))]
    ids = [codec._leaf(t[a:b]) for a, b in parts]
    left = codec.join(t, 0, 19, len(t), codec.join(t, 0, 7, 19, ids[0], ids[1]), ids[2])
    right = codec.join(t, 0, 7, len(t), ids[0], codec.join(t, 7, 19, len(t), ids[1], ids[2]))
    assert left == right == codec._leaf(t)


def test_bpe_rows(spark, odd, nothing):
    codec = bpe.Codec(RANKS, P.PATTERN)
    want = sorted(([i, len(ids := codec.encode(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] for i, t in ODD), key=repr)
    assert by_row(bpe.round_trip(odd, RANKS, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted((repr(r.doc_id), bytes(r.bytes)) for r in back.collect()) == sorted((repr(i), (t or "").encode()) for i, t in ODD)
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0


def brute_hits(text, items, size=8):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        w = low(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            window = w[k : k + size]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("passage", [256, 3])
def test_decontamination(spark, odd, nothing, monkeypatch, passage):
    monkeypatch.setattr(decontaminate, "PASSAGE", passage)
    r = random.Random(2)
    vocabulary = ["Ab", "cd", "é", "Ef9", "x-y", "z"]
    say = lambda a, b: " ".join(r.choice(vocabulary) for _ in range(r.randint(a, b)))
    items = [(k, say(1, 14)) for k in range(8)] + [(20, None), (21, ""), (22, "!!"), (23, "a"), (24, "a")]
    docs = [(k, say(0, 60)) for k in range(40)] + [(100 + k, f"{say(3, 5)} {items[k][1]}. {items[k + 1][1].upper()}") for k in range(4)] + ODD
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(([i, n, h, f, hashlib.sha256(",".join(f).encode()).hexdigest(), len(f) >= 2] for i, t in docs for n, h, f in [brute_hits(t, items)]), key=repr)
    got = decontaminate.contamination(df, bench, min_items=2)
    assert by_row(got, "doc_id", "n_words", "n_hit", "items", "items_sha256", "contaminated") == want
    text = dict(docs)
    for row in got.where("doc_id >= 100 and size(spans) > 0").collect():
        for s in row.spans:
            assert decontaminate.words_of(text[row.doc_id][s.start : s.end])
    kept = decontaminate.decontaminate(df.selectExpr("doc_id", "text", "1 AS block", "'q' AS items"), bench, min_items=2)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(w[0]) for w in want if not w[5])
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


@pytest.mark.parametrize("passage", [1, 7, 256])
def test_automaton_finds_every_window(monkeypatch, passage):
    """Overlapping, nested and repeated windows, whatever passages a text is read in."""
    monkeypatch.setattr(decontaminate, "PASSAGE", passage)
    r = random.Random(passage)
    for _ in range(40):
        say = lambda n: [r.choice([b"a", b"b", b"c"]) for _ in range(n)]
        windows = [(str(k % 5), say(r.randint(1, 8))) for k in range(r.randint(0, 25))]
        machine = decontaminate.Automaton(decontaminate.Automaton.build(iter(windows)))
        texts = [[w if r.random() < 0.9 else b"z" for w in say(r.randint(0, 40))] for _ in range(6)]
        for words, got in zip(texts, machine.scan(texts)):
            want = {(p, p + len(w), i) for i, w in windows for p in range(len(words) - len(w) + 1) if words[p : p + len(w)] == w}
            assert {(a, b, i) for a, b, w in got for i in machine.items_of(w)} == want and len(got) == len({(a, b) for a, b, _ in want})


def test_missing_automata_are_an_error(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = decontaminate.contamination(docs, bench)
    common.clean(spark)
    with pytest.raises(Exception, match="FileNotFoundError"):
        got.collect()


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(t):
    out = []
    for k, rule in RULES:
        for m in re.finditer(rule, t):
            d = re.sub(r"[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_spans_equal_the_rules():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("012.9@a-+ (%)b.é5") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute_base(t), t


def test_field_finds_what_the_rules_drop():
    field = pii.trained()
    data = pii.examples(800, seed=77)
    right = sum(sorted(s for a, b in pii.regions(t) for s in field.decode(t, a, b)) == sorted(g) for t, g in data)
    assert right / len(data) > 0.95
    t = "pay 4035787455641871 4845168114407329 or call +1 (741) 555-3069 10.0.0.1 on 2026-01-15"
    spans = pii.all_spans(t, field)
    assert (4, "card", 20) in spans and (46, "phone", 63) in spans and all(t[a:b] != "2026-01-15" for a, _, b in spans)
    assert pii.redacted(t, spans).startswith("pay <CARD> ")


def test_field_spans_overlap_no_rule_span():
    """However many rule spans a region holds, and for [at] regions, which come last, too."""

    class Everywhere:
        def decode(self, text, a, b):
            return [(k, "phone", k + 2) for k in range(a, b - 2)]

    for t in (" ".join(["+1 (741) 555-3069"] * 400), "joe@ab.org[at]cd.org " + "10.0.0.1 x " * 300):
        base, regions = pii.base_spans(t), list(pii.regions(t))
        rule = np.zeros(len(t), bool)
        for a, _, b in base:
            rule[a:b] = True
        inside = lambda a, b: any(p <= a and q >= b for p, _, q in base)
        want = {s for a, b in regions if not inside(a, b) for s in Everywhere().decode(t, a, b) if not rule[s[0] : s[2]].any()}
        assert set(pii.all_spans(t, Everywhere())) == want | set(base)


def test_field_decodes_the_best_segmentation():
    """Dynamic programming against all segmentations."""
    field, text = pii.trained(), "+1 (741) 555-3069 12"
    cuts, x, segs = field.lattice(text, 0, len(text))
    top = (x @ field.w.T).max(1)

    def best(at):
        if at == len(cuts) - 1:
            return 0.0
        return max([best(at + 1), *(top[k] + best(j) for k, (i, j) in enumerate(segs) if i == at)])

    found = field.decode(text, 0, len(text))
    got = sum(top[segs.index((cuts.index(a), cuts.index(b)))] for a, _, b in found)
    assert abs(got - best(0)) < 1e-9


def test_pii_rows(spark, odd, nothing):
    rows = {(r.doc_id, r.n_ip, r.n_phone, r.spans) for r in pii.find(odd).collect()}
    t = ODD[6][1]
    assert (6, 1, 1, pii.written(brute_base(t))) in rows and (1, 0, 0, "") in rows
    red = pii.redact(odd)
    assert red.columns == odd.columns
    row = red.where("doc_id = 6").first()
    assert row.text == "Zoë's naïve 🦊 test — <IP>, <PHONE>!" and row.n_chars == len(row.text)
    assert red.where("doc_id = 1").first().text is None and red.count() == len(ODD)
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_segments_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 14)
        x = [r.choice([-0.5, 1.0, 2.0]) for _ in range(n)]
        got = toxicity.segments([(i, v) for i, v in enumerate(x) if v > 0], 0.5)

        def maximal(lo, hi):
            """Ruzzo and Tompa: the best segment, then those on either side of it."""
            best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, _, a, b = best
            return maximal(lo, a) + [(a, b, best[0])] + maximal(b, hi)

        want = maximal(0, n)
        assert sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in want))
        assert all(sum(x[a:b]) == pytest.approx(s) for a, b, s in got) and all(b <= a for (_, b, _), (a, _, _) in zip(got, got[1:]))


@pytest.mark.parametrize("step", [2, 30, 200])
def test_segments_one_by_one(step):
    """The same segments as the scan that looks at all earlier ones, in time linear in the hits."""

    def plain(scores, gap):
        found, total, last = [], 0.0, 0
        for at, s in scores:
            total -= gap * (at - last)
            now, total, last = (at, at + 1, total, total + s), total + s, at + 1
            while True:
                j = next((j for j in range(len(found) - 1, -1, -1) if found[j][2] < now[2]), -1)
                if j < 0 or found[j][3] >= now[3]:
                    found.append(now)
                    break
                now = (found[j][0], now[1], found[j][2], now[3])
                del found[j:]
        return [(a, b, r - left) for a, b, left, r in found]

    r = random.Random(step)
    for _ in range(60):
        at = sorted(r.sample(range(step * 60), 60))
        scores = [(k, r.choice([0.5, 1.0, 3.0])) for k in at]
        assert toxicity.segments(scores, 0.1) == plain(scores, 0.1)
    start = time.time()
    assert len(toxicity.segments([(k * 30, 1.0) for k in range(16_000)], 0.1)) == 16_000
    assert time.time() - start < 1


def test_toxicity_odds_against_plain_counts(spark):
    """The log-odds of every word and beginning, from the labelled rows by hand."""
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    rows = [r for r in toxicity._apart(toxicity.sample(docs, labels, "toxic", 5, "doc_id", "text", 10_000)).collect() if r.part > 0]
    n, count = [0, 0], [collections.Counter(), collections.Counter()]
    for row in rows:
        words = set(toxicity.words_of(row.text))
        n[row.label] += len(words)
        for w in words:
            count[row.label].update(toxicity.tokens_of(w))
    prior = min(toxicity.PRIOR, toxicity.PRIOR_SHARE * sum(n))
    want = {}
    for w in count[0].keys() | count[1].keys():
        c, t = count[0][w], count[1][w]
        if c + t >= toxicity.MIN_DOCS:
            a = (c + t) / sum(n) * prior
            odds = lambda x, m: math.log((x + a) / (m + prior - x - a))
            d = odds(t, n[1]) - odds(c, n[0]) - toxicity.LOWER * math.sqrt(1 / (t + a) + 1 / (c + a))
            if d >= toxicity.MIN_ODDS:
                want[w] = d
    assert model.weights.keys() == want.keys() and all(model.weights[w] == pytest.approx(d) for w, d in want.items())
    p = np.array([count[0][w] + (count[0][w] + count[1][w]) / sum(n) * prior for w in want])
    assert model.lam > 0 and len(p) and model.slopes[0] >= 0


def test_two_labels_of_one_document(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string")
    both = spark.createDataFrame([(i, y, y) for i in range(50) for y in (1, 0)], "doc_id long, quality int, toxic int")
    assert {r.label for r in toxicity.sample(docs, both, "toxic", 5, "doc_id", "text", 100).collect()} == {0}


def test_ranking_is_the_best_by_brute_force(spark):
    """The weights are where the penalised logistic loss over the drawn pairs is flat, and the threshold is the quantile of label 0's share."""
    docs, labels = labelled(spark)
    pairs, seed = 2_000, 3
    model = quality.fit(docs, labels, pairs=pairs, seed=seed)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sorted({(zlib.crc32(text[r.doc_id].encode()), r.quality, text[r.doc_id]) for r in labels.collect() if common.fold_of(r.doc_id, 5) != 0})
    x, y = np.array([quality.features(t) for _, _, t in rows]), np.array([q for _, q, _ in rows], float)
    scale = np.where(x.std(0) < 1e-9, 1.0, x.std(0))
    z = np.clip((x - x.mean(0)) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]

    def loss(w):
        return 2 * sum(math.log1p(math.exp(-float(row @ w))) for row in d) + 0.5 * pairs * 1e-3 * float(w @ w)

    best = loss(model.weights)
    r = random.Random(1)
    for _ in range(30):
        assert loss(model.weights + np.array([r.gauss(0, 0.05) for _ in model.weights])) > best
    raw = ((x - x.mean(0)) / scale) @ model.weights
    assert model.threshold == pytest.approx(float(np.quantile(raw, 1 - y.mean())))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i in list(text)[:40]:
        v = float(((np.array(quality.features(text[i])) - x.mean(0)) / scale) @ model.weights)
        z0 = max(-40.0, min(40.0, model.slope * (v - model.threshold) + math.log(0.3 / 0.7)))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-z0)))

def labelled(spark, n=400):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(30, 80))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["zzrotten", "zzvile"]))
        docs.append((i, " ".join(words) + "." if good else " ".join(w + "!!" for w in words).upper(), len(words)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_learn(spark, odd, nothing):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    held = [i for i in truth if common.fold_of(i, 5) == 0]
    tox = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, tox).collect()}
    assert sum((got[i].score >= 0.5) == bool(truth[i].toxic) for i in held) / len(held) > 0.95
    text = {r.doc_id: r.text for r in docs.collect()}
    for i in held:
        for p in got[i].passages:
            assert "zz" in text[i][p.start : p.end].lower()
    qual = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, qual).collect()}
    assert sum((scores[i] >= 0.3) == bool(truth[i].quality) for i in held) / len(held) > 0.95
    for scored in (toxicity.score(odd, tox), quality.score(odd, qual)):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.drop_toxic(docs, tox)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}
    assert toxicity.score(nothing, tox).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0 and quality = 1"), spark.createDataFrame([(None, None, None), (10**9, 1, 1)], labels.schema)):
        assert all(0 <= r.score <= 1 for m, f in ((toxicity.fit(docs, none), toxicity), (quality.fit(docs, none), quality)) for r in f.score(odd, m).collect())


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    r = random.Random(6)
    for rows in (1, 5, 23):
        payload = bytes(r.choice(b"aaab \xff\0") for _ in range(192 * rows))
        found = list(tiff.walk(tiff.write(payload, compression, predictor, page_rows=7, strip_rows=3)))
        assert b"".join(p.pixels for p in found) == payload and len(found) == -(-rows // 7)
        assert all((p.width, p.samples, p.compression, p.predictor) == (64, 3, compression, predictor) for p in found)


def hand_made(order, big, tags, data):
    """A TIFF of one page from tags (tag, type, values) and the bytes before the directory."""
    o = order
    head = (b"II" if o == "<" else b"MM") + (struct.pack(o + "HHHQ", 43, 8, 0, 16 + len(data)) if big else struct.pack(o + "HI", 42, 8 + len(data)))
    at, extra, entries = len(head) + len(data), b"", b""
    room = 8 if big else 4
    end = at + (8 if big else 2) + len(tags) * (20 if big else 12) + room
    for tag, kind, values in tags:
        v = struct.pack(o + str(len(values)) + {3: "H", 4: "I"}[kind], *values)
        if len(v) > room:
            where, extra = end + len(extra), extra + v
            v = struct.pack(o + ("Q" if big else "I"), where)
        entries += struct.pack(o + ("HHQ" if big else "HHI"), tag, kind, len(values)) + v.ljust(room, b"\0")
    return head + data + struct.pack(o + ("Q" if big else "H"), len(tags)) + entries + b"\0" * room + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_tiles_planes_and_predictors(order, big):
    start = 16 if big else 8
    x = np.arange(20 * 30, dtype=np.uint8).reshape(20, 30)
    tiles = [zlib.compress(np.pad(x, ((0, 12), (0, 2)))[r : r + 16, c : c + 16].tobytes()) for r in (0, 16) for c in (0, 16)]
    offsets = [start + sum(map(len, tiles[:k])) for k in range(4)]
    base = [(256, 4, [30]), (257, 4, [20]), (258, 3, [8]), (259, 3, [8]), (277, 3, [1])]
    (page,) = tiff.walk(hand_made(order, big, [*base, (322, 4, [16]), (323, 4, [16]), (324, 4, offsets), (325, 4, [len(t) for t in tiles])], b"".join(tiles)))
    assert page.pixels == x.tobytes() and page.tiled and page.parts == 4
    f = np.linspace(-3, 9, 20 * 30, dtype=np.float32).reshape(20, 30)
    planes = f.astype(">f4").view(np.uint8).reshape(20, 30, 4).transpose(0, 2, 1).reshape(20, 120)
    data = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    (page,) = tiff.walk(hand_made(order, big, [(256, 4, [30]), (257, 4, [20]), (258, 3, [32]), (259, 3, [1]), (273, 4, [start]), (277, 3, [1]), (279, 4, [len(data)]), (317, 3, [3]), (339, 3, [3])], data))
    assert np.array_equal(np.frombuffer(page.pixels, order + "f4").reshape(20, 30), f)
    d16 = np.arange(600, dtype=np.uint16).reshape(20, 30) * 7
    data = np.diff(d16, axis=1, prepend=np.uint16(0)).astype(order + "u2").tobytes()
    (page,) = tiff.walk(hand_made(order, big, [(256, 4, [30]), (257, 4, [20]), (258, 3, [16]), (259, 3, [1]), (273, 4, [start]), (277, 3, [1]), (279, 4, [len(data)]), (317, 3, [2])], data))
    assert np.array_equal(np.frombuffer(page.pixels, order + "u2").reshape(20, 30), d16)
    rgb = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    parts = [rgb[:, :, k].tobytes() for k in range(3)]
    (page,) = tiff.walk(hand_made(order, big, [(256, 4, [5]), (257, 4, [4]), (258, 3, [8, 8, 8]), (259, 3, [1]), (273, 4, [start + 20 * k for k in range(3)]), (277, 3, [3]), (279, 4, [20] * 3), (284, 3, [2])], b"".join(parts)))
    assert page.pixels == rgb.tobytes()


def test_tiff_rows(spark, odd, nothing):
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in tiff.digests(odd).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])) in got
    stored = tiff.store(odd)
    pages = tiff.pages(stored).collect()
    assert len([p for p in pages if p.doc_id == 7]) == 1 and {p.compression for p in pages} == {8}
    assert tiff.digests(nothing).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"II*\0\x08\0\0\0\xff\xff")), (2, None), (3, bytearray(b"no"))], "doc_id long, media binary")
    assert tiff.pages(bad, damage="skip").count() == 0
    with pytest.raises(ValueError):
        list(tiff.walk(b"II*\0\x08\0\0\0\0\0\x08\0\0\0"))


def test_simple8b():
    r = np.random.default_rng(1)
    for n in range(400):
        k = int(r.integers(0, 400))
        bits = r.integers(0, 64, k) if n % 2 else np.minimum(r.integers(0, 64), r.integers(0, 64, k))
        x = (r.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> (63 - bits).astype(np.uint64)
        if n % 5 == 0:
            x = x * (r.random(k) < 0.05)
        words, escapes = tokenfile.pack(x)
        assert (tokenfile.unpack(words, escapes) == x).all()
    zeros = tokenfile.pack(np.zeros(240, np.uint64))[0]
    assert len(zeros) == 2 and len(tokenfile.pack(np.full(60, 1, np.uint64))[0]) == 1


def test_words_equal_the_library():
    t, r = tokenfile.Tokenizer(WORDS), random.Random(7)
    assert not t.whole
    for _ in range(3000):
        s = "".join(r.choice("ab  \n\tA'sÉé!1　\x1c\x85xİΣςß.,*<|") for _ in range(r.randint(0, 40))) + r.choice(["", "<|endoftext|>", "x <|startoftext|>y"])
        assert np.frombuffer(t.encode([s])[0], "<u4").tolist() == t.library.encode(s, add_special_tokens=False).ids, s
    other = tokenfile.Tokenizer(P.path("byte_bpe_50k.json"))
    assert other.whole and np.frombuffer(other.encode(["a b  c"])[0], "<u4").tolist() == other.library.encode("a b  c").ids


def test_token_files(spark, odd, nothing):
    url = common.new_folder(spark, "tokens")
    manifest = tokenfile.write(odd.repartition(3), url, WORDS)
    library = tokenfile.Tokenizer(WORDS).library
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append([i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())])
        at += len(ids)
    assert by_row(tokenfile.summary(manifest, url), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    first = tokenfile.read(manifest, url).where("doc_id = 3").first()
    assert first.ids == [*library.encode("a", add_special_tokens=False).ids, 1]
    url = common.new_folder(spark, "tokens")
    assert tokenfile.summary(tokenfile.write(nothing, url, WORDS), url).count() == 0
