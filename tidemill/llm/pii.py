"""Personal data: rules for the plain cases, a semi-Markov conditional random field for what the rules drop.

The rules find e-mail addresses, IP addresses, card and phone numbers, leftmost
and without overlap per kind; a match that isn't valid is dropped as it stands,
so that a card number with another number beside it is lost. The field looks at
the regions where an entity can be (runs of digits and separators with at least
four digits, addresses with [at] and [dot]), cuts them into tokens, and scores
every segment of up to MAX_TOKENS tokens and every kind by features of the whole
span: number of digits, check digit, grouping, separators, neighbours. Dynamic
programming over segments, each token outside an entity being one of its own,
chooses boundaries and kinds jointly. Weights are trained by maximum likelihood
on TRAINING generated regions with a fixed seed: entities of each kind, entities
with numbers beside them, and dates, versions, sums and ids that are none.

Spans of the rules stay; the field adds those that overlap none of them. Offsets
are code points, end exclusive.

Defined results: null and empty texts have no spans; kinds tie in the order
email, ip, card, phone; repeated rows get one result each; regions of any length
are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, TRAINING, SEED, ROUNDS = 16, 1200, 11, 60
Span = tuple[int, str, int]  # start, kind, end

# The starts these patterns skip can't begin a match that isn't found from an earlier start, and what they hold on to can't be given back with success.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REGION = re.compile(r"[+(]*+[0-9](?:[ ().+\-]{0,3}+[0-9])++")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,64}+){1,6}+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_ZEROS = str.maketrans("", "", " ().+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-20:]) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > end and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, "email", m.end()))
                end = m.end()
    out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if _octets(m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().translate(_ZEROS)
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(m.group().translate(_ZEROS)) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Where an entity can be that the rules miss."""
    for m in _REGION.finditer(text):
        if m.end() - m.start() >= 7:
            yield m.span()
    if "at]" in text or "at)" in text:
        yield from (m.span() for m in _AT.finditer(text))


_BINS = tuple(range(4, 20))
_D = 16 + 22


def span_features(text: str, a: int, b: int, n_tokens: int) -> np.ndarray:
    """Features of the whole span text[a:b] and of the characters beside it."""
    f = np.zeros(_D, np.float32)
    s = text[a:b]
    groups = re.findall("[0-9]+", s)
    n = sum(map(len, groups))
    if n in _BINS:
        f[n - 4] = 1
    before, after = text[a - 1 : a], text[b : b + 1]
    digits = "".join(groups) if n <= 19 else ""
    seps = set(s) - set("0123456789")
    k = 16
    f[k] = 12 <= n <= 19 and seps <= {" ", "-"} and len(seps) < 2 and luhn(digits)
    f[k + 1] = 12 <= n <= 19 and seps <= {" ", "-"} and not luhn(digits)
    f[k + 2] = seps == {"."} and len(groups) == 4 and s.count(".") == 3 and _octets(groups)
    f[k + 3] = seps == {"."} and not f[k + 2]
    f[k + 4] = s[0] == "+"
    f[k + 5] = s[0] == "("
    f[k + 6] = "(" in s and ")" in s and s.index("(") < s.index(")")
    f[k + 7] = s.count("(") != s.count(")")
    f[k + 8] = not seps
    f[k + 9] = len(groups) > 1 and all(len(g) == 4 for g in groups[:-1]) and 12 <= n <= 19 and len(groups[-1]) <= 7 and len(groups) > 2
    f[k + 10] = bool(groups) and len(groups[-1]) == 4 and any(len(g) == 3 for g in groups[:-1])
    f[k + 11] = before.isalnum() or before == "_"
    f[k + 12] = after.isalnum() or after == "_"
    f[k + 13] = before == "." and text[a - 2 : a - 1].isdigit() or after == "." and text[b + 1 : b + 2].isdigit()
    f[k + 14] = before in "+-(._%" and before != ""
    f[k + 15] = n < 9
    f[k + 16] = n > 15
    f[k + 17] = n > 19
    f[k + 18] = any(c.isalpha() for c in s) and bool(re.search(r"[\[(]at[\])]", s))
    f[k + 19] = any(c.isalpha() for c in s)
    f[k + 20] = not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum() or "  " in s
    f[k + 21] = min(n_tokens, 20) / 10
    return f


class Field:
    """Weights: a bias and one weight a feature for every kind. Tokens outside score 0."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros((len(KINDS), _D + 1)) if weights is None else weights

    @staticmethod
    def lattice(text: str, a: int, b: int) -> tuple[list[int], np.ndarray, list[tuple[int, int]]]:
        """Token borders, features and (first, end) tokens of every candidate segment, in order of its end."""
        cuts = [a, *(a + m.end() for m in _TOKEN.finditer(text[a:b]))]
        segs, rows = [], []
        for j in range(1, len(cuts)):
            if not (text[cuts[j] - 1].isalnum()):
                continue
            for i in range(max(0, j - MAX_TOKENS), j):
                c = text[cuts[i]]
                if c.isalnum() or c in "+(":
                    n = cuts[j] - cuts[i]
                    if 7 <= n <= 100:
                        segs.append((i, j))
                        rows.append(span_features(text, cuts[i], cuts[j], j - i))
        x = np.concatenate([np.array(rows, np.float64).reshape(-1, _D), np.ones((len(rows), 1))], axis=1)
        return cuts, x, segs

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation of text[a:b]."""
        cuts, x, segs = self.lattice(text, a, b)
        if not segs:
            return []
        scores = x @ self.w.T
        kind, top = scores.argmax(1), scores.max(1)
        best, back = [0.0] * len(cuts), [None] * len(cuts)
        k = 0
        for j in range(1, len(cuts)):
            best[j] = best[j - 1]
            while k < len(segs) and segs[k][1] == j:
                v = best[segs[k][0]] + top[k]
                if v > best[j]:
                    best[j], back[j] = v, k
                k += 1
        out, j = [], len(cuts) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i = segs[back[j]][0]
                out.append((cuts[i], KINDS[kind[back[j]]], cuts[j]))
                j = i
        return out[::-1]

    def gradient(self, x: np.ndarray, segs: list[tuple[int, int]], n: int, gold: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood and its gradient for one region; gold: kinds by segment, 0/1."""
        s = x @ self.w.T
        all_kinds = np.logaddexp.reduce(s, axis=1)
        alpha, beta = np.full(n, -np.inf), np.full(n, -np.inf)
        alpha[0] = beta[n - 1] = 0.0
        by_end: list[list[int]] = [[] for _ in range(n)]
        by_start: list[list[int]] = [[] for _ in range(n)]
        for k, (i, j) in enumerate(segs):
            by_end[j].append(k)
            by_start[i].append(k)
        for j in range(1, n):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[segs[k][0]] + all_kinds[k] for k in by_end[j])])
        for i in range(n - 2, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[segs[k][1]] + all_kinds[k] for k in by_start[i])])
        z = alpha[n - 1]
        at = np.array(segs)
        p = np.exp(alpha[at[:, 0]][:, None] + s + beta[at[:, 1]][:, None] - z)
        return float((gold * s).sum() - z), (gold - p).T @ x


def examples(n: int = TRAINING, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Generated texts with their spans."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + num(r.choice([14, 14, 14, 13, 11, 17]))
        d = next(c for c in "0123456789" if luhn(body + c))
        s = body + d
        return r.choice([s, s, " ".join(s[i : i + 4] for i in range(0, len(s), 4)), "-".join(s[i : i + 4] for i in range(0, len(s), 4))])

    def phone() -> str:
        p, q, t = num(3), num(3), num(4)
        c = r.choice(["1", "1", num(2), "44", "49"])
        return r.choice([f"+{c} ({p}) {q}-{t}", f"+{c} {p} {q} {t}", f"+{c}-{p}-{q}-{t}", f"({p}) {q}-{t}", f"+{c} {p} {q}-{t}", f"({p}) {q} {t}", f"+{c} ({p}) {q}-{t}"])

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def email() -> str:
        w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
        return f"{w()}{r.choice(['', '.' + num(2)])}{r.choice([' [at] ', '[at]', '(at)'])}{w()}{r.choice(['.', ' [dot] ', '[dot]'])}{r.choice(['com', 'org', 'net'])}"

    def no_card() -> str:
        s = num(r.choice([12, 13, 14, 15, 16, 16, 16, 17, 18, 19]))
        return no_card() if luhn(s) else r.choice([s, s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])

    decoys = [no_card, no_card, lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"20{num(2)}-{num(2)}-{num(2)} {num(2)}", lambda: f"{num(1)}.{num(2)}.{num(3)}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{r.randint(256, 999)}", lambda: f"1.{num(1)}.{num(1)}.{num(1)}.{num(1)}", lambda: num(r.randint(5, 11)), lambda: f"{num(3)} {num(3)}", lambda: f"{num(2)}.{num(2)}.20{num(2)}", lambda: num(r.randint(20, 40)), lambda: f"{num(3)}-{num(4)}", lambda: f"({num(4)}) {num(4)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{num(3)} {num(4)} {num(2)} {num(5)}", lambda: "-".join(num(3) for _ in range(r.randint(3, 8)))]
    out = []
    for k in range(n):
        kind = KINDS[k % 4]
        make = {"email": email, "ip": ip, "card": card, "phone": phone}[kind]
        left, right = r.choice(["", "see ", "No. ", "x: ", "\n", "("]), r.choice(["", ".", " and", ", so", ")", "\n", "!!"])
        mode = r.random()
        if mode < 0.4:
            s = make()
            out.append((left + s + right, [(len(left), kind, len(left) + len(s))]))
        elif mode < 0.65 and kind != "email":
            s, x = make(), num(r.randint(1, 6))
            gap = " " if kind != "ip" or r.random() < 0.5 else ", "
            if kind == "card":
                s = s.translate(_ZEROS)
            if r.random() < 0.5 or kind == "phone":
                out.append((left + s + gap + x + right, [(len(left), kind, len(left) + len(s))]))
            else:
                out.append((left + x + gap + s + right, [(len(left + x + gap), kind, len(left + x + gap + s))]))
        else:
            out.append((left + r.choice(decoys)() + right, []))
    return out


_field: Field | None = None


def trained() -> Field:
    """The field, trained once in a process."""
    global _field
    if _field is None:
        _field = train(examples())
    return _field


def train(data: list[tuple[str, list[Span]]], rounds: int = ROUNDS, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by Adagrad over all regions."""
    items = []
    for text, spans in data:
        for a, b in regions(text):
            cuts, x, segs = Field.lattice(text, a, b)
            if not segs:
                continue
            gold = np.zeros((len(segs), len(KINDS)))
            for i, kind, j in spans:
                for k, (p, q) in enumerate(segs):
                    if (cuts[p], cuts[q]) == (i, j):
                        gold[k, KINDS.index(kind)] = 1
            items.append((x, segs, len(cuts), gold))
    field, squares, order = Field(), np.full((len(KINDS), _D + 1), 1e-3), random.Random(SEED)
    for _ in range(rounds):
        order.shuffle(items)
        for k in range(0, len(items), 64):
            g = sum(field.gradient(*item)[1] for item in items[k : k + 64]) - ridge * field.w
            squares += g * g
            field.w = field.w + 0.5 * g / np.sqrt(squares)
    return field


def all_spans(text: str, field: Field, base: list[Span] | None = None) -> list[Span]:
    """Spans of the rules and those that the field adds."""
    base = base_spans(text) if base is None else base
    more: list[Span] = []
    taken = sorted((a, b) for a, _, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def over(a: int, b: int) -> list[tuple[int, int]]:
        """Rule spans that overlap a to b; ends are the largest so far, since spans may overlap."""
        return [t for t in taken[bisect_right(ends, a) : bisect_left(starts, b)] if t[1] > a]

    for a, b in regions(text):
        if any(p <= a and q >= b for p, q in over(a, b)):
            continue
        more += [s for s in field.decode(text, a, b) if not over(s[0], s[2])]
    return sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[1]), s[2])) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, spans array<struct<kind,start,end,rule>>, n_email, n_ip, n_card, n_phone, base_sha256, and all spans written out."""
    weights = trained().w
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        field = Field(weights)

        def one(i, text):
            text = text or ""
            base = base_spans(text)
            spans, known = all_spans(text, field, base), set(base)
            count = [sum(k == x for _, k, _ in base) for x in KINDS]
            return i, [{"kind": s[1], "start": s[0], "end": s[2], "rule": s in known} for s in spans], *count, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)

        return one

    return common.map_rows(common.texts(docs, id_col, text_col), make, f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,rule:boolean>>, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs, with all its columns, with personal data replaced in the text and the number of characters brought up to date."""
    weights = trained().w
    at, schema = docs.columns.index(text_col), docs.schema
    count = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch in batches:
            texts = [None if t is None else redacted(t, all_spans(t, field)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    common.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
