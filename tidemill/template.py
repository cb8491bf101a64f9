"""A small renderer of SQL templates: {{ value|filter:arg }}, {% if %}, {% for %}, {% set %}, {# comment #}.

Values are HTML-escaped unless marked safe. Missing names are empty.
"""

from __future__ import annotations

import html
import json
import operator
import re
from typing import Any

_PIECE = re.compile(r"({{.*?}}|{%.*?%}|{#.*?#})", re.S)
_LEX = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\d+\.\d+|\d+|[A-Za-z_]\w*|==|!=|<=|>=|&&|\|\||[<>|:.,()\[\]!+\-*/%])""")


class TemplateError(ValueError):
    """A template that can't be read."""


class _Safe(str):
    pass


COMPARISONS = {"==": operator.eq, ">=": operator.ge, ">": operator.gt, "!=": operator.ne, "<=": operator.le, "<": operator.lt}

FILTERS = {
    "default": lambda v, d="": v if v not in (None, "", [], {}, 0, False) else d,
    "safe": lambda v: _Safe(_text(v)),
    "join": lambda v, sep="": sep.join(map(_text, v)) if isinstance(v, list | tuple) else _text(v),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if v is not None else 0,
    "first": lambda v: v[0] if v else "",
    "last": lambda v: v[-1] if v else "",
    "trim": lambda v: _text(v).strip(),
    "title": lambda v: _text(v).title(),
    "escape": lambda v: _Safe(_escape(_text(v))),
    "add": lambda v, d=0: v + d if isinstance(v, int | float) and isinstance(d, int | float) else _text(v) + _text(d),
    "cut": lambda v, d="": _text(v).replace(d, ""),
    "replace": lambda v, a="", b="": _text(v).replace(a, b),
    "json": lambda v: _Safe(json.dumps(v, ensure_ascii=False)),
}


def _text(v: Any) -> str:
    return "" if v is None else ("True" if v else "False") if isinstance(v, bool) else v if isinstance(v, str) else str(v)


def _escape(s: str) -> str:
    return html.escape(s, quote=True).replace("&#x27;", "&#39;")


class _Expression:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.tokens.append(m.group(1))
            at = m.end()
        self.k = 0

    def peek(self) -> str:
        return self.tokens[self.k] if self.k < len(self.tokens) else ""

    def take(self, *want: str) -> str:
        t = self.peek()
        if want and t not in want:
            raise TemplateError(f"{want[0]} is missing before {t!r}")
        self.k += 1
        return t

    def value(self, names: dict) -> Any:
        v = self.either(names)
        if self.peek():
            raise TemplateError(f"{self.peek()!r} isn't understood")
        return v

    def either(self, names: dict) -> Any:
        v = self.both(names)
        while self.peek() in ("or", "||"):
            self.take()
            w = self.both(names)
            v = v or w
        return v

    def both(self, names: dict) -> Any:
        v = self.negated(names)
        while self.peek() in ("and", "&&"):
            self.take()
            w = self.negated(names)
            v = v and w
        return v

    def negated(self, names: dict) -> Any:
        if self.peek() in ("not", "!"):
            self.take()
            return not self.negated(names)
        v = self.sum(names)
        if self.peek() in COMPARISONS or self.peek() == "in":
            op, w = self.take(), self.sum(names)
            if op == "in":
                return v in (w or [])
            if op not in ("in", "==", "!=") and isinstance(v, str) != isinstance(w, str):
                try:
                    v, w = float(v), float(w)
                except (TypeError, ValueError):
                    return False
            elif isinstance(v, str) != isinstance(w, str):
                v, w = _text(v), _text(w)
            return COMPARISONS[op](v, w)
        return v

    def sum(self, names: dict) -> Any:
        v = self.filtered(names)
        while self.peek() in ("+", "-", "*", "/", "%"):
            op, w = self.take(), self.filtered(names)
            v = v + w if op == "+" else v - w if op == "-" else v * w if op == "*" else v / w if op == "/" else v % w
        return v

    def filtered(self, names: dict) -> Any:
        v = self.atom(names)
        while self.peek() == "|":
            self.take()
            name, args = self.take(), []
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            if self.peek() == ":":
                self.take()
                args.append(self.atom(names))
            elif self.peek() == "(":
                self.take()
                while self.peek() != ")":
                    args.append(self.either(names))
                    if self.peek() == ",":
                        self.take()
                self.take(")")
            v = FILTERS[name](v, *args)
        return v

    def atom(self, names: dict) -> Any:
        t = self.take()
        if t == "(":
            v = self.either(names)
            self.take(")")
        elif t == "-":
            v = -self.atom(names)
        elif t[:1] in "\"'" and t:
            v = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), t[1:-1])
        elif re.fullmatch(r"\d+", t):
            v = int(t)
        elif re.fullmatch(r"\d+\.\d+", t):
            v = float(t)
        elif t in ("true", "True"):
            v = True
        elif t in ("false", "False"):
            v = False
        elif re.match(r"[A-Za-z_]", t or " "):
            v = None if t in ("none", "None", "nil") else names.get(t)
        else:
            raise TemplateError(f"{t!r} isn't a value")
        while self.peek() in (".", "["):
            if self.take() == ".":
                key: Any = self.take()
                key = int(key) if key.isdigit() else key
            else:
                key = self.either(names)
                self.take("]")
            try:
                v = v[key]
            except (KeyError, IndexError, TypeError):
                v = None
        return v


def render(template: str, params: dict[str, Any] | None = None) -> str:
    pieces = _PIECE.split(template)
    out: list[str] = []
    end = _block(pieces, 0, dict(params or {}), out, ())
    if end != len(pieces):
        raise TemplateError("a block ends that didn't begin")
    return "".join(out)


def _tag(piece: str) -> tuple[str, str]:
    word, _, rest = piece[2:-2].strip().strip("-").strip().partition(" ")
    return word, rest.strip()


def _block(pieces: list[str], k: int, names: dict, out: list[str] | None, ends: tuple[str, ...]) -> int:
    """Render until one of `ends`; out None skips. Returns the place of the ending piece."""
    while k < len(pieces):
        p = pieces[k]
        if p.startswith("{{"):
            if out is not None:
                v = _Expression(p[2:-2].strip().strip("-")).value(names)
                out.append(v if isinstance(v, _Safe) else _escape(_text(v)))
        elif p.startswith("{%"):
            word, rest = _tag(p)
            if word in ends:
                return k
            if word == "if":
                done = out is None
                while True:
                    yes = not done and (word == "else" or bool(_Expression(rest).value(names)))
                    k = _block(pieces, k + 1, names, out if yes else None, ("elif", "else", "endif"))
                    if k >= len(pieces):
                        raise TemplateError("endif is missing")
                    done = done or yes
                    word, rest = _tag(pieces[k])
                    if word == "endif":
                        break
            elif word == "for":
                m = re.fullmatch(r"(\w+)(?:\s*,\s*(\w+))?\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError("for is written name in values")
                values = (_Expression(m.group(3)).value(names) or []) if out is not None else []
                items = list(values.items()) if isinstance(values, dict) else list(values)
                start, end = k + 1, None
                for i, item in enumerate(items):
                    inner = dict(names)
                    if m.group(2):
                        inner[m.group(1)], inner[m.group(2)] = item
                    else:
                        inner[m.group(1)] = item[0] if isinstance(values, dict) else item
                    about = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                    inner["loop"] = about
                    inner["forloop"] = {"Counter": i + 1, "Counter0": i, "First": i == 0, "Last": i == len(items) - 1}
                    end = _block(pieces, start, inner, out, ("endfor",))
                k = end if end is not None else _block(pieces, start, names, None, ("endfor",))
                if k >= len(pieces):
                    raise TemplateError("endfor is missing")
            elif word == "set":
                name, _, value = rest.partition("=")
                if out is not None:
                    names[name.strip()] = _Expression(value.strip()).value(names)
            else:
                raise TemplateError(f"unknown tag {word}")
        elif not p.startswith("{#") and out is not None:
            out.append(p)
        k += 1
    return k


def parse_param(raw: str) -> Any:
    """A parameter's value: @file, JSON, or the text itself."""
    text = raw.strip()
    if text.startswith("@"):
        try:
            with open(text[1:], encoding="utf-8") as f:
                text = f.read().strip()
        except OSError:
            return text
    if text[:1] in ("[", "{") and text:
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text
