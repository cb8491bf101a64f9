"""Tokens of the SQL dialect, nested by parentheses and CASE, and the script splitter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
  | (?P<quoted>`[^`]*`)
  | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?[dDfF]?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?[lLdD]?(?![\w]))
  | (?P<word>[^\W\d]\w*|\d+\w+)
  | (?P<op><=>|<>|!=|<=|>=|\|\||==|->|::|[-+*/%=<>(),.;\[\]{}:?&|^~!@$\#])""",
    re.X | re.S,
)


class SqlError(ValueError):
    """A statement that can't be read."""


@dataclass
class Token:
    kind: str  # string, quoted, number, word, op
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


@dataclass
class Group:
    """What stands between parentheses, or from CASE to END."""

    kind: str  # paren, case
    items: list[Node] = field(default_factory=list)
    up = ""


Node = Token | Group


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"can't read from {sql[at:at + 30]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group()))
        at = m.end()
    return out


def split_script(script: str) -> list[str]:
    """Statements parted by semicolons outside of quotes and comments; comments are left out."""
    out, now, at = [], [], 0
    quote = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|;|.", re.S)
    while at < len(script):
        m = quote.match(script, at)
        s = m.group()
        if s == ";":
            out.append("".join(now))
            now = []
        elif s.startswith("--") or s.startswith("/*"):
            now.append(" ")
        else:
            now.append(s)
        at = m.end()
    out.append("".join(now))
    return [s.strip() for s in out if s.strip()]


def nest(tokens: list[Token]) -> list[Node]:
    stack: list[list[Node]] = [[]]
    kinds: list[str] = []
    for t in tokens:
        if t.kind == "op" and t.text == "(":
            kinds.append("paren")
            stack.append([])
        elif t.kind == "word" and t.up == "CASE":
            kinds.append("case")
            stack.append([t])
        elif t.kind == "op" and t.text == ")" or t.kind == "word" and t.up == "END" and kinds and kinds[-1] == "case":
            if not kinds or kinds[-1] != ("paren" if t.text == ")" else "case"):
                raise SqlError("parentheses don't match")
            kind, items = kinds.pop(), stack.pop()
            if kind == "case":
                items.append(t)
            stack[-1].append(Group(kind, items))
        else:
            stack[-1].append(t)
    if kinds:
        raise SqlError("parentheses or CASE aren't closed")
    return stack[0]


_SPACED = frozenset("OVER IN VALUES FROM AS AND OR NOT ON BY WHERE EXISTS SELECT THEN WHEN ELSE HAVING JOIN UNION ALL".split())


def render(nodes: list[Node]) -> str:
    out: list[str] = []
    for n in nodes:
        if isinstance(n, Group):
            inner = render(n.items)
            out.append(f"({inner})" if n.kind == "paren" else inner)
        else:
            out.append(n.text)
    text = ""
    for k, s in enumerate(out):
        tight = k and (s in (".", ",") or out[k - 1] == "." or s.startswith("(") and re.fullmatch(r"\w+", out[k - 1] or " ") and out[k - 1].upper() not in _SPACED and isinstance(nodes[k], Group) and nodes[k].kind == "paren")
        text += s if tight or not k else f" {s}"
    return text


def split_list(nodes: list[Node], at: str = ",") -> list[list[Node]]:
    """Parts between commas of this level."""
    out: list[list[Node]] = [[]]
    for n in nodes:
        if isinstance(n, Token) and n.kind == "op" and n.text == at:
            out.append([])
        else:
            out[-1].append(n)
    return [] if len(out) == 1 and not out[0] else out


def is_word(n: Node, *words: str) -> bool:
    return isinstance(n, Token) and n.kind == "word" and n.up in words


def raw(sql: str) -> Token:
    """SQL that is ready as it stands."""
    return Token("sql", sql)


def unquote(t: Token) -> str:
    s = t.text
    if t.kind in ("string", "quoted"):
        q = s[0]
        return s[1:-1].replace(q + q, q) if q != "`" else s[1:-1]
    return s
