"""Queries of the dialect as Spark SQL.

Only what Spark reads otherwise, or doesn't read, is written anew, on nested tokens:
functions of another meaning, division by zero and concatenation of NULLs, windows
that build on other windows, SELECT aliases within OVER, text arrays in LATERAL
VIEW, and joins: keys are compared by the left column's type, and outer joins fill
the missing side with the columns' defaults. Everything ends up in one query, which
Catalyst plans as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException

from ..functions import FUNCTIONS
from ..functions.registry import BUILT_IN, TEXT_RESULTS, histogram_from_ends, number
from .tokens import Group, Node, SqlError, Token, is_word, nest, raw, render, split_list, tokenize, unquote

#: Name, Spark type and default (as a SQL literal) of each column of a relation.
Columns = list[tuple[str, str, str]]
Describe = Callable[[str], Columns]

_BOUNDS = {"SELECT", "DISTINCT", "ALL", "FROM", "WHERE", "AND", "OR", "NOT", "ON", "WHEN", "THEN", "ELSE", "CASE", "END", "BY", "HAVING", "AS", "IN", "LIKE", "RLIKE", "BETWEEN", "IS", "ASC", "DESC", "LIMIT", "ORDER", "GROUP", "UNION", "JOIN", "VALUES", "INTERVAL", "USING", "PARTITION", "ROWS", "RANGE"}
_COMPARE = frozenset(", = == < <= <=> <> != >= >".split())
_CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "LATERAL"}
_JOINS = {"JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "SEMI", "ANTI"}
#: A group of more values has its percentiles narrowed down in several passes, from sketches of this accuracy.
HEAVY, ACCURACY = 100_000, 2000
#: What a condition begins after.
_OPENERS = {"SELECT", "DISTINCT", "ALL", "WHERE", "AND", "OR", "NOT", "ON", "CASE", "WHEN", "THEN", "ELSE", "HAVING", "BY"}
#: Where one of these stands, a query may give other rows each time it is read.
_UNSTEADY = re.compile(r"\b(LIMIT|OFFSET|OVER|RAND|RANDN|RANDOM|RANDSTR|UNIFORM|UUID|SHUFFLE|TABLESAMPLE|FIRST|FIRST_VALUE|LAST|LAST_VALUE|ANY_VALUE|MONOTONICALLY_INCREASING_ID|SPARK_PARTITION_ID)\b", re.I)


def default_literal(kind: str, default: str | None = None, given: bool = False) -> str:
    """What fills a column of an unmatched side: its DEFAULT, or 0, false or the empty string by its type."""
    k = kind.lower().split("(")[0]
    if given:
        return f"cast(NULL as {kind})" if default is None else "cast('{}' as {})".format(default.replace("\\", "\\\\").replace("'", "\\'"), kind)
    if k in ("tinyint", "smallint", "int", "integer", "bigint", "long", "float", "double", "real", "decimal", "numeric"):
        return f"cast(0 as {kind})"
    if k in ("boolean", "bool"):
        return "false"
    return "''" if k in ("string", "varchar", "char", "text") else f"cast(NULL as {kind})"


@dataclass
class _Relation:
    source: str  # a name, or a query in parentheses
    alias: str
    kind: str = ""  # INNER, LEFT, RIGHT, FULL, SEMI, ANTI, CROSS
    on: list[Node] | None = None
    columns: Columns | None = None


class Rewriter:
    def __init__(self, describe: Describe | None = None):
        self.describe = describe
        self.ctes = ""  # WITH list so far, for describing its names
        self.named: frozenset[str] = frozenset()  # those names
        self.types: dict[str, str] = {}  # of the references in the SELECT at hand, lower-cased and without quotes
        self.joined, self.changed = True, False  # whether NOT IN and percentiles may become joins, and whether one has

    def query(self, sql: str) -> str:
        out = render(self.statement(nest(tokenize(sql))))
        if self.changed and self._resolved(out) is None:  # it stands where Spark takes no such join
            self.joined = self.changed = False
            return self.query(sql)
        return out

    def statement(self, nodes: list[Node]) -> list[Node]:
        """[WITH ...] SELECT ... [UNION ...]."""
        out: list[Node] = []
        k, before, named = 0, self.ctes, self.named
        if nodes and is_word(nodes[0], "WITH"):
            k, done = 1, []
            while True:
                name = nodes[k]
                j = k + 1
                columns = None
                if isinstance(nodes[j], Group):
                    columns, j = nodes[j], j + 1
                if not is_word(nodes[j], "AS") or not isinstance(nodes[j + 1], Group):
                    raise SqlError("WITH is written name AS (query)")
                body = self.statement(nodes[j + 1].items)
                done.append(f"{render([name])}{f' {render([columns])}' if columns else ''} AS ({render(body)})")
                self.named |= {unquote(name).lower()}
                self.ctes = f"WITH {', '.join(([before[5:]] if before else []) + done)} "
                k = j + 2
                if k < len(nodes) and isinstance(nodes[k], Token) and nodes[k].text == ",":
                    k += 1
                    continue
                break
            out.append(raw(f"WITH {', '.join(done)}"))
        parts: list[list[Node]] = [[]]
        seps: list[list[Node]] = []
        rest = nodes[k:]
        i = 0
        while i < len(rest):
            if is_word(rest[i], "UNION", "INTERSECT", "EXCEPT", "MINUS"):
                sep = [rest[i]]
                if i + 1 < len(rest) and is_word(rest[i + 1], "ALL", "DISTINCT"):
                    sep.append(rest[i + 1])
                    i += 1
                seps.append(sep)
                parts.append([])
            else:
                parts[-1].append(rest[i])
            i += 1
        for k, p in enumerate(parts):
            if k:
                out += seps[k - 1]
            out += self.block(p) if p and is_word(p[0], "SELECT") else self.expression(p)
        self.ctes, self.named = before, named
        return out

    # -- one SELECT --

    def block(self, nodes: list[Node]) -> list[Node]:
        before = self.types
        try:
            return self._block(nodes)
        finally:
            self.types = before

    def _block(self, nodes: list[Node]) -> list[Node]:
        clauses = self._clauses(nodes)
        clauses["SELECT"] = self._titled(clauses["SELECT"])
        windows = self._windows(clauses.pop("WINDOW", []))
        aliases = self._aggregate_aliases(clauses["SELECT"]) if "GROUP" in clauses else {}
        inlined = {k: self._over(v, windows, aliases) for k, v in clauses.items()}
        relations = self._relations(inlined["FROM"]) if "FROM" in inlined else None
        names: dict = {}
        if relations:
            for r in relations:
                if r.source.startswith("("):
                    r.source = f"({render(self.statement(nest(tokenize(r.source[1:-1]))))})"
            for r in relations:
                r.columns = self._describe(r)
            self.types = self._types(relations) | {f"__{r.alias}__{c}".lower(): kind for r in relations for c, kind, _ in r.columns or []}
            if len(relations) > 1:
                inlined["FROM"], names = self._joined(relations)
            else:
                inlined["FROM"] = [raw("FROM " + self._histograms(inlined, relations[0]))]
        else:
            self.types = self._inline(inlined["FROM"]) if "FROM" in inlined else {}
        if relations:
            inlined["FROM"] = [*inlined["FROM"], *self._percentiles(inlined, names)]
        shown = self._shown(inlined["SELECT"], names)
        aliased = {unquote(i[-1]).lower(): self._kind(i[:-2]) for i in split_list(inlined["SELECT"][1:]) if len(i) > 2 and is_word(i[-2], "AS") and isinstance(i[-1], Token)}
        out: list[Node] = []
        for key in ("SELECT", "FROM", "LATERAL", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT"):
            c = inlined.get(key)
            if not c:
                continue
            if key == "FROM":
                out += c if relations else self.expression(c)
            elif key == "LATERAL":
                out += self._lateral(self._renamed(c, names))
            elif key == "SELECT" and names:
                out += self._items(c, names)
            elif key == "ORDER":
                self.types = self.types | aliased
                out += self._ordered(self._renamed(c, shown), 2)
            else:
                out += self.expression(self._renamed(c, names))
        return out

    # -- numbers in text --

    def _inline(self, nodes: list[Node]) -> dict[str, str]:
        """Types of the columns of FROM (VALUES ...) AS t(...)."""
        k = next((i for i, n in enumerate(nodes) if isinstance(n, Group) and n.items and is_word(n.items[0], "VALUES")), None)
        if k is None or self.describe is None or len(split_list(nodes[1:])) != 1 or any(is_word(n, *_JOINS) for n in nodes):
            return {}
        columns = self.describe(f"SELECT * {render(self.expression(nodes))}") or []
        name = next((unquote(n) for n in nodes[k + 1 :] if isinstance(n, Token) and not is_word(n, "AS")), "")
        return {key: kind for c, kind, _ in columns for key in (c.lower(), f"{name}.{c}".lower())}

    def _kind(self, nodes: list[Node]) -> str:
        """'string', 'number' or 'other' for what an expression gives; '' where that isn't known."""
        if not nodes:
            return ""
        if any(isinstance(n, Token) and n.text == "||" for n in nodes):
            return "string"
        n = nodes[0]
        if isinstance(n, Group):
            if len(nodes) > 1:
                return ""
            if n.kind == "paren":
                return self._kind(n.items) if not (n.items and is_word(n.items[0], "SELECT", "WITH")) else ""
            kinds, items = set(), n.items
            for k, x in enumerate(items):
                if is_word(x, "THEN", "ELSE"):
                    end = next((j for j in range(k + 1, len(items)) if is_word(items[j], "WHEN", "ELSE", "END")), len(items))
                    kinds.add(self._kind(items[k + 1 : end]))
            return kinds.pop() if len(kinds) == 1 else ""
        if n.kind == "string" and len(nodes) == 1:
            return "string"
        if n.kind == "number" and len(nodes) == 1 or n.text == "-" and len(nodes) == 2 and isinstance(nodes[1], Token) and nodes[1].kind == "number":
            return "number"
        if n.kind == "word" and len(nodes) == 2 and isinstance(nodes[1], Group) and n.up in FUNCTIONS:
            args = split_list(nodes[1].items)
            if n.up in TEXT_RESULTS:
                return "string"
            if n.up == "CAST":
                return "string" if is_word(nodes[1].items[-1], "STRING", "VARCHAR", "CHAR", "TEXT") else ""
            if n.up in ("MIN", "MAX", "COALESCE", "NVL", "NULLIF", "GREATEST", "LEAST", "IF"):
                kinds = {self._kind(a) for a in (args[1:] if n.up == "IF" else args)}
                return kinds.pop() if len(kinds) == 1 else "string" if n.up in ("GREATEST", "LEAST") and "string" in kinds else ""
            if n.up in ("FLOOR", "CEIL", "CEILING", "ABS", "SQRT", "EXP", "LN", "LOG10", "LOG2", "SIGN", "ROUND", "POWER", "POW", "MOD"):
                return "string" if any(self._kind(a) == "string" for a in args) else ""
            return ""
        kind = self.types.get(re.sub(r"[`\s]", "", render(nodes)).lower(), "")
        base = kind.split("(")[0].lower()
        return "" if not kind else kind if kind in ("string", "number", "other") else "string" if base in ("string", "varchar", "char") else "number" if base in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else "other"

    def _ordered(self, nodes: list[Node], skip: int) -> list[Node]:
        """ORDER BY items; text is ordered by its numbers where it holds some, these before all other text."""
        if not any(self._kind([x for x in i if not is_word(x, "ASC", "DESC")]) == "string" for i in split_list(nodes[skip:])):
            return self.expression(nodes)
        done = []
        for item in split_list(nodes[skip:]):
            word = next((x.up for x in item if is_word(x, "ASC", "DESC")), "")
            x = [x for x in item if not is_word(x, "ASC", "DESC")]
            sql = render(self.expression(x))
            if self._kind(x) == "string":
                done += [f"{e} {word}".rstrip() for e in (f"{sql} IS NOT NULL", f"{number(sql)} IS NULL", number(sql), sql)]
            else:
                done.append(f"{sql} {word}".rstrip())
        return [*nodes[:skip], raw(", ".join(done))]

    def _compared(self, nodes: list[Node]) -> list[Node]:
        """Comparisons of text: as numbers where both sides are numbers, else as text. Typed columns, and text against a literal that is no number, stay as they are."""
        if "string" not in {k.split("(")[0] for k in self.types.values()}:
            return nodes
        bound = lambda n: isinstance(n, Token) and (n.kind == "word" and n.up in _BOUNDS or n.kind == "op" and n.text in _COMPARE or n.kind == "sql")
        out: list[Node] = []
        k = 0
        while k < len(nodes):
            n = nodes[k]
            op = n.text if isinstance(n, Token) and n.kind == "op" and n.text in ("=", "==", "<", ">", "<=", ">=", "<>", "!=") else ""
            between = is_word(n, "BETWEEN")
            if not op and not between:
                out.append(n)
                k += 1
                continue
            negated = between and bool(out) and is_word(out[-1], "NOT")
            i = len(out) - negated
            while i and not (bound(out[i - 1]) and not (isinstance(out[i - 1], Token) and out[i - 1].kind == "sql")):
                i -= 1
            j = k + 1
            while j < len(nodes) and not bound(nodes[j]):
                j += 1
            left, right, end = out[i : len(out) - negated], nodes[k + 1 : j], j
            upper: list[Node] = []
            if between:
                if j >= len(nodes) or not is_word(nodes[j], "AND"):
                    out.append(n)
                    k += 1
                    continue
                end = j + 1
                while end < len(nodes) and not bound(nodes[end]):
                    end += 1
                upper = nodes[j + 1 : end]
            tests = [self._test(left, o, r) for o, r in ((">=", right), ("<=", upper))] if between else [self._test(left, op, right)]
            if not all(tests):
                out.append(n)
                k += 1
                continue
            out[i:] = [raw(f"{'NOT ' * negated}({' AND '.join(tests)})")]
            k = end
        return out

    def _test(self, a: list[Node], op: str, b: list[Node]) -> str | None:
        """One comparison, or None where it may stay."""
        ka, kb = self._kind(a), self._kind(b)
        if "string" not in (ka, kb) or not {ka, kb} <= {"string", "number"}:
            return None
        literal = lambda x, kind: len(x) == 1 and isinstance(x[0], Token) and x[0].kind == kind
        for x in (a, b):
            if literal(x, "string"):
                try:
                    float(unquote(x[0]))
                except ValueError:
                    return None
        x, y = (render(self.expression(s)) for s in (a, b))
        if op in ("=", "==", "<>", "!="):
            if ka == kb:
                return None
            for s, t in ((a, b), (b, a)):
                if literal(t, "number"):
                    return f"{render(self.expression(s))} {op} '{t[0].text}'"
        tx, ty = (e if kind == "string" else f"cast({e} as string)" for e, kind in ((x, ka), (y, kb)))
        nx, ny = (number(e) if kind == "string" else e for e, kind in ((x, ka), (y, kb)))
        return f"coalesce({nx} {op} {ny}, {tx} {op} {ty})"

    # -- NOT IN (SELECT ...) --

    def _absent(self, out: list[Node], query: Group) -> int | None:
        """Puts x NOT IN (query) at the end of `out` as an anti join on equal keys, beside what NULLs make of it: from where in `out` it stands, or None where it stays as it is.

        Spark broadcasts the whole subquery for NOT IN, once a row, and compares row by row where
        it isn't a condition of its own. It stays for correlated subqueries, for rows of several
        columns, and for what may give other rows when it is read twice.
        """
        i = len(out)
        while i and not (is_word(out[i - 1], *_BOUNDS) or isinstance(out[i - 1], Token) and out[i - 1].text == ","):
            i -= 1
        if not self.joined or i == len(out) or i and is_word(out[i - 1], *_BOUNDS - _OPENERS):
            return None
        x, rows = render(self._concat(out[i:])), render(self.statement(query.items))
        if re.search(r"\bSELECT\b", x, re.I) or not self._steady(rows) or len(self._resolved(f"{self.ctes}SELECT * FROM ({rows})") or []) != 1:
            return None
        self.changed = True
        keys = f"FROM ({rows}) AS `__s`(`__v`)"
        # 0: the subquery has no rows; 1: none of them is NULL; 2: some are
        state = f"(SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(*) = count(`__v`) THEN 1 ELSE 2 END {keys})"
        out[i:] = [raw(f"(NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT `__v` {keys}) AS `__d` WHERE `__d`.`__v` = ({x})) AND CASE {state} WHEN 0 THEN true WHEN 1 THEN if(({x}) IS NULL, NULL, true) END)")]
        return i

    def _steady(self, sql: str) -> bool:
        """Whether what it reads is the same each time."""
        words = {t.text.strip("`").lower() for t in tokenize(sql) if t.kind in ("word", "quoted")}
        return not _UNSTEADY.search(f"{self.ctes} {sql}" if words & self.named else sql)

    def _resolved(self, sql: str) -> Columns | None:
        """A query's columns; None if it can't stand alone."""
        try:
            return self.describe(sql) if self.describe else None
        except AnalysisException:
            return None

    @staticmethod
    def _titled(select: list[Node]) -> list[Node]:
        """Calls without an alias are named by their text, not by what they are rewritten to."""
        start = 1 + any(is_word(n, "DISTINCT", "ALL") for n in select[1:2])
        out = select[:start]
        for k, item in enumerate(split_list(select[start:])):
            call = len(item) >= 2 and is_word(item[0], *FUNCTIONS) and isinstance(item[1], Group) and (len(item) == 2 or len(item) == 4 and is_word(item[2], "OVER"))
            title = render(item).replace("`", "")
            out = [*out, *([Token("op", ",")] if k else []), *item, *([Token("word", "AS"), Token("quoted", f"`{title}`")] if call else [])]
        return out

    @staticmethod
    def _shown(select: list[Node], names: dict) -> dict:
        """The names that ORDER BY takes: what SELECT shows goes before what the joined tables hold."""
        out = dict(names)
        items = split_list(select[1 + any(is_word(n, "DISTINCT", "ALL") for n in select[1:2]) :])
        if names:
            for item in items:
                alias = unquote(item[-1]) if len(item) > 2 and is_word(item[-2], "AS") and isinstance(item[-1], Token) else None
                bare = re.sub(r"[`\s]", "", render(item[:-2] if alias else item)).lower()
                if bare in names and bare != "*":
                    out[bare] = f"`{alias or bare.rsplit('.', 1)[-1]}`"
            for item in items:
                if len(item) > 2 and is_word(item[-2], "AS") and isinstance(item[-1], Token):
                    out[unquote(item[-1]).lower()] = f"`{unquote(item[-1])}`"
        return out

    @staticmethod
    def _clauses(nodes: list[Node]) -> dict[str, list[Node]]:
        out: dict[str, list[Node]] = {}
        now = "SELECT"
        for n in nodes:
            if isinstance(n, Token) and n.kind == "word" and n.up in _CLAUSES and not (n.up == "LATERAL" and now == "LATERAL"):
                now = n.up
            out.setdefault(now, []).append(n)
        return out

    @staticmethod
    def _windows(nodes: list[Node]) -> dict[str, list[Node]]:
        """Specifications of WINDOW a AS (...), b AS (a ...), with what they build on put in."""
        out: dict[str, list[Node]] = {}
        for part in split_list(nodes[1:]):
            if len(part) != 3 or not is_word(part[1], "AS") or not isinstance(part[2], Group):
                raise SqlError(f"WINDOW is written name AS (...), not {render(part)}")
            name = part[0].text.lower()
            if name in out:
                raise SqlError(f"window {name} is defined twice")
            out[name] = Rewriter._spec(part[2].items, out)
        return out

    @staticmethod
    def _spec(items: list[Node], windows: dict[str, list[Node]]) -> list[Node]:
        if items and isinstance(items[0], Token) and items[0].kind in ("word", "quoted") and not is_word(items[0], "PARTITION", "ORDER", "ROWS", "RANGE", "DISTRIBUTE", "SORT"):
            name = unquote(items[0]).lower()
            if name not in windows:
                raise SqlError(f"window {name} isn't defined")
            base, rest = list(windows[name]), items[1:]
            if rest and is_word(rest[0], "PARTITION") and any(is_word(n, "PARTITION") for n in base):
                raise SqlError(f"window {name} has a PARTITION BY already")
            if any(is_word(n, "ORDER") for n in rest):  # the new order goes over the old one, before a frame
                cut = next((k for k, n in enumerate(base) if is_word(n, "ORDER")), len(base))
                base = base[:cut]
            if any(is_word(n, "ROWS", "RANGE") for n in rest):
                cut = next((k for k, n in enumerate(base) if is_word(n, "ROWS", "RANGE")), len(base))
                base = base[:cut]
            return base + rest
        return items

    @staticmethod
    def _aggregate_aliases(select: list[Node]) -> dict[str, list[Node]]:
        out = {}
        for item in split_list(select[1:]):
            if len(item) > 2 and is_word(item[-2], "AS") and not any(is_word(n, "OVER") for n in item):
                body = item[:-2]
                if any(is_word(n, *(k for k, f in FUNCTIONS.items() if f.kind == "aggregate")) for n in body):
                    out[unquote(item[-1]).lower()] = body
        return out

    def _over(self, nodes: list[Node], windows: dict[str, list[Node]], aliases: dict[str, list[Node]]) -> list[Node]:
        out: list[Node] = []
        k = 0
        while k < len(nodes):
            n = nodes[k]
            if is_word(n, "OVER") and k + 1 < len(nodes):
                target = nodes[k + 1]
                if isinstance(target, Group):
                    spec = self._spec(target.items, windows)
                else:
                    name = unquote(target).lower()
                    if name not in windows:
                        raise SqlError(f"window {name} isn't defined")
                    spec = windows[name]
                done: list[Node] = []
                for j, s in enumerate(spec):
                    used = isinstance(s, Token) and s.kind in ("word", "quoted") and unquote(s).lower() in aliases
                    beside = j > 0 and isinstance(spec[j - 1], Token) and spec[j - 1].text == "." or j + 1 < len(spec) and isinstance(spec[j + 1], Group)
                    done += [Group("paren", aliases[unquote(s).lower()])] if used and not beside else [s]
                out += [n, Group("paren", done)]
                k += 2
                continue
            if isinstance(n, Group) and not (n.items and is_word(n.items[0], "SELECT", "WITH")):
                out.append(Group(n.kind, self._over(n.items, windows, aliases)))
            else:
                out.append(n)
            k += 1
        return out

    def _histograms(self, clauses: dict[str, list[Node]], r: _Relation) -> str:
        """The relation, with the ends of each HISTOGRAM_NUMERIC's values by group joined to it, so that buckets are counted by partial aggregation; calls become those counts."""
        named, select = self._named(r), clauses["SELECT"]
        groups = [render(self.expression(g)) for g in split_list(clauses.get("GROUP", [])[2:])]
        plain = all(re.fullmatch(r"[\w.`]+", g) for g in groups) and "LATERAL" not in clauses
        ends: list[str] = []
        out: list[Node] = []
        k = 0
        while k < len(select):
            n = select[k]
            if plain and is_word(n, "HISTOGRAM_NUMERIC") and k + 1 < len(select) and isinstance(select[k + 1], Group) and not (k + 2 < len(select) and is_word(select[k + 2], "OVER")):
                args = [render(self.expression(a)) for a in split_list(select[k + 1].items)]
                if len(args) == 2 and args[1].isdigit() and 0 < int(args[1]) <= 1000:
                    e = len(ends)
                    ends.append(args[0])
                    out.append(raw(histogram_from_ends(args[0], int(args[1]), f"`__lo{e}`", f"`__hi{e}`")))
                    k += 2
                    continue
            out.append(n)
            k += 1
        if not ends:
            return named
        clauses["SELECT"] = out
        where = f" {render(self.expression(clauses['WHERE']))}" if "WHERE" in clauses else ""
        by = f" GROUP BY {', '.join(groups)}" if groups else ""
        sums = ", ".join([*(f"{g} AS `__g{k}`" for k, g in enumerate(groups)), *(f"min(cast({x} as double)) AS `__lo{e}`, max(cast({x} as double)) AS `__hi{e}`" for e, x in enumerate(ends))])
        on = f"JOIN ({{}}) AS `__h` ON {' AND '.join(f'{g} <=> `__g{k}`' for k, g in enumerate(groups))}" if groups else "CROSS JOIN ({}) AS `__h`"
        found = f"SELECT {sums} FROM {named}{where}{by}"
        return f"(SELECT `{r.alias}`.*, {', '.join(f'`__lo{e}`, `__hi{e}`' for e in range(len(ends)))} FROM {named} {on.format(found)}) AS `{r.alias}`"

    def _percentiles(self, clauses: dict[str, list[Node]], names: dict) -> list[Node]:
        """Joins for FROM with the exact percentiles of groups of more than HEAVY values; the calls take them from there, and Spark's percentile is left with the other groups' values."""
        found: dict[str, list[str]] = {}
        sql = lambda nodes: render(self.expression(self._renamed(nodes, names)))

        def walk(nodes: list[Node]) -> list[Node]:
            out: list[Node] = []
            k = 0
            while k < len(nodes):
                n = nodes[k]
                if self._percentile(nodes, k):
                    x, p = (sql(a) for a in split_list(nodes[k + 1].items)[:2])
                    ps = found.setdefault(x, [])
                    ps += [p] * (p not in ps)
                    done = f"`__h{[*found].index(x)}`.`__p{ps.index(p)}`"
                    out.append(raw(f"coalesce(max({done}), percentile(if({done} IS NULL, cast({x} as double), NULL), cast({p} as double)))"))
                    k += 1
                else:
                    out.append(Group(n.kind, walk(n.items)) if isinstance(n, Group) and not (n.items and is_word(n.items[0], "SELECT", "WITH")) else n)
                k += 1
            return out

        new = {k: walk(clauses[k]) for k in ("SELECT", "HAVING", "ORDER") if k in clauses}
        groups = self._grouped(clauses)
        if not self.joined or not found or groups is None or "LATERAL" in clauses:
            return []
        by = [sql(g) for g in groups]
        rows = f"{render(clauses['FROM'])} {sql(clauses['WHERE']) if 'WHERE' in clauses else ''}"
        joins = []
        for k, (x, ps) in enumerate(found.items()):
            base = f"SELECT {', '.join([*(f'{g} AS `__g{i}`' for i, g in enumerate(by)), f'cast({x} as double) AS `__x`'])} {rows}"
            if not self._steady(base) or self._resolved(f"{self.ctes}{base}") is None:
                return []
            on = " AND ".join(f"{g} <=> `__h{k}`.`__g{i}`" for i, g in enumerate(by)) or "true"
            joins.append(raw(f"LEFT JOIN (SELECT /*+ BROADCAST(`__f`) */ * FROM ({self._ranked(base, len(by), ps)}) AS `__f`) AS `__h{k}` ON {on}"))
        clauses |= new
        self.changed = True
        return joins

    @staticmethod
    def _ranked(base: str, groups: int, ps: list[str]) -> str:
        """Each percentile of `__x` by group, for the groups of more than HEAVY values of the base.

        Sketches give two values around each percentile. What is below and between them is
        counted, so that only the values between, a few thousandths of all, are put in order.
        Where a sketch is off, that side is left open: the result is exact in any case. The
        tables that are broadcast have a row for each HEAVY values at most.
        """
        of = lambda t: "".join(f"`{t}`.`__g{i}`, " for i in range(groups))
        by = lambda t, *more: f" GROUP BY {', '.join([*(f'`{t}`.`__g{i}`' for i in range(groups)), *more])}" if groups or more else ""
        on = lambda t, *more: " AND ".join([*(f"`__b`.`__g{i}` <=> `{t}`.`__g{i}`" for i in range(groups)), *more]) or "true"
        middle = [float(p.strip("'\"")) for p in ps]
        ends = [e for p in middle for e in (max(0.0, p - 3 / ACCURACY), min(1.0, p + 3 / ACCURACY))]
        sketch = f"percentile_approx(`__x`, array({', '.join(f'{e!r}D' for e in ends)}), {ACCURACY}) AS `__a`"
        if groups:
            many = f"`__n` AS (SELECT {of('__b')}count(*) AS `n` FROM `__b`{by('__b')} HAVING count(*) > {HEAVY}), "
            sketches = f"SELECT /*+ BROADCAST(`__n`) */ {of('__b')}max(`__n`.`n`) AS `n`, {sketch} FROM `__b` JOIN `__n` ON {on('__n')}{by('__b')}"
        else:
            many, sketches = "", f"SELECT count(*) AS `n`, {sketch} FROM `__b` HAVING count(*) > {HEAVY}"
        flat = ", ".join(f"`__a`[{i}] AS `a{i}`" for i in range(len(ends)))
        sums = ", ".join(f"max(`a{2 * e}`) AS `a{2 * e}`, max(`a{2 * e + 1}`) AS `a{2 * e + 1}`, count_if(`__x` < `a{2 * e}`) AS `lt{e}`, count_if(`__x` <= `a{2 * e + 1}`) AS `le{e}`" for e in range(len(ps)))
        places = []
        for e, p in enumerate(ps):
            at = f"((`n` - 1) * cast({p} as double))"
            low = f"`lt{e}` <= floor({at})"
            places.append(f"named_struct('e', {e}, 'at', {at}, 'below', if({low}, `lt{e}`, 0L), 'lo', if({low}, `a{2 * e}`, NULL), 'hi', if(`le{e}` > ceil({at}), `a{2 * e + 1}`, NULL))")
        return (
            f"WITH `__b` AS (SELECT * FROM ({base}) WHERE `__x` IS NOT NULL), {many}"
            f"`__s` AS (SELECT {of('__k')}`n`, {flat} FROM ({sketches}) AS `__k`), "
            f"`__c` AS (SELECT /*+ BROADCAST(`__s`) */ {of('__b')}max(`n`) AS `n`, {sums} FROM `__b` JOIN `__s` ON {on('__s')}{by('__b')}), "
            f"`__t` AS (SELECT {of('__c')}inline(array({', '.join(places)})) FROM `__c` WHERE `n` IS NOT NULL), "
            f"`__m` AS (SELECT /*+ BROADCAST(`__t`) */ {of('__t')}`e`, `at`, `below`, `__x`, count(*) AS `c` FROM `__b` JOIN `__t` ON {on('__t', '(`lo` IS NULL OR `__x` >= `lo`)', '(`hi` IS NULL OR `__x` <= `hi`)')}{by('__t', '`e`', '`at`', '`below`', '`__x`')}), "
            f"`__w` AS (SELECT {of('__m')}`e`, `at`, `__x`, `below` + sum(`c`) OVER (PARTITION BY {of('__m')}`e` ORDER BY `__x` ROWS UNBOUNDED PRECEDING) AS `upto` FROM `__m`), "
            f"`__v` AS (SELECT {of('__w')}`e`, max(`at`) AS `at`, min(if(`upto` > floor(`at`), `__x`, NULL)) AS `a`, min(if(`upto` > ceil(`at`), `__x`, NULL)) AS `b` FROM `__w`{by('__w', '`e`')}) "
            f"SELECT {of('__v')}{', '.join(f'max(if(`e` = {e}, if(`a` = `b`, `a`, (ceil(`at`) - `at`) * `a` + (`at` - floor(`at`)) * `b`), NULL)) AS `__p{e}`' for e in range(len(ps)))} FROM `__v`{by('__v')}"
        )

    @staticmethod
    def _percentile(nodes: list[Node], k: int) -> bool:
        """Whether an aggregate's call of a percentile stands at k, with a literal between 0 and 1."""
        n, after = nodes[k], nodes[k + 2] if k + 2 < len(nodes) else None
        called = is_word(n, "PERCENTILE", "PERCENTILE_APPROX") and k + 1 < len(nodes) and isinstance(nodes[k + 1], Group) and not (k and isinstance(nodes[k - 1], Token) and nodes[k - 1].text == ".")
        if not called or FUNCTIONS.get(n.up) is not BUILT_IN[n.up] or is_word(after, "OVER", "FILTER", "WITHIN"):
            return False
        args = split_list(nodes[k + 1].items)
        if not FUNCTIONS[n.up].least <= len(args) <= FUNCTIONS[n.up].most or not args[0] or is_word(args[0][0], "DISTINCT", "ALL"):
            return False
        p = args[1][0] if len(args[1]) == 1 else None
        try:
            return isinstance(p, Token) and p.kind in ("number", "string") and 0 <= float(unquote(p)) <= 1
        except ValueError:
            return False

    def _grouped(self, clauses: dict[str, list[Node]]) -> list[list[Node]] | None:
        """GROUP BY's expressions, with what places and aliases stand for; None for forms that stay as they are."""
        nodes = clauses.get("GROUP", [])[2:]
        if any(is_word(n, "ROLLUP", "CUBE", "GROUPING", "SETS", "ALL", "WITH") for n in nodes):
            return None
        select = clauses["SELECT"]
        items = split_list(select[1 + any(is_word(n, "DISTINCT", "ALL") for n in select[1:2]) :])
        bodies = [i[:-2] if len(i) > 2 and is_word(i[-2], "AS") else i for i in items]
        aliases = {unquote(i[-1]).lower(): b for i, b in zip(items, bodies) if b is not i and isinstance(i[-1], Token)}
        out: list[list[Node]] = []
        for g in split_list(nodes):
            if len(g) == 1 and isinstance(g[0], Token):
                if g[0].kind == "number":
                    at = int(g[0].text) - 1 if g[0].text.isdigit() else -1
                    g = bodies[at] if 0 <= at < len(bodies) else []
                elif unquote(g[0]).lower() not in self.types:
                    g = aliases.get(unquote(g[0]).lower(), [])
            if not g:
                return None
            out.append(g)
        return out

    # -- joins --

    def _relations(self, nodes: list[Node]) -> list[_Relation] | None:
        """The left-deep chain of FROM; None for forms that stay as they are (comma lists, VALUES)."""
        items = nodes[1:]
        if len(split_list(items)) != 1:
            return None
        out: list[_Relation] = []
        k, kind = 0, ""
        while k < len(items):
            n = items[k]
            if isinstance(n, Group):
                if not n.items or not is_word(n.items[0], "SELECT", "WITH"):
                    return None
                source, k = f"({render(n.items)})", k + 1
            elif isinstance(n, Token) and n.kind in ("word", "quoted"):
                source, k = n.text, k + 1
                while k + 1 < len(items) and isinstance(items[k], Token) and items[k].text == ".":
                    source, k = f"{source}.{items[k + 1].text}", k + 2
            else:
                return None
            alias = unquote(Token("quoted", source)) if source.startswith("`") else source.rsplit(".", 1)[-1]
            if k < len(items) and is_word(items[k], "AS"):
                k += 1
                alias, k = unquote(items[k]), k + 1
            elif k < len(items) and isinstance(items[k], Token) and items[k].kind in ("word", "quoted") and items[k].up not in _JOINS | {"ON", "TABLESAMPLE", "PIVOT"}:
                alias, k = unquote(items[k]), k + 1
            on = None
            if k < len(items) and is_word(items[k], "ON"):
                k += 1
                start = k
                while k < len(items) and not is_word(items[k], *_JOINS):
                    k += 1
                on = items[start:k]
            elif k < len(items) and not is_word(items[k], *_JOINS):
                return None
            out.append(_Relation(source, alias, kind, on))
            words = []
            while k < len(items) and is_word(items[k], *_JOINS, "OUTER"):
                words.append(items[k].up)
                k += 1
            kind = next((w for w in ("SEMI", "ANTI", "LEFT", "RIGHT", "FULL", "CROSS") if w in words), "INNER")
        return out

    @staticmethod
    def _named(r: _Relation) -> str:
        return r.source if r.alias == r.source else f"{r.source} AS {r.alias}"

    def _joined(self, relations: list[_Relation]) -> tuple[list[Node], dict]:
        """FROM over nested joins, and the names that references take."""
        outer = any(r.kind in ("LEFT", "RIGHT", "FULL") for r in relations)
        if any(r.columns is None for r in relations):
            return [raw("FROM " + self._plain(relations, {}))], {}
        if not outer:
            return [raw("FROM " + self._plain(relations, self._types(relations)))], {}
        inner = lambda r, c: f"`__{r.alias}__{c}`"
        first = relations[0]
        sql = f"SELECT {', '.join(f'`{c}` AS {inner(first, c)}' for c, _, _ in first.columns)} FROM {self._named(first)}"
        seen = [first]
        for r in relations[1:]:
            left = [(x, c) for x in seen for c, _, _ in x.columns]
            names = self._names([*seen, r], inner)
            on = f" ON {render(self.expression(self._renamed(self._keys(r.on, [*seen, r], r), names)))}" if r.on else ""
            right = f"(SELECT {', '.join([*(f'`{c}` AS {inner(r, c)}' for c, _, _ in r.columns), *(['true AS `__r`'] * (r.kind in ('LEFT', 'FULL')))])} FROM {self._named(r)})"
            marked = f"(SELECT *, true AS `__l` FROM ({sql}))" if r.kind in ("RIGHT", "FULL") else f"({sql})"
            words = {"INNER": "JOIN", "SEMI": "LEFT SEMI JOIN", "ANTI": "LEFT ANTI JOIN", "CROSS": "CROSS JOIN"}.get(r.kind, f"{r.kind} JOIN")
            if r.kind == "INNER" and not r.on:
                words = "CROSS JOIN"
            defaults = {(x.alias, c): d for x in [*seen, r] for c, _, d in x.columns}
            show = [f"if(`__l` IS NULL, {defaults[x.alias, c]}, {inner(x, c)}) AS {inner(x, c)}" if r.kind in ("RIGHT", "FULL") else inner(x, c) for x, c in left]
            if r.kind not in ("SEMI", "ANTI"):
                show += [f"if(`__r` IS NULL, {d}, {inner(r, c)}) AS {inner(r, c)}" if r.kind in ("LEFT", "FULL") else inner(r, c) for c, _, d in r.columns]
                seen.append(r)
            sql = f"SELECT {', '.join(show)} FROM {marked} AS `__x` {words} {right} AS `__y`{on}"
        return [raw(f"FROM ({sql}) AS `__j`")], self._names(seen, inner)

    def _describe(self, r: _Relation) -> Columns | None:
        if self.describe is None:
            return None
        own = r.source.startswith("(") or r.source.strip("`").lower() in self.named
        return self.describe(f"{self.ctes}SELECT * FROM {r.source}" if own else r.source)

    @staticmethod
    def _types(relations: list[_Relation]) -> dict[str, str]:
        out: dict[str, str] = {}
        for r in relations:
            for c, kind, _ in r.columns or []:
                out[f"{r.alias}.{c}".lower()] = kind
                out[c.lower()] = "" if c.lower() in out else kind
        return out

    def _plain(self, relations: list[_Relation], types: dict[str, str]) -> str:
        out = self._named(relations[0])
        for k, r in enumerate(relations[1:], 1):
            words = {"INNER": "JOIN", "SEMI": "LEFT SEMI JOIN", "ANTI": "LEFT ANTI JOIN", "CROSS": "CROSS JOIN"}.get(r.kind, f"{r.kind} JOIN")
            on = f" ON {render(self.expression(self._keys(r.on, relations[: k + 1], r) if types else r.on))}" if r.on else ""
            out += f" {'CROSS JOIN' if r.kind == 'INNER' and not r.on else words} {self._named(r)}{on}"
        return out

    def _keys(self, on: list[Node] | None, relations: list[_Relation], right: _Relation) -> list[Node]:
        """Equalities of two columns compare by the left side's declared type: text trimmed, numbers as numbers."""
        types, out, k = self._types(relations), list(on or []), 0
        while k < len(out):
            if isinstance(out[k], Token) and out[k].text in ("=", "=="):
                a, b = self._reference(out, k - 1, -1), self._reference(out, k + 1, 1)
                if a and b:
                    (ai, aj), (bi, bj) = a, b
                    ta, tb = (types.get(re.sub(r"[`\s]", "", render(out[i:j])).lower(), "") for i, j in (a, b))
                    wrap_a = wrap_b = None
                    if ta == tb == "string":
                        wrap_a = wrap_b = "trim"
                    elif ta and tb and (ta == "string") != (tb == "string"):
                        number = tb if ta == "string" else ta
                        if number.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
                            wrap_a, wrap_b = (f"try_cast_{'decimal(38,10)'}", None) if ta == "string" else (None, f"try_cast_{'decimal(38,10)'}")
                    for (i, j), w in (((bi, bj), wrap_b), ((ai, aj), wrap_a)):
                        if w:
                            ref = out[i:j]
                            out[i:j] = [raw("trim"), Group("paren", ref)] if w == "trim" else [raw("try_cast"), Group("paren", [*ref, raw("AS decimal(38, 10)")])]
                            if i < k:
                                k += 2 - (j - i)
            k += 1
        return out

    @staticmethod
    def _reference(nodes: list[Node], k: int, step: int) -> tuple[int, int] | None:
        """(start, end) of a column reference that ends or begins at k."""
        ok = lambda n: isinstance(n, Token) and n.kind in ("word", "quoted")
        if not 0 <= k < len(nodes) or not ok(nodes[k]):
            return None
        if step < 0:
            return (k - 2, k + 1) if k >= 2 and isinstance(nodes[k - 1], Token) and nodes[k - 1].text == "." and ok(nodes[k - 2]) else (k, k + 1)
        if k + 1 < len(nodes) and isinstance(nodes[k + 1], Group):
            return None
        return (k, k + 3) if k + 2 < len(nodes) and isinstance(nodes[k + 1], Token) and nodes[k + 1].text == "." and ok(nodes[k + 2]) else (k, k + 1)

    @staticmethod
    def _names(relations: list[_Relation], inner) -> dict:
        """Lower-cased reference -> inner name; '*' lists (relation alias, column, inner name)."""
        out: dict = {"*": [(r.alias, c, inner(r, c)) for r in relations for c, _, _ in r.columns]}
        count: dict[str, int] = {}
        for a, c, n in out["*"]:
            out[f"{a}.{c}".lower()] = n
            count[c.lower()] = count.get(c.lower(), 0) + 1
            out.setdefault(c.lower(), n)
        for c, k in count.items():
            if k > 1:
                out[c] = ""  # in more than one: only with its table
        return out

    def _renamed(self, nodes: list[Node], names: dict) -> list[Node]:
        """References with the inner names; subqueries see the outer names too."""
        if not names:
            return nodes
        out: list[Node] = []
        k = 0
        while k < len(nodes):
            n = nodes[k]
            if isinstance(n, Group):
                out.append(n if n.items and is_word(n.items[0], "SELECT", "WITH") else Group(n.kind, self._renamed(n.items, names)))
            elif n.kind in ("word", "quoted"):
                dotted = k + 2 < len(nodes) and isinstance(nodes[k + 1], Token) and nodes[k + 1].text == "." and isinstance(nodes[k + 2], Token)
                key = f"{unquote(n)}.{unquote(nodes[k + 2])}".lower() if dotted else unquote(n).lower()
                called = k + 1 < len(nodes) and isinstance(nodes[k + 1], Group) and n.kind == "word"
                if key in names and key != "*" and not (called and not dotted) and not (out and isinstance(out[-1], Token) and out[-1].up == "AS"):
                    if not names[key]:
                        raise SqlError(f"{key} is in more than one table")
                    out.append(raw(names[key]))
                    k += 2 * dotted
                else:
                    out.append(n)
            else:
                out.append(n)
            k += 1
        return out

    def _items(self, select: list[Node], names: dict) -> list[Node]:
        """SELECT items over the joined names; stars spread out, bare columns keep their names."""
        start = 1 + any(is_word(n, "DISTINCT", "ALL") for n in select[1:2])
        done: list[str] = []
        for item in split_list(select[start:]):
            if isinstance(item[-1], Token) and item[-1].text == "*" and (len(item) == 1 or len(item) == 3 and isinstance(item[1], Token) and item[1].text == "."):
                only = None if len(item) == 1 else unquote(item[0]).lower()
                taken: set[str] = set()
                for a, c, n in names["*"]:
                    if only in (None, a.lower()):
                        done.append(f"{n} AS `{c if c.lower() not in taken else f'{a}.{c}'}`")
                        taken.add(c.lower())
                continue
            new = render(self.expression(self._renamed(item, names)))
            bare = re.sub(r"[`\s]", "", render(item))
            if bare.lower() in names:
                new += f" AS `{bare.rsplit('.', 1)[-1]}`"
            done.append(new)
        return [*select[:start], raw(", ".join(done))]

    # -- LATERAL VIEW --

    def _lateral(self, nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        k = 0
        while k < len(nodes):
            n = nodes[k]
            if is_word(n, "EXPLODE", "POSEXPLODE") and k + 1 < len(nodes) and isinstance(nodes[k + 1], Group):
                x = render(self.expression(nodes[k + 1].items))
                j = k + 2
                while j < len(nodes) and not is_word(nodes[j], "AS", "LATERAL"):
                    j += 1
                names = 1
                if j < len(nodes) and is_word(nodes[j], "AS"):
                    end = next((i for i in range(j, len(nodes)) if is_word(nodes[i], "LATERAL")), len(nodes))
                    names = len(split_list(nodes[j + 1 : end]))
                items = f"transform(split(nullif(cast({x} as string), ''), ','), e -> trim(e))"
                if n.up == "POSEXPLODE":
                    call = f"posexplode({items})"
                elif names == 2:  # k,v,k,v: an odd tail is dropped
                    call = f"inline(transform(filter(sequence(0, greatest(cast(floor(size({items}) / 2) as int) - 1, 0)), i -> 2 * i + 1 < size({items})), i -> named_struct('k', {items}[2 * i], 'v', {items}[2 * i + 1])))"
                else:
                    call = f"explode({items})"
                out.append(raw(call))
                k += 2
            else:
                out.append(n)
                k += 1
        return out

    # -- expressions --

    def expression(self, nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        k, nodes = 0, self._compared(nodes)
        while k < len(nodes):
            n = nodes[k]
            after_dot = out and isinstance(out[-1], Token) and out[-1].text == "."
            if isinstance(n, Token) and n.kind == "word" and n.up in FUNCTIONS and not after_dot and k + 1 < len(nodes) and isinstance(nodes[k + 1], Group) and nodes[k + 1].kind == "paren" and not (out and is_word(out[-1], "AS", "VIEW", "JOIN", "FROM")):
                k, call = self._call(nodes, k)
                out.append(call)
                continue
            if isinstance(n, Token) and n.text == "/" and n.kind == "op":
                k, right = self._primary(nodes, k + 1)
                out += [n, raw(f"nullif({render(self.expression(right))}, 0)")]
                continue
            if isinstance(n, Group):
                if n.items and is_word(n.items[0], "SELECT", "WITH"):
                    if len(out) > 2 and is_word(out[-1], "IN") and is_word(out[-2], "NOT"):
                        before = out[:-2]
                        if self._absent(before, n) is not None:
                            out, k = before, k + 1
                            continue
                    out.append(Group(n.kind, self.statement(n.items)))
                else:
                    out.append(Group(n.kind, self.expression(n.items)))
            else:
                out.append(n)
            k += 1
        return self._concat(out)

    def _primary(self, nodes: list[Node], k: int) -> tuple[int, list[Node]]:
        start = k
        while k < len(nodes) and isinstance(nodes[k], Token) and nodes[k].text in ("-", "+"):
            k += 1
        k += 1
        while k < len(nodes):
            n, last = nodes[k], nodes[k - 1]
            if isinstance(n, Token) and n.text == "." or isinstance(last, Token) and last.text == ".":
                k += 1
            elif isinstance(n, Group) and n.kind == "paren" and isinstance(last, Token) and last.kind == "word":
                k += 1
                if k < len(nodes) and is_word(nodes[k], "OVER"):
                    k += 2
            else:
                break
        return k, nodes[start:k]

    def _call(self, nodes: list[Node], k: int) -> tuple[int, Node]:
        f, items = FUNCTIONS[nodes[k].up], nodes[k + 1].items
        k += 2
        over = ""
        if k < len(nodes) and is_word(nodes[k], "OVER"):
            over = f" OVER {render([Group('paren', self._window_order(nodes[k + 1].items))])}"
            k += 2
        distinct = bool(items) and is_word(items[0], "DISTINCT")
        if distinct:
            items = items[1:]
        if f.name == "CAST":
            at = next((i for i, n in enumerate(items) if is_word(n, "AS")), None)
            args = [render(self.expression(items[:at])), render(items[at + 1 :])] if at is not None else [render(self.expression(x)) for x in split_list(items)]
        elif f.name == "EXTRACT" and any(is_word(n, "FROM") for n in items):
            at = next(i for i, n in enumerate(items) if is_word(n, "FROM"))
            args = [render(items[:at]), render(self.expression(items[at + 1 :]))]
        else:
            args = [render(self.expression(x)) for x in split_list(items)]
        of_text = any(self._kind(x) == "string" for x in split_list(items))
        try:
            return k, raw(f.sql(args, over, distinct, of_text))
        except (ValueError, TypeError) as e:
            raise SqlError(str(e)) from e

    def _window_order(self, spec: list[Node]) -> list[Node]:
        at = next((i for i, n in enumerate(spec) if is_word(n, "ORDER")), None)
        if at is None or any(is_word(n, "RANGE") for n in spec):
            return self.expression(spec)
        end = next((i for i in range(at, len(spec)) if is_word(spec[i], "ROWS")), len(spec))
        return [*self.expression(spec[:at]), *self._ordered(spec[at:end], 2), *self.expression(spec[end:])]

    @staticmethod
    def _concat(nodes: list[Node]) -> list[Node]:
        """a || b || c as one concat in which NULL counts as the empty string."""
        if not any(isinstance(n, Token) and n.text == "||" for n in nodes):
            return nodes
        bound = lambda n: isinstance(n, Token) and (n.kind == "word" and n.up in _BOUNDS or n.kind == "op" and n.text in _COMPARE)
        out: list[Node] = []
        k = 0
        while k < len(nodes):
            if bound(nodes[k]):
                out.append(nodes[k])
                k += 1
                continue
            j = k
            while j < len(nodes) and not bound(nodes[j]):
                j += 1
            parts = split_list(nodes[k:j], "||")
            out += [raw(f"concat({', '.join(f'coalesce(cast({render(p)} as string), {chr(39) * 2})' for p in parts)})")] if len(parts) > 1 else nodes[k:j]
            k = j
        return out
