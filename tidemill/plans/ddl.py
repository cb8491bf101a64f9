"""CREATE TABLE and INSERT as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

from .tokens import Group, Node, SqlError, Token, is_word, nest, render, split_list, tokenize, unquote


@dataclass
class ColumnDef:
    name: str
    type: str
    default: str | None = None  # as text
    has_default: bool = False


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]
    options: dict[str, str]
    partitions: list[str] = field(default_factory=list)
    external: bool = False


@dataclass
class Insert:
    table: str
    overwrite: bool
    query: str | None  # SELECT text
    values: list[list[str]] | None  # rows of SQL expressions


def _name(n: Node) -> str:
    if not isinstance(n, Token) or n.kind not in ("word", "quoted"):
        raise SqlError("a name is missing")
    return unquote(n)


def parse_create(sql: str) -> CreateTable:
    nodes = nest(tokenize(sql))
    k = 1
    external = is_word(nodes[k], "EXTERNAL")
    k += external
    if not is_word(nodes[k], "TABLE"):
        raise SqlError("CREATE is followed by [EXTERNAL] TABLE")
    k += 1
    if is_word(nodes[k], "IF"):
        k += 3
    name = _name(nodes[k])
    k += 1
    if k >= len(nodes) or not isinstance(nodes[k], Group):
        raise SqlError(f"table {name} has no columns")
    columns = [_column(c) for c in split_list(nodes[k].items)]
    k += 1
    options: dict[str, str] = {}
    partitions: list[str] = []
    while k < len(nodes):
        if is_word(nodes[k], "WITH") and k + 1 < len(nodes) and isinstance(nodes[k + 1], Group):
            for pair in split_list(nodes[k + 1].items):
                if len(pair) < 3 or render([pair[1]]) != "=":
                    raise SqlError(f"an option is written key = value, not {render(pair)}")
                options[_name(pair[0]).lower()] = unquote(pair[2]) if len(pair) == 3 else render(pair[2:]).replace(" ", "")
            k += 2
        elif is_word(nodes[k], "PARTITIONED") and k + 2 < len(nodes) and is_word(nodes[k + 1], "BY"):
            partitions = [_name(p[0]) for p in split_list(nodes[k + 2].items)]
            k += 3
        else:
            raise SqlError(f"unknown clause at {render(nodes[k:k + 3])}")
    return CreateTable(name, columns, options, partitions, external)


def _column(nodes: list[Node]) -> ColumnDef:
    if len(nodes) < 2:
        raise SqlError(f"a column is written name TYPE, not {render(nodes)}")
    name, kind, k = _name(nodes[0]), render(nodes[1:2]), 2
    if k < len(nodes) and isinstance(nodes[k], Group):
        kind += render(nodes[k : k + 1])
        k += 1
    out = ColumnDef(name, kind.upper())
    if k < len(nodes):
        if not is_word(nodes[k], "DEFAULT") or k + 1 >= len(nodes):
            raise SqlError(f"unknown column clause {render(nodes[k:])}")
        value = nodes[k + 1 :]
        out.has_default = True
        if len(value) == 1 and isinstance(value[0], Token):
            out.default = None if is_word(value[0], "NULL") else unquote(value[0])
        else:
            out.default = render(value).replace(" ", "")
    return out


def parse_insert(sql: str) -> Insert:
    nodes = nest(tokenize(sql))
    if not is_word(nodes[1], "OVERWRITE", "INTO"):
        raise SqlError("INSERT is followed by OVERWRITE or INTO")
    overwrite, k = is_word(nodes[1], "OVERWRITE"), 2
    k += is_word(nodes[k], "TABLE")
    table = _name(nodes[k])
    k += 1
    if k >= len(nodes):
        raise SqlError("INSERT has no rows")
    if is_word(nodes[k], "VALUES"):
        rows = []
        for part in split_list(nodes[k + 1 :]):
            if len(part) != 1 or not isinstance(part[0], Group):
                raise SqlError("VALUES takes lists in parentheses")
            rows.append([render(x) for x in split_list(part[0].items)])
        return Insert(table, overwrite, None, rows)
    if not is_word(nodes[k], "SELECT", "WITH"):
        raise SqlError("INSERT takes SELECT or VALUES")
    return Insert(table, overwrite, render(nodes[k:]), None)
