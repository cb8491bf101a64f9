"""Declared tables: columns, options, partitions; and options from URLs."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

from .plans.ddl import ColumnDef, CreateTable
from .plans.rewrite import default_literal

TYPES = {"INT": "int", "INTEGER": "int", "BIGINT": "bigint", "LONG": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint", "FLOAT": "float", "DOUBLE": "double", "REAL": "double", "DECIMAL": "decimal(38,18)", "NUMERIC": "decimal(38,18)", "STRING": "string", "VARCHAR": "string", "CHAR": "string", "TEXT": "string", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
PORTS = {"ftp": "21", "sftp": "22", "mysql": "3306", "postgres": "5432"}


def spark_type(declared: str) -> str:
    base, _, args = declared.upper().replace(" ", "").partition("(")
    if base in ("DECIMAL", "NUMERIC") and args:
        return f"decimal({args}"
    if base not in TYPES:
        raise ValueError(f"unknown type {declared}")
    return TYPES[base]


@dataclass
class Table:
    name: str
    columns: list[ColumnDef]
    options: dict[str, str]
    partitions: list[str] = field(default_factory=list)
    external: bool = False

    @property
    def storage(self) -> str:
        return self.options.get("storage", "local").lower()

    @property
    def format(self) -> str:
        f = self.options.get("format", "csv").lower()
        return {"excel": "xlsx", "jsonl": "json"}.get(f, f)

    @property
    def data_columns(self) -> list[ColumnDef]:
        """Columns that are in the files, without those that the directories hold."""
        return [c for c in self.columns if c.name.lower() not in {p.lower() for p in self.partitions}]

    @property
    def all_columns(self) -> list[ColumnDef]:
        """Data columns, then partition columns as text."""
        return self.data_columns + [ColumnDef(p, "STRING") for p in self.partitions]

    def described(self) -> list[tuple[str, str, str]]:
        return [(c.name, spark_type(c.type), default_literal(spark_type(c.type), c.default, c.has_default)) for c in self.all_columns]


class Catalog:
    """Tables by name, regardless of case."""

    def __init__(self) -> None:
        self._tables: dict[str, Table] = {}

    def register(self, t: Table) -> Table:
        if t.name.lower() in self._tables:
            raise ValueError(f"table {t.name} exists already")
        self._tables[t.name.lower()] = t
        return t

    def create(self, c: CreateTable) -> Table:
        for col in c.columns:
            spark_type(col.type)
        return self.register(Table(c.name, c.columns, with_url(c.options), c.partitions, c.external))

    def get(self, name: str) -> Table | None:
        return self._tables.get(name.strip("`").lower())

    def drop(self, name: str) -> None:
        self._tables.pop(name.lower(), None)

    def list(self) -> list[str]:
        return sorted(t.name for t in self._tables.values())


def with_url(options: dict[str, str]) -> dict[str, str]:
    """Options completed from `url`; what is set explicitly wins, defaults come last."""
    out = dict(options)
    if "location" in out:
        out.setdefault("path", out["location"])
    url = out.get("url", "")
    found: dict[str, str] = {}
    if "://" in url:
        u = urlsplit(url)
        scheme = u.scheme.lower()
        login = {k: unquote(v) for k, v in (("username", u.username or ""), ("password", u.password or "")) if v}
        place = {k: v for k, v in (("host", u.hostname or ""), ("port", str(u.port or ""))) if v}
        if scheme in ("ftp", "sftp"):
            found = {"storage": scheme, "path": u.path, **place, **login}
        elif scheme in ("s3", "s3a"):
            parts = [p for p in u.path.split("/") if p]
            found = {"storage": "s3"}
            if "." in u.netloc or ":" in u.netloc:
                found |= {"endpoint": f"https://{u.netloc}", "bucket": parts[0] if parts else "", "path": "/".join(parts[1:])}
            else:
                found |= {"bucket": u.netloc, "path": "/".join(parts)}
            for k, v in parse_qsl(u.query):
                k = k.lower()
                found["access_key" if k in ("access_key", "accesskey") else "access_secret" if k in ("access_secret", "accesssecret", "secret_key", "secretkey") else k] = v
        elif scheme == "hdfs":
            found = {"storage": "hdfs", "path": url}
        elif scheme in ("webdav", "webdavs"):
            found = {"storage": "webdav", "base": f"http{'s' * (scheme == 'webdavs')}://{u.hostname}{f':{u.port}' if u.port else ''}", "path": u.path, **login}
        elif scheme in ("gitlfs", "git-lfs", "git"):
            found = {"storage": "gitlfs", "path": u.path}
        elif scheme == "lark":
            found = {"storage": "lark", "path": f"{u.hostname or ''}{u.path}", **{k: v for k, v in (("app_id", u.username), ("app_secret", u.password)) if v}, **dict(parse_qsl(u.query))}
        elif scheme == "local":
            found = {"storage": "local", "path": u.path}
        elif scheme in ("mysql", "postgres", "postgresql"):
            found = {"storage": "mysql" if scheme == "mysql" else "postgres", "database": u.path.strip("/"), **place, **login, **dict(parse_qsl(u.query))}
        elif scheme in ("sqlite", "sqlite3"):
            found = {"storage": "sqlite", "path": f"{u.netloc}{u.path}" if u.netloc else u.path}
        elif scheme in ("http", "https") and out.get("storage") == "webdav":
            found = {"base": f"{scheme}://{u.netloc}", "path": u.path}
    merged = found | out
    if merged.get("storage") == "webdav" and merged.get("path") and found.get("path") and out.get("path"):
        merged["path"] = out["path"]
    if merged.get("storage") in PORTS:
        merged.setdefault("port", PORTS[merged["storage"]])
    return merged
