"""The engine: scripts of CREATE TABLE, SELECT, INSERT and EXPLAIN over one Spark session.

    engine = Engine(spark)
    engine.execute("CREATE TABLE t (id INT, name STRING) WITH (path = '/data/t', format = 'csv')")
    engine.execute("SELECT name, COUNT(*) AS n FROM t GROUP BY name").show()

SELECT returns a lazy DataFrame: nothing runs before an action.
"""

from __future__ import annotations

import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import template
from .catalog import Catalog, Table, spark_type
from .plans.ddl import parse_create, parse_insert
from .plans.rewrite import Columns, Rewriter, default_literal
from .plans.tokens import SqlError, is_word, nest, split_script, tokenize
from .sources import readers, sinks


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog, self.verbose = spark, catalog or Catalog(), 0
        self._views: dict[str, Columns] = {}

    # -- tables --

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame as a table."""
        df.createOrReplaceTempView(name)
        self._views[name.lower()] = _columns(df.schema)

    def register_parquet(self, folder: str, *names: str) -> None:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))

    def table(self, name: str) -> DataFrame:
        """A declared table, or a view."""
        t = self.catalog.get(name)
        return readers.load(self.spark, t) if t else self.spark.table(name)

    def set_verbose(self, level: int) -> None:
        self.verbose = max(0, min(5, level))

    # -- statements --

    def execute(self, script: str) -> DataFrame | None:
        """Run a script; the result of its last SELECT, if it has one."""
        out = None
        for statement in split_script(script):
            got = self._statement(statement)
            out = got if got is not None else out
        return out

    def execute_template(self, text: str, params: dict[str, Any] | None = None) -> DataFrame | None:
        return self.execute(template.render(text, params))

    def results(self, script: str):
        """Run a script; the results of its SELECTs and EXPLAINs, one by one."""
        for statement in split_script(script):
            got = self._statement(statement)
            if got is not None:
                yield got

    def explain(self, sql: str) -> str:
        """The plans of a SELECT: as read, analysed, optimised and physical."""
        return self._select(sql)._jdf.queryExecution().toString()

    def _statement(self, sql: str) -> DataFrame | None:
        head = tokenize(sql)
        first = head[0].up if head else ""
        if first == "CREATE":
            self.catalog.create(parse_create(sql))
            return None
        if first == "INSERT":
            self._insert(sql)
            return None
        if first == "EXPLAIN":
            rest = sql[sql.upper().index("EXPLAIN") + 7 :]
            return self.spark.createDataFrame([(self.explain(rest),)], "plan string")
        if first in ("SELECT", "WITH"):
            df = self._select(sql)
            if self.verbose:
                self._report(sql, df)
            return df
        raise SqlError(f"a statement begins with CREATE, SELECT, WITH, INSERT or EXPLAIN, not {first or 'nothing'}")

    def rewritten(self, sql: str) -> str:
        """The query as Spark gets it, its declared tables bound to views."""
        self._bind(sql)
        return Rewriter(self._describe).query(sql)

    def _select(self, sql: str) -> DataFrame:
        return self.spark.sql(self.rewritten(sql))

    def _bind(self, sql: str) -> None:
        """Views for the declared tables that the query names; files are looked up anew each time."""
        for name in {t.text.strip("`") for t in tokenize(sql) if t.kind in ("word", "quoted")}:
            t = self.catalog.get(name)
            if t is None:
                continue
            try:
                readers.load(self.spark, t).createOrReplaceTempView(t.name)
            except readers.NoFiles:
                if _reads(sql, name):
                    raise

    def _describe(self, source: str) -> Columns | None:
        name = source.strip("`").lower()
        t = self.catalog.get(name)
        if t is not None:
            return t.described()
        if name in self._views:
            return self._views[name]
        query = source if source[:5].upper() in ("WITH ", "SELEC") else f"SELECT * FROM {source}"
        return _columns(self.spark.sql(query).schema)

    def _insert(self, sql: str) -> None:
        i = parse_insert(sql)
        t = self.catalog.get(i.table)
        if t is None:
            raise SqlError(f"table {i.table} doesn't exist")
        sinks.write(self._values(t, i.values) if i.values is not None else self._mapped(t, i.query), t, i.overwrite)

    def _values(self, t: Table, rows: list[list[str]]) -> DataFrame:
        columns = t.all_columns
        for r in rows:
            if len(r) > len(columns):
                raise SqlError(f"{len(r)} values for the {len(columns)} columns of {t.name}")
            if any(not c.has_default for c in columns[len(r) :]):
                raise SqlError(f"{len(r)} values for {t.name}: only columns with a DEFAULT may be left out")
        kinds = [spark_type(c.type) for c in columns]
        write = Rewriter(self._describe)
        selects = []
        for r in rows:
            cells = [_as(write.query(v), k) for v, k in zip(r, kinds)]
            cells += [default_literal(k, c.default, True) for c, k in list(zip(columns, kinds))[len(r) :]]
            selects.append("SELECT " + ", ".join(f"{v} AS `{c.name}`" for v, c in zip(cells, columns)))
        return self.spark.sql(" UNION ALL ".join(selects))

    def _mapped(self, t: Table, query: str) -> DataFrame:
        """The query's columns on the table's: by position, or by name for SELECT *; a DEFAULT or NULL where there is none."""
        df, columns = self._select(query), t.all_columns
        nodes = nest(tokenize(query))
        star = len(nodes) > 1 and is_word(nodes[0], "SELECT") and getattr(nodes[1], "text", "") == "*"
        names = {c.lower(): c for c in df.columns} if star else {}
        if not star and len(df.columns) > len(columns):
            raise SqlError(f"{len(df.columns)} columns for the {len(columns)} of {t.name}")
        position = [f"_{k}" for k in range(len(df.columns))]
        numbered = df.toDF(*position)
        out = []
        for k, c in enumerate(columns):
            kind = spark_type(c.type)
            at = df.columns.index(names[c.name.lower()]) if c.name.lower() in names else k if not star and k < len(position) else None
            v = F.expr(_as(position[at], kind)) if at is not None else F.expr(default_literal(kind, c.default, True) if c.has_default else f"cast(NULL as {kind})")
            out.append(v.alias(c.name))
        return numbered.select(*out)

    def _report(self, sql: str, df: DataFrame) -> None:
        print(f"-- {' '.join(sql.split())[:200]}", file=sys.stderr)
        print(f"-- columns: {', '.join(f'{n} {k}' for n, k in df.dtypes)}", file=sys.stderr)
        if self.verbose >= 2:
            print(f"-- {Rewriter(self._describe).query(sql)}", file=sys.stderr)
        if self.verbose >= 3:
            df.explain("formatted" if self.verbose < 5 else "extended")
        if self.verbose >= 4:
            print(f"-- rows: {df.count()}", file=sys.stderr)


def _as(v: str, kind: str) -> str:
    return f"cast({v} as string)" if kind == "string" else f"try_cast({v} as {kind})"


def _columns(schema: StructType) -> Columns:
    return [(f.name, f.dataType.simpleString(), default_literal(f.dataType.simpleString())) for f in schema]


def _reads(sql: str, name: str) -> bool:
    """Whether a query reads from the name, rather than calling a column so."""
    ts = tokenize(sql)
    return any(t.text.strip("`").lower() == name.lower() and k and ts[k - 1].up in ("FROM", "JOIN", ",") for k, t in enumerate(ts))
