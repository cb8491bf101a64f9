"""python -m tidemill: run SQL from the command line.

-e SQL, -s FILE or URL, -t TEMPLATE may repeat and share one catalog, in the order
given; -a NAME=VALUE sets template parameters (JSON, @file or text; a repeated name
joins its values for an IN list); -v up to five times tells more; `desc` lists functions.
"""

from __future__ import annotations

import argparse
import sys

from .engine import Engine
from .functions import FUNCTIONS
from .sources.storages import fetch_text
from .template import parse_param, render


class _Step(argparse.Action):
    def __call__(self, parser, namespace, values, option_string=None):
        namespace.steps = [*(namespace.steps or []), (self.dest, values)]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidemill", description="Hive-flavoured SQL over files and databases, on Spark.")
    p.set_defaults(steps=None)
    p.add_argument("-e", dest="sql", action=_Step, metavar="SQL", help="run SQL")
    p.add_argument("-s", dest="script", action=_Step, metavar="FILE|URL", help="run a script")
    p.add_argument("-t", dest="template", action=_Step, metavar="FILE|URL", help="render and run a template")
    p.add_argument("-a", dest="params", action="append", default=[], metavar="NAME=VALUE", help="a template parameter")
    p.add_argument("-v", dest="verbose", action="count", default=0, help="tell more")
    p.add_argument("--master", default=None, help="Spark's master")
    p.add_argument("command", nargs="?", choices=["desc"], help="list all functions")
    return p


def params_of(pairs: list[str]) -> dict:
    out: dict = {}
    for pair in pairs:
        name, eq, value = pair.partition("=")
        if not eq:
            raise SystemExit(f"-a takes NAME=VALUE, not {pair}")
        new = parse_param(value)
        out[name] = f"{out[name]}','{new}" if name in out else new
    return out


def table_text(df) -> str:
    """Rows under a header, columns by name."""
    names = sorted(df.columns)
    rows = [", ".join("" if r[n] is None else str(r[n]) for n in names) for r in df.collect()]
    return "\n".join([", ".join(names), *rows]) if rows else "No rows returned"


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "desc":
        for name, f in sorted(FUNCTIONS.items()):
            print(f"{name}\t{f.kind}\t{f.least}{'' if f.most == f.least else f'-{f.most}' if f.most is not None else '+'}")
        return 0
    if not a.steps:
        parser().print_help()
        return 2
    own = spark is None
    if own:
        from pyspark.sql import SparkSession

        b = SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        spark = (b.master(a.master) if a.master else b).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    engine.set_verbose(a.verbose)
    params = params_of(a.params)
    try:
        for kind, value in a.steps:
            text = value if kind == "sql" else fetch_text(value)
            for df in engine.results(render(text, params) if kind == "template" else text):
                if df.columns == ["plan"]:
                    print(df.first().plan)
                else:
                    print(table_text(df))
    except Exception as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()
    return 0
