"""124 functions as Spark SQL.

A function whose meaning is Spark's own passes through; the others are expressions
over built-in functions, so that all of them stay within code generation. `{over}`
marks where a window goes, inside of what is wrapped around an aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "tidemill 0.1.0"


@dataclass(frozen=True)
class Function:
    name: str
    kind: str  # aggregate, window, scalar
    least: int
    most: int | None
    build: Callable[..., str] | None = None  # of the arguments' SQL; None: Spark's own function
    native: str | None = None

    def sql(self, args: list[str], over: str = "", distinct: bool = False, of_text: bool = False) -> str:
        """of_text: an argument is text."""
        if len(args) < self.least or self.most is not None and len(args) > self.most:
            raise ValueError(f"{self.name} takes {self.least}{'' if self.most == self.least else f' to {self.most}' if self.most is not None else ' or more'} arguments, not {len(args)}")
        form = TEXT_FORMS.get(self.name) if of_text and FUNCTIONS.get(self.name) is BUILT_IN.get(self.name) else None
        if form is not None and not distinct:
            return form(*args).replace("{over}", over)
        if self.build is None:
            return f"{self.native or self.name.lower()}({'DISTINCT ' * distinct}{', '.join(args)}){over}"
        if distinct:
            args = [f"DISTINCT {args[0]}", *args[1:]]
        out = self.build(*args)
        return out.replace("{over}", over) if "{over}" in out else out + over


FUNCTIONS: dict[str, Function] = {}
BUILT_IN: dict[str, Function] = {}


def register(name: str, kind: str, least: int, most: int | None, build: Callable[..., str] | None = None, native: str | None = None) -> None:
    """Add a function, or take another meaning for a name."""
    FUNCTIONS[name.upper()] = Function(name.upper(), kind, least, most, build, native)


def list_functions(kind: str | None = None) -> list[str]:
    return sorted(k for k, f in FUNCTIONS.items() if kind in (None, f.kind))


def call(name: str, *args: str) -> Column:
    """A column from a registered function over SQL expressions."""
    return F.expr(FUNCTIONS[name.upper()].sql(list(args)))


def text(x: str) -> str:
    return f"cast({x} as string)"


def filled(x: str) -> str:
    """Text, with NULL as the empty string."""
    return f"coalesce({text(x)}, '')"


_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss")


def moment(x: str) -> str:
    """A timestamp from a date, a timestamp, or text in one of the known layouts; NULL where none fits. The type decides at planning time."""
    tries = ", ".join('try_to_timestamp({}, "{}")'.format(text(x), f) for f in _LAYOUTS)
    return f"(CASE WHEN typeof({x}) IN ('timestamp', 'timestamp_ntz', 'date') THEN try_cast({x} as timestamp) ELSE coalesce({tries}) END)"


def day(x: str) -> str:
    return f"cast({moment(x)} as date)"


def _part(f: str) -> Callable[[str], str]:
    return lambda x: f"coalesce({f}({moment(x)}), 0)"


def _whole(x: str) -> str:
    """A whole number from anything: cut off, 0 where it is none."""
    return f"coalesce(cast(try_cast({x} as double) as bigint), 0)"


def number(x: str) -> str:
    """Text as a number; NULL where it is none."""
    return f"try_cast({x} as double)"


def ordered(x: str) -> str:
    """What text is compared by: numbers as numbers, before all other text; NULL for NULL."""
    return f"if({x} IS NULL, NULL, named_struct('t', {number(x)} IS NULL, 'n', {number(x)}, 's', {x}))"


def plain(d: str) -> str:
    """A number as text, whole ones without a fraction."""
    return f"CASE WHEN {d} = floor({d}) AND abs({d}) < 1e15 THEN cast(cast({d} as bigint) as string) ELSE cast({d} as string) END"


def _tolerant(f: str, *args: str) -> str:
    """A function of numbers over text: what isn't a number comes back as it is."""
    return f"coalesce({plain(f'{f}({chr(44).join(map(number, args))})')}, {text(args[0])})"


#: Forms over text, of all arguments; typed numbers keep Spark's own functions.
TEXT_FORMS: dict[str, Callable[..., str]] = {
    **{n: lambda x, f=f: f"coalesce({f}({number(x)}){{over}}, 0)" for n, f in (("SUM", "sum"), ("AVG", "avg"), ("STDDEV", "stddev_pop"), ("STDDEV_POP", "stddev_pop"), ("VARIANCE", "var_pop"), ("VAR_POP", "var_pop"), ("STDDEV_SAMP", "stddev_samp"), ("VAR_SAMP", "var_samp"))},
    **{n: lambda x, y, f=f: f"coalesce(nanvl({f}({number(x)}, {number(y)}){{over}}, 0D), 0)" for n, f in (("CORR", "corr"), ("COVAR_POP", "covar_pop"), ("COVAR_SAMP", "covar_samp"))},
    **{n: lambda x, f=n.lower(): f"{f}({ordered(x)}){{over}}.s" for n in ("MIN", "MAX")},
    **{n: lambda *a, f=n.lower(): f"{f}({', '.join(ordered(text(x)) for x in a)}).s" for n in ("GREATEST", "LEAST")},
    **{n: lambda x, f=n.lower(): _tolerant(f, x) for n in ("FLOOR", "CEIL", "CEILING", "ABS", "SQRT", "EXP", "LN", "LOG10", "LOG2")},
    "SIGN": lambda x: f"coalesce(cast(sign({number(x)}) as string), {text(x)})",
    "ROUND": lambda x, d="0": f"coalesce({plain(f'round({number(x)}, {d})')}, {text(x)})",
    **{n: lambda x, y: _tolerant("power", x, y) for n in ("POWER", "POW")},
    "MOD": lambda x, y: _tolerant("try_mod", x, y),
}
#: Functions whose result is text.
TEXT_RESULTS = frozenset("CONCAT CONCAT_WS SUBSTRING SUBSTR UPPER UCASE LOWER LCASE TRIM LTRIM RTRIM REPLACE REVERSE LPAD RPAD INITCAP SPLIT TO_DATE DATE_FORMAT FROM_UNIXTIME TRUNC REGEXP_REPLACE REGEXP_EXTRACT BASE64 UNBASE64 HEX UNHEX MD5 SHA1 SHA2 ENCODE DECODE GET_JSON_OBJECT JSON_TUPLE MASK MASK_FIRST_N MASK_LAST_N MASK_SHOW_FIRST_N MASK_SHOW_LAST_N COLLECT_LIST COLLECT_SET HISTOGRAM_NUMERIC".split())


def groups_of(pattern: str) -> int | None:
    """How many groups a literal pattern has; -1 if it is none; None if it isn't a literal or there is nothing to ask."""
    m = re.fullmatch(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|\"((?:[^\"\\]|\\.|\"\")*)\")\s*", pattern, re.S)
    context = SparkContext._active_spark_context
    if not m or context is None:
        return None
    raw = m.group(1) if m.group(1) is not None else m.group(2)
    value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(e.group(1), e.group(0) if e.group(1) in "%_" else e.group(1)), raw.replace("''", "'"), flags=re.S)
    try:
        return context._jvm.java.util.regex.Pattern.compile(value).matcher("").groupCount()
    except Exception:  # the JVM's PatternSyntaxException
        return -1


def _regexp_extract(s: str, p: str, g: str = "1") -> str:
    """The empty string where the pattern is bad, or has no such group."""
    n = groups_of(p)
    if n is not None and (n < 0 or g.strip().isdigit() and int(g) > n):
        return "''"
    return f"coalesce(regexp_extract({s}, {p}, {g}), '')"


def _cond(c: str) -> str:
    return f"(CASE typeof({c}) WHEN 'boolean' THEN coalesce(try_cast({c} as boolean), false) ELSE coalesce({text(c)} IN ('true', 'TRUE'), false) OR coalesce(try_cast({text(c)} as double) != 0, false) END)"


def _listed(f: str) -> Callable[[str], str]:
    return lambda x: f"concat('[', array_join(array_sort({f}({text(x) if 'DISTINCT' not in x else x}){{over}}), ','), ']')"


def _percentile(x: str, p: str, *_: str) -> str:
    return f"percentile(cast({x} as double), cast({p} as double)){{over}}"


def _number(e: str) -> str:
    """Up to six decimals, without zeros at the end."""
    return f"regexp_replace(cast(cast(round({e}, 6) as decimal(38, 6)) as string), '\\\\.?0+$', '')"


def histogram(x: str, n: str) -> str:
    """[[lo-hi:n],...] over n buckets of equal width between the least and the largest value, the last one closed; [[v,n]] for a single value. This form keeps a group's values in one place; where the query's form allows it, histogram_from_ends goes instead."""
    v = f"array_sort(collect_list(cast({x} as double)){{over}})"
    lo, hi = "element_at(h, 1)", "element_at(h, -1)"
    b = f"cast({n} as int)"
    width = f"(({hi} - {lo}) / {b})"
    row = f"concat('[', {_number(f'{lo} + i * {width}')}, '-', {_number(f'{lo} + (i + 1) * {width}')}, ':', cast(size(filter(h, e -> least(cast(floor((e - {lo}) / {width}) as int), {b} - 1) = i)) as string), ']')"
    many = f"concat('[', array_join(transform(sequence(0, {b} - 1), i -> {row}), ','), ']')"
    one = f"concat('[[', {_number(lo)}, ',', cast(size(h) as string), ']]')"
    return f"element_at(transform(array({v}), h -> CASE WHEN size(h) = 0 THEN '[]' WHEN {lo} = {hi} THEN {one} ELSE {many} END), 1)"


def histogram_from_ends(x: str, n: int, lo: str, hi: str) -> str:
    """The same, from columns with the group's least and largest value: a partial aggregation of n counts."""
    v, a, b = f"cast({x} as double)", f"max({lo})", f"max({hi})"
    at = f"least(cast(floor(({v} - {lo}) / nullif(({hi} - {lo}) / {n}, 0)) as int), {n - 1})"
    width = f"(({b} - {a}) / {n})"
    rows = ", ".join(f"concat('[', {_number(f'{a} + {k} * {width}')}, '-', {_number(f'{a} + {k + 1} * {width}')}, ':', cast(count_if({at} = {k}) as string), ']')" for k in range(n))
    return f"(CASE WHEN {a} IS NULL THEN '[]' WHEN {a} = {b} THEN concat('[[', {_number(a)}, ',', cast(count({v}) as string), ']]') ELSE concat('[', concat_ws(',', {rows}), ']') END)"


def _trunc(x: str, unit: str = "'DD'") -> str:
    d = moment(x)
    u = f"upper({unit})"
    fmt = lambda v, f: f"date_format({v}, '{f}')"
    return (
        f"(CASE WHEN {u} IN ('YY', 'YYYY', 'YEAR') THEN {fmt(f'trunc(cast({d} as date), \"YY\")', 'yyyy-MM-dd')} WHEN {u} IN ('MM', 'MON', 'MONTH') THEN {fmt(f'trunc(cast({d} as date), \"MM\")', 'yyyy-MM-dd')} "
        f"WHEN {u} IN ('HH', 'HOUR') THEN {fmt(f'date_trunc(\"HOUR\", {d})', 'yyyy-MM-dd HH:mm:ss')} WHEN {u} IN ('MI', 'MINUTE') THEN {fmt(f'date_trunc(\"MINUTE\", {d})', 'yyyy-MM-dd HH:mm:ss')} ELSE {fmt(d, 'yyyy-MM-dd')} END)"
    )


EXTRACTS = {"YEAR": "year", "MONTH": "month", "DAY": "dayofmonth", "DAYOFMONTH": "dayofmonth", "HOUR": "hour", "MINUTE": "minute", "SECOND": "second", "WEEK": "weekofyear", "WEEKOFYEAR": "weekofyear", "QUARTER": "quarter", "YEARDAY": "dayofyear", "DOY": "dayofyear"}


def extract(field: str, x: str) -> str:
    """Fields as named; DOW and DAYOFWEEK count Monday as 1."""
    f = field.strip("'\"").upper()
    if f in ("DOW", "DAYOFWEEK"):
        return f"coalesce(weekday({moment(x)}) + 1, 0)"
    if f not in EXTRACTS:
        raise ValueError(f"EXTRACT doesn't know {field}")
    return f"coalesce({EXTRACTS[f]}({moment(x)}), 0)"


_DAYS = "('sunday', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sun', 'mon', 'tue', 'wed', 'thu', 'fri', 'sat')"
_CAST = {"INT": "int", "INTEGER": "int", "BIGINT": "bigint", "LONG": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint"}


def cast(x: str, kind: str) -> str:
    """Whole numbers are cut off and 0 where the value is none, floats 0 likewise; booleans are true for true, TRUE, 1 and t only."""
    k = kind.strip("'\"").upper()
    if k in _CAST:
        return f"coalesce(try_cast({text(x)} as {_CAST[k]}), try_cast(try_cast({x} as double) as {_CAST[k]}), cast(0 as {_CAST[k]}))"
    if k in ("FLOAT", "DOUBLE", "REAL"):
        return f"coalesce(try_cast({x} as double), 0D)"
    if k in ("STRING", "VARCHAR", "CHAR", "TEXT"):
        return text(x)
    if k in ("BOOLEAN", "BOOL"):
        return f"coalesce({text(x)} IN ('true', 'TRUE', '1', 't'), false)"
    return f"try_cast({x} as {kind})"


def hash31(*args: str) -> str:
    """h = h * 31 + code point over all arguments on end, as a wrapping 64-bit number, without its sign."""
    s = f"concat({', '.join(map(filled, args))})"
    # two halves of 32 bits keep the products within a long: h = hi * 2^32 + lo
    step = "(h, c) -> named_struct('hi', (h.hi * 31 + shiftright(h.lo * 31 + ascii(c), 32)) & 4294967295, 'lo', (h.lo * 31 + ascii(c)) & 4294967295)"
    done = "h -> abs(shiftleft(if(h.hi >= 2147483648, h.hi - 4294967296, h.hi), 32) | h.lo)"
    return f"aggregate(filter(split({s}, ''), e -> e != ''), named_struct('hi', 0L, 'lo', 0L), {step}, {done})"


def _mask(x: str, *marks: str) -> str:
    return f"mask({', '.join([text(x), *marks])})"


def _left(x: str, n: str) -> str:
    return f"substring({text(x)}, 1, greatest({n}, 0))"


def _rest(x: str, n: str) -> str:
    return f"substring({text(x)}, greatest({n}, 0) + 1)"


def _head_of(x: str, n: str) -> str:
    """All but the last n characters."""
    return f"substring({text(x)}, 1, greatest(length({text(x)}) - greatest({n}, 0), 0))"


def _tail_of(x: str, n: str) -> str:
    return f"substring({text(x)}, greatest(length({text(x)}) - greatest({n}, 0), 0) + 1)"


def _utf8(cs: str) -> str:
    return f"upper({cs}) IN ('UTF-8', 'UTF8')"


def _round(x: str, d: str | None = None) -> str:
    return f"round({x}{'' if d is None else f', {d}'})"


for _n, _b in {
    "COUNT": None, "MIN": None, "MAX": None, "STDDEV_POP": None, "VAR_POP": None, "COVAR_POP": None,
}.items():
    register(_n, "aggregate", 1 if _n != "COVAR_POP" else 2, None if _n == "COUNT" else 2 if _n == "COVAR_POP" else 1, _b)
register("SUM", "aggregate", 1, 1, lambda x: f"coalesce(sum({x}){{over}}, 0)")
register("AVG", "aggregate", 1, 1, lambda x: f"coalesce(avg({x}){{over}}, 0)")
register("STDDEV", "aggregate", 1, 1, lambda x: f"stddev_pop({x}){{over}}")
register("VARIANCE", "aggregate", 1, 1, lambda x: f"var_pop({x}){{over}}")
register("STDDEV_SAMP", "aggregate", 1, 1, lambda x: f"coalesce(stddev_samp({x}){{over}}, 0)")
register("VAR_SAMP", "aggregate", 1, 1, lambda x: f"coalesce(var_samp({x}){{over}}, 0)")
register("COLLECT_LIST", "aggregate", 1, 1, _listed("collect_list"))
register("COLLECT_SET", "aggregate", 1, 1, _listed("collect_set"))
register("CORR", "aggregate", 2, 2, lambda x, y: f"coalesce(nanvl(corr({x}, {y}){{over}}, 0D), 0)")
register("COVAR_SAMP", "aggregate", 2, 2, lambda x, y: f"coalesce(covar_samp({x}, {y}){{over}}, 0)")
register("PERCENTILE", "aggregate", 2, 2, _percentile)
register("PERCENTILE_APPROX", "aggregate", 2, 3, _percentile)
register("HISTOGRAM_NUMERIC", "aggregate", 2, 2, histogram)

for _n, _least, _most in (("ROW_NUMBER", 0, 0), ("RANK", 0, 0), ("DENSE_RANK", 0, 0), ("LEAD", 1, 3), ("LAG", 1, 3), ("FIRST_VALUE", 1, 1), ("LAST_VALUE", 1, 1), ("CUME_DIST", 0, 0), ("PERCENT_RANK", 0, 0), ("NTH_VALUE", 2, 2)):
    register(_n, "window", _least, _most)

register("NTILE", "window", 1, 1, lambda n: f"ntile({n}){{over}}" if not re.fullmatch(r"-\s*\d+|0+", n.strip()) else "(row_number(){over} * 0 + 1)")

register("CONCAT", "scalar", 1, None, lambda *a: f"concat({', '.join(map(filled, a))})")
register("CONCAT_WS", "scalar", 2, None, lambda s, *a: f"concat_ws({s}, {', '.join(map(filled, a))})")
for _n in ("SUBSTRING", "SUBSTR"):
    register(_n, "scalar", 2, 3, lambda x, p, n=None: f"substring({text(x)}, greatest({p}, 1){'' if n is None else f', {n}'})")
for _n in ("UPPER", "UCASE", "LOWER", "LCASE", "LTRIM", "RTRIM", "LENGTH", "REVERSE"):
    register(_n, "scalar", 1, 1, lambda x, f=_n.lower(): f"{f}({text(x)})")
register("TRIM", "scalar", 1, 1, lambda x: f"regexp_replace({text(x)}, '(?U)^\\\\s+|\\\\s+$', '')")
register("REPLACE", "scalar", 3, 3)
register("LOCATE", "scalar", 2, 3)
register("INSTR", "scalar", 2, 2)
register("LPAD", "scalar", 3, 3)
register("RPAD", "scalar", 3, 3)
register("INITCAP", "scalar", 1, 1, lambda x: f"array_join(transform(split({text(x)}, '(?<=[ \\t\\n_-])'), w -> concat(upper(left(w, 1)), lower(substr(w, 2)))), '')")
register("ASCII", "scalar", 1, 1)
register("SPLIT", "scalar", 2, 2, lambda s, d: f"concat('[', array_join(split({text(s)}, concat('\\\\Q', replace({d}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')), ','), ']')")

register("ROUND", "scalar", 1, 2, _round)
for _n in ("FLOOR", "CEIL", "CEILING", "ABS", "SQRT", "EXP", "LN", "LOG10", "LOG2", "SIGN"):
    register(_n, "scalar", 1, 1)
register("POWER", "scalar", 2, 2)
register("POW", "scalar", 2, 2)
register("MOD", "scalar", 2, 2, lambda x, y: f"coalesce(try_mod({x}, {y}), {x})")
register("RAND", "scalar", 0, 1)
register("GREATEST", "scalar", 2, None)
register("LEAST", "scalar", 2, None)
register("WIDTH_BUCKET", "scalar", 4, 4, lambda v, a, b, n: f"coalesce(width_bucket({v}, {a}, {b}, {n}), 0)")

register("CURRENT_DATE", "scalar", 0, 0)
register("CURRENT_TIMESTAMP", "scalar", 0, 0)
register("UNIX_TIMESTAMP", "scalar", 0, 2, lambda x=None, f=None: "unix_timestamp()" if x is None else f"coalesce(unix_timestamp({moment(x)}), 0)" if f is None else f"coalesce(unix_timestamp(try_to_timestamp({text(x)}, {f})), 0)")
register("FROM_UNIXTIME", "scalar", 1, 2, lambda n, f="'yyyy-MM-dd HH:mm:ss'": f"from_unixtime({_whole(n)}, {f})")
register("TO_DATE", "scalar", 1, 1, lambda x: f"coalesce(date_format({moment(x)}, 'yyyy-MM-dd'), {text(x)})")
for _n, _f in (("YEAR", "year"), ("MONTH", "month"), ("DAY", "dayofmonth"), ("DAYOFMONTH", "dayofmonth"), ("HOUR", "hour"), ("MINUTE", "minute"), ("SECOND", "second"), ("WEEKOFYEAR", "weekofyear"), ("QUARTER", "quarter")):
    register(_n, "scalar", 1, 1, _part(_f))
register("DATEDIFF", "scalar", 2, 2, lambda e, s: f"cast((unix_timestamp({moment(e)}) - unix_timestamp({moment(s)})) / 86400 as int)")
register("DATE_ADD", "scalar", 2, 2, lambda x, n: f"date_add({day(x)}, cast({n} as int))")
register("DATE_SUB", "scalar", 2, 2, lambda x, n: f"date_sub({day(x)}, cast({n} as int))")
register("DATE_FORMAT", "scalar", 2, 2, lambda x, f: f"date_format({moment(x)}, {f})")
register("ADD_MONTHS", "scalar", 2, 2, lambda x, n: f"add_months({day(x)}, cast({n} as int))")
register("LAST_DAY", "scalar", 1, 1, lambda x: f"last_day({day(x)})")
register("NEXT_DAY", "scalar", 2, 2, lambda x, d: f"if(lower({d}) IN {_DAYS}, next_day({day(x)}, if(lower({d}) IN {_DAYS}, {d}, 'mon')), {day(x)})")
register("MONTHS_BETWEEN", "scalar", 2, 2, lambda e, s: f"round((year({day(e)}) - year({day(s)})) * 12 + (month({day(e)}) - month({day(s)})) + (dayofmonth({day(e)}) - dayofmonth({day(s)})) / dayofmonth(last_day({day(s)})), 6)")
register("TRUNC", "scalar", 1, 2, _trunc)
register("FROM_UTC_TIMESTAMP", "scalar", 2, 2, lambda x, z: f"date_format(from_utc_timestamp({moment(x)}, {z}), 'yyyy-MM-dd HH:mm:ss')")
register("TO_UTC_TIMESTAMP", "scalar", 2, 2, lambda x, z: f"date_format(to_utc_timestamp({moment(x)}, {z}), 'yyyy-MM-dd HH:mm:ss')")
register("EXTRACT", "scalar", 2, 3, lambda f, x, *y: extract(f, y[-1] if y else x))

register("IF", "scalar", 3, 3, lambda c, a, b: f"if({_cond(c)}, {a}, {b})")
register("COALESCE", "scalar", 1, None, lambda *a: f"coalesce({', '.join(_nonempty(x) for x in a)})")
register("NVL", "scalar", 2, 2, lambda x, y: f"coalesce({_nonempty(x)}, {y})")
register("NULLIF", "scalar", 2, 2)
register("CAST", "scalar", 2, 2, cast)

register("REGEXP_REPLACE", "scalar", 3, 3, lambda s, p, r: text(s) if groups_of(p) == -1 else f"regexp_replace({s}, {p}, {r})")
register("REGEXP_EXTRACT", "scalar", 2, 3, _regexp_extract)
register("REGEXP_LIKE", "scalar", 2, 2, lambda s, p: "false" if groups_of(p) == -1 else f"regexp_like({s}, {p})")
register("BASE64", "scalar", 1, 1, lambda x: f"base64(encode({text(x)}, 'UTF-8'))")
register("UNBASE64", "scalar", 1, 1, lambda x: f"coalesce(cast(try_to_binary({text(x)}, 'base64') as string), {text(x)})")
register("HEX", "scalar", 1, 1, lambda x: f"lower(hex(encode({text(x)}, 'UTF-8')))")
register("UNHEX", "scalar", 1, 1, lambda x: f"if(length({text(x)}) % 2 = 0, coalesce(cast(unhex({text(x)}) as string), {text(x)}), {text(x)})")
register("MD5", "scalar", 1, 1, lambda x: f"md5(encode({text(x)}, 'UTF-8'))")
register("SHA1", "scalar", 1, 1, lambda x: f"sha1(encode({text(x)}, 'UTF-8'))")
register("SHA2", "scalar", 2, 2, lambda x, n: f"CASE coalesce(try_cast({n} as int), 256) WHEN 224 THEN sha2(encode({text(x)}, 'UTF-8'), 224) WHEN 384 THEN sha2(encode({text(x)}, 'UTF-8'), 384) WHEN 512 THEN sha2(encode({text(x)}, 'UTF-8'), 512) ELSE sha2(encode({text(x)}, 'UTF-8'), 256) END")
register("CRC32", "scalar", 1, 1, lambda x: f"crc32(encode({text(x)}, 'UTF-8'))")
register("HASH", "scalar", 1, None, hash31)
register("ENCODE", "scalar", 2, 2, lambda x, cs: f"if({_utf8(cs)}, {text(x)}, lower(hex(encode({text(x)}, 'UTF-8'))))")
register("DECODE", "scalar", 2, 2, lambda x, cs: f"if({_utf8(cs)}, {text(x)}, coalesce(cast(unhex({text(x)}) as string), {text(x)}))")
register("GET_JSON_OBJECT", "scalar", 2, 2)
register("JSON_TUPLE", "scalar", 2, None, lambda j, k, *_: f"get_json_object({j}, concat('$.', {k}))")
register("CURRENT_USER", "scalar", 0, 0)
register("CURRENT_DATABASE", "scalar", 0, 0)
register("VERSION", "scalar", 0, 0, lambda: f"'{VERSION}'")
register("MASK", "scalar", 1, 4, _mask)
register("MASK_FIRST_N", "scalar", 2, 2, lambda x, n: f"concat(mask({_left(x, n)}), {_rest(x, n)})")
register("MASK_LAST_N", "scalar", 2, 2, lambda x, n: f"concat({_head_of(x, n)}, mask({_tail_of(x, n)}))")
register("MASK_SHOW_FIRST_N", "scalar", 2, 2, lambda x, n: f"concat({_left(x, n)}, mask({_rest(x, n)}))")
register("MASK_SHOW_LAST_N", "scalar", 2, 2, lambda x, n: f"concat(mask({_head_of(x, n)}), {_tail_of(x, n)})")


def _nonempty(x: str) -> str:
    """NULL for the empty string; other types pass as they are, decided at planning time."""
    return f"(CASE WHEN typeof({x}) = 'string' AND {text(x)} = '' THEN NULL ELSE {x} END)"


# a function that is registered anew has no form of its own over text
BUILT_IN.update(FUNCTIONS)
