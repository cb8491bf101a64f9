"""Statements over temporary files."""

import os

import pytest

from tidemill import Engine
from tidemill.plans.tokens import SqlError, split_script


@pytest.fixture
def engine(spark):
    return Engine(spark)


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def joined(engine, tmp_path):
    put(tmp_path / "c", "c.csv", "1,Ann,X\n2,Bob,Y\n3,Cid,Z\n4,Dee,X\n5,Eve,Y\n")
    put(tmp_path / "o", "o.csv", "11,1,500\n12,1,150\n13,2,300\n14,9,999\n15,3,250\n")
    engine.execute(f"""
      CREATE TABLE c (id INT, name STRING, city STRING) WITH (format='csv', path='{tmp_path}/c');
      CREATE TABLE o (oid INT, cid INT, amount INT) WITH (format='csv', path='{tmp_path}/o');""")
    return engine


@pytest.mark.parametrize("join, n", [("JOIN", 4), ("INNER JOIN", 4), ("LEFT JOIN", 6), ("LEFT OUTER JOIN", 6), ("RIGHT JOIN", 5), ("FULL OUTER JOIN", 7), ("LEFT SEMI JOIN", 3)])
def test_join_kinds(joined, join, n):
    assert joined.execute(f"SELECT c.id FROM c {join} o ON c.id = o.cid").count() == n
    assert joined.execute(f"SELECT c.id FROM c {join} o ON o.cid = c.id").count() == n


def test_cross_join(joined):
    assert joined.execute("SELECT c.id, o.oid FROM c CROSS JOIN o").count() == 25


def test_outer_joins_fill_by_type(joined):
    assert sorted(rows(joined.execute("SELECT * FROM c FULL JOIN o ON c.id = o.cid WHERE amount = 0 OR name IS NULL OR name = ''"))) == [(0, "", "", 14, 9, 999), (4, "Dee", "X", 0, 0, 0), (5, "Eve", "Y", 0, 0, 0)]


def test_order_by_over_an_outer_join(joined):
    assert rows(joined.execute("SELECT c.city AS name, COUNT(*) AS n, SUM(o.amount) AS s FROM c LEFT JOIN o ON c.id = o.cid GROUP BY c.city ORDER BY name DESC")) == [("Z", 1, 250), ("Y", 2, 300), ("X", 3, 650)]
    assert rows(joined.execute("SELECT DISTINCT c.city FROM c LEFT JOIN o ON c.id = o.cid ORDER BY c.city LIMIT 2")) == [("X",), ("Y",)]
    assert rows(joined.execute("SELECT c.*, o.amount FROM c LEFT JOIN o ON c.id = o.cid WHERE o.oid > 0 ORDER BY o.oid DESC LIMIT 1")) == [(3, "Cid", "Z", 250)]
    assert rows(joined.execute("SELECT name FROM c LEFT JOIN o ON c.id = o.cid WHERE c.id IN (SELECT cid FROM o WHERE amount > 400) AND amount / 0 IS NULL ORDER BY amount")) == [("Ann",), ("Ann",)]


def test_declared_default_wins_in_outer_join(engine, tmp_path):
    put(tmp_path / "l", "a.csv", "1\n2\n")
    put(tmp_path / "r", "a.csv", "1,5,ok,\n")
    engine.execute(f"CREATE TABLE l (id INT) WITH (path='{tmp_path}/l'); CREATE TABLE r (lid INT, amt INT DEFAULT -7, note STRING DEFAULT 'missing', code INT) WITH (path='{tmp_path}/r')")
    want = [(1, 5, "ok", None), (2, -7, "missing", 0)]
    assert rows(engine.execute("SELECT l.id, amt, note, code FROM l LEFT JOIN r ON l.id = r.lid ORDER BY l.id")) == want
    assert rows(engine.execute("WITH x AS (SELECT id FROM l) SELECT x.id, amt, note, code FROM x LEFT JOIN r ON x.id = r.lid ORDER BY x.id")) == want
    assert rows(engine.execute("SELECT l.id, s.m FROM l LEFT JOIN (SELECT lid, MAX(amt) AS m FROM r GROUP BY lid) AS s ON l.id = s.lid ORDER BY l.id")) == [(1, 5), (2, 0)]


def test_second_join_sees_filled_values(engine):
    got = engine.execute("WITH a AS (SELECT 1 AS x UNION ALL SELECT 7), b AS (SELECT 1 AS y), z AS (SELECT 0 AS w, 'zero' AS nm) SELECT a.x, b.y, z.nm FROM a LEFT JOIN b ON a.x = b.y LEFT JOIN z ON b.y = z.w ORDER BY a.x")
    assert rows(got) == [(1, 1, ""), (7, 0, "zero")]


def test_keys_compare_by_type(engine):
    assert engine.execute("WITH a AS (SELECT 1 AS k), b AS (SELECT '001' AS k UNION ALL SELECT 'x') SELECT a.k FROM a JOIN b ON a.k = b.k").count() == 1
    assert engine.execute("WITH a AS (SELECT ' u ' AS k), b AS (SELECT 'u' AS k) SELECT a.k FROM a JOIN b ON a.k = b.k").count() == 1


def test_default_for_short_lines_only(engine, tmp_path):
    put(tmp_path, "a.csv", "1,x,3\n2,y\n3,,\n4\n")
    engine.execute(f"CREATE TABLE t (id INT, s STRING DEFAULT 'none', n INT DEFAULT 9) WITH (path='{tmp_path}')")
    assert rows(engine.execute("SELECT * FROM t ORDER BY id")) == [(1, "x", 3), (2, "y", 9), (3, None, None), (4, "none", 9)]


def test_csv_options(engine, tmp_path):
    put(tmp_path, "a.csv", "skip|this\nid|name|v\n1|A,B|1.5\n2| lead|x\n")
    engine.execute(f"CREATE TABLE t (id INT, name STRING, v DOUBLE) WITH (path='{tmp_path}', delimiter='|', skip_lines='2')")
    assert rows(engine.execute("SELECT * FROM t ORDER BY id")) == [(1, "A,B", 1.5), (2, "lead", None)]


def test_insert_values_and_append_with_header(engine, tmp_path):
    engine.execute(f"CREATE TABLE t (id INT, name STRING, code INT DEFAULT 7) WITH (path='{tmp_path}/t', file_name='x.csv', include_header='true', skip_lines='1')")
    engine.execute("INSERT OVERWRITE TABLE t VALUES (1, 'a', 2), (2, 'it''s; b', 3); INSERT INTO t VALUES (3, 'c')")
    assert rows(engine.execute("SELECT * FROM t ORDER BY id")) == [(1, "a", 2), (2, "it's; b", 3), (3, "c", 7)]
    assert open(tmp_path / "t" / "x.csv").read().splitlines()[0] == "id,name,code"
    engine.execute("INSERT OVERWRITE t SELECT id + 10, name, code FROM t WHERE id > 1")
    assert rows(engine.execute("SELECT id FROM t ORDER BY id")) == [(12,), (13,)]
    assert os.listdir(tmp_path / "t") == ["x.csv"]
    with pytest.raises(SqlError):
        engine.execute("INSERT INTO t VALUES (1, 'a', 2, 3)")
    with pytest.raises(SqlError):
        engine.execute("INSERT INTO t VALUES (1)")


def test_failed_insert_leaves_the_table(engine, tmp_path):
    engine.execute(f"CREATE TABLE t (id INT) WITH (path='{tmp_path}/t', file_name='x.csv'); INSERT OVERWRITE t VALUES (1)")
    with pytest.raises(Exception):
        engine.execute("INSERT OVERWRITE t SELECT nothing FROM t")
    assert rows(engine.execute("SELECT * FROM t")) == [(1,)]


@pytest.mark.parametrize("layout, folder", [("col=value", "dt=d1"), ("value", "d1")])
def test_partitions(engine, tmp_path, layout, folder):
    engine.execute(f"CREATE TABLE p (id INT, name STRING) WITH (path='{tmp_path}/p', file_name='y.csv', partition_format='{layout}') PARTITIONED BY (dt)")
    engine.execute("INSERT OVERWRITE p VALUES (1, 'a', 'd1'), (2, 'b', 'd2'), (3, 'c', 'd2')")
    assert os.path.exists(tmp_path / "p" / folder / "y.csv")
    engine.execute("INSERT OVERWRITE p SELECT 9, 'n', 'd1'; INSERT INTO p SELECT 10, 'm', 'd1'")
    assert rows(engine.execute("SELECT id, dt FROM p WHERE dt = 'd1' ORDER BY id")) == [(9, "d1"), (10, "d1")]
    assert rows(engine.execute("SELECT dt, COUNT(*) AS n FROM p WHERE dt >= 'd2' GROUP BY dt")) == [("d2", 2)]


def test_partition_values_stay_text(engine, tmp_path):
    put(tmp_path / "2026" / "03", "rows.csv", "1,5\n")
    put(tmp_path / "2026" / "11", "rows.csv", "2,6\n")
    engine.execute(f"CREATE TABLE t (id INT, v INT) WITH (path='{tmp_path}', file_pattern='rows.csv') PARTITIONED BY (year, month)")
    assert rows(engine.execute("SELECT id, month FROM t WHERE year = 2026 AND month >= '04'")) == [(2, "11")]


def test_json_xlsx_sqlite(engine, tmp_path):
    for kind, options in (("json", "format='json', file_name='a.json'"), ("xlsx", "format='xlsx', file_name='a.xlsx', include_header='true', sheet='S'"), ("db", f"storage='sqlite', location='{tmp_path}/a.db', table_name='u'")):
        path = "" if kind == "db" else f", path='{tmp_path}/{kind}'"
        engine.execute(f"CREATE TABLE {kind} (id INT, name STRING, v DOUBLE) WITH ({options}{path}); INSERT OVERWRITE {kind} VALUES (1, 'a<&\"', 1.5); INSERT INTO {kind} VALUES (2, 'b', NULL)")
        assert rows(engine.execute(f"SELECT * FROM {kind} ORDER BY id")) == [(1, 'a<&"', 1.5), (2, "b", None)], kind
        engine.execute(f"INSERT OVERWRITE {kind} SELECT * FROM {kind} WHERE id = 2")
        assert rows(engine.execute(f"SELECT id FROM {kind}")) == [(2,)], kind
    engine.execute(f"CREATE TABLE q (id INT) WITH (storage='sqlite', location='{tmp_path}/a.db', query='SELECT id FROM u WHERE id > 1')")
    assert rows(engine.execute("SELECT * FROM q")) == [(2,)]


def test_git_lfs_pointer(engine, tmp_path):
    from tidemill.sources.storages import GitLfs

    os.makedirs(tmp_path / ".git" / "lfs" / "objects")
    GitLfs({"path": str(tmp_path / "d")}).write(str(tmp_path / "d" / "a.csv"), b"1,x\n2,y\n")
    assert open(tmp_path / "d" / "a.csv").read().startswith("version https://git-lfs")
    engine.execute(f"CREATE TABLE t (id INT, s STRING) WITH (storage='gitlfs', path='{tmp_path}/d')")
    assert rows(engine.execute("SELECT * FROM t ORDER BY id")) == [(1, "x"), (2, "y")]


def test_windows(engine):
    src = "(SELECT 'p' AS name, 'A' AS city, 10 AS age UNION ALL SELECT 'q', 'B', 20 UNION ALL SELECT 'r', 'A', 30 UNION ALL SELECT 's', 'B', 40) AS t"
    assert rows(engine.execute(f"SELECT name, SUM(age) OVER w AS s FROM {src} WINDOW w AS (PARTITION BY city) ORDER BY name")) == [("p", 40), ("q", 60), ("r", 40), ("s", 60)]
    assert rows(engine.execute(f"SELECT name, ROW_NUMBER() OVER (w ORDER BY age DESC) AS r, RANK() OVER w2 AS k FROM {src} WINDOW w AS (PARTITION BY city), w2 AS (w ORDER BY age) ORDER BY name")) == [("p", 2, 1), ("q", 2, 1), ("r", 1, 2), ("s", 1, 2)]
    for bad in ("SELECT SUM(age) OVER nope AS s FROM {}", "SELECT SUM(age) OVER w AS s FROM {} WINDOW w AS (PARTITION BY city), w AS (ORDER BY age)", "SELECT SUM(age) OVER (v ORDER BY age) AS s FROM {} WINDOW w AS (PARTITION BY city)"):
        with pytest.raises(SqlError):
            engine.execute(bad.format(src))


def test_alias_within_over(engine):
    assert rows(engine.execute("SELECT g, SUM(x) AS tot, RANK() OVER (ORDER BY tot DESC) AS r FROM (VALUES (1,2),(2,5),(1,1)) AS t(g,x) GROUP BY g ORDER BY g")) == [(1, 3, 2), (2, 5, 1)]


def test_lateral_views(engine):
    assert rows(engine.execute("SELECT id, v FROM (VALUES (1,'a, b'),(2,'')) AS t(id,m) LATERAL VIEW EXPLODE(m) x AS v")) == [(1, "a"), (1, "b")]
    assert rows(engine.execute("SELECT id, v FROM (VALUES (1,'a'),(2,'')) AS t(id,m) LATERAL VIEW OUTER EXPLODE(m) x AS v ORDER BY id")) == [(1, "a"), (2, None)]
    assert rows(engine.execute("SELECT k, v FROM (VALUES (1,'a,1,b,2,c')) AS t(id,m) LATERAL VIEW EXPLODE(m) x AS k, v")) == [("a", "1"), ("b", "2")]
    assert rows(engine.execute("SELECT p, v, w FROM (VALUES (1,'a,b','c')) AS t(id,m,n) LATERAL VIEW POSEXPLODE(m) x AS p, v LATERAL VIEW EXPLODE(n) y AS w")) == [(0, "a", "c"), (1, "b", "c")]


def test_names_of_calls_without_alias(engine):
    assert engine.execute("SELECT SUM(x), COUNT(*), x AS y, RANK() OVER (ORDER BY x) FROM (SELECT 1 AS x) AS t GROUP BY x").columns == ["SUM(x)", "COUNT(*)", "y", "RANK() OVER (ORDER BY x)"]


def test_option_values_over_lines(engine, tmp_path):
    engine.execute(f"CREATE TABLE t (id INT) WITH (path=`{tmp_path}`, note=`a\n-- b;\nc`, n=5)")
    assert engine.catalog.get("t").options["note"] == "a\n-- b;\nc" and engine.catalog.get("t").options["n"] == "5"


def test_aggregates_of_few_rows(engine):
    assert rows(engine.execute("SELECT STDDEV_SAMP(x) AS a, VAR_SAMP(x) AS b, STDDEV(x) AS c, COVAR_SAMP(x, x) AS d, CORR(x, x) AS e, COLLECT_SET(x) AS f, HISTOGRAM_NUMERIC(x, 3) AS g FROM (VALUES (4)) AS t(x)")) == [(0.0, 0.0, 0.0, 0.0, 0.0, "[4]", "[[4,1]]")]
    assert rows(engine.execute("SELECT SUM(x) AS s, AVG(x) AS a, COUNT(*) AS n FROM (VALUES (1)) AS t(x) WHERE x > 1")) == [(0, 0.0, 0)]


def test_scripts_templates_explain(engine):
    assert split_script("SELECT ';' -- a; b\n; /* ; */ SELECT \"x;y\"") == ["SELECT ';'", 'SELECT "x;y"']
    assert rows(engine.execute_template("{% for r in rows %}SELECT {{ r.id }} AS id, '{{ r.n|upper }}' AS n;{% endfor %}", {"rows": [{"id": 1, "n": "a"}, {"id": 2, "n": "b"}]})) == [(2, "B")]
    assert "Physical Plan" in engine.execute("EXPLAIN SELECT 1 AS x").first().plan
    for bad in ("DROP TABLE x", "SELECT (1", "CREATE TABLE t", "INSERT INTO nowhere VALUES (1)"):
        with pytest.raises(ValueError):
            engine.execute(bad)


def test_missing_files_and_duplicate_tables(engine, tmp_path):
    engine.execute(f"CREATE EXTERNAL TABLE t (id INT) WITH (location='{tmp_path}/none')")
    with pytest.raises(FileNotFoundError):
        engine.execute("SELECT * FROM t")
    with pytest.raises(ValueError):
        engine.execute("CREATE TABLE T (id INT) WITH (path='x')")


def test_not_in_with_nulls(spark):
    e = Engine(spark)
    e.register("a", spark.sql("SELECT * FROM VALUES (1), (2), (NULL) AS t(k)"))
    for rows, kept, shown in (("(1), (1)", [2], [False, True, None]), ("(1), (NULL)", [], [False, None, None]), ("(NULL)", [], [None, None, None])):
        e.register("b", spark.sql(f"SELECT cast(v AS bigint) AS v FROM VALUES {rows} AS t(v)"))
        assert [r.k for r in e.execute("SELECT k FROM a WHERE k NOT IN (SELECT v FROM b)").collect()] == kept
        assert [r.x for r in e.execute("SELECT k, k NOT IN (SELECT v FROM b) AS x FROM a ORDER BY k IS NULL, k").collect()] == shown
        assert e.execute("SELECT k FROM a WHERE k NOT IN (SELECT v FROM b WHERE v > 9)").count() == 3
