"""Templates, URLs, command line, DataFrame operators, stores."""

import http.server
import threading

import pytest

from tidemill import operators as ops
from tidemill.catalog import with_url
from tidemill.cli import main, params_of
from tidemill.sources.storages import WebDav
from tidemill.template import TemplateError, render


def test_template_features():
    assert render("{{ a.b }} {{ x|default('id') }} {{ u }} {{ u|safe }} {{ ids|join:\",\" }} {{ n|upper }}{{ ids|length }}", {"a": {"b": 3}, "u": "a','b", "ids": [1, 2], "n": "q"}) == "3 id a&#39;,&#39;b a','b 1,2 Q2"
    assert render("{% if a and b > 2 %}y{% elif c %}z{% else %}n{% endif %}", {"a": 1, "b": 3}) == "y"
    assert render("{% for k, v in m %}{{ k }}={{ v }};{% endfor %}{# gone #}{% for x in none %}q{% endfor %}", {"m": {"a": 1, "b": 2}}) == "a=1;b=2;"
    for bad in ("{% if x %}", "{% for x in y %}", "{{ x|nope }}", "{% endif %}", "{% wat %}"):
        with pytest.raises(TemplateError):
            render(bad, {"x": 1, "y": [1]})


def test_urls():
    assert with_url({"url": "ftp://u:p%40@h:2121/d", "username": "me"}) == {"url": "ftp://u:p%40@h:2121/d", "storage": "ftp", "path": "/d", "host": "h", "port": "2121", "username": "me", "password": "p@"}
    assert with_url({"url": "s3://b/x/y"})["bucket"] == "b"
    s3 = with_url({"url": "s3://s3.example.com/b/x?access_key=k&secret_key=s"})
    assert (s3["endpoint"], s3["bucket"], s3["path"], s3["access_key"], s3["access_secret"]) == ("https://s3.example.com", "b", "x", "k", "s")
    my = with_url({"url": "mysql://r:s@db/x", "table_name": "t"})
    assert (my["storage"], my["database"], my["port"]) == ("mysql", "x", "3306")
    assert with_url({"url": "sqlite:///tmp/a.db"})["path"] == "/tmp/a.db"
    assert with_url({"url": "git:///repo/x"})["storage"] == "gitlfs"
    assert with_url({"location": "/d"})["path"] == "/d"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "t.sql").write_text("SELECT '{{ c }}' AS c, {{ n }} AS n")
    (tmp_path / "s.sql").write_text("SELECT 2 AS b, 1 AS a")
    assert main(["-t", str(tmp_path / "t.sql"), "-s", str(tmp_path / "s.sql"), "-e", "SELECT 1 AS x LIMIT 0", "-a", "c=q", "-a", "n=5"], spark) == 0
    assert capsys.readouterr().out == "c, n\nq, 5\na, b\n1, 2\nNo rows returned\n"
    assert main(["-e", "DROP x"], spark) == 1
    assert main(["desc"]) == 0 and "HISTOGRAM_NUMERIC" in capsys.readouterr().out
    assert params_of(["u=a", "u=b", "j=[1,2]"]) == {"u": "a','b", "j": [1, 2]}


def test_join_operator(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, n string")
    b = spark.createDataFrame([(1, None, True), (3, 7, False)], "id int, v int, f boolean")
    got = {how: sorted((tuple(r) for r in ops.join_with_defaults(a, b, "id", "id", how).collect()), key=str) for how in ("left", "right", "full", "inner")}
    assert got["left"] == [(1, "x", 1, None, True), (2, "y", 0, 0, False)]
    assert got["right"] == [(0, "", 3, 7, False), (1, "x", 1, None, True)]
    assert len(got["full"]) == 3 and len(got["inner"]) == 1
    assert ops.join_with_defaults(a, b, "id", "id", "left_anti").count() == 1
    assert ops.join_with_defaults(a, b, "id", "id", "left", {"v": "-5"}).where("v = -5").count() == 1


def test_explode_and_histogram(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, "")], "id int, m string")
    assert [r.v for r in ops.explode_text(df, "m", "v").collect()] == ["a", "b"]
    assert ops.explode_text(df, "m", "v", outer=True, position="p").count() == 3
    assert [(r.k, r.v) for r in ops.explode_map_text(spark.createDataFrame([("a,1,b",)], "m string"), "m", "k", "v").collect()] == [("a", "1")]
    h = ops.histogram(spark.range(11).selectExpr("cast(id as double) x"), "x", 5).orderBy("bucket").collect()
    assert [r.n for r in h] == [2, 2, 2, 2, 3] and h[0].low == 0 and h[-1].high == 10
    assert ops.histogram(spark.createDataFrame([(None,)], "x double"), "x", 3).count() == 0


def test_webdav_store():
    class Handler(http.server.BaseHTTPRequestHandler):
        files = {"/d/a.csv": b"1,x\n"}

        def log_message(self, *a):
            pass

        def do_PROPFIND(self):
            body = b'<?xml version="1.0"?><D:multistatus xmlns:D="DAV:"><D:response><D:href>/d/</D:href><D:propstat><D:prop><D:resourcetype><D:collection/></D:resourcetype></D:prop></D:propstat></D:response>' + b"".join(f"<D:response><D:href>{p}</D:href><D:propstat><D:prop><D:resourcetype/></D:prop></D:propstat></D:response>".encode() for p in self.files) + b"</D:multistatus>"
            self.send_response(207)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.files[self.path])

        def do_PUT(self):
            self.files[self.path] = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(201)
            self.end_headers()

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        s = WebDav({"base": f"http://127.0.0.1:{server.server_port}", "path": "/d"})
        s.write("/d/b.csv", b"2,y\n")
        assert s.find("*.csv") == ["/d/a.csv", "/d/b.csv"] and s.read("/d/b.csv") == b"2,y\n"
    finally:
        server.shutdown()


def test_stream_of_a_declared_table(spark, tmp_path):
    from tidemill import Engine
    from tidemill.streaming import read_stream

    e = Engine(spark)
    e.execute(f"CREATE TABLE t (id INT, s STRING) WITH (path='{tmp_path}/in', file_name='a.csv'); INSERT OVERWRITE t VALUES (1, 'x'), (2, 'y')")
    q = read_stream(spark, e.catalog.get("t")).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2
