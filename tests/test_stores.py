"""Stores without a server at hand, against small stand-ins."""

import ftplib
import http.server
import json
import re
import threading

import pytest

from tidemill.sources import readers, sinks
from tidemill.sources.storages import Ftp, Lark, register_storage, storage
from tidemill import Engine
from tidemill.catalog import Table, with_url
from tidemill.plans.ddl import ColumnDef


class FakeFtp:
    """The part of ftplib.FTP that is used, over a dict."""

    files: dict = {}

    def __init__(self, timeout=None):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *a):
        pass

    def connect(self, host, port):
        assert (host, port) == ("h", 2121)

    def login(self, user, password):
        assert (user, password) == ("u", "p")

    def mlsd(self, folder, facts):
        inside = [k[len(folder) + 1 :] for k in self.files if k.startswith(folder + "/")]
        return [(n, {"type": "file"}) for n in inside if "/" not in n] + [(n, {"type": "dir"}) for n in {i.split("/")[0] for i in inside if "/" in i}]

    def retrbinary(self, command, take):
        take(self.files[command.split(" ", 1)[1]])

    def storbinary(self, command, data):
        self.files[command.split(" ", 1)[1]] = data.read()

    def rename(self, a, b):
        self.files[b] = self.files.pop(a)


def test_ftp_through_the_driver(monkeypatch):
    monkeypatch.setattr(ftplib, "FTP", FakeFtp)
    FakeFtp.files = {"/d/a.csv": b"1,x\n", "/d/b.txt": b"", "/d/k=1/c.csv": b"2,y\n"}
    s = Ftp(with_url({"url": "ftp://u:p@h:2121/d"}))
    assert s.find("*.csv") == ["/d/a.csv"] and s.find("*.csv", 1) == ["/d/k=1/c.csv"] and s.read("/d/a.csv") == b"1,x\n"


def test_insert_into_a_store(spark, monkeypatch):
    monkeypatch.setattr(ftplib, "FTP", FakeFtp)
    FakeFtp.files = {}
    e = Engine(spark)
    e.execute("CREATE TABLE t (id INT, s STRING) WITH (url='ftp://u:p@h:2121/d', file_name='o.csv', include_header='true'); INSERT OVERWRITE t VALUES (1, 'a,b'); INSERT INTO t VALUES (2, NULL)")
    assert FakeFtp.files == {"/d/o.csv": b'id,s\n1,"a,b"\n2,\n'}
    e.execute("CREATE TABLE p (id INT) WITH (url='ftp://u:p@h:2121/q', file_name='o.json', format='json') PARTITIONED BY (k); INSERT OVERWRITE p VALUES (1, 'x'), (2, 'y')")
    assert FakeFtp.files["/q/k=y/o.json"] == b'{"id": "2"}\n'


def test_http_drive():
    class Drive(http.server.BaseHTTPRequestHandler):
        tree = {"root": [("f", "folder", "T1")], "T1": [("a.csv", "file", "T2")]}
        data = {"T2": b"1,x\n"}

        def log_message(self, *a):
            pass

        def send(self, body: bytes):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            assert self.headers["Authorization"] == "Bearer tok"
            if m := re.match(r"/drive/v1/files/(\w+)/download", self.path):
                return self.send(self.data[m.group(1)])
            token = re.search(r"folder_token=(\w+)", self.path).group(1)
            self.send(json.dumps({"data": {"files": [{"name": n, "type": t, "token": k} for n, t, k in self.tree[token]], "has_more": False}}).encode())

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if "auth" in self.path:
                assert json.loads(body) == {"app_id": "i", "app_secret": "s"}
                return self.send(b'{"tenant_access_token": "tok"}')
            if "prepare" in self.path:
                return self.send(b'{"data": {"upload_id": "U", "block_num": 3, "block_size": 4}}')
            got = re.search(rb'filename="file"\r\nContent-Type: application/octet-stream\r\n\r\n(.*)\r\n--', body, re.S)
            self.data["up"] = self.data.get("up", b"") + (got.group(1) if got else b"")
            self.send(b"{}")

    server = http.server.HTTPServer(("127.0.0.1", 0), Drive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        s = Lark({"base": f"http://127.0.0.1:{server.server_port}", "app_id": "i", "app_secret": "s", "root_token": "root", "path": "f"})
        assert s.find("*.csv") == ["f/a.csv"] and s.read("f/a.csv") == b"1,x\n"
        s.write("f/b.csv", b"2,y\n")
        assert Drive.data["up"] == b"2,y\n"
        s.CHUNK, Drive.data["up"] = 5, b""
        s.write("f/c.csv", b"0123456789")
        assert Drive.data["up"] == b"0123456789"
        with pytest.raises(FileNotFoundError):
            s.read("f/none")
    finally:
        server.shutdown()


def test_options_for_databases_and_s3():
    t = Table("t", [ColumnDef("a", "INT")], with_url({"url": "postgres://u:p%23@db:5433/x?sslmode=disable", "table_name": "q"}))
    assert readers.jdbc_options(t) == {"url": "jdbc:postgresql://db:5433/x?sslmode=disable", "user": "u", "password": "p#"}
    s3 = Table("t", [], with_url({"url": "s3://b/p?endpoint=e&access_key=k&secret_key=s"}))
    assert readers.base_of(s3) == "s3a://b/p" and readers.hadoop_options(s3) == {"fs.s3a.endpoint": "e", "fs.s3a.access.key": "k", "fs.s3a.secret.key": "s"}
    assert sinks.file_name(t) == "result.csv"
    readers.register_database("other", "jdbc:other", "99")
    assert readers.jdbc_options(Table("t", [], {"storage": "other", "port": "99"}))["url"].startswith("jdbc:other://")


def test_registered_stores():
    class Mine(Ftp):
        pass

    register_storage("mine", Mine)
    assert isinstance(storage({"storage": "mine"}), Mine)
    with pytest.raises(ValueError):
        storage({"storage": "nowhere"})
