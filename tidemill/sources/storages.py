"""Where files lie: local folders, Git LFS, FTP, SFTP, WebDAV and a drive over HTTP, behind one small interface.

Cluster file systems (hdfs, s3a) and local folders are read by Spark itself; this
interface is for stores that Spark has no connector for. Files are the unit of
parallelism there: a task opens its own connection and reads one file.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import os
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from xml.etree import ElementTree


class Storage:
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.base = options.get("path", "") or "."

    def list(self, folder: str) -> list[tuple[str, bool]]:
        """(path, is a folder) of the entries."""
        raise NotImplementedError

    def read(self, path: str) -> bytes:
        raise NotImplementedError

    def write(self, path: str, data: bytes) -> None:
        raise NotImplementedError

    def join(self, *parts: str) -> str:
        return "/".join(p.strip("/") if k else p.rstrip("/") for k, p in enumerate(parts) if p)

    def find(self, pattern: str, depth: int = 0) -> list[str]:
        """Files of the base folder, `depth` folders below it, by name pattern, sorted."""
        folders = [self.base]
        for _ in range(depth):
            folders = [p for f in folders for p, is_folder in self.list(f) if is_folder]
        return sorted(p for f in folders for p, is_folder in self.list(f) if not is_folder and fnmatch.fnmatch(p.rsplit("/", 1)[-1], pattern))


class Local(Storage):
    def list(self, folder: str) -> list[tuple[str, bool]]:
        return [(e.path, e.is_dir()) for e in os.scandir(folder)] if os.path.isdir(folder) else []

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(f"{path}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{path}.tmp", path)


class GitLfs(Local):
    """A checkout whose large files are pointers to .git/lfs/objects."""

    _SPEC = "https://git-lfs.github.com" + "/spec/v1"
    _POINTER = re.compile(b"^version " + re.escape(_SPEC.encode()) + rb"\s.*?oid sha256:([0-9a-f]{64})\s+size (\d+)", re.S)

    def _objects(self, path: str) -> str:
        at = os.path.abspath(path if os.path.isdir(path) else os.path.dirname(path))
        while not os.path.isdir(os.path.join(at, ".git")) and os.path.dirname(at) != at:
            at = os.path.dirname(at)
        return os.path.join(at, ".git", "lfs", "objects")

    def _object(self, path: str, oid: str) -> str:
        """objects/aa/bb/oid, or objects/aa/rest as older stores have it."""
        root = self._objects(path)
        new = os.path.join(root, oid[:2], oid[2:4], oid)
        return new if os.path.exists(new) else os.path.join(root, oid[:2], oid[2:])

    def resolve(self, path: str) -> str:
        """The file that holds the data of path."""
        with open(path, "rb") as f:
            m = self._POINTER.match(f.read(1024))
        return self._object(path, m.group(1).decode()) if m else path

    def read(self, path: str) -> bytes:
        return super().read(self.resolve(path))

    def write(self, path: str, data: bytes) -> None:
        oid = hashlib.sha256(data).hexdigest()
        super().write(os.path.join(self._objects(path), oid[:2], oid[2:]), data)
        super().write(path, "\n".join([f"version {self._SPEC}", f"oid sha256:{oid}", f"size {len(data)}", ""]).encode())


class Ftp(Storage):
    def _connect(self):
        import ftplib

        o = self.options
        ftp = ftplib.FTP(timeout=60)
        ftp.connect(o.get("host", ""), int(o.get("port", 21)))
        ftp.login(o.get("username", "anonymous"), o.get("password", ""))
        return ftp

    def list(self, folder: str) -> list[tuple[str, bool]]:
        with self._connect() as ftp:
            try:
                return [(self.join(folder, n), f.get("type") == "dir") for n, f in ftp.mlsd(folder, ["type"]) if f.get("type") in ("dir", "file")]
            except Exception:  # servers without MLSD
                lines: list[str] = []
                ftp.dir(folder, lines.append)
                return [(self.join(folder, x.split(None, 8)[-1]), x.startswith("d")) for x in lines if x[:1] in "d-"]

    def read(self, path: str) -> bytes:
        out = io.BytesIO()
        with self._connect() as ftp:
            ftp.retrbinary(f"RETR {path}", out.write)
        return out.getvalue()

    def write(self, path: str, data: bytes) -> None:
        with self._connect() as ftp:
            ftp.storbinary(f"STOR {path}.tmp", io.BytesIO(data))
            ftp.rename(f"{path}.tmp", path)


class Sftp(Storage):
    """Needs paramiko."""

    def _connect(self):
        try:
            import paramiko
        except ImportError as e:
            raise RuntimeError("sftp needs the package paramiko") from e
        o = self.options
        client = paramiko.SSHClient()
        client.load_system_host_keys()
        client.connect(o.get("host", ""), int(o.get("port", 22)), o.get("username"), o.get("password"), key_filename=o.get("ssh_key") or o.get("key_file"))
        return client.open_sftp()

    def list(self, folder: str) -> list[tuple[str, bool]]:
        import stat

        with self._connect() as s:
            return [(self.join(folder, e.filename), stat.S_ISDIR(e.st_mode)) for e in s.listdir_attr(folder)]

    def read(self, path: str) -> bytes:
        with self._connect() as s, s.open(path, "rb") as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        with self._connect() as s:
            with s.open(f"{path}.tmp", "wb") as f:
                f.write(data)
            s.posix_rename(f"{path}.tmp", path)


class WebDav(Storage):
    def _call(self, method: str, path: str, data: bytes | None = None, headers: dict[str, str] | None = None) -> bytes:
        import base64

        o = self.options
        base = o.get("base") or o.get("url", "")
        request = urllib.request.Request(base.rstrip("/") + urllib.parse.quote("/" + path.lstrip("/")), data, headers or {}, method=method)
        if o.get("username"):
            request.add_header("Authorization", "Basic " + base64.b64encode(f"{o['username']}:{o.get('password', '')}".encode()).decode())
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.read()

    def list(self, folder: str) -> list[tuple[str, bool]]:
        root = ElementTree.fromstring(self._call("PROPFIND", folder.rstrip("/") + "/", headers={"Depth": "1"}))
        out = []
        for r in root.iter("{DAV:}response"):
            path = urllib.parse.unquote(urllib.parse.urlsplit(r.findtext("{DAV:}href") or "").path)
            if path.strip("/") != folder.strip("/"):
                out.append((path.rstrip("/"), r.find(".//{DAV:}collection") is not None))
        return out

    def read(self, path: str) -> bytes:
        return self._call("GET", path)

    def write(self, path: str, data: bytes) -> None:
        self._call("PUT", path, data)


class Lark(Storage):
    """A cloud drive over its HTTP interface: a token from app_id and app_secret, folders by token, files by name."""

    HOST, CHUNK = "https://open.feishu.cn/open-apis", 20 << 20

    def _call(self, method: str, path: str, body: dict | None = None, raw: bytes | None = None, kind: str = "application/json") -> bytes:
        headers = {"Content-Type": kind}
        if not path.startswith("/auth"):
            headers["Authorization"] = f"Bearer {self._token()}"
        data = raw if raw is not None else json.dumps(body).encode() if body is not None else None
        with urllib.request.urlopen(urllib.request.Request(self.options.get("base", self.HOST) + path, data, headers, method=method), timeout=60) as r:
            return r.read()

    def _token(self) -> str:
        if "_token" not in self.options:
            got = json.loads(self._call("POST", "/auth/v3/tenant_access_token/internal", {"app_id": self.options["app_id"], "app_secret": self.options["app_secret"]}))
            self.options = {**self.options, "_token": got["tenant_access_token"]}
        return self.options["_token"]

    def _entries(self, token: str) -> list[dict]:
        out, page = [], ""
        while True:
            got = json.loads(self._call("GET", f"/drive/v1/files?folder_token={token}&page_size=200{f'&page_token={page}' if page else ''}"))["data"]
            out += got.get("files", [])
            page = got.get("next_page_token", "")
            if not got.get("has_more"):
                return out

    def _folder(self, path: str) -> str:
        token = self.options.get("root_token", "")
        for part in [p for p in path.split("/") if p not in ("", ".")]:
            token = next((e["token"] for e in self._entries(token) if e["name"] == part and e["type"] == "folder"), None)
            if token is None:
                raise FileNotFoundError(path)
        return token

    def list(self, folder: str) -> list[tuple[str, bool]]:
        return [(self.join(folder, e["name"]), e["type"] == "folder") for e in self._entries(self._folder(folder))]

    def read(self, path: str) -> bytes:
        folder, _, name = path.rpartition("/")
        token = next((e["token"] for e in self._entries(self._folder(folder)) if e["name"] == name), None)
        if token is None:
            raise FileNotFoundError(path)
        return self._call("GET", f"/drive/v1/files/{token}/download")

    def write(self, path: str, data: bytes) -> None:
        folder, _, name = path.rpartition("/")
        node = self._folder(folder)
        if len(data) <= self.CHUNK:
            self._form("/drive/v1/files/upload_all", {"file_name": name, "parent_type": "explorer", "parent_node": node, "size": str(len(data))}, data)
            return
        job = json.loads(self._call("POST", "/drive/v1/files/upload_prepare", {"file_name": name, "parent_type": "explorer", "parent_node": node, "size": len(data)}))["data"]
        for k in range(job["block_num"]):
            part = data[k * job["block_size"] : (k + 1) * job["block_size"]]
            self._form("/drive/v1/files/upload_part", {"upload_id": job["upload_id"], "seq": str(k), "size": str(len(part))}, part)
        self._call("POST", "/drive/v1/files/upload_finish", {"upload_id": job["upload_id"], "block_num": job["block_num"]})

    def _form(self, path: str, fields: dict[str, str], data: bytes) -> None:
        mark = hashlib.sha1(data).hexdigest()
        body = b"".join(f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items())
        body += f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="file"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + data + f"\r\n--{mark}--\r\n".encode()
        self._call("POST", path, raw=body, kind=f"multipart/form-data; boundary={mark}")


STORAGES: dict[str, Callable[[dict[str, str]], Storage]] = {"local": Local, "gitlfs": GitLfs, "ftp": Ftp, "sftp": Sftp, "webdav": WebDav, "lark": Lark}


def register_storage(name: str, make: Callable[[dict[str, str]], Storage]) -> None:
    """Add a store, or take another one for a name. Workers import `make` by its module."""
    STORAGES[name.lower()] = make


def storage(options: dict[str, str]) -> Storage:
    kind = options.get("storage", "local").lower()
    if kind not in STORAGES:
        raise ValueError(f"unknown storage {kind}")
    return STORAGES[kind](options)


def fetch_text(place: str) -> str:
    """SQL or template text from a file or an http(s) URL."""
    if place.startswith(("http://", "https://")):
        with urllib.request.urlopen(place, timeout=60) as r:
            return r.read().decode()
    with open(place, encoding="utf-8") as f:
        return f.read()
