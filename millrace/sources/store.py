"""Addresses, stores and the files in them, over Spark's file systems."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, RequestError, StoreError
from .files import contents, listing, where

SCHEMES = {"file": "file", "s3": "s3a", "r2": "s3a", "gs": "gs"}


@dataclass(frozen=True)
class Address:
    scheme: str
    authority: str | None
    key: str


def parse_uri(uri: str) -> Address:
    """Scheme, bucket and key; a file address has no bucket."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        raise ConfigError(f"no scheme in {uri!r}")
    if scheme == "file":
        return Address(scheme, None, rest)
    bucket, _, key = rest.partition("/")
    return Address(scheme, bucket, key)


def uri_columns(uri: Column) -> list[Column]:
    """``parse_uri`` as columns scheme, authority and key; all are null where there is no scheme."""
    whole = uri.contains("://")
    scheme, rest = F.substring_index(uri, "://", 1), F.regexp_extract(uri, "^.*?://(.*)$", 1)
    file = scheme == "file"
    return [
        F.when(whole, scheme).alias("scheme"), F.when(whole & ~file, F.substring_index(rest, "/", 1)).alias("authority"),
        F.when(whole, F.when(file, rest).otherwise(F.regexp_extract(rest, "^[^/]*/?(.*)$", 1))).alias("key"),
    ]


def join_uri(root: str, key: str) -> str:
    """The full address of a key that is relative to the root."""
    return f"{root.rstrip('/')}/{key.lstrip('/')}" if key else root


def join_uri_column(root: Column, key: Column) -> Column:
    """``join_uri`` as a column."""
    return F.when(key == "", root).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(key, "^/+", "")))


def safe_key(key: str) -> str:
    """The key, refused if it could leave its root."""
    if ".." in key.split("/") or key.startswith("/"):
        raise StoreError(f"key leaves its root: {key!r}")
    return key


def settings(scheme: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """Hadoop settings of a scheme from the environment; an account overrides an endpoint."""
    env = dict(os.environ) if env is None else env
    out: dict[str, str] = {}
    if scheme in ("s3", "r2"):
        prefix = "R2" if scheme == "r2" else "AWS"
        for name, key in (("ACCESS_KEY_ID", "access.key"), ("SECRET_ACCESS_KEY", "secret.key")):
            if value := env.get(f"{prefix}_{name}"):
                out[f"fs.s3a.{key}"] = value
        if endpoint := env.get("R2_ENDPOINT" if scheme == "r2" else "AWS_ENDPOINT"):
            out["fs.s3a.endpoint"] = endpoint
        if scheme == "r2" and (account := env.get("R2_ACCOUNT_ID")):
            out["fs.s3a.endpoint"] = f"https://{account}.r2.cloudflarestorage.com"
    return out


class Store:
    """A root folder, in which files have keys. ``open_store`` makes one from an address."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root or "/").getFileSystem(spark._jsc.hadoopConfiguration())
        self._place = where(self.root or "/", {k: v for k in ("fs.s3a.access.key", "fs.s3a.secret.key", "fs.s3a.endpoint") if (v := spark._jsc.hadoopConfiguration().get(k))})

    def describe(self) -> str:
        return self.root

    def _at(self, key: str):
        if self._place.scheme == "file":
            root = os.path.realpath(self._place.path)
            if os.path.commonpath([root, os.path.realpath(os.path.join(root, safe_key(key)))]) != root:
                raise StoreError(f"key leaves its root: {key!r}")
        return self._path(join_uri(self.root, safe_key(key)))

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._at(key))

    def head(self, key: str) -> dict:
        """Key, size, etag (which file systems don't have) and last change in epoch seconds."""
        if not self.exists(key):
            raise StoreError(f"no such key: {key}")
        s = self._fs.getFileStatus(self._at(key))
        return {"key": key, "size": s.getLen(), "etag": None, "last_modified": s.getModificationTime() // 1000}

    def get(self, key: str) -> bytes:
        """The bytes of a file."""
        return self.get_range(key, 0, self.head(key)["size"])

    def get_range(self, key: str, offset: int, length: int) -> bytes:
        """The bytes of a range, which is cut at the end of the file; nothing else of it is read."""
        size = self.head(key)["size"]
        start, end = min(max(offset, 0), size), min(max(offset, 0) + max(length, 0), size)
        system, base = self._place.open()
        with system.open_input_file(f"{base.rstrip('/')}/{safe_key(key)}") as file:
            file.seek(start)
            return file.read(end - start)

    def get_fresh(self, key: str) -> tuple[bytes, dict]:
        """The bytes of a file with what ``head`` says of it, read past any cache; if it changes meanwhile, it is read again."""
        while True:
            before = self.head(key)
            raw = self.get(key)
            if self.head(key) == before:
                return raw, before
    def put(self, key: str, content: bytes) -> None:
        out = self._fs.create(self._at(key), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def delete(self, key: str) -> None:
        self.head(key)
        self._fs.delete(self._at(key), False)

    def list(self, prefix: str = "") -> DataFrame:
        """(key, size, etag, last_modified) of all files under a prefix, hidden and empty ones too, without reading them."""
        rows = listing(self.spark, self._place, safe_key(prefix))
        return rows.select("key", "size", F.lit(None).cast("string").alias("etag"), F.col("modified").alias("last_modified"))

    def corpus(self, prefix: str = "", pattern: str | None = None, max_bytes: int | None = None) -> DataFrame:
        """(uri, content) of all files under a prefix; uris are keys. Files that don't match the glob, or are larger, aren't read."""
        rows = self.list(prefix).select("key", "size")
        if pattern is not None:
            rows = glob(rows, "", pattern)
        if max_bytes is not None:
            rows = rows.where(F.col("size") <= max_bytes)
        return contents(rows.select("key"), self._place).select(F.col("key").alias("uri"), "content")


class CorpusCache:
    """Contents of a store that stay in the shared folder from call to call, checked on every use against a listing.

    Files whose size, etag and time are as before come from the table, which is read and kept as Spark does with any
    other; only new and changed ones are read from the store. Each refresh writes a new version, whose name is committed last.
    """

    def __init__(self, store: Store, folder: str):
        self.store, self.folder, self.spark = store, folder.rstrip("/"), store.spark
        self.fetched = 0

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [f.getPath() for f in system.listStatus(path)]
        done = [int(p.getName().removeprefix("v")) for p in names if p.getName().startswith("v") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(done)

    def corpus(self, prefix: str = "") -> DataFrame:
        """(uri, content) of the files under a prefix as they are now."""
        now, versions = self.store.list(prefix), self._versions()
        same = ["key", "size", "last_modified"]
        if versions:
            old = self.spark.read.parquet(f"{self.folder}/v{versions[-1]}")
            kept = old.join(now.select(*same), same, "left_semi")
            fresh = now.join(old.select(*same), same, "left_anti")
        else:
            kept, fresh = None, now
        self.fetched = fresh.count()
        if versions and not self.fetched and old.count() == now.count():
            return old.select(F.col("key").alias("uri"), "content")
        read_ = contents(fresh.select(*same), self.store._place)
        path = f"{self.folder}/v{versions[-1] + 1 if versions else 0}"
        (read_ if kept is None else kept.unionByName(read_)).write.parquet(path)
        return self.spark.read.parquet(path).select(F.col("key").alias("uri"), "content")


def open_store(spark: SparkSession, uri: str) -> tuple[Store, str]:
    """The store of an address and the prefix in it.

    A file address that names a file, or a missing name with a dot in an existing folder, has its folder
    as the root and its name as the prefix; any other one is the root itself, and is made where it is missing.
    """
    at = parse_uri(uri)
    if at.scheme not in SCHEMES:
        raise ConfigError(f"unknown scheme {at.scheme!r}")
    if at.scheme != "file":
        conf = spark._jsc.hadoopConfiguration()
        for key, value in settings(at.scheme).items():
            conf.set(key, value)
        return Store(spark, f"{SCHEMES[at.scheme]}://{at.authority}"), at.key
    path = os.path.abspath(at.key)
    parent, name = os.path.split(path)
    if os.path.isfile(path) or (not os.path.exists(path) and os.path.isdir(parent) and "." in name):
        return Store(spark, "file://" + parent), name
    os.makedirs(path, exist_ok=True)
    return Store(spark, "file://" + path), ""


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob, in which ``*`` and ``?`` cross slashes too."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if pattern[i : i + 3] == "**/":
                out, i = out + "(?:.*/)?", i + 3
                continue
            while pattern[i : i + 1] == "*":
                i += 1
            out += ".*"
            continue
        if c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in "\\.+*?()|[]{}^$" else c
        i += 1
    return f"^(?s:{out})$"


def glob(listing: DataFrame, prefix: str, pattern: str) -> DataFrame:
    """Rows whose key, relative to the prefix, matches a glob."""
    inside = prefix.rstrip("/") + "/" if prefix else ""
    relative = F.when(F.startswith("key", F.lit(inside)), F.substring(F.col("key"), len(inside) + 1, 1 << 30)).otherwise(F.col("key"))
    return listing.where(relative.rlike(glob_regex(pattern)))


def ls(listing: DataFrame, prefix: str = "", pattern: str | None = None, limit: int = 1000) -> DataFrame:
    """(key, size) in order of keys, at most ``limit``, but one even at a limit of 0."""
    rows = glob(listing, prefix, pattern) if pattern else listing
    return rows.select("key", "size").orderBy("key").limit(max(limit, 1))


def read(corpus: DataFrame, key: str, offset: int | None = None, length: int | None = None) -> DataFrame:
    """(uri, bytes, text) of one file or a range of it; ``bytes`` counts them, and ``text`` is null unless they are
    valid UTF-8. Offset and length come together or not at all."""
    if (offset is None) != (length is None):
        raise RequestError("offset and length come together")
    return ranges(corpus.where(F.col("uri") == key), offset, length)


def ranges(corpus: DataFrame, offset: int | None = None, length: int | None = None) -> DataFrame:
    """``read`` for every file of a corpus."""
    b = F.col("content").cast("binary")
    if offset is not None:
        b = F.substring(b, offset + 1, length)
    rows = corpus.select("uri", b.alias("b"))
    return rows.select("uri", F.octet_length("b").cast("long").alias("bytes"), F.when(F.is_valid_utf8(F.col("b").cast("string")), F.col("b").cast("string")).alias("text"))


def text_files(corpus: DataFrame, pattern: str = "**/*.md", max_file_bytes: int = 4 << 20) -> DataFrame:
    """Files to index: matched by the glob, not empty, not too large and valid UTF-8."""
    rows = corpus.where(F.col("uri").rlike(glob_regex(pattern)) & (F.octet_length("content") > 0) & (F.octet_length("content") <= max_file_bytes))
    return rows.where(F.is_valid_utf8(F.col("content").cast("string")))
