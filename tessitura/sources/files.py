"""Small files that several processes agree on: created by one only, or replaced whole."""

from __future__ import annotations

import os
import urllib.parse
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    """The path in the operating system, if it names a local file."""
    url = urllib.parse.urlsplit(path)
    return urllib.parse.unquote(url.path) if url.scheme == "file" else path if not url.scheme and path.startswith("/") else None


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    p, fs = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def modified(spark: SparkSession, path: str) -> float | None:
    """Seconds since the epoch; None if there is no such file (any more)."""
    p, fs = _hadoop(spark, path)
    try:
        return fs.getFileStatus(p).getModificationTime() / 1000
    except Py4JJavaError as e:
        if "FileNotFoundException" in str(e.java_exception):
            return None
        raise


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, None if there is none."""
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    f = fs.open(p)
    try:
        return bytes(f.readAllBytes()).decode()
    finally:
        f.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _hadoop(spark, path)
    f = fs.create(p, True)
    try:
        f.write(bytearray(text.encode()))
    finally:
        f.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with its whole text; False, with nothing changed, if there is one. Of any number at once, one succeeds.

    Local files are linked to their name, others renamed to it without overwriting, which HDFS does atomically.
    """
    folder, name = path.rsplit("/", 1)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if (own := _local(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(_local(part), "x") as f:
            f.write(text)
        try:
            os.link(_local(part), own)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(_local(part))
    _write(spark, part, text)
    to, _ = _hadoop(spark, path)
    return _rename(spark, part, to, overwrite=False)


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Give the file this text in one step: a reader sees the old text or the new."""
    folder, name = path.rsplit("/", 1)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if (own := _local(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(_local(part), "x") as f:
            f.write(text)
        os.replace(_local(part), own)
        return
    _write(spark, part, text)
    to, _ = _hadoop(spark, path)
    _rename(spark, part, to, overwrite=True)


def _rename(spark: SparkSession, part: str, to, *, overwrite: bool) -> bool:
    jvm = spark._jvm
    options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), "OVERWRITE" if overwrite else "NONE")
    at, _ = _hadoop(spark, part)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(at, to, options)
        return True
    except Exception as e:
        delete(spark, part)
        if not overwrite and "FileAlreadyExists" in str(e):
            return False
        raise
