"""Files by Hadoop's file systems, so that a path may be on any store that Spark reads.

These run on the driver, for listings and small files such as manifests; rows go through Spark's
own readers and writers.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def _at(path: str | Path):
    """(file system, Hadoop path) of a path or URI."""
    spark = SparkSession.active()
    there = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def child(path: str | Path, name: str) -> str:
    return f"{str(path).rstrip('/')}/{name}"


def qualified(path: str | Path) -> str:
    """The path with its scheme and all its folders."""
    fs, there = _at(path)
    return fs.makeQualified(there).toString()


def exists(path: str | Path) -> bool:
    fs, there = _at(path)
    return fs.exists(there)


def is_file(path: str | Path) -> bool:
    fs, there = _at(path)
    return fs.exists(there) and fs.getFileStatus(there).isFile()


def is_folder(path: str | Path) -> bool:
    fs, there = _at(path)
    return fs.exists(there) and fs.getFileStatus(there).isDirectory()


def files(path: str | Path) -> list[tuple[str, int]]:
    """(path with its scheme, bytes) of a file, or of all files below a folder."""
    fs, there = _at(path)
    found, listing = [], fs.listFiles(there, True)
    while listing.hasNext():
        status = listing.next()
        found.append((status.getPath().toString(), status.getLen()))
    return found


def is_local(path: str | Path) -> bool:
    """Whether the path is on a mounted file system, which Python can open too."""
    return _at(path)[0].getUri().getScheme() == "file"


def mounted(path: str | Path) -> str:
    """The plain path of a local URI."""
    if not is_local(path):
        raise ValueError(f"{path} must be on a file system that all machines mount")
    return _at(path)[1].toUri().getPath()


def read_bytes(path: str | Path) -> bytes:
    fs, there = _at(path)
    stream = fs.open(there)
    try:
        return bytes(SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def sha256(path: str | Path) -> str:
    """Of one file of any size, streamed through the driver."""
    fs, there = _at(path)
    stream = fs.open(there, 1 << 24)
    try:
        return SparkSession.active()._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def publish(path: str | Path, data: bytes) -> None:
    """Create a small file at once, whole; FileExistsError if there is one."""
    fs, there = _at(path)
    if fs.exists(there):
        raise FileExistsError(f"{path} exists")
    jvm = SparkSession.active()._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{there}.{jvm.java.util.UUID.randomUUID()}")
    stream = fs.create(draft, False)
    stream.write(bytearray(data))
    stream.close()
    if fs.exists(there) or not fs.rename(draft, there):
        fs.delete(draft, False)
        raise FileExistsError(f"{path} exists")


def replace(path: str | Path, data: bytes) -> None:
    """Write a small file, over one that may be there."""
    fs, there = _at(path)
    stream = fs.create(there, True)
    stream.write(bytearray(data))
    stream.close()


def remove(path: str | Path) -> None:
    fs, there = _at(path)
    fs.delete(there, True)
