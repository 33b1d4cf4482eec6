"""Results as an archive: a driver-side utility over the shared file system, one part of a file at a time."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

BYTES = 1 << 20


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, sorted((s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())


def contents(spark: SparkSession, folder: str) -> Iterator[bytes]:
    """The bytes of a folder of text parts as one file, with one header."""
    fs, parts = _files(spark, folder)
    for number, part in enumerate(parts):
        stream, header, rest = fs.open(part), number > 0, b""
        try:
            while data := bytes(stream.readNBytes(BYTES)):
                rest += data
                if header and b"\n" in rest:
                    rest, header = rest.partition(b"\n")[2], False
                if not header:
                    yield rest
                    rest = b""
        finally:
            stream.close()


def archive(spark: SparkSession, path: str, files: dict[str, str]) -> str:
    """A ZIP archive at path of files by name, each the folder that holds its parts."""
    with tempfile.NamedTemporaryFile(suffix=".zip") as own:  # on the driver, which alone writes and reads it
        with zipfile.ZipFile(own, "w", zipfile.ZIP_DEFLATED) as out:
            for name, folder in files.items():
                with out.open(name, "w") as f:
                    for data in contents(spark, folder):
                        f.write(data)
        own.flush()
        own.seek(0)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{own.name}"), target)
    return path


def listing(path: str) -> list[tuple[str, int]]:
    """Names and sizes in an archive on the driver."""
    with zipfile.ZipFile(path) as z:
        return [(i.filename, i.file_size) for i in z.infolist()]


def sha256(path: str) -> str:
    """Hex digest of a file on the driver."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
