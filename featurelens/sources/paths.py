"""Paths that driver and executors read alike, and the file systems behind them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

#: Hadoop's scheme names where the file-system library uses another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasbs": "abfss", "wasb": "abfss", "dbfs": "file"}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark itself would use for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a qualified URI."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"qualify the path on the driver first: {uri!r}")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.strip("/")
    if scheme == "dbfs":  # mounted under this folder on every node
        return pafs.LocalFileSystem(), "/dbfs/" + rest.strip("/")
    system, path = pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return system, path.rstrip("/")


def entries(system: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names right below ``folder`` with their lengths, None for a folder. Links are followed.

    Entries of a local folder come as they are read, so its size takes no memory.
    """
    if not isinstance(system, pafs.LocalFileSystem):
        for info in system.get_file_info(pafs.FileSelector(folder)):
            yield info.base_name, None if info.type == pafs.FileType.Directory else info.size or 0
        return
    with os.scandir(folder) as found:
        for entry in found:
            try:
                yield entry.name, None if entry.is_dir() else entry.stat().st_size
            except FileNotFoundError:  # a link to nothing, or a file that has just gone
                continue


def passed_over(name: str, folder: bool) -> bool:
    """Whether Spark's file sources ignore a file or folder of this name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


#: What a URI's path cannot hold as it stands; other letters beyond ASCII stay.
_UNSAFE = re.compile("[^-A-Za-z0-9_!.~'()*:@&=+$,;/\u00a1-\U0010ffff]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def encoded(path: str) -> str:
    """``path`` as it stands in the URI that Hadoop makes of it."""
    return _UNSAFE.sub(lambda found: quote(found[0]), path)
