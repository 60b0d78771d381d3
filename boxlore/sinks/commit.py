"""Publication by one rename that never replaces: what is staged takes a name that nothing has, or it does not.

The store's rename must be atomic, as that of HDFS, of network file systems and of a local disk is.
"""

from __future__ import annotations

import errno
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

#: Digits of an entry's number, which is the name of its folder.
DIGITS = 12


def _jvm_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on this machine if it is one of the local file system, by its own scheme or by the default one."""
    at, files = _jvm_path(spark, path)
    whole = urlparse(files.makeQualified(at).toString())
    return unquote(whole.path) if whole.scheme == "file" else None


def claim(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename a folder that is not empty; False, and nothing happens, if the target is there already."""
    here, there = local_path(spark, staged), local_path(spark, target)
    if here is not None and there is not None:
        try:
            os.rename(here, there)
        except OSError as e:
            if e.errno in (errno.ENOTEMPTY, errno.EEXIST, errno.ENOTDIR):
                return False
            raise
        return True
    jvm = spark._jvm
    source, _ = _jvm_path(spark, staged)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(source, _jvm_path(spark, target)[0], none)
    except Exception as e:  # the driver's gateway wraps what the store raises
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def last_entry(spark: SparkSession, folder: str) -> int:
    """The number of a folder's last entry, 0 if there is none. Entries are numbered without gaps, so it is found by halving."""
    here = local_path(spark, folder)
    _, files = _jvm_path(spark, folder)
    there = lambda n: os.path.exists(entry(here, n)) if here is not None else files.exists(_jvm_path(spark, entry(folder, n))[0])
    low, high = 0, 1
    while there(high):
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if there(middle) else (low, middle)
    return low


def entry(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/{number:0{DIGITS}d}"


def staging(folder: str) -> str:
    """A new hidden place in the folder, which readers pass by."""
    return f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"


def add_entry(spark: SparkSession, folder: str, staged: str) -> int:
    """Give what is staged the number after the last entry; of writers at the same time each gets its own."""
    number = last_entry(spark, folder) + 1
    while not claim(spark, staged, entry(folder, number)):
        number += 1
    return number


def discard(spark: SparkSession, staged: str) -> None:
    at, files = _jvm_path(spark, staged)
    files.delete(at, True)


def publish(spark: SparkSession, roots: list[str], write: Callable[[str], None], again: bool = False) -> list[str]:
    """What ``write`` leaves below the folder that it is given becomes the next entry of each root: the entries' paths.

    A root's entry is there as a whole or not at all, and ``published`` gives the last one, so no reader sees a part. Unless
    ``again``, no root may have an entry yet: all are looked at before anything is written, all are written before the first is
    published, and of two writers at the same time one raises. What fails leaves nothing of what was not published; roots take
    their entries in the order given, the first being the one that counts and the others copies.
    """
    if len({str(_jvm_path(spark, r)[0]) for r in roots}) != len(roots):
        raise ValueError("two outputs have one destination")
    there = [] if again else [r for r in roots if last_entry(spark, r)]
    if there:
        raise FileExistsError(f"there already: {there}")
    staged = {r: staging(r) for r in roots}
    done: list[str] = []
    try:
        for place in staged.values():
            write(place)
        for root, place in staged.items():
            if again:
                done.append(entry(root, add_entry(spark, root, place)))
            elif claim(spark, place, entry(root, 1)):
                done.append(entry(root, 1))
            else:
                raise FileExistsError(f"there already: {[root]}")
    except BaseException:
        for place in staged.values():
            discard(spark, place)
        raise
    return done


def published(spark: SparkSession, root: str) -> str:
    """The path of what was published last under a root; nothing raises."""
    number = last_entry(spark, root)
    if not number:
        raise FileNotFoundError(f"nothing is published in {root}")
    return entry(root, number)
