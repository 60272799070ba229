"""Looking into folders of the shared file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def make(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.mkdirs(target)


def publish(spark: SparkSession, staged: str, path: str) -> bool:
    """Move a finished folder to its place in one step; False where another attempt has done so before.

    Readers see all files of the folder or none, as a rename is a single step of the file system.
    """
    target, system = _path(spark, path)
    if system.exists(target):
        return False
    system.mkdirs(target.getParent())
    if not system.rename(_path(spark, staged)[0], target):
        raise OSError(f"cannot move {staged} to {path}")
    return True


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the entries `<prefix>=<n>` below `path`, in one call to the file system."""
    target, system = _path(spark, path)
    if not system.exists(target):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(target)]
    return sorted(int(name.split("=", 1)[1]) for name in names if name.startswith(f"{prefix}="))


def read_text(spark: SparkSession, path: str) -> str:
    target, system = _path(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears as a whole or not at all; one that is there is left as it is."""
    staged = f"{path.rsplit('/', 1)[0]}/_staged-{uuid.uuid4().hex}"
    target, system = _path(spark, staged)
    stream = system.create(target)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    publish(spark, staged, path)


def remove(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.delete(target, True)


def committed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the finished writes below `path`, each in a folder `<prefix>=<n>`."""
    target, system = _path(spark, path)
    if not system.exists(target):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(target) if entry.isDirectory()]
    numbers = [int(name.split("=", 1)[1]) for name in names if name.startswith(f"{prefix}=")]
    return sorted(n for n in numbers if exists(spark, f"{path}/{prefix}={n}/_SUCCESS"))
