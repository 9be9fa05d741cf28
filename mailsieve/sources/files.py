"""Steps on the file system that holds the tables: look, move, remove, small notes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

_MOVERS = 16


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what lies in a folder; none if there is no such folder."""
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all in it; nothing if it is not there."""
    fs, place = _at(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename to a path that must be free, creating its folder."""
    fs, place = _at(spark, target)
    fs.mkdirs(place.getParent())
    if fs.exists(place) or not fs.rename(_at(spark, source)[1], place):
        raise FileExistsError(f"cannot move {source} to {target}")


def side_by_side(step: Callable[[str], None], paths: Sequence[str]) -> None:
    """A step for each of many files. Steps wait for the name node or store, so a few threads keep them under way."""
    with ThreadPoolExecutor(_MOVERS) as pool:
        list(pool.map(step, paths))


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or absent: it is written under another name and moved."""
    fs, place = _at(spark, f"{path}.tmp")
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    remove(spark, path)
    move(spark, f"{path}.tmp", path)


def read_note(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
