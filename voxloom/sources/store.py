"""File-system calls of the driver on any store that Spark knows, and the journal of a commit.

A commit is a list of renames. It is written down before the first of them, and it is a success once the list itself has been renamed
from ``.pending`` to ``.done``, in one step. Until then readers leave out all that it lists, so a driver that dies between two
renames leaves nothing visible; :func:`recover` carries out the rest of the list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

COMMITS = "_commits"
PENDING, DONE = ".pending", ".done"
CALLS = 16  # renames at a time


class Store:
    """The file system of one path."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def glob(self, pattern: str) -> list[str]:
        return sorted(s.getPath().toString() for s in self._fs.globStatus(self._path(pattern)) or [])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def qualified(self, path: str) -> str:
        return self._fs.makeQualified(self._path(path)).toString()

    def make_folder(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} was not renamed to {new}")

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()


def commit(store: Store, folder: str, moves: Sequence[tuple[str, str]], note: dict | None = None) -> None:
    """Carry out ``moves`` (from, to) below ``folder``; both are paths relative to it. What stands at a target is replaced."""
    name = f"{folder}/{COMMITS}/{uuid.uuid4().hex}"
    store.make_folder(f"{folder}/{COMMITS}")
    store.write(f"{name}.writing", json.dumps({"moves": [list(m) for m in moves], "note": note or {}}))
    store.rename(f"{name}.writing", f"{name}{PENDING}")
    _carry_out(store, folder, name)


def _carry_out(store: Store, folder: str, name: str) -> None:
    moves = json.loads(store.read(f"{name}{PENDING}"))["moves"]
    there = set()  # one listing for each folder instead of questions about each file
    for parent in sorted({new.rpartition("/")[0] for _, new in moves}):
        store.make_folder(f"{folder}/{parent}")
        there |= {f"{parent}/{n}" if parent else n for n in store.names(f"{folder}/{parent}")}

    def move(pair: list[str]) -> None:
        old, new = (f"{folder}/{p}" for p in pair)
        if pair[1] in there:
            if not store.exists(old):  # an earlier attempt has moved it
                return
            store.delete(new)
        try:
            store.rename(old, new)
        except Exception as failure:
            if not store.exists(old):
                raise FileNotFoundError(f"neither {old} nor {new} is there") from failure
            raise

    with ThreadPoolExecutor(CALLS) as pool:
        list(pool.map(move, moves))
    store.rename(f"{name}{PENDING}", f"{name}{DONE}")


def pending(store: Store, folder: str) -> list[str]:
    """Commits that have begun and not ended."""
    return [f"{folder}/{COMMITS}/{n.removesuffix(PENDING)}" for n in store.names(f"{folder}/{COMMITS}") if n.endswith(PENDING)]


def hidden(store: Store, folder: str) -> set[str]:
    """Paths, relative to ``folder``, that no reader should see yet."""
    return {new for name in pending(store, folder) for _, new in json.loads(store.read(f"{name}{PENDING}"))["moves"]}


def recover(spark: SparkSession, folder: str) -> int:
    """Finish the commits that a driver left half done, and return their number. No other writer may be at work there."""
    store = Store(spark, folder)
    left = pending(store, folder)
    for name in left:
        _carry_out(store, folder, name)
    return len(left)
