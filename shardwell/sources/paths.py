"""Paths of files in any store: local ones as pathlib has them, all others through Hadoop's file systems."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import NamedTuple

from pyspark.sql import SparkSession

SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+):/")


class Status(NamedTuple):
    st_size: int
    st_mtime_ns: int


@dataclass(frozen=True, order=True)
class StorePath:
    """A path by its URI, with the part of pathlib's interface that the engine uses. The active session's Hadoop
    configuration says how to reach it."""

    uri: str

    def __str__(self) -> str:
        return self.uri

    def __fspath__(self) -> str:
        return self.uri

    def __truediv__(self, more: str | os.PathLike) -> StorePath:
        return StorePath(f"{self.uri}/{os.fspath(more)}")

    @property
    def _pure(self) -> PurePosixPath:
        return PurePosixPath(self.uri)

    name = property(lambda self: self._pure.name)
    suffix = property(lambda self: self._pure.suffix)
    stem = property(lambda self: self._pure.stem)

    @property
    def parent(self) -> StorePath:
        return StorePath(self.uri.rpartition("/")[0])

    @property
    def parts(self) -> tuple[str, ...]:
        return tuple(self.uri.split("/"))

    def with_name(self, name: str) -> StorePath:
        return self.parent / name

    def expanduser(self) -> StorePath:
        return self

    def resolve(self) -> StorePath:
        return self

    def is_relative_to(self, other: object) -> bool:
        return self.uri == str(other) or self.uri.startswith(f"{other}/")

    def relative_to(self, other: object) -> PurePosixPath:
        if not self.is_relative_to(other):
            raise ValueError(f"{self} is not below {other}")
        return PurePosixPath(self.uri[len(str(other)) + 1 :])

    def samefile(self, other: object) -> bool:
        return str(self) == str(other)

    def _at(self) -> tuple:
        context = SparkSession.active().sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.uri)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._at()
        return bool(fs.exists(path))

    def is_file(self) -> bool:
        fs, path = self._at()
        return bool(fs.exists(path)) and bool(fs.getFileStatus(path).isFile())

    def is_dir(self) -> bool:
        fs, path = self._at()
        return bool(fs.exists(path)) and bool(fs.getFileStatus(path).isDirectory())

    def stat(self) -> Status:
        fs, path = self._at()
        found = fs.getFileStatus(path)
        return Status(found.getLen(), found.getModificationTime() * 1_000_000)

    def _of(self, found) -> StorePath:
        """A status's path, written as this one is."""
        return StorePath(self.uri + found.getPath().toUri().getPath()[len(self._at()[1].toUri().getPath()) :])

    def iterdir(self) -> Iterator[StorePath]:
        fs, path = self._at()
        yield from (self._of(s) for s in fs.listStatus(path))

    def rglob(self, pattern: str) -> Iterator[StorePath]:
        """All files below whose names match."""
        fs, path = self._at()
        found = fs.listFiles(path, True)
        while found.hasNext():
            one = self._of(found.next())
            if PurePosixPath(one.name).match(pattern):
                yield one

    def glob(self, pattern: str) -> Iterator[StorePath]:
        yield from (p for p in self.iterdir() if PurePosixPath(p.name).match(pattern))

    def read_bytes(self) -> bytes:
        fs, path = self._at()
        stream = fs.open(path)
        try:
            return bytes(SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_text(self) -> str:
        return self.read_bytes().decode()

    def write_text(self, text: str) -> None:
        fs, path = self._at()
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def mkdir(self, parents: bool = True, exist_ok: bool = True) -> None:
        fs, path = self._at()
        fs.mkdirs(path)

    def unlink(self, missing_ok: bool = False) -> None:
        fs, path = self._at()
        fs.delete(path, False)

    def rmdir(self) -> None:
        fs, path = self._at()
        fs.delete(path, False)


AnyPath = Path | StorePath


def place(path: str | os.PathLike) -> AnyPath:
    """A path as it was given: one with a scheme other than file: is in a store."""
    if isinstance(path, StorePath):
        return path
    text = os.fspath(path)
    found = SCHEME.match(text)
    if found is None:
        return Path(text).expanduser().resolve()
    if found[1].lower() == "file":
        return Path("/" + text.partition(":")[2].lstrip("/")).resolve()
    return StorePath(text.rstrip("/"))


def move(source: AnyPath, target: AnyPath) -> None:
    """Rename within a store, over what is there."""
    if isinstance(source, StorePath):
        fs, path = source._at()
        other = target._at()[1]
        if fs.exists(other):
            fs.delete(other, False)
        if not fs.rename(path, other):
            raise OSError(f"cannot move {source} to {target}")
    else:
        os.replace(source, target)


def remove(path: AnyPath) -> None:
    """Delete a file or a folder with all that is in it; it may be missing."""
    if isinstance(path, StorePath):
        fs, at = path._at()
        fs.delete(at, True)
    elif path.is_dir():
        shutil.rmtree(path, ignore_errors=True)
    else:
        path.unlink(missing_ok=True)


def copy(source: AnyPath, target: AnyPath) -> None:
    if isinstance(source, StorePath) or isinstance(target, StorePath):
        context = SparkSession.active().sparkContext
        uri = lambda p: StorePath(str(p) if isinstance(p, StorePath) else f"file://{p}")
        (from_fs, a), (to_fs, b) = uri(source)._at(), uri(target)._at()
        context._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, b, False, True, context._jsc.hadoopConfiguration())
    else:
        shutil.copyfile(source, target)
