"""File systems: qualified paths, and entries and bytes of any store pyarrow can open."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession

# Hadoop's names of a scheme -> the one pyarrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
# Tries to remove a folder that tasks on their way out still write to.
ATTEMPTS = 20


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as scans name it: with scheme and authority, absolute, no final slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def is_folder(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(path) and system.getFileStatus(path).isDirectory()


def location(path: str) -> str:
    """The URI pyarrow opens for a path as scans give it."""
    # File scans name local files with one slash after the scheme, URIs have three.
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:") :]
    scheme, mark, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{mark}{rest}" if mark else path


def _renamed(path: str, to: str) -> None:
    """A local file under a new name, which may be in another folder and taken.

    A rename between folders has to wait for all others of its disk, links wait for those of their folder only.
    """
    try:
        os.link(path, to)
    except FileNotFoundError:
        raise
    except OSError:  # the name is taken, or the disk knows no links
        os.replace(path, to)
    else:
        os.unlink(path)


class Stores:
    """Opened file systems of one task, one for each scheme and authority."""

    def __init__(self) -> None:
        self.opened: dict[str, object] = {}
        self.empties: list[str] = []  # local folders nobody needs any more; those that are empty become new ones

    @staticmethod
    def _local(store: object) -> bool:
        from pyarrow import fs

        return isinstance(store, fs.LocalFileSystem)

    def _at(self, path: str):  # noqa: ANN202 - pyarrow's file system and a path in it
        from pyarrow import fs

        uri = location(path)
        scheme, mark, rest = uri.partition("://")
        root = f"{scheme}{mark}{rest.partition('/')[0]}" if mark else ""
        local = not mark or scheme == "file"
        target = rest[rest.index("/") :] if scheme == "file" else uri if local else rest
        if root not in self.opened:
            self.opened[root] = fs.LocalFileSystem() if local else fs.FileSystem.from_uri(uri)[0]
        if not local and scheme != "s3":
            target = "/" + rest.partition("/")[2]
        return self.opened[root], target

    def entries(self, folder: str) -> Iterator[tuple[str, datetime | None, int | None, bool]]:
        """(path, time, length, is folder) of what a folder holds; nothing if it is gone."""
        from pyarrow import fs

        store, target = self._at(folder)
        base = folder.rstrip("/") + "/"
        try:
            if isinstance(store, fs.LocalFileSystem):
                with os.scandir(target) as found:  # one entry at a time, however large the folder
                    for e in found:
                        if e.is_dir(follow_symlinks=False):
                            yield base + e.name, None, None, True
                        elif e.is_file():
                            stat = e.stat()
                            yield base + e.name, datetime.fromtimestamp(stat.st_mtime, timezone.utc), stat.st_size, False
            else:
                for info in store.get_file_info(fs.FileSelector(target)):
                    is_folder = info.type == fs.FileType.Directory
                    yield base + info.base_name, info.mtime, None if is_folder else info.size, is_folder
        except FileNotFoundError:
            return

    def delete(self, path: str) -> None:
        store, target = self._at(path)
        store.delete_file(target)

    def discard(self, path: str) -> None:
        """Delete a file, if it is there."""
        try:
            self.delete(path)
        except OSError:
            if self.there(path):
                raise

    def make(self, folder: str, parents: bool = True) -> None:
        """Make a folder; without ``parents`` the one around it has to be there."""
        store, target = self._at(folder)
        store.create_dir(target, recursive=parents)

    def clear(self, folder: str) -> None:
        """Remove a folder with all it holds, if it is there, also while others still write to it."""
        from pyarrow import fs

        store, target = self._at(folder)
        for attempt in range(ATTEMPTS):
            try:
                store.delete_dir(target)
            except OSError:
                if attempt + 1 == ATTEMPTS and store.get_file_info(target).type != fs.FileType.NotFound:
                    raise
            if store.get_file_info(target).type == fs.FileType.NotFound:
                return
            time.sleep(0.05 * attempt)

    def move(self, path: str, to: str) -> None:
        """Under its new name at once, in folders that may be new; both in one store."""
        store, target = self._at(path)
        _, end = self._at(to)
        if self._local(store):
            try:
                _renamed(target, end)
                return
            except FileNotFoundError:  # most files come into a folder that is there
                if not os.path.lexists(target):
                    raise
                self._take(end.rpartition("/")[0])
        store.create_dir(end.rpartition("/")[0], recursive=True)
        if self._local(store):
            _renamed(target, end)
        else:
            store.move(target, end)

    def _take(self, folder: str) -> None:
        """Make a local folder of one of ``empties``, if there is one and the folder around it is there."""
        while self.empties:
            empty = self._at(self.empties.pop())[1]
            try:
                with os.scandir(empty) as found:
                    if next(found, None) is not None:
                        continue
                os.rename(empty, folder)
            except FileNotFoundError:  # another task was first
                if os.path.isdir(os.path.dirname(folder)):
                    continue
            except OSError:  # it is there
                pass
            return

    def shift(self, path: str, to: str) -> bool:
        """A local file or folder under another name in one step, with no folder made; false if that can't be."""
        store, target = self._at(path)
        if not self._local(store):
            return False
        try:
            os.rename(target, self._at(to)[1])
        except OSError:
            return False
        return True

    def move_once(self, path: str, to: str) -> None:
        """The same for a move that may have been made before: then only the new name is there."""
        if self._local(self._at(path)[0]):
            try:
                self.move(path, to)
            except FileNotFoundError:
                if self.there(path) or not self.there(to):
                    raise
        elif self.there(path) or not self.there(to):
            self.move(path, to)

    def there(self, path: str) -> bool:
        from pyarrow import fs

        store, target = self._at(path)
        return store.get_file_info(target).type == fs.FileType.File

    def read(self, path: str) -> bytes:
        store, target = self._at(path)
        if self._local(store):
            with open(target, "rb", buffering=0) as stream:
                return stream.readall()
        with store.open_input_stream(target) as stream:
            return stream.read()

    def put(self, path: str, content: bytes) -> None:
        """A file in a folder that nobody reads before its writer is done; a failed write may leave a part of it.

        A local file that is there is written over and cut to its new length; to empty it first would give its disk
        space back and ask for it anew.
        """
        store, target = self._at(path)
        if not self._local(store):
            with store.open_output_stream(target) as out:
                out.write(content)
            return
        with open(target, "wb", opener=lambda name, flags: os.open(name, flags & ~os.O_TRUNC, 0o666)) as out:
            out.write(content)
            if os.fstat(out.fileno()).st_size > len(content):
                out.truncate()

    def write(self, path: str, content: bytes, make: bool = True) -> None:
        """The file appears under its name only when complete; nothing is left of a failed write.

        Without ``make`` its folder has to be there.
        """
        store, target = self._at(path)
        if make:
            store.create_dir(target.rpartition("/")[0], recursive=True)
        partial = f"{target}.{uuid.uuid4().hex}.tmp"
        try:
            with store.open_output_stream(partial) as out:
                out.write(content)
            store.move(partial, target)
        except Exception:
            try:
                store.delete_file(partial)
            except OSError:
                pass  # it was never made, or is gone
            raise
