"""Numbered entries in a shared folder: a log that several writers can extend without losing an entry.

An entry is a JSON file named by its number.  It is written under another name
first and then renamed, which fails where the number is taken, so an entry is
whole or absent and of two writers of one number only one succeeds.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Taken(Exception):
    """Another writer was first."""


class Files:
    """The few operations on a shared folder that Spark's readers and writers don't offer."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.conf, self._path = spark._jsc.hadoopConfiguration(), self.jvm.org.apache.hadoop.fs.Path
        self._rename: Callable | None = None
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, relative: str):
        return self._path(f"{self.root}/{relative}" if relative else self.root)

    def exists(self, relative: str = "") -> bool:
        return self.fs.exists(self.path(relative))

    def names(self, relative: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path(relative))] if self.exists(relative) else []

    def age_ms(self, relative: str, now: int) -> int:
        return now - self.fs.getFileStatus(self.path(relative)).getModificationTime()

    def delete(self, relative: str) -> None:
        self.fs.delete(self.path(relative), True)

    def read(self, relative: str) -> str:
        stream = self.fs.open(self.path(relative))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, relative: str, text: str) -> None:
        """The whole file, or ``Taken`` if there is one of the name."""
        part = self.path(f"{relative.rpartition('/')[0]}/.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._rename is None:  # looked up once, as each name of a class is a call to the JVM
            self._rename = self._linked() if self.fs.getUri().getScheme() == "file" else self._renamed(part)
        try:
            self._rename(part, self.path(relative))
        except Exception as e:
            self.fs.delete(part, False)
            if self.exists(relative):
                raise Taken(relative) from e
            raise

    def _renamed(self, part) -> Callable:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self.fs.getUri(), self.conf)
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        how = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        how[0] = none
        return lambda a, b: context.rename(a, b, how)

    def _linked(self) -> Callable:
        """A second name for the file, which fails where there is one: a rename that does so starts processes on local disks."""
        link, place, slow = self.jvm.java.nio.file.Files.createLink, self.jvm.java.nio.file.Paths.get, None

        def rename(a, b) -> None:
            nonlocal slow
            if slow is None:
                try:
                    link(place(self.fs.makeQualified(b).toUri()), place(self.fs.makeQualified(a).toUri()))
                    self.fs.delete(a, False)
                    return
                except Exception:
                    if self.fs.exists(b):
                        raise
                    slow = self._renamed(a)  # a disk without links
            slow(a, b)

        return rename


class Log:
    """Entries by number; the one with the highest number is the latest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self._near = Files(spark, folder), 0
        self._last = (0, "")  # what was appended last: an entry never changes

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("") if re.fullmatch(r"\d{12}\.json", n))

    def get(self, number: int) -> dict:
        return json.loads(self.files.read(f"{number:012d}.json"))

    def latest(self) -> tuple[int, dict | None]:
        """The last entry and its number; 0 and None where there is none.

        Numbers have no gaps and the lowest are forgotten first, so an entry
        that is there while the next one was not is the last.  Looking on from
        the last one known takes no listing of the folder, which grows.
        """
        name = lambda n: f"{n:012d}.json"
        for n in range(self._near, self._near + 8) if self._near else ():
            if not self.files.exists(name(n + 1)):
                if self.files.exists(name(n)):
                    self._near = n
                    return n, json.loads(self._last[1]) if n == self._last[0] else self.get(n)
                break
        found = self._listed()
        self._near = found[0]
        return found

    def _listed(self) -> tuple[int, dict | None]:
        while numbers := self.numbers():
            try:
                return numbers[-1], self.get(numbers[-1])
            except Exception:  # noqa: BLE001  forgotten meanwhile: a later one is there
                if numbers[-1] in self.numbers():
                    raise
        return 0, None

    def append(self, number: int, entry: dict) -> None:
        """Raises ``Taken`` if the number is."""
        text = json.dumps(entry)
        self.files.create(f"{number:012d}.json", text)
        self._near, self._last = number, (number, text)

    def forget(self, below: int) -> None:
        """Removes entries with lower numbers, but never the latest."""
        for n in self.numbers()[:-1]:
            if n < below:
                self.files.delete(f"{n:012d}.json")
