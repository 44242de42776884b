"""Result tables of one run that replace those of the last run together, or not at all."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

# Where a run writes, and the list of its tables. Readers of the output folder pass over both names.
STAGED = "_nuevo-"
MANIFEST = "_tablas"


class _Files:
    """The few file operations needed, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def folders(self, root: str) -> list[str]:
        if not self.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(root)) if s.isDirectory())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self.path(path), True)

    def move(self, source: str, target: str) -> None:
        if not self._fs.rename(self.path(source), self.path(target)):
            raise OSError(f"could not move {source} to {target}")

    def write(self, path: str, names: list[str]) -> None:
        """The whole list appears at once: a file half written has another name."""
        out = self._fs.create(self.path(f"{path}-parte"), True)
        try:
            out.write(bytearray("".join(f"{n}\n" for n in names).encode()))
        finally:
            out.close()
        self.move(f"{path}-parte", path)

    def read(self, path: str) -> list[str]:
        stream = self._fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")[:-1]
        finally:
            stream.close()


def _swap(files: _Files, output: str, staged: str) -> None:
    """Put the tables of a finished run in place. May be repeated from wherever it stopped."""
    for name in files.read(f"{staged}/{MANIFEST}"):
        if files.exists(f"{staged}/{name}"):
            files.delete(f"{output}/{name}")
            files.move(f"{staged}/{name}", f"{output}/{name}")
    files.delete(f"{output}/{MANIFEST}")
    files.move(f"{staged}/{MANIFEST}", f"{output}/{MANIFEST}")
    files.delete(staged)


def recover(spark: SparkSession, output: str) -> int:
    """End the swaps that a lost driver left half done; how many there were.

    Runs that had not written all their tables are left alone, since they may still be going on.
    """
    files = _Files(spark, output)
    left = [f"{output}/{f}" for f in files.folders(output) if f.startswith(STAGED)]
    ended = [s for s in left if files.exists(f"{s}/{MANIFEST}")]
    for staged in ended:
        log.warning("ending the run in %s", staged)
        _swap(files, output, staged)
    return len(ended)


@contextmanager
def replacing(spark: SparkSession, output: str) -> Iterator[str]:
    """A folder to write the tables of a run to; at the end each takes its place in ``output``.

    After an error the folder is deleted, and the tables of the last run stay whole. Once all tables are written
    a manifest lists them, and from then on the swap, a few renames, is ended by ``recover`` if the
    driver is lost. Afterwards ``output`` holds the manifest; tables that this run did not write stay as they were.
    One run at a time may write to ``output``.
    """
    output = output.rstrip("/")
    recover(spark, output)
    files, staged = _Files(spark, output), f"{output}/{STAGED}{uuid4().hex}"
    try:
        yield staged
        files.write(f"{staged}/{MANIFEST}", files.folders(staged))
    except BaseException:
        files.delete(staged)
        raise
    _swap(files, output, staged)


def tables(spark: SparkSession, output: str) -> list[str]:
    """Names of the tables that the last run to ``output`` wrote; swaps left half done are ended first."""
    output = output.rstrip("/")
    recover(spark, output)
    files = _Files(spark, output)
    return files.read(f"{output}/{MANIFEST}") if files.exists(f"{output}/{MANIFEST}") else []
