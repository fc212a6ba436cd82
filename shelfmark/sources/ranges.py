"""Byte ranges of files: headers are read where they stand, whole files never are.

A listing (path, length) is all that Spark moves.  Tasks open a file and read
the ranges that a header walk asks for, in aligned blocks that are kept for as long
as the walk stays near.  A container of many gigabytes costs its box headers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes read at once, and blocks of one file kept in memory.
BLOCK, KEPT = 1 << 12, 64
#: What the end chunk of a PNG may be followed by, at most.
TAIL = 1 << 16


class Ranged:
    """A file that is indexed and sliced like ``bytes``; only the blocks touched are read."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self._read_at, self._size, self._blocks = read_at, size, {}
        self.bytes_read = 0

    def __len__(self) -> int:
        return self._size

    def _block(self, number: int) -> bytes:
        if number not in self._blocks:
            if len(self._blocks) >= KEPT:
                self._blocks.pop(next(iter(self._blocks)))
            wanted = min(BLOCK, self._size - number * BLOCK)
            data = self._read_at(number * BLOCK, wanted)
            if len(data) < wanted:
                raise OSError("shorter than listed")
            self.bytes_read += len(data)
            self._blocks[number] = data
        return self._blocks[number]

    def __getitem__(self, where):
        if isinstance(where, int):
            if not 0 <= where < self._size:
                raise IndexError(where)
            return self._block(where // BLOCK)[where % BLOCK]
        start, stop, _ = where.indices(self._size)
        if stop <= start:
            return b""
        first, last = start // BLOCK, (stop - 1) // BLOCK
        data = b"".join(self._block(n) for n in range(first, last + 1))
        return data[start - first * BLOCK:stop - first * BLOCK]


def opened(path: str):
    """A random-access file by its address as Spark lists it (``file:/a``, ``s3a://b/c``, ``hdfs://...``, a plain path)."""
    from urllib.parse import unquote

    import pyarrow.fs as pafs

    local = re.match(r"^file:/+(.*)$", path)
    if local or "://" not in path:
        return pafs.LocalFileSystem().open_input_file("/" + unquote(local[1]) if local else path)
    system, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return system.open_input_file(inner)


def listed(spark, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of all files below a folder; contents are not read.  Spark lists no empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(
        folder).select("path", "length")


def walked(files: DataFrame, columns: Sequence[str], schema: str, walk: Callable[[Ranged], Iterator[tuple]]) -> DataFrame:
    """Rows that ``walk`` yields for each file of ``files`` (path, length), the path before them.

    A file that cannot be opened or read to the place a header points to yields
    what was read before; the audits find it by its absence.
    """

    def job(batches):
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"]):
                try:
                    with opened(path) as handle:
                        for row in walk(Ranged(lambda at, n, h=handle: h.read_at(n, at), int(length))):
                            rows.append((path, *row))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", *columns])

    return files.select("path", F.col("length").cast("long").alias("length")).mapInPandas(job, f"path string, {schema}")


def ends(files: DataFrame, head: int = 16) -> DataFrame:
    """path, head (first bytes) and tail (the last 64 KiB) of each file that can be read; no tail if it is shorter than listed."""

    def walk(data: Ranged) -> Iterator[tuple]:
        first = data[:head]
        try:
            yield first, data[max(0, len(data) - TAIL):]
        except OSError:
            yield first, None

    return walked(files, ["head", "tail"], "head binary, tail binary", walk)
