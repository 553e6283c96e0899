"""Large binary files read by many tasks, a bounded run of records at a time.

A first pass walks over each file, reading no more of it than it takes to
know where records end, and tells where chunks of them begin; the chunks are
then spread over the tasks and decoded on their own.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a chunk, from which on it ends at its next record.
CHUNK = 8 << 20


def open_file(path: str) -> BinaryIO:
    """A file by its path or URI, which can be sought in."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, length) of the files found; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def read_chunks(found: DataFrame, walk: Callable[[BinaryIO], Iterator[tuple[int, int]]], decode: Callable[[str, BinaryIO, int, int, int], Iterator[pd.DataFrame]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """What ``decode`` makes of each chunk of the files ``found`` (path).

    ``walk`` gives (begin, number before it) of a file's records in order, or of
    some of them, and last (end, number of all). ``decode`` takes path, file, begin and end of a chunk and the
    number of the first record.
    """

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path in rows["path"]:
                out = []
                with open_file(path) as f:
                    begin, number, last = None, 0, None
                    for at, k in walk(f):
                        if begin is None:
                            begin, number = at, k
                        elif at - begin >= chunk:
                            out.append((path, begin, at, number))
                            begin, number = at, k
                        last = at
                    if begin is not None and last > begin:
                        out.append((path, begin, last, number))
                yield pd.DataFrame(out, columns=["path", "begin", "end", "first"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                with open_file(r.path) as f:
                    yield from decode(r.path, f, r.begin, r.end, r.first)

    spark = found.sparkSession
    # Rows are places in files: few and small.
    planned = found.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(plan, "path string, begin long, end long, first long")
    return planned.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "begin").mapInPandas(run, schema)


def walk_fixed(f: BinaryIO, begin: int, size: int, n: int, step: int = 4096) -> Iterator[tuple[int, int]]:
    """Every ``step``-th of ``n`` records of ``size`` bytes, and the end."""
    yield from ((begin + k * size, k) for k in range(0, n, step))
    yield begin + n * size, n


def walk_counted(f: BinaryIO, size_at: Callable[[Callable[[int, int], bytes], int], int], buffer: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Records of different sizes after a count of 8 bytes; ``size_at`` tells a record's size by reading (place, bytes)."""
    window, base = b"", 0

    def read(at: int, n: int) -> bytes:
        nonlocal window, base
        if at < base or at + n > base + len(window):
            f.seek(at)
            window, base = f.read(max(n, buffer)), at
        return window[at - base : at - base + n]

    (n,) = struct.unpack("<Q", read(0, 8))
    at = 8
    for k in range(n):
        yield at, k
        at += size_at(read, at)
    yield at, n


def frames(rows: Iterator[tuple], columns: list[str], most: int = 2048) -> Iterator[pd.DataFrame]:
    """Tuples as data frames of bounded length."""
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == most:
            yield pd.DataFrame(batch, columns=columns)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns)
