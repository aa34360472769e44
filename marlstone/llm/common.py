"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import remove, scratch

#: Words of the word-based operators: runs of anything but ASCII white space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Word hashes kept per worker.
CACHE_WORDS = 150_000
_U = np.uint64


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage is cut
    and a lost executor costs no recomputation of what was written."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def release(*written: DataFrame) -> None:
    """Remove tables made by ``materialise`` that nothing will read again, so that
    a long session keeps no more than its results depend on."""
    for df in written:
        if path := getattr(df, "_marlstone_path", None):
            remove(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session; they need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_marlstone_shipped", False):
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="marlstone-code-")) / "marlstone.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, Path(package.name) / file.relative_to(package))
        sc.addPyFile(str(path))
        sc._marlstone_shipped = True


def small(batches: Iterator[pa.RecordBatch], *texts: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces with about ``most`` bytes of text (columns ``texts``), so
    that a worker's memory depends on that and its longest row, not on Spark's batches."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for at in texts)
        piece = np.cumsum(size + 16) // most
        cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                yield batch.slice(low, high - low)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h
