"""Plumbing shared by the training-data operators: tables, shared files, words, Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.store import removed, shared_folder, tidied  # noqa: F401
from quire.sources.store import stored as written  # noqa: F401

# The word rule of the query contracts.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Texts are long: unless the session says otherwise, rows go to Python 1,000 at a time, so that batches are some MB on either side."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null: empty) and the named columns; every other column is left out."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    return picked


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """quire_* names that no column of the frame has, whatever its case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        name = f"quire_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, from a scan without a shuffle of rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def give_back() -> None:
    """Hands memory that is free to the system: a Python worker lives on after its task, beside others, and the driver after a fit."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def pieces_of(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes in the column, or one row, so that memory follows the longest text and not the batch."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def words_of(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of each text in order: (row of each word, words). The ASCII whitespace of Arrow is 0x20 and 0x09 to 0x0D, the contract's gap."""
    parts = pc.ascii_split_whitespace(flat(text))
    words = parts.flatten()
    rows = np.repeat(np.arange(len(parts)), np.asarray(pc.fill_null(pc.list_value_length(parts), 0)))
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():  # empty parts at the ends of a text
        words, rows = words.filter(full), rows[np.asarray(full)]
    return rows, words


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
