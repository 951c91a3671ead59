"""What the operators share: reading tables, cutting lineage, settings."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage as cut  # noqa: F401

#: The white space that separates tokens, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: A-Z to a-z for ``bytes.translate``; UTF-8 continuation bytes are untouched.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and all white space to spaces.
TOKENS = bytes(32 if 9 <= b <= 13 else b for b in LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other letters too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fold of a row. Null ids count as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return what was freed to the system: workers live on after a task, and an executor's others need the room."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one has left behind is given back before the next."""
    for b in batches:
        yield b
        del b
        give_back()


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts of a batch: a column of that name, or a field of its one struct column."""
    return batch.column(name) if name in batch.schema.names else batch.column(0).field(name)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of an odd number, and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, pow(base, -1, 2**64)))


def ranges(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one range after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Lookup:
    """Places of distinct 64-bit keys, in arrays: open addressing, half full at most."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.value = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        at, left = self._first(keys), np.arange(len(keys))
        # every key is entered at the first free place from its own on; of several at one place, one
        while len(left):
            free = left[self.value[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.value[at[put]] = keys[put], put
            left = left[self.value[at[left]] != left]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        keys = keys.astype(np.uint64)
        at = self._first(keys)
        out = self.value[at]
        look = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(look):
            at[look] = (at[look] + 1) & (len(self.keys) - 1)
            out[look] = self.value[at[look]]
            look = look[(out[look] >= 0) & (self.keys[at[look]] != keys[look])]
        return out


#: Bytes of text that are told apart at once.
PART = 1 << 21


def runs(texts: list[bytes], table: bytes, part: int = PART) -> Iterator[tuple[np.ndarray, pa.DictionaryArray]]:
    """(text number, run) of all runs of bytes that ``table`` does not turn into spaces, some megabytes of text at a time.

    A longer text is read in parts, cut at a space."""
    held, of, size = [], [], 0

    def out() -> tuple[np.ndarray, pa.DictionaryArray]:
        flat = np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8)
        word = flat != 32
        step = np.diff(word.view(np.int8))
        first, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        offsets = np.r_[0, np.cumsum(end - first)].astype(np.int32)
        begin = np.cumsum([1, *(len(p) + 1 for p in held[:-1])])
        owner = np.array(of)[np.searchsorted(begin, first, side="right") - 1]
        return owner, pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(flat[word].tobytes())]).dictionary_encode()

    for k, t in enumerate(texts):
        t, at = t.translate(table), 0
        while at <= len(t):
            end = t.find(b" ", at + part) if len(t) - at > part else -1
            end = len(t) if end < 0 else end
            held.append(t[at:end])
            of.append(k)
            size += end - at + 1
            at = end + 1
            if size > part:
                yield out()
                held, of, size = [], [], 0
    if held:
        yield out()
