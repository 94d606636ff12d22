"""Helpers shared by the corpus operators.

Tables are handled alike everywhere: an operator first selects the columns it
names, so that further columns of the input, whatever they are called, neither
clash nor travel.  Python runs on Arrow batches cut by bytes of text, so that a
task holds a small piece of its partition whatever the length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
MEMO_ENTRIES = 200_000
LAST_ID = 2**63 - 1
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` with null texts as empty ones, and the columns asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``budget`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            reach = (ends[start - 1] if start else 0) + budget
            stop = max(start + 1, int(np.searchsorted(ends, reach, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class Memo(dict):
    """Remembers ``of(key)`` for keys in use, at most ``2 * entries`` of them.

    When full, what it holds becomes the older generation, from which keys in use return.
    """

    def __init__(self, of, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.of, self.entries, self.older = of, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.of(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


    def fill(self, keys: set, of_many) -> None:
        """Learn what ``keys`` stand for, all that are not remembered at once."""
        new = [key for key in keys if key not in self and key not in self.older]
        for key, value in zip(new, of_many(new), strict=True):
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value


def word_codes() -> Memo:
    """64-bit codes of words (bytes)."""
    return Memo(xxhash.xxh3_64_intdigest)


def coded(texts: list[bytes], codes: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all texts, and the number of words of each text.

    A word is a run of bytes other than space and 0x09-0x0D, which is what ``bytes.split`` gives.
    """
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        words = text.split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_codes(codes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Codes of the n-grams that start at each word; the last n - 1 entries are of shorter ones.

    Built by doubling: a gram of length a + b is combined from grams of length a and b.
    """
    with np.errstate(over="ignore"):
        one = mixed(codes + np.uint64(seed))
        out, length = None, 0
        power, width = one, 1
        while n:
            if n & 1:
                out = power if out is None else joined(out, shifted(power, length), width)
                length += width
            n >>= 1
            if n:
                power, width = joined(power, shifted(power, width), width), 2 * width
    return out


def joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right + np.uint64(width))


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width], by doubling; windows over the end see fewer values."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** (i + 1) modulo 2**64."""
    return np.cumprod(np.full(n, base)) if n else np.zeros(0, np.uint64)


def prefix_hashes(codes: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """h[i] of the first i + 1 codes: h[i] = h[i - 1] * base + mixed code, modulo 2**64."""
    inverse = np.uint64(pow(int(base), -1, 2**64))
    return np.cumsum(mixed(codes + np.uint64(1)) * powers(inverse, len(codes))) * powers(base, len(codes))


def range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of codes[start:end] for many ranges, from the prefix hashes."""
    before = np.where(start > 0, hashes[np.maximum(start, 1) - 1], np.uint64(0))
    length = end - start
    return mixed(hashes[end - 1] - before * powers(base, int(length.max()))[length - 1] + length.astype(np.uint64))
