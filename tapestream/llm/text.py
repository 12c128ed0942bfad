"""Small helpers on whole texts inside Arrow batches.

Texts travel as UTF-8 bytes: ``bytes.split()`` splits at exactly 0x20 and 0x09-0x0D, and
``bytes.lower()`` lower-cases exactly A-Z, which is what the operators' contracts ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of most operators: runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes that don't begin a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
BLANKS = b" \t\n\x0b\x0c\r"


def as_bytes(column: str) -> Column:
    return F.col(column).cast("binary").alias(column)


def word_count(column: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one slice hold about ``most_bytes`` at most; a longer text is alone."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held + n > most_bytes and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)


class WordHashes(dict):
    """64-bit hashes of words; forgets them beyond ``most`` entries, which changes no result."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values (uint64, wraps)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` word hashes."""
    size = len(words) - n + 1
    total = np.zeros(max(size, 0), np.uint64)
    for k in range(n):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
        total += words[k : k + size] * factor if size > 0 else total
    return mixed(total)
