"""Words, word hashes and staged tables shared by the text operators.

Words are runs of bytes other than the six ASCII blanks, which is what
``bytes.split()`` gives. Only A-Z are lower-cased (``bytes.lower()``), so the
result does not depend on a locale or a Unicode version.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellfield.session import scratch_path

BLANKS = " \t\n\x0b\x0c\r"
# Spark frees the shuffle files of a query when it has ended, instead of when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MEMO_WORDS = 120_000


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back; its shuffle files are freed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df = df.select("*")  # planned again, so that the setting above counts
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(FREE_SHUFFLES, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "staged_path", None)
        if path:
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def word_count(text: Column) -> Column:
    """Number of words without building them: the places where a word starts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for the words of a task up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value


class PlainWordHashes(WordHashes):
    """As WordHashes, of the case-folded word (in any script) without ASCII punctuation around it."""

    def __missing__(self, word: bytes) -> int:
        folded = word.decode().casefold()
        value = xxhash.xxh3_64_intdigest((folded.strip(string.punctuation) or folded).encode())
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value


def binary_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class Tokens:
    """Word hashes of a batch of texts, one after the other."""

    def __init__(self, texts: list[bytes], memo: WordHashes, lower: bool = True):
        self.words = [(t.lower() if lower else t).split() for t in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        look = memo.__getitem__
        self.hashes = np.fromiter(
            (look(w) for ws in self.words for w in ws), np.uint64, int(self.ends[-1]) if len(texts) else 0
        )

    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def window_hashes(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of ``size`` words inside one text.

    The hash is the Rabin-Karp polynomial of the word hashes modulo 2**64 with an odd
    base, computed for all windows of the batch at once, and spread by ``mix``.
    """
    h = tokens.hashes
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    value = h[:n].copy()
    for j in range(1, size):
        value *= base
        value += h[j : j + n]
    inside = np.ones(n, bool)
    for j in range(1, size):  # no window runs over the end of its text
        cut = tokens.ends - j
        cut = cut[(cut >= tokens.starts) & (cut < n) & (tokens.counts > 0)]
        inside[cut] = False
    at = np.flatnonzero(inside)
    return at, mix(value[at])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in source if b.num_rows)


def pieces(source: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, so that a task holds the words of few texts."""
    for batch in batches(source):
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield batch.slice(a, b - a)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra columns with any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
