"""Benchmark decontamination with spaced seeds.

A mask keeps some of the word positions of a span and ignores the others, so its hash survives
substitutions at the ignored ones. The masks below have an occurrence in every window of
13 to 25 words with up to a fifth of them substituted, wherever those are; a longer one has such a part. Hashes of the test items
and of the documents are joined, and around each hit the alignment of the two texts is
checked word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import PlainWordHashes, Tokens, as_long, batches, binary_texts, mix, pieces, plain, stage

MASKS = ("11110111", "11001001111", "11111101", "11010000010111", "1110100111", "11100101001001")
WINDOW = 13
SHORT_ITEM = 8  # shorter items match whole and exactly, where they are asked for
WHOLE = 100  # added to the length of a pattern that is a whole item
SHARE = (4, 5)  # of the words of an overlap, at least these parts are equal
# The filter of the test hashes: 256 bits for each hash, 16 MB at most. Beyond that it only lets more pass.
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 256, 16, 27
PROBES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _seeds(tokens: Tokens, kept: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words at the offsets ``kept`` from every start whose span is inside one text."""
    h = tokens.hashes
    span = kept[-1] + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    value = np.full(n, salt, np.uint64)
    for j in kept:
        value *= np.uint64(0x9E3779B97F4A7C15)
        value += h[j : j + n]
    ends = np.repeat(tokens.ends, tokens.counts)[:n]
    at = np.flatnonzero(np.arange(n) + span <= ends)
    return at, mix(value[at])


def _offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def _halves(n: int) -> set[int]:
    return {n // 2, n - n // 2}


def _item_seeds(least_words: int):
    def run(source):
        yield from _seeds_of_items(source, least_words)

    return run


def _seeds_of_items(source, least_words: int):
    memo = PlainWordHashes()
    for batch in batches(source):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tokens = Tokens(binary_texts(batch.column(1)), memo, lower=False)
        found = []
        rows = tokens.rows()
        long_item = tokens.counts >= WINDOW
        for salt, mask in enumerate(MASKS):
            at, seed = _seeds(tokens, _offsets(mask), salt)
            keep = long_item[rows[at]]
            found.append((rows[at][keep], at[keep], seed[keep], np.zeros(keep.sum(), np.int64)))
        for length in range(SHORT_ITEM // 2, WINDOW // 2 + 1):
            at, seed = _seeds(tokens, tuple(range(length)), 100 + length)
            row = rows[at]
            n, p = tokens.counts[row], at - tokens.starts[row]
            first, last = n // 2, n - n // 2  # one half of a short item has no substitution
            keep = (n >= SHORT_ITEM) & (n < WINDOW)
            keep &= ((p == 0) & (length == first)) | ((p == first) & (length == last))
            found.append((row[keep], at[keep], seed[keep], np.full(keep.sum(), length)))
        for length in range(max(1, least_words), SHORT_ITEM):
            at, seed = _seeds(tokens, tuple(range(length)), 100 + WHOLE + length)
            keep = tokens.counts[rows[at]] == length
            found.append((rows[at][keep], at[keep], seed[keep], np.full(keep.sum(), WHOLE + length)))
        row, at, seed, short = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(as_long(seed)),
                pa.array(ids[row]),
                pa.array((at - tokens.starts[row]).astype(np.int32)),
                pa.array(short.astype(np.int32)),
            ],
            names=["seed", "item_id", "item_at", "short"],
        )


def _probe(seed: np.ndarray, times: np.uint64, bits: int) -> np.ndarray:
    return ((seed * times) >> np.uint64(64 - bits)).astype(np.int64)


def _probes(bits: int):
    def run(source):
        for batch in batches(source):
            seed = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([_probe(seed, t, bits) for t in PROBES]))
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["bit"])

    return run


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the seeds as a bit array of at most 2 ** MOST_BITS bits, and its size."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(seeds.count() * BITS_PER_SEED).bit_length()))
    pieces = (
        seeds.select("seed")
        .mapInArrow(_probes(bits), "bit long")
        .groupBy(F.bitmap_bucket_number("bit").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    )
    held = np.zeros((1 << bits) // 8, np.uint8)
    for piece, bitmap in pieces.collect():  # 16 MB at most
        at = (piece - 1) * 4096
        part = np.frombuffer(bytes(bitmap), np.uint8)[: len(held) - at]
        held[at : at + len(part)] = part
    return held, bits


def _doc_seeds(held, bits: int, short: list[int]):
    patterns = [(_offsets(m), salt) for salt, m in enumerate(MASKS)]
    patterns += [(tuple(range(code % WHOLE)), 100 + code) for code in short]

    def run(source):
        memo = PlainWordHashes()
        bitmap = held.value
        for batch in pieces(source, 1):
            tokens = Tokens(binary_texts(batch.column(1)), memo, lower=False)
            all_at, all_seeds = [], []
            for kept, salt in patterns:
                at, seed = _seeds(tokens, kept, salt)
                for times in PROBES:
                    bit = _probe(seed, times, bits)
                    hit = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    at, seed = at[hit], seed[hit]
                all_at.append(at)
                all_seeds.append(seed)
            at, seed = np.concatenate(all_at), np.concatenate(all_seeds)
            row = tokens.rows()[at]
            order = np.argsort(row, kind="stable")
            at, seed, row = at[order], seed[order], row[order]
            rows, counts = np.unique(row, return_counts=True)
            where = (at - tokens.starts[row]).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            hits = pa.StructArray.from_arrays(
                [pa.array(as_long(seed)), pa.array(where)], names=["seed", "doc_at"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    batch.column(1).take(pa.array(rows)),
                    pa.ListArray.from_arrays(offsets, hits),
                ],
                names=["doc_id", "text", "hits"],
            )

    return run


def overlap(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in the item, length, equal words) of the longest overlap found on one alignment.

    Word i of the item lies on word i + shift of the document. An overlap is a run of at
    least 13 aligned words of which at least four fifths are equal. A shorter item has to be there
    whole, with one word changed at most, one of less than 8 words without any change.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    need = min(WINDOW, len(item))
    if high - low < need:
        return None
    equal = item[low:high] == doc[low + shift : high + shift]
    if len(item) < WINDOW:  # one substitution leaves a half without any, which is what the seeds of short items find
        changed = 1 if len(item) >= SHORT_ITEM else 0
        return (0, len(item), int(equal.sum())) if equal.sum() >= len(item) - changed else None
    sums = np.concatenate([[0], np.cumsum(SHARE[1] * equal.astype(np.int64) - SHARE[0])])
    least = np.minimum.accumulate(sums)
    good = np.flatnonzero(sums[need:] >= least[: len(sums) - need]) + need
    if not len(good):
        return None
    # For an end, the first start at which the sum is small enough gives the longest run.
    starts = np.searchsorted(-least, -sums[good], side="left")
    best = int(np.argmax(good - starts))
    a, b = int(starts[best]), int(good[best])
    return low + a, b - a, int(equal[a:b].sum())


def _verify(source):
    memo = PlainWordHashes()
    for batch in pieces(source, 3):
        items = Tokens(binary_texts(batch.column(2)), memo, lower=False)
        docs = Tokens(binary_texts(batch.column(3)), memo, lower=False)
        out = []
        for row, shifts in enumerate(batch.column(4).to_pylist()):
            item = items.hashes[items.starts[row] : items.ends[row]]
            doc = docs.hashes[docs.starts[row] : docs.ends[row]]
            found = [(o[1], o[2], o[0], s) for s in shifts if (o := overlap(item, doc, s))]
            if found:
                length, equal, start, shift = max(found)
                out.append((row, start + shift, start, length, equal))
        rows = [o[0] for o in out]
        columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(1, 5)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), *columns],
            names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = SHORT_ITEM) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_equal): documents that share text with items.

    One row for each document and test item with an overlap: at least 13 aligned words
    (positions in words from 0), four fifths of them equal, case-folded and without
    punctuation around. Items of 8 to 12 words have to be there whole, with one word
    changed at most, shorter ones whole and exactly. Items of less than ``least_words`` words match nothing.

    Defined cases: null and blank texts on either side match nothing. A row whose
    doc_id or item_id is null is compared like any other and carries the null. Of rows that share
    a doc_id (or items that share an item_id) the longest overlap is given. Other columns are ignored.

    Scale: of the documents only those that pass a filter of the test hashes (16 MB at
    most, whatever the size of the benchmark) are moved, with their text, once. Hashes of a passage
    that very many documents have meet few test rows in a join that Spark can split.
    """
    spark = docs.sparkSession
    items = plain(benchmark, "item_id", "text").select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("item_text")
    )
    items = items.distinct().withColumn("item", F.xxhash64("item_id", "item_text"))
    items = stage(items, "items")
    seeds = stage(
        items.select("item", "item_text").mapInArrow(_item_seeds(least_words), "seed long, item_id long, item_at int, short int"),
        "seeds",
    )
    held, bits = seed_filter(seeds)
    short = sorted(r[0] for r in seeds.select("short").distinct().collect() if r[0])  # lengths 4 to 6 of halves and 1 to 7 of whole items
    held = spark.sparkContext.broadcast(held)
    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = named.filter("text is not null").mapInArrow(
        _doc_seeds(held, bits, short), "doc_id long, text string, hits array<struct<seed:long,doc_at:int>>"
    )
    found = stage(found.withColumn("doc", F.xxhash64("doc_id", "text")), "found")
    shifts = (
        found.select("doc", F.explode("hits").alias("hit"))
        .select("doc", "hit.seed", "hit.doc_at")
        .join(seeds, "seed")
        .select("doc", F.col("item_id").alias("item"), (F.col("doc_at") - F.col("item_at")).cast("long").alias("shift"))
        .groupBy("doc", "item")
        .agg(F.collect_set("shift").alias("shifts"))
    )
    pairs = (
        shifts.join(found.select("doc", "doc_id", "text").dropDuplicates(["doc"]), "doc")
        .join(items, "item")
        .select("doc_id", "item_id", "item_text", "text", "shifts")
    )
    shared = pairs.mapInArrow(
        _verify, "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
    )
    best = F.max(F.struct("n_words", "n_equal", "doc_start", "item_start")).alias("best")
    return (
        shared.groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "best.doc_start", "best.item_start", "best.n_words", "best.n_equal")
    )
