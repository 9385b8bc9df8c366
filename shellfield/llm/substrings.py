"""Substring deduplication: word windows that an earlier document has are removed.

Every window of ``size`` consecutive words gets a Rabin-Karp hash. The hashes are
dealt out and sorted by Spark; the smallest doc_id of a hash keeps its window, all other
documents are told the hash. The told windows of a document are merged into maximal
intervals, whose words are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import Tokens, WordHashes, as_long, batches, binary_texts, pieces, plain, stage, window_hashes

# A row that needs no partner is dealt out by key = window * SPREAD + doc, which can be turned back.
_SPREAD = 0xD1342543DE82EF95
_UNSPREAD = pow(_SPREAD, -1, 1 << 64)


def _first_of(values: np.ndarray) -> np.ndarray:
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return first


def _post(size: int):
    """One row for each window and batch, and one for each further document of the batch that has it.

    Within a batch the smallest document of a window is known to come before the others, so
    those are decided at once. What is left is one row for a window and batch, however
    many documents share it.
    """

    def run(source):
        memo = WordHashes()
        for batch in pieces(source, 1):
            tokens = Tokens(binary_texts(batch.column(1)), memo, lower=False)
            at, window = window_hashes(tokens, size)
            doc = batch.column(0).to_numpy(zero_copy_only=False)[tokens.rows()[at]]
            order = np.lexsort((doc, window))
            doc, window = doc[order], window[order]
            new = _first_of(window)
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
            decided = (doc > least) & (new | _first_of(doc))
            out = np.flatnonzero(new | decided)
            out = out[np.argsort(order[out])]  # as in the texts again: rows of one document compress well
            key, doc, known = window[out], doc[out], decided[out]
            key[known] = key[known] * np.uint64(_SPREAD) + doc[known].astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(key)), pa.array(doc), pa.array(known)], names=["key", "doc", "known"]
            )

    return run


def _tell():
    """From rows sorted by (key, doc): each document that has to drop a window, with its hash."""

    def run(source):
        last, least = None, None
        for batch in batches(source):
            key = batch.column(0).to_numpy(zero_copy_only=False)
            doc = batch.column(1).to_numpy(zero_copy_only=False)
            known = batch.column(2).to_numpy(zero_copy_only=False)
            window = (key[known].view(np.uint64) - doc[known].astype(np.uint64)) * np.uint64(_UNSPREAD)
            told_doc, told = [doc[known]], [as_long(window)]
            key, doc = key[~known], doc[~known]
            if len(key):
                new = _first_of(key)
                if last == key[0]:
                    new[0] = False
                head = np.flatnonzero(new)
                smallest = np.concatenate([[least if least is not None else doc[0]], doc[head]])[np.cumsum(new)]
                later = doc > smallest
                told_doc.append(doc[later])
                told.append(key[later])
                last, least = key[-1], smallest[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(told_doc)), pa.array(np.concatenate(told))], names=["doc", "window"]
            )

    return run


def _cut(size: int):
    def run(source):
        memo = WordHashes()
        for batch in pieces(source, 1):
            tokens = Tokens(binary_texts(batch.column(1)), memo, lower=False)
            at, window = window_hashes(tokens, size)
            told = batch.column(2)
            change = np.zeros(len(tokens.hashes) + size + 1, np.int64)
            bounds = np.searchsorted(at, np.concatenate([tokens.starts, tokens.ends[-1:]]))
            for row in np.flatnonzero(told.is_valid().to_numpy(zero_copy_only=False)):
                mine = slice(bounds[row], bounds[row + 1])
                gone = at[mine][np.isin(as_long(window[mine]), told[int(row)].values.to_numpy())]
                change[gone] += 1
                change[gone + size] -= 1
            removed = np.cumsum(change)[: len(tokens.hashes)] > 0
            kept, spans, counts = [], [], []
            for row, words in enumerate(tokens.words):
                drop = removed[tokens.starts[row] : tokens.ends[row]]
                counts.append(int(drop.sum()))
                if counts[-1]:
                    kept.append(b" ".join([w for w, d in zip(words, drop.tolist()) if not d]).decode())
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                else:
                    kept.append(b" ".join(words).decode())
                    spans.append([])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(tokens.counts),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    return run


def remove_repeated_windows(docs: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) for each row of ``docs(doc_id, text)``.

    A word goes if a window of ``size`` words over it also starts in a document with a
    smaller doc_id; ``spans`` are the maximal removed intervals [start, end) in words.

    Defined cases: null, blank and short texts have no window and lose nothing. Rows with a
    null doc_id neither lose words nor make others lose any. Rows with the same doc_id are one
    document: they do not remove each other's words, and any of them removes those of larger
    doc_ids. Other columns are ignored. Two different windows are taken for one with
    a chance of 2**-64 for each pair.

    Scale: one row of 16 bytes for a window is dealt out once; a window that a third of all
    documents has comes to its task once for each batch of texts, not for each
    document. Texts are moved once, to meet what they are told.
    """
    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    posted = named.filter("doc_id is not null and text is not null").mapInArrow(
        _post(size), "key long, doc long, known boolean"
    )
    told = (
        posted.repartition("key")
        .sortWithinPartitions("key", "doc")
        .mapInArrow(_tell(), "doc long, window long")
        .groupBy("doc")
        .agg(F.collect_set("window").alias("windows"))
    )
    told = stage(told, "windows")
    return (
        named.join(told, named["doc_id"] == told["doc"], "left")
        .select("doc_id", "text", "windows")
        .mapInArrow(
            _cut(size),
            "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string",
        )
    )
