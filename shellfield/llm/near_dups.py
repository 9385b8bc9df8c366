"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each document is sketched: the hash of its set of word shingles and a MinHash signature.
   Documents with equal sets are one class with one representative.
2. A representative is posted under each of its coordinate values. A coordinate is ``ROWS``
   MinHash values together; single values would put all texts with a common passage into one list.
3. A list with two or more documents is merged in blocks. The collisions of a
   document with those not yet reached are counted on the signatures; pairs that
   are already connected are skipped. Pairs above the match threshold connect,
   and a block returns only the edges of a spanning forest.
4. The groups found this way are joined with their texts, and links are confirmed on the full
   sets, again block by block with connected pairs skipped.

Prefix: of ``COORDINATES`` coordinates all are posted, so a pair with a similarity of 0.8 has
none in common with a chance of 0.59 ** 40 < 1e-9. The threshold of 96 of 160 equal values
is more than six standard deviations below the 128 that such a pair has on average.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import Tokens, WordHashes, as_long, batches, binary_texts, discard, mix, pieces
from shellfield.llm.common import plain, stage, window_hashes
from shellfield.llm.components import components

COORDINATES, ROWS = 40, 4
VALUES = COORDINATES * ROWS
LEAST_MATCHES = 96
BLOCK_DOCS = 2048
BLOCK_SHINGLES = 2_000_000

_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[bytes], memo: WordHashes, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    A text with fewer than ``size`` words has one shingle, the whole sequence.
    """
    tokens = Tokens(texts, memo)
    at, shingle = window_hashes(tokens, size)
    bounds = np.searchsorted(at, np.concatenate([tokens.starts, tokens.ends[-1:]]))
    sets = []
    for row, n in enumerate(tokens.counts.tolist()):
        if n >= size:
            sets.append(np.unique(shingle[bounds[row] : bounds[row + 1]]))
        elif n:
            value = np.uint64(n)
            for h in tokens.hashes[tokens.starts[row] : tokens.ends[row]]:
                value = mix(np.array([value ^ h], np.uint64))[0]
            sets.append(np.array([value], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """VALUES MinHash values of 16 bits for each non-empty set, in blocks that stay in the cache."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    cuts = np.cumsum(sizes[full]) // block
    for rows in np.split(full, np.flatnonzero(np.diff(cuts)) + 1) if len(full) else []:
        joined = np.concatenate([sets[r] for r in rows])
        x = (joined ^ (joined >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        least = np.empty((VALUES, len(rows)), np.uint32)
        y = np.empty_like(x)
        for j in range(VALUES):
            np.bitwise_xor(x, _XOR[j], out=y)
            np.multiply(y, _TIMES[j], out=y)
            least[j] = np.minimum.reduceat(y, starts)
        out[rows] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).T
    return out


def _sketch(size: int):
    def run(source):
        memo = WordHashes()
        for batch in pieces(source, 1):
            sets = shingle_sets(binary_texts(batch.column(1)), memo, size)
            both = [(np.add.reduce(s), np.bitwise_xor.reduce(mix(s))) if len(s) else (0, 0) for s in sets]
            signs = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(as_long(np.array([x for x, _ in both], np.uint64))),
                    pa.array(as_long(np.array([x for _, x in both], np.uint64))),
                    pa.array([s.tobytes() for s in signs], pa.binary()),
                ],
                names=["doc_id", "n", "a", "b", "sign"],
            )

    return run


def _postings(source):
    step = np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches(source):
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, COORDINATES)
        keys = mix(mix(signs) + step)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), COORDINATES)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(keys.ravel())), pa.array(ids)], names=["key", "id"])


def _groups(source, width: int):
    """Rows of equal leading ``width`` columns of a sorted stream, as one batch each."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches(source):
        lead = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        new = np.zeros(batch.num_rows, bool)
        for x in lead:
            new[1:] |= x[1:] != x[:-1]
        first = tuple(x[0] for x in lead)
        new[0] = before is not None and first != before
        cuts = np.flatnonzero(new)
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches([h for h in held if h.num_rows]).combine_chunks()
            held, at = [], cut
        held.append(batch.slice(at))
        before = tuple(x[-1] for x in lead)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0..n-1; near(u, others) tells which of others u is linked with.

    A node is compared only with those that nothing has reached yet.
    """
    left = np.arange(n)
    edges = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = near(u, left)
            edges += [(u, v) for v in left[hit].tolist()]
            queue += left[hit].tolist()
            left = left[~hit]
    return edges


def _edge_batches(found, size: int = 50_000):
    pairs: list[tuple[int, int]] = []
    for more in found:
        pairs += more
        if len(pairs) >= size:
            yield _edge_batch(pairs)
            pairs = []
    yield _edge_batch(pairs)


def _edge_batch(pairs):
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _merge_lists(least: int, percent: int):
    """Rows (key, left, right, id, n, sign) sorted by block -> edges between signatures that match."""

    def block(group: pa.Table):
        ids, n = group.column(3).to_numpy(), group.column(4).to_numpy()
        signs = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint16).reshape(-1, VALUES)

        def near(u, others):
            hit = (signs[others] == signs[u]).sum(1) >= least
            small, large = np.minimum(n[others], n[u]), np.maximum(n[others], n[u])
            return hit & (100 * small >= percent * large)

        return [(ids[u], ids[v]) for u, v in _forest(len(ids), near) if ids[u] != ids[v]]

    def run(source):
        yield from _edge_batches(block(g) for g in _groups(source, 3))

    return run


def _confirm(size: int, percent: int):
    """Rows (group, left, right, id, text) sorted by block -> edges between sets that are similar."""

    def block(group: pa.Table, memo):
        ids = group.column(3).to_numpy()
        sets = shingle_sets(binary_texts(group.column(4).combine_chunks()), memo, size)
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(-sizes, kind="stable")
        _, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        ids, sizes = ids[order], sizes[order]
        ends = np.cumsum(sizes)
        mark = np.zeros(codes.max() + 1 if len(codes) else 1, np.int64)

        def near(u, others):
            hit = np.zeros(len(others), bool)
            close = np.flatnonzero(
                (100 * np.minimum(sizes[others], sizes[u]) >= percent * np.maximum(sizes[others], sizes[u]))
                & (sizes[others] > 0)
            )
            if not len(close):
                return hit
            there = others[close]
            mine = codes[ends[u] - sizes[u] : ends[u]]
            mark[mine] = 1
            lengths = sizes[there]
            starts = np.cumsum(lengths) - lengths
            take = np.arange(lengths.sum()) + np.repeat(ends[there] - lengths - starts, lengths)
            common = np.add.reduceat(mark[codes[take]], starts)
            mark[mine] = 0
            hit[close] = 100 * common >= percent * (sizes[u] + lengths - common)
            return hit

        return [(ids[u], ids[v]) for u, v in _forest(len(ids), near) if ids[u] != ids[v]]

    def run(source):
        memo = WordHashes()
        yield from _edge_batches(block(g, memo) for g in _groups(source, 3))

    return run


def _in_blocks(members: DataFrame, by: str, parts) -> DataFrame:
    """``members(<by>, id, ..., parts)`` with the blocks (left, right) that a member belongs to.

    A group in p parts becomes p * (p + 1) / 2 blocks of two parts each, so any two members
    meet, and a block stays small however large the group is.
    """
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    blocks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda other: F.struct(F.least(part, other).alias("left"), F.greatest(part, other).alias("right")),
    )
    return members.withColumn("block", F.explode(blocks)).select(
        by, "block.left", "block.right", *[c for c in members.columns if c not in (by, "parts")]
    )


def _dealt(blocks: DataFrame, by: str) -> DataFrame:
    return blocks.repartition(by, "left", "right").sortWithinPartitions(by, "left", "right")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``.

    Words are lower-cased (A-Z). Two documents are linked if 100 times the size of the
    intersection of their shingle sets is at least ``percent`` times that of the union;
    component_id is the smallest doc_id that links lead to, and kept marks that document.

    Defined cases: null and blank texts have no shingle and are linked with nothing. Equal
    texts are linked. Rows with a null doc_id are linked with nothing, have a null component_id
    and are kept. Rows with the same doc_id are one document as far as links go; each of them
    that is its component's smallest is kept. Other columns are ignored.

    Scale: postings are 16 bytes for each of 40 coordinates; signatures travel only to lists
    with two or more documents, texts only to the groups found. Groups of any size are
    cut into blocks; equal texts cost one row. No group is listed as pairs.
    """
    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stage(named.mapInArrow(_sketch(size), "doc_id long, n long, a long, b long, sign binary"), "sketch")
    linkable = sketch.filter("n > 0 and doc_id is not null")
    classes = (
        linkable.groupBy("a", "b")
        .agg(F.min(F.struct("doc_id", "n", "sign")).alias("first"))
        .select("a", "b", F.col("first.doc_id").alias("id"), "first.n", "first.sign")
    )
    classes = stage(classes, "classes")

    posted = stage(classes.select("id", "sign").mapInArrow(_postings, "key long, id long"), "postings")
    lists = posted.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    lists = lists.select("key", F.ceil(F.col("m") / BLOCK_DOCS).cast("long").alias("parts"))
    members = posted.join(lists, "key").join(classes.select("id", "n", "sign"), "id")
    blocks = _in_blocks(members.select("key", "id", "n", "sign", "parts"), "key", "parts")
    matches = stage(
        _dealt(blocks, "key").mapInArrow(_merge_lists(LEAST_MATCHES, percent), "a long, b long"), "matches"
    )
    discard(posted)

    groups = components(matches)
    groups = groups.union(groups.select(F.col("component").alias("node"), "component")).distinct()
    groups = groups.join(classes.select(F.col("id").alias("node"), "n"), "node")
    groups = stage(groups, "groups")
    discard(matches)
    weights = groups.groupBy("component").agg(
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("parts")
    )
    texts = named.join(groups, named["doc_id"] == groups["node"]).join(weights, "component")
    blocks = _in_blocks(texts.select("component", F.col("doc_id").alias("id"), "text", "parts"), "component", "parts")
    links = stage(_dealt(blocks, "component").mapInArrow(_confirm(size, percent), "a long, b long"), "links")

    linked = components(links)
    discard(groups, links)
    joined = (
        sketch.select("doc_id", "n", "a", "b")
        .join(classes.select("a", "b", "id"), ["a", "b"], "left")
        .join(linked, F.col("id") == F.col("node"), "left")
    )
    component = F.when(
        (F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "id")
    ).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
