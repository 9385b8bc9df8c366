"""Line deduplication with levelled sorted runs of line hashes.

A run is a staged table (a, b, n): the two hashes of a line key and the number of documents
that have it, sorted by hash. A batch of documents is first anti-joined with the keys
that the runs already know to be frequent, and what is left becomes a run of level 0. When a
level holds ``fanout`` runs they are merged into one run of the next level, so k batches leave
about log(k) runs, and a key is rewritten log(k) times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import BLANKS, discard, lower_ascii, plain, stage


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hashes(key: Column) -> Column:
    """128 bits of a line key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


class LineRuns:
    """Document counts of line keys over batches of documents."""

    def __init__(self, min_docs: int, fanout: int = 3):
        self.min_docs = min_docs
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        return reduce(DataFrame.unionAll, runs).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame | None:
        """(a, b) of the keys that at least ``min_docs`` documents have so far."""
        found = self._all()
        return None if found is None else found.filter(F.col("n") >= self.min_docs).select("a", "b")

    def add(self, batch: DataFrame) -> None:
        """Adds (doc, a, b), each once for a document; no document comes in two batches."""
        known = self.frequent()
        if known is not None:  # staged, so that Spark may split a frequent key's side of the join
            known = stage(known, "frequent")
            batch = batch.join(known, ["a", "b"], "left_anti")
        self._put(0, batch.groupBy("a", "b").agg(F.count("*").alias("n")))
        if known is not None:
            discard(known)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        here = self.levels[level]
        here.append(stage(run.sortWithinPartitions("a", "b"), f"run{level}"))
        if len(here) >= self.fanout:
            self.levels[level] = []
            merged = reduce(DataFrame.unionAll, here).groupBy("a", "b").agg(F.sum("n").alias("n"))
            self._put(level + 1, merged)
            discard(*here)

    def close(self) -> None:
        discard(*[r for level in self.levels for r in level])
        self.levels = []


def cut_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int = 4, fanout: int = 3
) -> DataFrame:
    """(row, cut) for each row of ``docs``: its columns as one struct, and kept_text, n_lines, n_dropped as another.

    A line goes if its key (blanks stripped at both ends, A-Z lower-cased) has at least
    ``min_chars`` code points and at least ``min_docs`` documents have it. The result does not
    depend on ``n_batches`` and ``fanout``.

    Defined cases: null and empty texts have one empty line. Rows with the same doc_id are
    one document, also those with a null doc_id, and lose their lines all the same. Other columns are
    carried inside of the struct, whatever their names.

    Scale: hashes are moved, and texts once to meet the hashes they lose. Counts are summed
    before they are shuffled; the join of lines with frequent keys is one that Spark
    splits where a key is hot.
    """
    keys = plain(docs, "doc_id", "text").select(
        "doc_id",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter(lines_of(F.col("text")), lambda x: F.length(line_key(x)) >= F.lit(min_chars)),
                    lambda x: key_hashes(line_key(x)),
                )
            )
        ).alias("k"),
    )
    keys = keys.select(F.col("doc_id").alias("doc"), "k.a", "k.b").distinct()
    keys = stage(keys.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(n_batches)).cast("int")), "lines")
    runs = LineRuns(min_docs, fanout)
    for part in range(n_batches):
        runs.add(keys.filter(F.col("part") == part).drop("part"))
    frequent = stage(runs.frequent(), "frequent")
    runs.close()
    hit = (
        keys.join(frequent, ["a", "b"], "left_semi")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("a", "b")).alias("frequent_keys"))
    )
    hit = stage(hit, "hits")
    discard(keys, frequent)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Always by shuffle: a broadcast at small sizes would say nothing about large ones.
    joined = rows.join(hit.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("doc")), "left")
    text = F.coalesce("row.text", F.lit(""))
    lines = lines_of(text)
    left = F.filter(lines, lambda x: ~F.array_contains(F.col("frequent_keys"), key_hashes(line_key(x))))
    cut = F.struct(
        F.coalesce(F.array_join("left", "\n"), text).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("left").isNotNull(), F.size(lines) - F.size("left")).otherwise(0).cast("long").alias("n_dropped"),
    )
    joined = joined.select("row", F.when(F.col("frequent_keys").isNotNull(), left).alias("left"))
    return joined.select("row", cut.alias("cut"))


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int = 4, fanout: int = 3
) -> DataFrame:
    """Each row of ``docs`` with all its columns, and kept_text, n_lines, n_dropped of ``cut_frequent_lines``.

    Columns of docs that have one of these three names are replaced; all others stay as they are.
    """
    cut = cut_frequent_lines(docs, min_docs, min_chars, n_batches, fanout)
    new = ("kept_text", "n_lines", "n_dropped")
    return cut.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in new],
        *[F.col(f"cut.{c}").alias(c) for c in new],
    )
