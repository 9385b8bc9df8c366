"""Mixing sources to target weights with a low-discrepancy schedule.

The documents of a source are put into a shuffled order, one after the other, and their words
are cut into blocks of equal size. The mix is a sequence of slots of one block; slot i goes to the source
whose interval of cumulative weights, by blocks, holds the i-th point of the golden-ratio sequence, so every
stretch of the schedule is close to the weights. The r-th slot of a source takes
its block r, and starts over when the blocks are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellfield.llm.common import stage, word_count

WEIGHTS = (5, 2, 1)
GOLDEN = 0.6180339887498949
SLOT_CHUNK = 1 << 12
DOC_CHUNK = 1 << 12


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) from ``sizes(source, source_size)``.

    ``share`` of all words is dealt out by weight; no target exceeds ``most`` times its source,
    and what is over goes to the others by weight. Filling by weight stops at a source in the
    order of size per weight, so the sources that stop are a prefix of that order.
    """
    in_order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    by_room = (F.col("source_size") / F.col("weight")).asc()
    before = Window.partitionBy().orderBy(by_room, F.col("source").asc_nulls_last())
    filled = before.rowsBetween(Window.unboundedPreceding, -1)
    rest = before.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(filled), F.lit(0))
    ) / F.sum("weight").over(rest)
    steps = weighed.withColumn("level", level).withColumn(
        "stops", most * F.col("source_size") <= F.col("level") * F.col("weight")
    )
    common = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return steps.withColumn(
        "target",
        F.when(F.col("stops") | common.isNull(), most * F.col("source_size")).otherwise(common * F.col("weight")),
    ).select("source", "source_size", "weight", F.col("target").cast("double"))


def running(df: DataFrame, groups: list[str], chunk: str, order: list, value) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows in front, in each group.

    Rows are ordered by chunk, then ``order``. A chunk is summed first, the chunk sums are added
    up, and only the rows of one chunk are ordered together, however large a group is.
    """
    sums = df.groupBy(*groups, chunk).agg(F.sum(value).alias("chunk_sum"))
    in_group = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("chunk_start", F.coalesce(F.sum("chunk_sum").over(in_group), F.lit(0))).drop("chunk_sum")
    in_chunk = Window.partitionBy(*groups, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("inner", F.coalesce(F.sum(value).over(in_chunk), F.lit(0)))
    return (
        inner.join(offsets, [*groups, chunk])
        .withColumn("before", (F.col("chunk_start") + F.col("inner")).cast("long"))
        .drop("chunk_start", "inner")
    )


def schedule(aimed: DataFrame) -> DataFrame:
    """``aimed(source, source_size, target, n)`` with what each source has in the schedule.

    block is its size of a block: a 512th of its target, between 1 and 2048 words, so that a small source does not cut
    the others into small pieces. Of all n_slots it has those whose point is from low up to high; the interval is as
    wide as its number of blocks is large.
    """
    block = F.greatest(F.lit(1), F.least(F.lit(2048), F.floor(F.col("target") / 512))).cast("long")
    upper = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    sized = aimed.withColumn("block", block).withColumn("wanted", F.col("target") / F.col("block"))
    end = F.sum("wanted").over(upper.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("wanted").over(Window.partitionBy())
    return sized.select(
        F.row_number().over(upper).alias("sid"),
        "source", "source_size", "target", "n", "block",
        F.try_divide(end - F.col("wanted"), total).alias("low"),
        F.try_divide(end, total).alias("high"),
        F.lead(F.lit(False), 1, True).over(upper).alias("last"),
        F.ceil(total).cast("long").alias("n_slots"),
        F.ceil(F.col("source_size") / F.col("block")).cast("long").alias("n_blocks"),
    )


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs(doc_id, source, text)``.

    ``taken`` is the number of the document's words in the mix, repeats counted. All words of a
    source lie in blocks of one size: a 512th of its target, between 1 and 2048 words. A source takes its target up to a few blocks, and no document more than ``most`` times
    its size.

    Defined cases: null and blank texts have size 0 and take nothing. Null is a source of
    its own, the last one. Rows with the same doc_id are single documents. The order depends on hashes of
    doc_id and text only, so reruns agree; equal rows may change places, which changes nothing.
    An empty table gives an empty mix. Other columns are ignored.

    Scale: running sums are taken by chunks of about 4,000 documents or slots; blocks and
    slots meet by (source, block), and texts are never moved.
    """
    text_hash = F.xxhash64("doc_id", "text")
    sized = docs.select(
        F.col("`doc_id`").alias("doc_id"),
        F.col("`source`").alias("source"),
        word_count(F.col("`text`")).alias("size"),
        text_hash.alias("place"),
    )
    sized = stage(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aimed = targets(per_source.select("source", "source_size"), share, most, weights).join(
        per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))
    )
    aimed = stage(schedule(aimed), "targets")

    n_slots = aimed.agg(F.max("n_slots")).first()[0] or 0
    spark = docs.sparkSession
    point = (F.col("id") + 0.5) * F.lit(GOLDEN)
    slots = spark.range(n_slots).select("id", (point - F.floor(point)).alias("point"))
    inside = (F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | F.col("last"))
    ranges = aimed.filter("target > 0").select("sid", "low", "high", "last", "n_blocks")
    # The unit interval in 1,024 cells, so that a point meets only the sources of its cell.
    cells = ranges.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * 1024), F.least(F.floor(F.col("high") * 1024), F.lit(1023))))
    )
    dealt = (
        slots.withColumn("cell", F.floor(F.col("point") * 1024))
        .join(cells, "cell")
        .filter(inside)
        .select("sid", "n_blocks", "id", F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"))
    )
    ranked = running(dealt, ["sid"], "chunk", [F.col("id")], F.lit(1))
    # A source whose target is all it may take can get a slot more than it has blocks; that slot stays empty.
    taken = (
        ranked.filter(F.col("before") < F.floor(most * F.col("n_blocks")))
        .groupBy("sid", F.pmod("before", "n_blocks").alias("block_id"))
        .agg(F.count("*").alias("times"))
    )

    placed = sized.join(
        aimed.select(F.col("source").alias("s"), "sid", "source_size", "target", "n", "block"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / DOC_CHUNK))
    shuffled = F.xxhash64(F.lit(7), "place")
    placed = placed.withColumn("chunk", F.pmod(shuffled, n_chunks))
    placed = running(placed, ["sid"], "chunk", [F.col("place"), F.col("doc_id"), F.col("size")], F.col("size"))
    placed = stage(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    # The parts of a document in each block that it touches.
    pieces = (
        placed.filter("size > 0")
        .select(
            "row", "sid", "before", "size", "block",
            F.explode(
                F.sequence(
                    F.floor(F.col("before") / F.col("block")),
                    F.floor((F.col("before") + F.col("size") - 1) / F.col("block")),
                )
            ).alias("block_id"),
        )
        .withColumn(
            "part",
            F.least(F.col("before") + F.col("size"), (F.col("block_id") + 1) * F.col("block"))
            - F.greatest(F.col("before"), F.col("block_id") * F.col("block")),
        )
    )
    got = (
        pieces.join(taken, ["sid", "block_id"])
        .groupBy("row")
        .agg(F.sum(F.col("part") * F.col("times")).alias("taken"))
    )
    return (
        placed.join(got, "row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
