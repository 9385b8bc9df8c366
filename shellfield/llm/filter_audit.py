"""What filters remove together and alone, by the Hart-Mas-Colell potential of the removal game.

Filters are players; the worth v(S) of a coalition S is the number of documents that at least
one filter of S fails. The potential is P(S) = (v(S) + the sum of P(S without i) over i in S) / |S|,
P of nobody 0, and the Shapley value of filter i is P(all) - P(all without i). A filter run right after
the filters of S removes v(S with i) - v(S), which gives every step of every order.

Coalitions are bit masks. All worths of a part come from its counts by set of failed filters, which are made on
the map side; potentials are exact whole numbers, kept times the least common multiple of the sizes.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import BLANKS, plain, stage

MOST_FILTERS = 6


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of each row of ``docs(doc_id, text, lang)``.

    A: under 100 words. B: 100 * distinct words < 80 * words. C: 100 * characters A-Z > 10 * code
    points. D: any of ``#$%&*|``. E: the text of a row with a smaller doc_id, anywhere in the table.

    Defined cases: null texts are empty; a null lang is the part ''. A null doc_id is neither smaller nor
    larger than another: such rows are no copies and make none. Rows with the same doc_id and text
    are not copies of each other. Other columns are ignored.

    Scale: texts are read once and never move; what moves is 32 bytes of SHA-256, the
    doc_id and four bits. Only texts that come twice or more are joined back, from a staged
    table, so that Spark can split the rows of one frequent text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = word_list(text)
    rows = plain(docs, "doc_id", "text", "lang").select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("different")).alias("w"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"),
        F.length(text).alias("length"),
        text.rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = stage(
        rows.select(
            "doc_id",
            "part",
            "digest",
            (F.col("w.n") < 100).alias("A"),
            (F.col("w.different").cast("long") * 100 < F.col("w.n").cast("long") * 80).alias("B"),
            (F.col("capitals").cast("long") * 100 > F.col("length").cast("long") * 10).alias("C"),
            "D",
        ),
        "failures",
    )
    copies = (
        rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").drop("n")
    )
    copies = stage(copies, "copies")
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return rows.join(copies, "digest", "left").select("doc_id", "part", "A", "B", "C", "D", later.alias("E"))


def audit(failures: DataFrame, filters: list[str], part: str, losses: list[str]) -> DataFrame:
    """One row for each part, order of all filters and step.

    ``failures`` has a boolean column for each filter (names of one letter or digit, at most six) and one for each
    of ``losses`` (documents whose removal is a loss of that kind); nulls count as false.
    Columns: part, filter_order, step (from 1; its filter is that letter of the order), kept, removed, redundant (fail
    the filter, removed earlier), unique_fails (fail this filter alone), one column for each
    loss (removed in this step), shapley (removed at any step, summed over all orders).

    Defined cases: a null part is a part of its own; without rows there are no parts. Filters that
    nothing fails have rows of zeros.

    Scale: one grouping by part and set of failed filters, in which every task sends 2 ** n rows at most
    for each of its parts; worths are sums over those. The n! orders of n filters are literals.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or any(len(f) != 1 or not f.isalnum() for f in filters) or len(set(filters)) != n:
        raise ValueError(f"from 1 to {MOST_FILTERS} different filters with names of one letter or digit")
    everyone = (1 << n) - 1
    bits = [1 << i for i in range(n)]
    mask = sum((F.coalesce(F.col(f"`{f}`"), F.lit(False)).cast("int") * b for f, b in zip(filters, bits)), F.lit(0))
    games = ["removed", *losses]
    rows = failures.select(
        F.col(f"`{part}`").alias("part"),
        mask.alias("mask"),
        *[F.coalesce(F.col(f"`{x}`"), F.lit(False)).alias(f"in_{k}") for k, x in enumerate(losses, 1)],
    )

    counted = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n0"), *[F.count_if(F.col(f"in_{k}")).alias(f"n{k}") for k in range(1, len(games))]
    )

    def worth(game: int, coalition: int) -> Column:
        return F.sum(F.when(F.col("mask").bitwiseAND(coalition) != 0, F.col(f"n{game}")).otherwise(0))

    worths = counted.groupBy("part").agg(
        F.sum("n0").alias("total"),
        *[F.array(*[worth(k, s) for s in range(everyone + 1)]).alias(f"v{k}") for k in range(len(games))],
    )

    # Potentials by size of the coalition; times ``scale`` they are whole numbers, and so is every division.
    scale = lcm(*range(1, n + 1))
    potential = worths.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, n + 1):
        potential = potential.withColumns(
            {
                f"p{s}": F.expr(
                    f"({scale} * v0[{s}] + " + " + ".join(f"p{s ^ b}" for b in bits if s & b) + f") div {size}"
                )
                for s in range(1, everyone + 1)
                if s.bit_count() == size
            }
        )
    share = [F.expr(f"(p{everyone} - p{everyone ^ b}) * {factorial(n)} div {scale}") for b in bits]
    parts = potential.select("part", "total", *[f"v{k}" for k in range(len(games))], F.array(*share).alias("shapley"))

    # The bit of the filter that stands at place {} of the order.
    bit = f"shiftleft(1, instr('{''.join(filters)}', substring(filter_order, {{}}, 1)) - 1)"
    steps = (
        parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("own", F.expr(bit.format("step")))
        .withColumn(
            "before", F.expr(f"aggregate(sequence(0, step - 1), 0, (s, i) -> s + if(i = 0, 0, {bit.format('i')}))")
        )
    )

    def gain(game: int) -> Column:
        return F.expr(f"v{game}[before | own] - v{game}[before]")

    return steps.select(
        "part",
        "filter_order",
        "step",
        F.expr("total - v0[before | own]").alias("kept"),
        gain(0).alias("removed"),
        F.expr("v0[own] - (v0[before | own] - v0[before])").alias("redundant"),
        F.expr(f"v0[{everyone}] - v0[{everyone} ^ own]").alias("unique_fails"),
        *[gain(k).alias(x) for k, x in enumerate(losses, 1)],
        F.expr(f"shapley[instr('{''.join(filters)}', substring(filter_order, step, 1)) - 1]").alias("shapley"),
    )


def audit_text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of ``text_failures`` by language, with good_lost and toxic_lost.

    ``labels(doc_id, quality, toxic)``: a document is good if a label row of its doc_id has quality 1,
    toxic if one has toxic 1; documents without labels are neither.
    """
    failures = text_failures(docs)
    label = (
        plain(labels, "doc_id", "quality", "toxic")
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.max(F.col("quality") == 1).alias("good_lost"), F.max(F.col("toxic") == 1).alias("toxic_lost"))
    )
    joined = failures.join(label, failures["doc_id"] == label["labelled"], "left")
    return audit(joined, list("ABCDE"), "part", ["good_lost", "toxic_lost"])
