"""Quality rules: text statistics and robust multivariate outliers.

Documents that fail a base rule are rejected. Of the others, a vector of transformed statistics is
held against a minimum-covariance-determinant (MCD) estimate of its language and source: location
and scatter of the half of the rows whose own scatter is smallest, found by
concentration steps over all rows of the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import Tokens, WordHashes, binary_texts, discard, pieces, stage, window_hashes

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5
DIMENSIONS = ("word_length", "symbols", "dup_lines", "repeats")
# Spread that is natural in clean text, added to the estimated scatter (a source of equal texts has none).
TOLERANCE = (0.1, 0.25, 0.05, 0.05)
HALF_CHI2 = 3.3566939800333224  # median of the chi-square distribution with four degrees of freedom
CUTOFF = 18.46682695290317  # 0.999 quantile of the chi-square distribution with four degrees of freedom
LEAST_ROWS = 100
KEPT_SHARE = 0.5  # up to half of a group may be copies of one bad text
STEPS = 3
SALTS = 64


def repeated_words(window: np.ndarray, n_words: int) -> int:
    """Words in windows whose hash comes twice or more; ``window`` has one hash for each start."""
    if len(window) < 2:
        return 0
    _, back, counts = np.unique(window, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[back] > 1)
    if not len(at):
        return 0
    change = np.zeros(n_words + 1, np.int64)
    change[at] += 1
    change[at + REPEAT_WINDOW] -= 1
    return int((np.cumsum(change) > 0).sum())


def _statistics(source):
    memo = WordHashes()
    blanks = b" \t\n\x0b\x0c\r"
    for batch in pieces(source, 1):
        texts = binary_texts(batch.column(1))
        tokens = Tokens(texts, memo, lower=False)
        at, window = window_hashes(tokens, REPEAT_WINDOW)
        bounds = np.searchsorted(at, np.concatenate([tokens.starts, tokens.ends[-1:]]))
        chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        repeats, symbols, dup, word_chars = [], [], [], []
        for row, text in enumerate(texts):
            repeats.append(repeated_words(window[bounds[row] : bounds[row + 1]], int(tokens.counts[row])))
            symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
            word_chars.append(int(chars[row]) - len(text) + len(text.translate(None, blanks)))
            lines = [line for line in text.split(b"\n") if line.strip()]
            dup.append(len(lines) - len(set(lines)))
        longs = [pa.array(x, pa.int64()) for x in (tokens.counts, word_chars, symbols, dup, repeats)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *longs],
            names=["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def statistics(docs: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of ``docs(row, text)``."""
    return docs.select("row", "text").mapInArrow(
        _statistics,
        "row struct<doc_id:bigint,lang:string,source:string,text_hash:bigint>, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long",
    )


def vector() -> list[Column]:
    """The transformed statistics, in the order of DIMENSIONS."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(10 * F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _groups(key: str) -> Column:
    """A row's group and the wider ones that stand in where it is too small, the narrowest first."""

    def name(*parts):
        return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})

    lang, source = F.col(f"{key}.lang").alias("lang"), F.col(f"{key}.source").alias("source")
    return F.array(
        *[
            F.struct(F.lit(i).alias("level"), g.alias("group"))
            for i, g in enumerate((name(lang, source), name(lang), F.lit("all")))
        ]
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of the array x from ``mean`` by ``inverse`` (row by row)."""
    p = len(DIMENSIONS)
    gap = [F.col("x")[i] - F.col("mean")[i] for i in range(p)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            total = total + gap[i] * gap[j] * F.col("inverse")[i * p + j]
    return total


def _moments() -> list[Column]:
    p = len(DIMENSIONS)
    x = [F.col("x")[i] for i in range(p)]
    return [
        F.count("*").alias("n"),
        F.array(*[F.avg(v) for v in x]).alias("mean"),
        F.array(*[F.avg(x[i] * x[j]) for i in range(p) for j in range(p)]).alias("product"),
    ]


def _inverted(frames):
    p = len(DIMENSIONS)
    floor = np.diag(np.square(TOLERANCE))
    for frame in frames:
        mean = np.array(frame["mean"].tolist(), float).reshape(-1, p)
        product = np.array(frame["product"].tolist(), float).reshape(-1, p, p)
        scatter = product - mean[:, :, None] * mean[:, None, :]
        scale = frame["scale"].to_numpy(float)
        inverse = np.linalg.inv(scatter * scale[:, None, None] + floor)
        yield pd.DataFrame(
            {"group": frame["group"], "n": frame["n"], "mean": list(mean), "inverse": list(inverse.reshape(-1, p * p))}
        )


def _beside(rows: DataFrame, values: DataFrame) -> DataFrame:
    """``rows`` with the one row that ``values`` has for their group; a large group is met in many tasks."""
    salted = values.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(salted, ["group", "salt"])


def mcd(rows: DataFrame, share: float = KEPT_SHARE, steps: int = STEPS) -> DataFrame:
    """(group, n, mean, inverse) from ``rows(group, x)``: location and inverse scatter of each group.

    Starts from the medians and the deviations around them, then repeats the concentration
    step: distances by the estimate, the ``share`` of rows with the smallest, their mean and
    covariance. The scatter is scaled so that the median distance is that of a normal
    distribution. All rows count in each step; sums and quantile sketches combine before the
    shuffle, so one group may hold all rows.
    """
    p = len(DIMENSIONS)
    schema = "group string, n long, mean array<double>, inverse array<double>"
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    medians = rows.groupBy("group").agg(
        F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 10000) for i in range(p)]).alias("mean")
    )
    gaps = _beside(rows, medians).select(
        "group", "mean", F.array(*[F.abs(F.col("x")[i] - F.col("mean")[i]) for i in range(p)]).alias("gap")
    )
    start = gaps.groupBy("group", "mean").agg(
        F.count("*").alias("n"),
        F.array(*[F.percentile_approx(F.col("gap")[i], 0.5, 10000) for i in range(p)]).alias("mad"),
    )
    spread = F.array(
        *[
            F.col("mean")[i] * F.col("mean")[j] + (F.pow(1.4826 * F.col("mad")[i], 2) if i == j else F.lit(0.0))
            for i in range(p)
            for j in range(p)
        ]
    )
    fit = start.select("group", "n", "mean", spread.alias("product"), F.lit(1.0).alias("scale"))
    fit = stage(fit.mapInPandas(_inverted, schema), "fit")
    for _ in range(steps):
        far = _beside(rows, fit).withColumn("d", _distance())
        cuts = far.groupBy("group").agg(
            F.percentile_approx("d", share, 10000).alias("cut"),
            F.percentile_approx("d", 0.5, 10000).alias("middle"),
            F.count("*").alias("all_rows"),
        )
        near = _beside(far.select("group", "salt", "x", "d"), cuts).filter("d <= cut")
        core = near.groupBy("group").agg(*_moments(), F.max("middle").alias("middle"), F.max("all_rows").alias("all_rows"))
        scale = F.greatest(F.lit(1.0), F.col("middle") / HALF_CHI2)
        core = core.select("group", F.col("all_rows").alias("n"), "mean", "product", scale.alias("scale"))
        after = stage(core.mapInPandas(_inverted, schema), "fit")
        discard(fit)
        fit = after
    return fit


def judge(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang, source)``: statistics and verdict.

    Columns: doc_id, lang, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance (of rows that pass the base rules), kept. A row is rejected if a base
    rule fails (fewer than 10 words, or more than a fifth of the words in repeated windows), or if its
    squared distance is over ``cutoff``, whichever statistics are off, one alone or several together.

    Defined cases: null and blank texts have no words and fail. Null languages and sources are
    groups of their own. A group with fewer than ``least_rows`` rows is judged by its language,
    then by all rows; the rows of a table smaller than that by all there are. Equal rows get equal verdicts. Other
    columns are ignored.

    Scale: one pass over the texts leaves eight numbers for each document; the steps read only those.
    """
    row = F.struct(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.col("`lang`").alias("lang"),
        F.col("`source`").alias("source"),
        F.xxhash64("`text`").alias("text_hash"),
    )
    counted = statistics(docs.select(row.alias("row"), F.col("`text`").alias("text")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed).withColumn("x", F.array(*vector()))
    counted = stage(counted, "statistics")
    passed = counted.filter(~F.col("base_failed")).withColumn("g", F.explode(_groups("row")))
    fit = mcd(passed.select("g.group", "x"))
    # The narrowest group with enough rows stands for each (lang, source).
    kinds = passed.select("row.lang", "row.source", "g.level", "g.group").distinct().join(fit, "group")
    enough = (F.col("n") >= least_rows) | (F.col("level") == 2)
    chosen = (
        kinds.filter(enough)
        .groupBy("lang", "source")
        .agg(F.min(F.struct("level", "group", "n", "mean", "inverse")).alias("fit"))
        .select(F.col("lang").alias("l"), F.col("source").alias("s"), "fit.mean", "fit.inverse")
    )
    judged = counted.join(
        chosen, F.col("row.lang").eqNullSafe(F.col("l")) & F.col("row.source").eqNullSafe(F.col("s")), "left"
    )
    distance = F.when(~F.col("base_failed"), _distance())
    return judged.withColumn("distance", distance).select(
        "row.doc_id", "row.lang", "row.source", "row.text_hash",
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))).alias("kept"),
    )


def drop_rejected(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    bad = judge(docs, **settings).filter(~F.col("kept"))
    bad = bad.select(*[F.col(c).alias(f"bad_{c}") for c in ("doc_id", "lang", "source", "text_hash")]).distinct()
    same = F.xxhash64(docs["text"]) == bad["bad_text_hash"]
    for c in ("doc_id", "lang", "source"):
        same &= docs[c].eqNullSafe(bad[f"bad_{c}"])
    return docs.join(bad, same, "left_anti")
