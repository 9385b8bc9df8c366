"""Exact metrics of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellfield.functions.scalars import hash_order, ratio
from shellfield.operators.order_stats import running_totals

COUNTS = ["tp", "fp", "tn", "fn"]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = []) -> DataFrame:
    """tp, fp, tn and fn in one pass, optionally per group."""
    y, p = _q(label), _q(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def metric_columns() -> dict[str, Column]:
    """Metrics from the four counts; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in COUNTS)
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # Balanced accuracy averages over the classes that occur.
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": ratio(recall + specificity, present.cast("double")),
        "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "iou": ratio(tp, tp + fp + fn),
        "specificity": specificity,
        "sensitivity": recall,
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
    }


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = []
) -> DataFrame:
    counts = confusion_matrix(df, label, prediction, by)
    return counts.select(*by, *COUNTS, *[c.alias(n) for n, c in metric_columns().items()])


def long_metrics(metrics: DataFrame) -> DataFrame:
    """A metrics row as (metric, value) rows."""
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in metrics.columns if n not in COUNTS]
    return metrics.select(F.inline(F.array(*entries)))


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two (metric, value) tables side by side with their difference."""
    return before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric").withColumn(
        "delta", F.col("after") - F.col("before")
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    c = confusion_matrix(df, label, prediction)
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")

    def part(name, hit, wrong, missed):
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(F.lit(2.0) * hit, F.lit(2.0) * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    c = c.withColumn("c0", part("0", F.col("tn"), F.col("fn"), F.col("fp")))
    c = c.withColumn("c1", part("1", F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("total", total)
    names = ["precision", "recall", "f1"]
    macro = [((F.col(f"c0.{m}") + F.col(f"c1.{m}")) / 2).alias(m) for m in names]
    weighted = [
        ratio(F.col(f"c0.{m}") * F.col("c0.support") + F.col(f"c1.{m}") * F.col("c1.support"), F.col("total")).alias(m)
        for m in names
    ]
    accuracy = [ratio(F.col("tp") + F.col("tn"), F.col("total")).alias(m) for m in names]
    rows = [
        F.col("c0"),
        F.col("c1"),
        F.struct(F.lit("accuracy").alias("class"), *accuracy, F.col("total").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), *macro, F.col("total").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), *weighted, F.col("total").alias("support")),
    ]
    return c.select(F.inline(F.array(*rows)))


def curve(df: DataFrame, label: str = "label", score: str = "score", rows_per_bucket: int = 2_000_000) -> DataFrame:
    """Positives and negatives per distinct score, with totals from the highest score down."""
    per_score = (
        df.filter(_q(label).isNotNull() & _q(score).isNotNull())
        .groupBy(_q(score).cast("double").alias("score"))
        .agg(F.count_if(_q(label) == 1).alias("pos"), F.count_if(_q(label) == 0).alias("neg"))
    )
    return running_totals(per_score, "score", ["pos", "neg"], rows_per_bucket)


def auc(df: DataFrame, label: str = "label", score: str = "score", rows_per_bucket: int = 2_000_000) -> DataFrame:
    """ROC-AUC (ties count half) and average precision in one row; null for a single class."""
    points = curve(df, label, score, rows_per_bucket)
    pos, cum_pos, cum_neg = (F.col(c).cast("double") for c in ("pos", "cum_pos", "cum_neg"))
    below = F.sum("neg").cast("double")
    # sum of pos * (negatives with a lower score + half of the ties)
    seen = F.sum(pos * (cum_neg - F.col("neg") / 2.0))
    totals = points.agg(
        F.sum("pos").cast("double").alias("p"),
        below.alias("n"),
        seen.alias("above"),
        F.sum(pos * cum_pos / (cum_pos + cum_neg)).alias("steps"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return totals.select(
        F.when(both, F.lit(1.0) - F.col("above") / (F.col("p") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.col("steps") / F.col("p")).alias("pr_auc"),
    )


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """All metrics as (metric, value) rows."""
    areas = auc(df, label, score)
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in areas.columns]
    return long_metrics(classification_metrics(df, label, prediction)).unionByName(areas.select(F.inline(F.array(*entries))))


def leaderboard(metrics: DataFrame, by: str = "iou") -> DataFrame:
    """Models ranked by one metric, best first; equal values share a rank.

    One row per model comes in, so a single window is enough.
    """
    from pyspark.sql import Window

    ranked = metrics.withColumn("rank", F.rank().over(Window.orderBy(F.desc(by))))
    return ranked.orderBy("rank")


def dummy_baseline(df: DataFrame, key: list[str], positive_share: float, seed: str = "0") -> DataFrame:
    """Random predictions that keep the class shares; the same on every run."""
    uniform = F.conv(F.substring(hash_order(seed, *[_q(c) for c in key]), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return df.withColumn("prediction", (uniform < F.lit(float(positive_share))).cast("int")).withColumn(
        "score", F.col("prediction").cast("double")
    )
