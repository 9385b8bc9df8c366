"""Model run: clean, split, weight, train, fine-tune and score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.functions import constants as k
from shellfield.operators import cleaning, forest, scoring, split
from shellfield.session import stage
from shellfield.sources.tables import in_feature_order


@dataclass
class ModelRun:
    models: list[RandomForestClassificationModel]
    initial: DataFrame
    final: DataFrame
    delta: DataFrame | None
    baseline: DataFrame
    report: DataFrame
    test: DataFrame | None


def prepared(df: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "class") -> DataFrame:
    rows = cleaning.drop_missing_label(cleaning.repair_types(df, label=label), label)
    return in_feature_order(rows, features, [*keys, label])


def run(
    train: DataFrame,
    features: Sequence[str] = k.FEATURE_COLUMNS,
    keys: Sequence[str] = ("file_name", "x", "y", "z"),
    label: str = "class",
    finetune: DataFrame | None = None,
    test: DataFrame | None = None,
    settings: forest.ForestSettings = forest.ForestSettings(),
    by_group: str | None = "file_name",
) -> ModelRun:
    """The whole model run as tables of metrics.

    ``by_group`` keeps all points of one structure on one side of the split;
    None splits by row, with exact class shares, as the published runs do.
    Weights come from the training part only.
    """
    keys = list(keys)
    seed = str(settings.seed)
    rows = prepared(train, features, keys, label)
    if by_group:
        rows = split.group_split(rows, by_group, settings.validation_size, seed)
    else:
        rows = split.stratified_split(rows, keys, label, settings.validation_size, seed)
    rows = stage(rows, "split")
    fit_rows, held = rows.filter("part = 'train'"), rows.filter("part = 'validation'")

    def scored(part, models):
        """Scored rows, written once: the metrics read them several times."""
        rows = forest.predict(part, models, features)
        return stage(rows.select(*keys, F.col(f"`{label}`").alias("label"), "prediction", "score"), "scored")

    models = [forest.train(fit_rows, features, label, settings)]
    first = last = scored(held, models)
    initial = scoring.evaluate(first)
    final, delta = initial, None
    if finetune is not None:
        models.append(forest.finetune(prepared(finetune, features, keys, label), features, label, settings))
        last = scored(held, models)
        final = scoring.evaluate(last)
        delta = scoring.metric_delta(initial, final)
    shares = split.class_distribution(fit_rows, label).first()
    share = shares["class_1"] / shares["total"] if shares["total"] else 0.0
    guessed = scoring.dummy_baseline(held.withColumnRenamed(label, "label"), keys, share, seed)
    tested = None
    if test is not None:
        tested = scoring.evaluate(scored(prepared(test, features, keys, label), models))
    return ModelRun(
        models,
        initial,
        final,
        delta,
        scoring.evaluate(guessed),
        scoring.classification_report(last),
        tested,
    )
