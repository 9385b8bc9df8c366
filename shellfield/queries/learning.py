"""Registered queries: splits, balance, metrics and the forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from shellfield.operators import bagging, forest, importance, scoring, split
from shellfield.queries import views as v
from shellfield.queries.base import Registry
from shellfield.session import dealt, stage

registry = Registry()
query = registry.query


def order_rows(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("class")
    )


_ORDERS = "rows as (select o_orderkey, o_custkey, (o_orderpriority = '1-URGENT')::int as class from orders)"
_RANKED = f"""with {_ORDERS}, ranked as (select *, count(*) over (partition by class) as n,
  row_number() over (partition by class order by md5('0|' || o_orderkey), o_orderkey) as place from rows)"""


@query(
    "stratified_split",
    f"""{_RANKED} select o_orderkey, class, case when place <= round(n * 0.2::double) then 'validation' else 'train' end as part from ranked""",
)
def stratified_split(spark, sf):
    return split.stratified_split(order_rows(spark, sf), ["o_orderkey"]).select("o_orderkey", "class", "part")


@query(
    "group_split",
    f"""with {_ORDERS} select o_orderkey, case when substr(md5('0|' || o_custkey), 1, 8) < '33333333' then 'validation' else 'train' end as part from rows""",
)
def group_split(spark, sf):
    return split.group_split(order_rows(spark, sf), "o_custkey").select("o_orderkey", "part")


@query(
    "class_distribution",
    f"""with {_ORDERS} select count(*) as total, count(*) filter (class = 0) as class_0, count(*) filter (class = 1) as class_1,
    round(100.0::double * count(*) filter (class = 1) / count(*), 6) as class_1_pct from rows""",
)
def class_distribution(spark, sf):
    return split.class_distribution(order_rows(spark, sf)).withColumn("class_1_pct", F.round("class_1_pct", 6))


@query(
    "class_weights",
    f"""with {_ORDERS}, c as (select class, count(*) as n from rows group by class)
    select class, n, round((sum(n) over ())::double / (count(*) over () * n), 6) as weight from c""",
)
def class_weights(spark, sf):
    return split.class_weights(order_rows(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(
    "downsample",
    f"{_RANKED} select o_orderkey, class from ranked where place <= (select min(n) from ranked)",
)
def downsample(spark, sf):
    return split.downsample(order_rows(spark, sf), ["o_orderkey"]).select("o_orderkey", "class")


@query(
    "upsample",
    f"""{_RANKED}, top as (select max(n) as m from ranked)
    select o_orderkey, class, unnest(generate_series(1, m // n + (place <= m % n)::int))::int as copy from ranked, top""",
)
def upsample(spark, sf):
    return split.upsample(order_rows(spark, sf), ["o_orderkey"]).select("o_orderkey", "class", "copy")


# --- metrics ------------------------------------------------------------------


def scored_docs(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = v.table(spark, sf, "labels").join(docs, "doc_id")
    return rows.select(
        "doc_id",
        "source",
        F.col("quality").alias("label"),
        (F.col("n_chars") > 600).cast("int").alias("prediction"),
        (F.col("toxic") == 0).cast("int").alias("other"),
    )


_SCORED = """scored as (select doc_id, source, quality as label, (n_chars > 600)::int as prediction, (toxic = 0)::int as other
  from labels join documents using (doc_id))"""


def _counts(prediction="prediction"):
    return ", ".join(
        f"(count(*) filter (label = {y} and {prediction} = {p}))::double as {name}"
        for name, y, p in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))
    )


def _safe(a, b):
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


_METRICS = {
    "accuracy": _safe("tp + tn", "tp + fp + tn + fn"),
    "balanced_accuracy": _safe(
        f"{_safe('tp', 'tp + fn')} + {_safe('tn', 'tn + fp')}", "((tp + fn > 0)::int + (tn + fp > 0)::int)::double"
    ),
    "f1": _safe("2 * tp", "2 * tp + fp + fn"),
    "precision": _safe("tp", "tp + fp"),
    "recall": _safe("tp", "tp + fn"),
    "iou": _safe("tp", "tp + fp + fn"),
    "specificity": _safe("tn", "tn + fp"),
    "sensitivity": _safe("tp", "tp + fn"),
    "false_positive_rate": _safe("fp", "fp + tn"),
    "false_negative_rate": _safe("fn", "fn + tp"),
}
_ROUNDED = ", ".join(f"round({e}, 6) as {n}" for n, e in _METRICS.items())
_INTS = "tp::bigint as tp, fp::bigint as fp, tn::bigint as tn, fn::bigint as fn"


def _rounded(df, skip=()):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query("confusion_matrix", f"with {_SCORED}, c as (select source, {_counts()} from scored group by source) select source, {_INTS} from c")
def confusion_matrix(spark, sf):
    return scoring.confusion_matrix(scored_docs(spark, sf), by=["source"])


@query("classification_metrics", f"with {_SCORED}, c as (select {_counts()} from scored) select {_INTS}, {_ROUNDED} from c")
def classification_metrics(spark, sf):
    return _rounded(scoring.classification_metrics(scored_docs(spark, sf)))


@query(
    "model_leaderboard",
    f"""with {_SCORED}, c as (select source, {_counts()} from scored group by source), m as (select source, {_ROUNDED} from c)
    select rank() over (order by iou desc) as rank, source, iou, f1, "precision", recall from m""",
)
def model_leaderboard(spark, sf):
    """Sources ranked by IoU, each taken as the output of one model."""
    metrics = _rounded(scoring.classification_metrics(scored_docs(spark, sf), by=["source"]))
    ranked = scoring.leaderboard(metrics).withColumn("rank", F.col("rank").cast("long"))
    return ranked.select("rank", "source", "iou", "f1", "precision", "recall")


@query(
    "classification_report",
    f"""with {_SCORED}, c as (select {_counts()} from scored), per as (
      select '0' as class, {_safe('tn', 'tn + fn')} as p, {_safe('tn', 'tn + fp')} as r, {_safe('2 * tn', '2 * tn + fn + fp')} as f, tn + fp as s from c
      union all select '1', {_safe('tp', 'tp + fp')}, {_safe('tp', 'tp + fn')}, {_safe('2 * tp', '2 * tp + fp + fn')}, tp + fn from c),
    rows as (select class, p, r, f, s from per
      union all select 'accuracy', (tp + tn) / (tp + fp + tn + fn), (tp + tn) / (tp + fp + tn + fn), (tp + tn) / (tp + fp + tn + fn), tp + fp + tn + fn from c
      union all select 'macro avg', avg(p), avg(r), avg(f), sum(s) from per
      union all select 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) from per)
    select class, round(p, 6) as "precision", round(r, 6) as recall, round(f, 6) as f1, s::bigint as support from rows""",
)
def classification_report(spark, sf):
    return _rounded(scoring.classification_report(scored_docs(spark, sf)))


@query(
    "metric_delta",
    f"""with {_SCORED}, a as (select {_counts()} from scored), b as (select {_counts('other')} from scored),
    la as (unpivot (select {", ".join(f"{e} as {n}" for n, e in _METRICS.items())} from a) on columns(*) into name metric value before),
    lb as (unpivot (select {", ".join(f"{e} as {n}" for n, e in _METRICS.items())} from b) on columns(*) into name metric value after)
    select metric, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) + 0.0 as delta from la join lb using (metric)""",
)
def metric_delta(spark, sf):
    rows = scored_docs(spark, sf)
    before = scoring.long_metrics(scoring.classification_metrics(rows))
    after = scoring.long_metrics(scoring.classification_metrics(rows, prediction="other"))
    out = _rounded(scoring.metric_delta(before, after))
    return out.withColumn("delta", F.col("delta") + F.lit(0.0))


_CURVE = """with per as (select l_extendedprice as score, count(*) filter (l_returnflag = 'R') as pos, count(*) filter (l_returnflag <> 'R') as neg
  from lineitem group by 1),
  c as (select *, sum(pos) over w as cp, sum(neg) over w as cn from per window w as (order by score desc)),
  t as (select sum(pos)::double as p, sum(neg)::double as n from per)"""


def scored_lines(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").alias("score")
    )


@query("roc_auc", f"{_CURVE} select round(1 - sum(pos * (cn - neg / 2.0::double)) / (any_value(p) * any_value(n)), 9) as roc_auc from c, t")
def roc_auc(spark, sf):
    return scoring.auc(scored_lines(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("pr_auc", f"{_CURVE} select round(sum(pos * cp::double / (cp + cn)) / any_value(p), 9) as pr_auc from c, t")
def pr_auc(spark, sf):
    return scoring.auc(scored_lines(spark, sf)).select(F.round("pr_auc", 9).alias("pr_auc"))


@query(
    "dummy_baseline",
    f"""with {_SCORED}, share as (select avg(label) as s from scored)
    select doc_id, label, (cast(concat('0x', substr(md5('0|' || doc_id), 1, 8)) as bigint) / 4294967296.0::double < s)::int as prediction
    from scored, share""",
)
def dummy_baseline(spark, sf):
    rows = scored_docs(spark, sf).select("doc_id", "label")
    share = rows.agg(F.avg("label")).first()[0]
    return scoring.dummy_baseline(rows, ["doc_id"], share).select("doc_id", "label", "prediction")


# --- forest -------------------------------------------------------------------
# A learner's scores are its own; what holds for any forest is checked against SQL: which rows are
# scored, with which label, that scores are probabilities, that predictions and ensembles
# follow from them, and that the model is better than the larger class.

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SETTINGS = forest.ForestSettings(features=2)


def line_rows(spark, sf):
    rows = v.table(spark, sf, "lineitem")
    label = (F.col("l_extendedprice") * F.col("l_discount") > 3000).cast("int")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.select(F.col("l_orderkey").alias("file_name"), key.alias("row_key"), "l_linestatus", *FEATURES, label.alias("class"))
    return split.group_split(rows)


def forest_rows(spark, sf):
    """Training rows, and rows to score in parts for all cores."""
    rows = line_rows(spark, sf)
    fit = rows.filter("part = 'train'").select("l_linestatus", *FEATURES, "class")
    return fit, dealt(rows.filter("part = 'validation'"), forest.ROWS_A_TASK)


def judged(scored):
    """Scored rows with what must hold for them."""
    scored = stage(scored, "scored")
    right, ones = scored.agg(F.avg((F.col("prediction") == F.col("class")).cast("int")), F.avg("class")).first()
    return scored.withColumns(
        {
            "is_probability": F.col("score").between(0, 1),
            "follows_score": F.col("prediction") == (F.col("score") > 0.5).cast("int"),
            "beats_larger_class": F.lit(right is not None and right > max(ones, 1 - ones)),
        }
    )


_FOREST = """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row_key,
  (l_extendedprice * l_discount > 3000)::int as class, true as is_probability, true as follows_score,
  true as beats_larger_class{more} from lineitem where substr(md5('0|' || l_orderkey), 1, 8) < '33333333'"""


@query("rf_train_predict", _FOREST.format(more=""))
def rf_train_predict(spark, sf):
    fit, held = forest_rows(spark, sf)
    model = forest.train(fit, FEATURES, settings=SETTINGS)
    scored = judged(forest.predict(held, [model], FEATURES))
    return scored.select("row_key", "class", "is_probability", "follows_score", "beats_larger_class")


@query("rf_finetune_predict", _FOREST.format(more=", true as is_tree_mean, 400 as trees"))
def rf_finetune_predict(spark, sf):
    fit, held = forest_rows(spark, sf)
    models = [
        forest.train(fit, FEATURES, settings=SETTINGS),
        forest.finetune(fit.filter("l_linestatus = 'F'"), FEATURES, settings=SETTINGS),
    ]
    trees = [m.getNumTrees for m in models]
    scored = forest.predict(held, models, FEATURES)
    for i, model in enumerate(models):
        scored = forest.predict(scored.withColumnRenamed("score", "whole").withColumnRenamed("prediction", "y"), [model], FEATURES)
        scored = scored.withColumnRenamed("score", f"alone_{i}").drop("prediction")
        scored = scored.withColumnRenamed("whole", "score").withColumnRenamed("y", "prediction")
    mean = sum(F.col(f"alone_{i}") * n for i, n in enumerate(trees)) / sum(trees)
    scored = judged(scored.withColumns({"is_tree_mean": F.abs(mean - F.col("score")) < 1e-9, "trees": F.lit(sum(trees))}))
    return scored.select(
        "row_key", "class", "is_probability", "follows_score", "beats_larger_class", "is_tree_mean", "trees"
    )


BAGS = 10
_TIMES = " + ".join(
    f"(cast(concat('0x', substr(md5('1234567/' || b || '|' || row_key), 1, 8)) as bigint) / 4294967296.0::double >= {x})::int"
    for x in bagging.AT_MOST
)


@query(
    "rf_out_of_bag",
    f"""with rows as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row_key,
      (l_extendedprice * l_discount > 3000)::int as class from lineitem where substr(md5('0|' || l_orderkey), 1, 8) >= '33333333'),
    drawn as (select row_key, class, b, {_TIMES} as times from rows, range({BAGS}) t(b))
    select row_key, class, count(*) filter (where times = 0) as n_out, sum(times)::bigint as n_times,
      count(*) filter (where times = 0) > 0 as is_scored, true as is_probability, true as near_validation
    from drawn group by row_key, class""",
)
def rf_out_of_bag(spark, sf):
    """Training rows scored by the bags that do not have them; the accuracy is that of held-out structures, up to 0.02."""
    rows = line_rows(spark, sf)
    fit, held = (dealt(rows.filter(F.col("part") == part), forest.ROWS_A_TASK) for part in ("train", "validation"))
    fit = stage(bagging.with_draws(fit, ["row_key"], BAGS, SETTINGS.seed), "fit")
    models = bagging.train_bags(fit, FEATURES, ["row_key"], settings=SETTINGS, bags=BAGS)
    scored = stage(bagging.out_of_bag(fit, models, FEATURES, ["row_key"], SETTINGS), "scored")

    def accuracy(df):
        return df.filter("score is not null").agg(F.avg((F.col("prediction") == F.col("class")).cast("int"))).first()[0]

    off = abs(accuracy(scored) - accuracy(forest.predict(held, models, FEATURES)))
    times = sum((F.col("_drawn")[b] for b in range(BAGS)), F.lit(0))
    return scored.select(
        "row_key",
        "class",
        F.size("out_of").cast("long").alias("n_out"),
        times.cast("long").alias("n_times"),
        F.col("score").isNotNull().alias("is_scored"),
        F.coalesce(F.col("score").between(0, 1), F.lit(True)).alias("is_probability"),
        F.lit(off <= 0.02).alias("near_validation"),
    )


IMPORTANCE = forest.ForestSettings(trees=20, depth=10, features=2)


@query(
    "permutation_importance",
    """select c as feature, (select count(*) from lineitem where substr(md5('0|' || l_orderkey), 1, 8) < '33333333') as n,
      c in ('l_extendedprice', 'l_discount') as leads
    from (values ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(c)""",
)
def permutation_importance(spark, sf):
    """Held-out rows with one column shuffled: the two that make the label matter most."""
    fit, held = forest_rows(spark, sf)
    model = forest.train(fit, FEATURES, settings=IMPORTANCE)
    found = importance.permutation_importance(held, ["row_key"], FEATURES, lambda df: forest.predict(df, [model], FEATURES))
    # Quantity is a part of the price, so it has some importance too.
    found = stage(found, "importance")
    second = found.orderBy(F.desc("importance")).limit(2).agg(F.min("importance")).first()[0]
    return found.select("feature", "n", (F.col("importance") >= second).alias("leads"))
