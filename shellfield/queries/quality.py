"""Registered queries: profiles, validation and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from shellfield.operators import cleaning, profile, sketches
from shellfield.queries import views as v
from shellfield.queries.base import Registry
from shellfield.session import scratch_path
from shellfield.sources import tables

registry = Registry()
query = registry.query

# Documents as points: source = structure file, language = residue, quality = class.
# Documents without a label have a missing class and a missing second label.


def doc_points(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    points = docs.join(v.table(spark, sf, "labels"), "doc_id", "left")
    return points.select(
        "doc_id",
        F.col("source").alias("file_name"),
        F.substring("source", 4, 1).alias("chain_id"),
        (F.col("n_chars") % 50).cast("int").alias("residue_number"),
        F.col("lang").alias("residue_name"),
        (F.col("n_chars") % 7).cast("double").alias("neighbours"),
        F.when(F.col("toxic").isNotNull(), F.col("n_chars").cast("double")).alias("size"),
        F.col("quality").alias("class"),
    )


_POINTS = """points as (select d.doc_id, source as file_name, substr(source, 4, 1) as chain_id, (n_chars % 50)::int as residue_number,
  lang as residue_name, (n_chars % 7)::double as neighbours, case when toxic is not null then n_chars::double end as size,
  quality as class from documents d left join labels l using (doc_id))"""
_BAD = "(size is null or class is null)"
DROPPED = ("de", "es")


@query("value_counts", "select l_shipdate::date::varchar as shipdate, count(*) as n from lineitem group by 1")
def value_counts(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("shipdate"))
    return profile.value_counts(rows, "shipdate")


@query("value_counts_with_missing", f"with {_POINTS} select class, count(*) as n from points group by class")
def value_counts_with_missing(spark, sf):
    return profile.value_counts(doc_points(spark, sf), "class", with_missing=True)


@query("distinct_values", "select distinct p_type from part")
def distinct_values(spark, sf):
    return profile.distinct_values(v.table(spark, sf, "part"), 3)


@query("top_residues", "select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 5")
def top_residues(spark, sf):
    return profile.top_values(v.table(spark, sf, "part"), "p_brand")


@query(
    "summary_stats",
    """select 'Total Points' as metric, count(*) as value from lineitem union all select 'Unique Proteins', count(distinct l_suppkey) from lineitem
    union all select 'Unique Chains', count(distinct l_returnflag) from lineitem
    union all select 'Unique Residues', count(*) from (select distinct l_returnflag, l_partkey from lineitem)""",
)
def summary_stats(spark, sf):
    return profile.summary_stats(v.table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_partkey")


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(column):
    return f"""select '{column}' as feature, count({column}) as count, round(avg({column}), 6) as mean, round(stddev_samp({column}), 6) as std,
      min({column}) as min, round(quantile_cont({column}, 0.25), 6) as q25, round(quantile_cont({column}, 0.5), 6) as q50,
      round(quantile_cont({column}, 0.75), 6) as q75, max({column}) as max from lineitem"""


@query("feature_describe", " union all ".join(_describe_sql(c) for c in MEASURES))
def feature_describe(spark, sf):
    out = profile.describe(v.table(spark, sf, "lineitem"), MEASURES)
    return out.select(
        "feature",
        "count",
        *[F.round(c, 6).alias(c) for c in ("mean", "std")],
        "min",
        *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")],
        "max",
    )


def _range_sql(column):
    return f"""select '{column}' as "column", min({column})::double as lowest, max({column})::double as highest,
      min({column}) < -10000 or max({column}) > 10000 as extreme from lineitem"""


@query("range_check", " union all ".join(_range_sql(c) for c in MEASURES))
def range_check(spark, sf):
    return profile.range_check(v.table(spark, sf, "lineitem"), 10_000, MEASURES)


@query(
    "validate_report",
    f"""with {_POINTS} select count(*) as points, (sum((size is null)::int) + sum((class is null)::int))::bigint as missing_values,
    count(*) filter ({_BAD}) as rows_with_missing, max(greatest(abs(doc_id), abs(neighbours), abs(coalesce(size, 0)))) > 1e10 as has_extreme_values,
    count(distinct file_name) as proteins, count(distinct chain_id) as chains, 'x,y' as missing_columns, false as valid from points""",
)
def validate_report(spark, sf):
    required = ["file_name", "x", "y", "chain_id", "residue_number"]
    return profile.validate(doc_points(spark, sf), required)


@query(
    "null_profile",
    f"with {_POINTS} "
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) - count({c}) as missing, count({c}) as present from points"
        for c in "doc_id file_name chain_id residue_number residue_name neighbours size class".split()
    ),
)
def null_profile(spark, sf):
    return profile.null_profile(doc_points(spark, sf))


_DOC_COLUMNS = "doc_id file_name chain_id residue_number residue_name neighbours size class".split()
_EVENT_COLUMNS = "event_id ts user_id event_type value props".split()


def _missing_in(table, columns):
    return " union all ".join(f"select '{c}' as c from {table} having count(*) > count({c})" for c in columns)


@query(
    "null_columns_equal",
    f"""with {_POINTS}, l as ({_missing_in("points", _DOC_COLUMNS)}), r as ({_missing_in("events", _EVENT_COLUMNS)})
    select coalesce((select string_agg(c, ',' order by c) from l), '') as left_columns,
    coalesce((select string_agg(c, ',' order by c) from r), '') as right_columns,
    coalesce((select string_agg(c, ',' order by c) from l where c not in (select c from r)), '') as only_left,
    coalesce((select string_agg(c, ',' order by c) from r where c not in (select c from l)), '') as only_right,
    not exists (select c from l except select c from r) and not exists (select c from r except select c from l) as same""",
)
def null_columns_equal(spark, sf):
    return profile.null_columns_equal(doc_points(spark, sf), v.table(spark, sf, "events"))


@query("rows_any_null", f"with {_POINTS} select * from points where {_BAD}")
def rows_any_null(spark, sf):
    return cleaning.rows_any_missing(doc_points(spark, sf))


_PCT = "coalesce(round(100.0::double * {a} / nullif({b}, 0), 6), 0)"


@query(
    "class_null_crosstab",
    f"""with {_POINTS}, counted as (select class, count(*) as n, count(*) filter (size is null or neighbours = 0 or class is null) as n_missing
    from points group by class) select class, n, n_missing, {_PCT.format(a="n_missing", b="n")} as missing_pct from counted""",
)
def class_null_crosstab(spark, sf):
    points = doc_points(spark, sf).withColumn("neighbours", F.nullif("neighbours", F.lit(0.0)))
    out = profile.class_null_crosstab(points)
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "cleaning_impact",
    f"""with {_POINTS}, counted as (select count(*) as n, count(*) filter ({_BAD}) as n_missing from points)
    select n, n_missing, {_PCT.format(a="n_missing", b="n")} as missing_pct from counted""",
)
def cleaning_impact(spark, sf):
    return profile.cleaning_impact(doc_points(spark, sf)).withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "zero_neighbour_profile",
    f"""with {_POINTS} select residue_name, count(*) as n, count(*) filter (neighbours = 0) as n_zero,
    count(*) filter (neighbours = 0 and class = 0) as n_zero_class_0, count(*) filter (neighbours = 0 and class = 1) as n_zero_class_1,
    count(*) filter (neighbours = 0 and {_BAD}) as n_zero_missing, count(*) filter (neighbours <> 0 and {_BAD}) as n_other_missing,
    round(100.0::double * count(*) filter (neighbours = 0) / count(*), 6) as zero_pct from points group by residue_name""",
)
def zero_neighbour_profile(spark, sf):
    out = profile.zero_neighbour_profile(doc_points(spark, sf), "neighbours")
    return out.withColumn("zero_pct", F.round("zero_pct", 6))


@query(
    "null_row_sources",
    f"""with {_POINTS}, bad as (select * from points where {_BAD})
    select 'residue_name' as "column", residue_name as value, count(*) as n from bad group by all
    union all select 'file_name', file_name, count(*) from bad group by all""",
)
def null_row_sources(spark, sf):
    return profile.null_row_sources(doc_points(spark, sf), ["residue_name", "file_name"])


@query(
    "residue_null_rate",
    f"""with {_POINTS}, watch as (select unnest(['en', 'de', 'xx']) as residue_name),
    counted as (select residue_name, count(*) as n, count(*) filter ({_BAD}) as n_missing from points group by all)
    select residue_name, c.n is not null as found, coalesce(c.n, 0) as n, coalesce(n_missing, 0) as n_missing,
    {_PCT.format(a="n_missing", b="c.n")} as missing_pct from watch left join counted c using (residue_name)""",
)
def residue_null_rate(spark, sf):
    out = profile.residue_null_rate(doc_points(spark, sf), ["en", "de", "xx"])
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "residue_examples",
    """select * exclude (rn) from (select l_partkey, l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_partkey
    order by l_orderkey, l_linenumber, l_quantity) as rn from lineitem) where rn = 1""",
)
def residue_examples(spark, sf):
    rows = v.table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return profile.first_rows(rows, "l_partkey", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("last_rows", "select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 10")
def last_rows(spark, sf):
    return profile.last_rows(v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


# --- cleaning -----------------------------------------------------------------


@query(
    "clean_features",
    f"with {_POINTS} select * from points where residue_name not in ('de', 'es') and neighbours <> 0",
)
def clean_features(spark, sf):
    return cleaning.clean_features(doc_points(spark, sf), count="neighbours", dropped=DROPPED)


_CLEAN = f"with {_POINTS}, cleaned as (select * from points where residue_name not in ('de', 'es') and neighbours <> 0)"


@query(
    "clean_assertions",
    _CLEAN
    + """ select count(*) as rows, (sum((size is null)::int) + sum((class is null)::int))::bigint as missing_values, count(*) filter (residue_name = 'de') as residue_de,
    count(*) filter (residue_name = 'es') as residue_es, count(*) filter (neighbours = 0) as zero_neighbours from cleaned""",
)
def clean_assertions(spark, sf):
    cleaned = cleaning.clean_features(doc_points(spark, sf), count="neighbours", dropped=DROPPED)
    return cleaning.clean_assertions(cleaned, count="neighbours", dropped=DROPPED)


@query(
    "drop_null_label",
    f"with {_POINTS} select doc_id, residue_number::varchar as residue_number, class from points where class is not null",
)
def drop_null_label(spark, sf):
    points = doc_points(spark, sf).select("doc_id", "residue_number", F.col("class").cast("double").alias("class"))
    return cleaning.drop_missing_label(cleaning.repair_types(points, ["residue_number"]))


@query("impute_zero", f"with {_POINTS} select doc_id, coalesce(size, 0) as size, coalesce(class, 0) as class from points")
def impute_zero(spark, sf):
    return cleaning.impute_zero(doc_points(spark, sf).select("doc_id", "size", "class"), ["size", "class"])


def _impute_sql(fn):
    return f"""with {_POINTS}, m as (select {fn}(size) as ms, {fn}(class) as mc from points)
      select doc_id, round(coalesce(size, ms), 6) as size, round(coalesce(class, mc), 6) as class from points, m"""


def _rounded(df):
    return df.select("doc_id", *[F.round(c, 6).alias(c) for c in ("size", "class")])


@query("impute_mean", _impute_sql("avg"))
def impute_mean(spark, sf):
    return _rounded(cleaning.impute_mean(doc_points(spark, sf).select("doc_id", "size", "class"), ["size", "class"]))


@query("impute_median", _impute_sql("median"))
def impute_median(spark, sf):
    return _rounded(cleaning.impute_median(doc_points(spark, sf).select("doc_id", "size", "class"), ["size", "class"]))


@query(
    "rollup_profile",
    f"""with {_POINTS} select file_name, chain_id, (2 - grouping(file_name) - grouping(chain_id))::int as level, count(*) as n,
    count(*) filter (where class = 1) as n_class_1, count(*) filter (where {_BAD}) as n_missing,
    100.0::double * count(*) filter (where class = 1) / count(*) as class_1_pct
    from points group by rollup (file_name, chain_id)""",
)
def rollup_profile(spark, sf):
    """The whole table, each file, and each chain of a file."""
    out = profile.rollup_profile(doc_points(spark, sf), ["file_name", "chain_id"])
    return out.withColumns({c: F.col(c).cast("long") for c in ("n", "n_class_1", "n_missing")})


# --- sinks --------------------------------------------------------------------


@query(
    "analysis_files",
    f"""with {_POINTS}
    select 'summary_stats' as file, 'Total Points' as name, count(*) as n from points
    union all select 'summary_stats', 'Unique Proteins', count(distinct file_name) from points
    union all select 'summary_stats', 'Unique Chains', count(distinct chain_id) from points
    union all select 'summary_stats', 'Unique Residues', count(distinct (chain_id, residue_number))
      filter (where chain_id is not null and residue_number is not null) from points
    union all select 'feature_stats', 'size', count(size) from points union all select 'feature_stats', 'neighbours', count(neighbours) from points
    union all select 'chain_counts', chain_id, count(*) from points where chain_id is not null group by chain_id
    union all select 'residue_counts', residue_name, count(*) from points where residue_name is not null group by residue_name""",
)
def analysis_files(spark, sf):
    """The four analysis files of a run, written and read back as text."""
    path = scratch_path(spark, "analysis")
    profile.write_analysis(profile.analyse(doc_points(spark, sf).drop("doc_id", "class")), path)

    def read(name, key, value):
        rows = spark.read.csv(f"{path}/{name}", header=True)
        return rows.select(F.lit(name).alias("file"), F.col(key).alias("name"), F.col(value).cast("long").alias("n"))

    stats = read("feature_stats", "feature", "count").filter("name in ('size', 'neighbours')")
    counts = read("chain_counts", "chain_id", "n").union(read("residue_counts", "residue_name", "n"))
    return read("summary_stats", "metric", "value").union(stats).union(counts)


@query("replace_table", f"with {_POINTS} select doc_id, file_name, size from points where not {_BAD}")
def replace_table(spark, sf):
    """A stored table cleaned over itself: what is read is what is overwritten."""
    path = scratch_path(spark, "points")
    doc_points(spark, sf).select("doc_id", "file_name", "size", "class").write.parquet(path)
    tables.replace_table(spark.read.parquet(path).dropna().drop("class"), path)
    return spark.read.parquet(path)


# --- sketches -----------------------------------------------------------------
# Estimates are not SQL. What SQL checks is how many values they are about, and that they are within their bounds.

SKETCHED = ["l_quantity", "l_extendedprice", "l_discount"]
QUANTILES = [0.01, 0.25, 0.5, 0.75, 0.99]


def sketched_lines(spark, sf):
    """Line items with 6,000 to a structure, and the sketches of two halves of the structures, added one after the other."""
    rows = v.table(spark, sf, "lineitem").withColumn("file_name", F.floor(F.col("l_orderkey") / 6000).cast("long"))
    path = scratch_path(spark, "sketches")
    for part in (rows.filter("file_name % 2 = 0"), rows):
        store = sketches.add_sketches(part, path, SKETCHED, ["l_partkey", "l_suppkey"])
    return rows, store


@query(
    "sketch_quantiles",
    " union all ".join(
        f"select '{c}' as feature, {q}::double as quantile, count({c}) as n, true as in_bound from lineitem"
        for c in SKETCHED
        for q in QUANTILES
    ),
)
def sketch_quantiles(spark, sf):
    """Quantiles from merged sketches, with the rank that each has in the exact table: within twice the sketch's rank error."""
    rows, store = sketched_lines(spark, sf)
    found = sketches.merged_quantiles(store, QUANTILES)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in SKETCHED])
    values = rows.select(F.inline(pairs)).groupBy("name", "x").agg(F.count(F.lit(1)).alias("c"))
    met = values.join(F.broadcast(found), F.col("name") == F.col("feature"))  # one row for each column and quantile
    ranks = met.groupBy("feature", "quantile", "value", "n").agg(
        (F.sum(F.when(F.col("x") < F.col("value"), F.col("c")).otherwise(0)) / F.col("n")).alias("below"),
        (F.sum(F.when(F.col("x") <= F.col("value"), F.col("c")).otherwise(0)) / F.col("n")).alias("up_to"),
    )
    bound = 2 * sketches.rank_error()
    ok = (F.col("below") - bound <= F.col("quantile")) & (F.col("quantile") <= F.col("up_to") + bound)
    return ranks.select("feature", "quantile", "n", ok.alias("in_bound"))


@query(
    "sketch_distinct",
    " union all ".join(
        f"select '{c}' as column_name, count({c}) as n, count(distinct {c}) as n_distinct, true as in_bound, true as same_merged from lineitem"
        for c in ("l_partkey", "l_suppkey")
    ),
)
def sketch_distinct(spark, sf):
    """Distinct counts from merged sketches: within three standard errors of the exact ones, however the rows are parted."""
    rows, store = sketched_lines(spark, sf)
    columns = ["l_partkey", "l_suppkey"]
    found = sketches.merged_distinct(store)
    other = sketches.structure_sketches(rows.withColumn("file_name", F.col("l_linenumber")), [], columns)
    other = sketches.merged_distinct(other).select("column", F.col("estimate").alias("other"))
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in columns])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in columns])))
    off = F.abs(F.col("estimate") - F.col("n_distinct"))
    return found.join(other, "column").join(exact, "column").select(
        F.col("column").alias("column_name"),
        "n",
        "n_distinct",
        (off <= F.greatest(F.lit(1.0), 3 * sketches.distinct_error() * F.col("n_distinct"))).alias("in_bound"),
        (F.col("estimate") == F.col("other")).alias("same_merged"),
    )
