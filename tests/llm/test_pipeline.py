"""The corpus pipeline against its stages done by brute force."""

import corpus_pipeline
from tests.llm.corpus import SCHEMA, frame, rows_of, text_of, words
from tests.llm.test_decontaminate import ITEMS, brute
from tests.llm.test_dedup import brute_components, key
from tests.llm.test_mixing import brute_targets
from tests.llm.test_scores import brute_judge

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, items):
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars") if rows else spark.createDataFrame([], COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).select("item_id", "text").write.parquet(f"{path}/benchmark.parquet")


def near_groups(rows):
    """Components of rows (not of doc_ids), by five words and 0.8."""
    return [c for _, _, c in brute_components([(k, t) for k, (_, t, *_) in enumerate(rows)], 5)]


def test_run(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = rows_of(150)
    items = [(1, text_of(rng, 40), 1, "x"), (2, text_of(rng, 20), 1, "x")]
    rows += [(6000 + i, text_of(rng, 30) + " " + items[i % 2][1] + " " + text_of(rng, 30), "en", "src0") for i in range(5)]
    rows += [(7000, "## $$ " * 40, "en", "src0")]
    assert len({r[0] for r in rows}) < len(rows) - 3 and None in {r[0] for r in rows}
    tables(spark, tmp_path, rows, items)
    left = [r for r, judged in zip(rows, brute_judge(rows, 100)) if judged[-1]]
    found = {}
    for i, t, *_ in left:
        for line in (t or "").split("\n"):
            if key(line):
                found.setdefault(key(line), set()).add(i)
    left = [(i, "\n".join(x for x in (t or "").split("\n") if len(found.get(key(x), ())) < 10), *r) for i, t, *r in left]
    first = {}
    for k, c in enumerate(near_groups(left)):
        first.setdefault(c, []).append(k)
    stays = {min(members, key=lambda k: (left[k][0] is None, left[k][0] or 0, k)) for members in first.values()}
    left = [r for k, r in enumerate(left) if k in stays]
    bad = {k for k, _ in brute([(k, r[1]) for k, r in enumerate(left)], items)}
    left = [r for k, r in enumerate(left) if k not in bad]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((i, len(words(t))) for i, t, *_ in left), key=repr)
    assert bad and len(left) < len(rows)
    sizes = {}
    for _, t, _, s in left:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    aim = brute_targets(sizes)
    # Rows of the result are those of left; what a doc_id without or with several rows takes is the source's all the same.
    taken = {}
    for r in got:
        assert r.taken <= 2 * r.size
        source = next(s for i, t, _, s in left if i == r.doc_id and len(words(t)) == r.size)
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - aim[s]) <= max(10, 0.03 * aim[s]) for s in sizes)


def test_near_dups_keeps_other_texts_and_one_of_equal_rows(spark, tmp_path):
    import random

    rng = random.Random(2)
    a, b, other = text_of(rng, 60), text_of(rng, 60), text_of(rng, 60)
    rows = [(1, a), (2, a), (2, other), (5, b), (5, b), (None, b), (None, ""), (None, ""), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(4)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dups(spark, docs, str(tmp_path)).collect()]
    expected = [(1, a), (2, other), (5, b), (None, ""), (None, ""), (9, None), (9, None)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


CLASHING = ["kept_lines", "frequent_keys", "doc", "n_dropped", "n_lines", "kept_text", "row", "cut", "left", "a", "b", "found",
            "gone", "stays", "row_0", "id", "text_hash", "size", "kept", "part", "component_id"]


def test_columns_named_as_inner_ones_stay_as_they_are(spark, tmp_path):
    rows = rows_of(60)
    tables(spark, tmp_path, rows, [(1, "no such words in there", 1, "x")])
    docs = spark.createDataFrame(
        [(*r, len(r[1] or ""), *[f"{c} {k}" for c in CLASHING]) for k, r in enumerate(rows)],
        COLUMNS + "".join(f", {c} string" for c in CLASHING),
    )
    before = {tuple(r[c] for c in CLASHING) for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        after = {tuple(r[c] for c in CLASHING) for r in out.collect()}
        assert after and after <= before, name
    assert corpus_pipeline.mixing(spark, docs, str(tmp_path)).count() == len(rows)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    tables(spark, tmp_path, rows_of(40), [(1, None, 1, "x")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        assert out.count() <= docs.count()


def test_extra_columns_stay(spark, tmp_path):
    tables(spark, tmp_path, rows_of(40), [(1, None, 1, "x")])
    docs = frame(spark, rows_of(40))
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert spark.createDataFrame([], SCHEMA).count() == 0
