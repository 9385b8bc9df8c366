"""Line, substring and near-duplicate removal against brute force."""

import pytest

from shellfield.llm.components import components
from shellfield.llm.line_runs import drop_frequent_lines
from shellfield.llm.near_dups import _forest, near_duplicates
from shellfield.llm.substrings import remove_repeated_windows
from tests.llm.corpus import SCHEMA, frame, rows_of, words

BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(s):
    return s.encode().lower().decode()


def key(line):
    return lower_ascii(line.strip(BLANKS))


def test_lines(spark):
    rows = rows_of()
    found = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if key(line):
                found.setdefault(key(line), set()).add(i)
    expected = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(found.get(key(x), ())) < 10]
        expected.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    for batches, fanout in ((4, 3), (5, 2)):
        got = drop_frequent_lines(frame(spark, rows), min_docs=10, n_batches=batches, fanout=fanout)
        assert "a.b" in got.columns and "kept" in got.columns
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(d for *_, d, _ in expected)


def test_lines_carry_columns_named_as_inner_ones(spark):
    names = ["kept_lines", "frequent_keys", "doc", "row", "cut", "left", "a", "b", "k", "n", "part"]
    rows = rows_of(40)
    docs = spark.createDataFrame(
        [(r[0], r[1], *[f"{c} {i}" for c in names], 7) for i, r in enumerate(rows)],
        "doc_id long, text string, " + ", ".join(f"{c} string" for c in names) + ", n_dropped int",
    )
    got = drop_frequent_lines(docs, min_docs=10)
    assert got.columns == ["doc_id", "text", *names, "kept_text", "n_lines", "n_dropped"]
    assert {tuple(r[c] for c in names) for r in got.collect()} == {tuple(r[c] for c in names) for r in docs.collect()}


def brute_windows(rows, size):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[p : p + size])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("size", [13, 3])
def test_windows(spark, size):
    rows = rows_of()
    got = remove_repeated_windows(frame(spark, rows).repartition(5), size=size).collect()
    expected = brute_windows(rows, size)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == sorted(expected, key=repr)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def brute_components(rows, size):
    def shingles(t):
        w = words(t, lower=True)
        return frozenset(tuple(w[p : p + size]) for p in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, other in sets[:k]:
            if i is not None and j is not None and s and 100 * len(s & other) >= 80 * len(s | other):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(i, len(s), None if i is None else root(i) if s else i) for i, s in sets]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    rows = [r for r in rows_of() if r[0] != 4]  # one text for each doc_id
    got = near_duplicates(frame(spark, rows).repartition(3), size=size).collect()
    expected = brute_components(rows, size)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert any(c != i for i, _, c in expected)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """A group cut into many blocks has the same components; the chain 0-1-2.. needs links in between."""
    from shellfield.llm import near_dups

    monkeypatch.setattr(near_dups, "BLOCK_DOCS", 3)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 200)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        changed = list(base)
        for j in range(i):
            changed[(7 * j) % 60] = f"x{j}"
        rows.append((i, " ".join(changed), "en", "s"))
    got = near_duplicates(frame(spark, rows), size=4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute_components(rows, 4))


def test_forest_reaches_all_with_few_comparisons():
    compared = []

    def near(u, others):
        compared.append(len(others))
        return (others % 3) == (u % 3)

    edges = _forest(300, near)
    assert len(edges) == 297
    assert sum(compared) < 300 * 300 / 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 100), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 51)}, 100: 90}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drop_frequent_lines(empty).count() == 0
    assert remove_repeated_windows(empty).count() == 0
    assert near_duplicates(empty).count() == 0
