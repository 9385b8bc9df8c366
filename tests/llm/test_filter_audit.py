"""The potentials of the removal game against filters that run one after the other."""

from itertools import permutations

import pytest

from shellfield.llm.filter_audit import audit, audit_text_filters, text_failures
from tests.llm.corpus import SCHEMA, frame, rows_of, words

LABELS = "doc_id long, quality int, toxic int, part string, A boolean"


def brute_failures(rows):
    out = []
    for i, t, lang, _ in rows:
        t, w = t or "", words(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": any(i is not None and j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        out.append((i, lang or "", fails))
    return out


def brute_audit(fails, labels):
    out = {}
    for order in permutations("ABCDE"):
        for part in {p for _, p, _ in fails}:
            left = [(i, f) for i, p, f in fails if p == part]
            everyone = list(left)
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[c]]
                left = [(i, f) for i, f in left if not f[c]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f[c] for _, f in everyone) - len(gone),
                    sum(f[c] and sum(f.values()) == 1 for _, f in everyone),
                    sum(any(j == i and q == 1 for j, q, *_ in labels) for i, _ in gone if i is not None),
                    sum(any(j == i and x == 1 for j, _, x, *_ in labels) for i, _ in gone if i is not None),
                ]
    shapley = {}
    for (part, order, step), row in out.items():
        at = part, order[step - 1]
        shapley[at] = shapley.get(at, 0) + row[1]
    return {k: tuple([*row, shapley[k[0], k[1][k[2] - 1]]]) for k, row in out.items()}


def corpus():
    rows = rows_of(60)
    rows += [(900 + i, f"## {i} $ " + "AB cd " * 60, ("en", None)[i % 2], "s") for i in range(6)]
    rows += [(910 + i, " ".join(f"w{k}" for k in range(120 + i)) + "|" * (i % 2), "", "s") for i in range(4)]
    return rows + [(911, None, "fr", "s"), (912, "", "fr", "s")]


def test_failures(spark):
    rows = corpus()
    got = sorted(((r.doc_id, r.part, *r[2:]) for r in text_failures(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, p, *f.values()) for i, p, f in brute_failures(rows)), key=repr)
    for k in range(2, 7):
        assert 0 < sum(r[k] for r in got) < len(got)


def test_audit(spark):
    rows = corpus()
    labels = [(i, i % 2, int(i % 5 == 0), "p", True) for i in range(0, 60, 2)]
    labels += [(4, 1, None, "p", None), (None, 1, 1, "p", None), (905, None, 1, "x", False), (5000, 1, 1, "x", False)]
    got = audit_text_filters(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    expected = brute_audit(brute_failures(rows), labels)
    assert len(got) == len(expected) == 600 * len({r.part for r in got})
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == expected[
            r.part, r.filter_order, r.step
        ]
    assert any(r.good_lost for r in got) and any(r.toxic_lost for r in got)


def test_shares_add_up_for_any_number_of_filters(spark):
    rows = [(p, a, b, c) for p in ("x", None) for a in (True, None) for b in (True, False) for c in (True, False) for _ in range(3)]
    table = spark.createDataFrame(rows, "part string, A boolean, B boolean, C boolean")
    for names in ("A", "AB", "ABC"):
        got = audit(table, list(names), "part", []).collect()
        for part in ("x", None):
            own = {r.filter_order[r.step - 1]: r.shapley for r in got if r.part == part}
            removed = sum(1 for r in rows if r[0] == part and any(r[1 + "ABC".index(c)] for c in names))
            orders = len(list(permutations(names)))
            assert sum(own.values()) == removed * orders
            assert len({*own.values()}) == 1  # these filters are alike
    with pytest.raises(ValueError):
        audit(table, ["A", "A"], "part", [])


def test_empty(spark):
    assert audit_text_filters(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0
