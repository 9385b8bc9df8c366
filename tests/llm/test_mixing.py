"""Targets, schedule and blocks of the mix."""

import pytest

from shellfield.llm.mixing import mix, schedule, targets
from tests.llm.corpus import SCHEMA, frame, rows_of, words


def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    stopped = set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        open_weight = sum(weight[s] for s in order if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in stopped and target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100},
    {"src10": 50, "src2": 900, "src1": 10, None: 400, "é": 7, "Z": 0},
    {"only": 5},
    {"a": 0, None: 0},
])
def test_targets(spark, sizes):
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = brute_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == expected


def test_mix(spark):
    rows = rows_of(400) + [(5000, "w " * 9000, "en", None), (5001, "v u", "en", "zz")]
    first = mix(frame(spark, rows).repartition(5)).collect()
    again = mix(frame(spark, rows[::-1]).repartition(2)).collect()
    as_rows = lambda rs: sorted(map(repr, rs))
    assert as_rows(first) == as_rows(again)
    assert len(first) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    aim = brute_targets(size)
    by_size = {}
    for s, n in size.items():
        by_size.setdefault(n, []).append(s)
    taken = {}
    for r in first:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size in by_size
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        assert any(r.target == pytest.approx(aim[s]) for s in by_size[r.source_size])
    for n, (s,) in by_size.items():
        assert abs(taken[n] - aim[s]) <= max(10, 0.02 * aim[s]), (s, n, aim[s], taken[n])


def test_a_tiny_source_leaves_the_blocks_of_others_alone(spark):
    sizes = {"big": 50_000_000, "tiny": 3, "mid": 90_000, None: 0}
    aimed = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).selectExpr("*", "1L as n")
    got = {r.source: r for r in schedule(aimed).collect()}
    aim = brute_targets(sizes)
    assert got["big"].block == 2048 and got["tiny"].block == 1 and got[None].block == 1
    slots = got["big"].n_slots
    assert slots < aim["big"] / 2048 + 2 * 1024 + 10
    points = sorted(((i + 0.5) * 0.6180339887498949) % 1 for i in range(slots))
    for s, r in got.items():
        dealt = sum(r.low <= x < r.high for x in points)
        assert abs(dealt * r.block - aim[s]) <= max(6 * r.block, 0.01 * aim[s]), s


def test_mix_of_small_tables(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mix(frame(spark, [(1, None, None, None), (2, "", "en", "a")])).collect()
    assert [r.taken for r in got] == [0, 0]
    got = mix(frame(spark, [(1, "a b c", None, None)] * 2)).collect()
    assert sum(r.taken for r in got) == pytest.approx(9, abs=2)
