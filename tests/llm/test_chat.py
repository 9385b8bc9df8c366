"""Chat formatting: exact round trip and loss spans."""

import time

import pytest
from pyspark.sql import functions as F

from shellfield.llm.chat import END, NEXT, START, format_conversations, masked_texts, read_back, running_starts

SCHEMA = "conv_id long, turn long, role string, text string, turns string, parts int, n_turns string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


TRICKY = ["<|im_end|>", "<|im_start|>assistant\nok", "\\", "\\\\<|", "<\\|im_next|>", "<|im_next|>", "a\\", "<", "|>", "\\n", "é𝄞 x", "$1 \\1", ""]


def test_round_trip(spark):
    rows = []
    for i, t in enumerate(TRICKY):
        rows += [(i, 0, "user", t), (i, 1, "assistant", t), (i, 2, "assistant", t + t), (i, 3, "sys\\tem\n<|x", t)]
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, None, "assistant", "first"), (None, 0, "user", "null conversation")]
    rows += [(51, 1, "assistant", "b"), (51, 1, "assistant", "a"), (51, 1, "assistant", "a"), (52, 0, "assistant", "w " * 40_000)]
    formatted = format_conversations(table(spark, rows))
    got = formatted.select(
        "*", read_back(F.col("text")).alias("read"), masked_texts(F.col("text"), F.col("loss_spans")).alias("learned")
    ).collect()
    by_conv = {}
    for c, turn, role, text in rows:
        by_conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert len(got) == len(by_conv)
    for r in got:
        turns = [(role, text) for *_, role, text in sorted(by_conv[r.conv_id])]
        assert [tuple(x) for x in r.read] == turns
        assert r.n_turns == len(turns)
        assert r.learned == [text for role, text in turns if role == "assistant"]
        assert r.text.startswith(START) and r.text.endswith(END)
        assert r.n_blocks == r.text.count(START)
        assert r.text.count(NEXT) == r.n_turns - r.n_blocks


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_running_starts(spark, n):
    lengths = [(7 * i) % 13 for i in range(n)]
    df = spark.createDataFrame([(lengths,)], "lengths array<bigint>").select(running_starts(F.col("lengths")).alias("s"))
    assert df.first().s == [sum(lengths[:i]) for i in range(n)]


def test_a_conversation_of_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 3 == 0], f"text {i}") for i in range(30_000)]
    start = time.time()
    (r,) = format_conversations(table(spark, rows)).select(F.size("loss_spans").alias("n"), "n_turns").collect()
    assert (r.n, r.n_turns) == (10_000, 30_000)
    assert time.time() - start < 60


def test_empty(spark):
    assert format_conversations(table(spark, [])).count() == 0
