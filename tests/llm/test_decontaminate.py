"""Spaced seeds: every overlap that brute force finds, and no other."""

import itertools
import random

import numpy as np

from shellfield.llm.decontaminate import MASKS, WINDOW, contaminated, overlap
from tests.llm.corpus import SCHEMA, frame, rows_of, text_of

ITEMS = "item_id long, text string, n_words int, seed string"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text):
    words = [w.decode().casefold() for w in (text or "").encode().split()]
    return [w.strip(PUNCTUATION) or w for w in words]


def brute(docs, items):
    found = set()
    for d, text, *_ in docs:
        b = tokens(text)
        for k, item, *_ in items:
            a = tokens(item)
            if len(a) < 8:
                continue
            need = min(WINDOW, len(a))
            for shift in range(-len(a), len(b)):
                low, high = max(0, -shift), min(len(a), len(b) - shift)
                equal = [a[i] == b[i + shift] for i in range(low, high)]
                sums = list(itertools.accumulate(equal, initial=0))
                if len(a) < WINDOW:
                    if len(equal) == len(a) and sum(equal) >= len(a) - 1:
                        found.add((d, k))
                elif any(
                    5 * (sums[e] - sums[s]) >= 4 * (e - s)
                    for s in range(len(equal))
                    for e in range(s + need, len(equal) + 1)
                    if s < len(equal)
                ):
                    found.add((d, k))
    return found


def test_masks_cover_two_substitutions_anywhere():
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    for gone in itertools.combinations(range(WINDOW), 2):
        assert any(
            not set(gone) & {o + k for k in mask} for mask in masks for o in range(WINDOW - mask[-1])
        )


def test_overlaps(spark):
    rng = random.Random(4)
    items = [(k, text_of(rng, n), 1, "x") for k, n in enumerate((40, 13, 25, 8, 10, 12, 5, 60))]
    items += [(20, None, 1, "x"), (21, "", 1, "x"), (None, items[2][1], 1, "x"), (0, items[0][1], 1, "x")]
    docs = rows_of(30)
    for n, (k, text, *_) in enumerate(items[:8]):
        for edits in range(0, 7):
            words = text.split()
            for e in rng.sample(range(len(words)), min(edits, len(words) // 4)):
                words[e] = "other"
            part = words[rng.randrange(3) :] if len(words) > 20 else words
            docs.append((1000 + 10 * n + edits, text_of(rng, 9) + " " + " ".join(part).upper() + "! " + text_of(rng, 5), "en", "s"))
    items.append((30, "Ça é ÜBER straße ñ über où été naïve façon Ångström çà là öl âme", 1, "x"))
    docs.append((2000, "x " + items[-1][1].upper() + "!!", "fr", "s"))
    docs.append((None, items[0][1], "en", "s"))
    docs.append((1000, items[0][1], "en", "s"))
    got = contaminated(frame(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(docs, items)
    assert (2000, 30) in pairs
    assert all(5 * r.n_equal >= 4 * r.n_words for r in got)
    assert {r.n_words for r in got if (r.doc_id, r.item_id) == (None, 0)} == {len(tokens(items[0][1]))}


def test_overlap_is_the_longest():
    a = np.arange(30, dtype=np.uint64)
    b = a.copy()
    b[[3, 15, 16, 17, 18, 19]] = 99
    start, length, equal = overlap(a, b, 0)
    assert (start, length, equal) == (0, 18, 15) or 5 * equal >= 4 * length
    assert overlap(a, b[:12], 0) is None


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    some = frame(spark, rows_of(5))
    assert contaminated(docs, items).count() == 0
    assert contaminated(some, items).count() == 0
    assert contaminated(docs, spark.createDataFrame([(1, "a b c d e f g h i j", 1, "x")], ITEMS)).count() == 0


def test_masks_cover_a_fifth_of_any_window():
    masks = [(sum(1 << i for i, c in enumerate(m) if c == "1"), len(m)) for m in MASKS]
    for n in range(WINDOW, 2 * WINDOW):  # a longer window is two of these sizes, one with its share or less
        hits = [bits << o for bits, span in masks for o in range(n - span + 1)]
        for gone in itertools.combinations(range(n), n // 5):
            lost = sum(1 << i for i in gone)
            assert any(not h & lost for h in hits), (n, gone)


def test_every_fourth_word_changed_and_short_items(spark):
    rng = random.Random(12)
    item, short = text_of(rng, 15), "alpha beta gamma"
    changed = " ".join("other" if i % 4 == 3 else w for i, w in enumerate(item.split()))
    docs = [
        (1, text_of(rng, 9) + " " + changed + " " + text_of(rng, 5), "en", "s"),
        (2, "so Alpha, beta GAMMA! it is", "en", "s"),
        (3, "alpha beta other gamma", "en", "s"),
    ]
    items = spark.createDataFrame([(1, item, 1, "x"), (2, short, 1, "x")], ITEMS)
    pairs = lambda **k: sorted((r.doc_id, r.item_id) for r in contaminated(frame(spark, docs), items, **k).collect())
    assert pairs() == [(1, 1)]
    assert pairs(least_words=1) == [(1, 1), (2, 2)]
