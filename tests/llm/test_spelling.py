"""Spelling variants against all pairs of words."""

import random
import zlib

import pytest

from shellfield.llm import spelling
from shellfield.llm.spelling import corpus_words, follow, variants
from tests.llm.corpus import SCHEMA, frame, rows_of

LETTERS = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100))]


def runs(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c in LETTERS:
            run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif run:
            out.append(run)
            run = ""
    return out


def brute_words(rows, length=5, least=3):
    count = {}
    for i, t, *_ in rows:
        for w in runs(t):
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= length:
                count[w] = count.get(w, 0) + 1
    return {w: n for w, n in count.items() if n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return out


def vocabulary(seed, n=700):
    """Words of few syllables, edited copies of them, long ones and ones with other letters."""
    rng = random.Random(seed)
    parts = ["tion", "er", "an", "th", "é", "ÿz", "ing", "a"]
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 7)))
        words.add(w)
        if rng.random() < 0.5:
            at = rng.randrange(len(w))
            words.add(w[:at] + rng.choice(["", "x", "b" + w[at]]) + w[at + 1 :])
    words |= {"q" * k for k in range(5, 60)} | {"z" * 300, "z" * 299 + "y", "z" * 301}
    return {w: rng.choice([3, 4, 6, 9, 20, 50, 200]) for w in sorted(words) if len(w) >= 5}


def found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("rare,longest_list", [(512, 4096), (1, 5)])
def test_against_all_pairs(spark, monkeypatch, rare, longest_list):
    """With frequent grams that have to grow, and lists cut into blocks."""
    monkeypatch.setattr(spelling, "OFTEN", rare)
    monkeypatch.setattr(spelling, "KNOWN", min(rare, 32))
    monkeypatch.setattr(spelling, "LIST_WORDS", longest_list)
    count = vocabulary(rare)
    got = variants(spark.createDataFrame(sorted(count.items()), "word string, n long").repartition(3))
    expected = brute_variants(count)
    assert found(got) == expected
    assert any(r[1] and r[2] != r[1] for r in expected)


def test_one_asked_gram_is_left_by_every_edit():
    """The two grams lie apart, and the other word has one of them where an edit can have moved it."""
    import numpy as np

    rng = random.Random(4)
    texts = [t for t in vocabulary(11, 200) if len(t) < 40]
    words = spelling.Words(texts)
    parts = [words.grams(p[0][p[0] + k <= words.ends[p[1]]], k) for k in (3, 4, 5) for p in [words.places()]]
    known = spelling.Grams(*np.unique(np.concatenate(parts), return_counts=True), 1)

    def grams(text, most):
        one = spelling.Words([text])
        place, word, gram, length, count = spelling.decompose(one, known, np.array([most]))
        ask = spelling.asked(one, place, word, length, spelling._costs(one, place, word, length, count))
        return list(zip(place.tolist(), gram.tolist(), (place + length).tolist())), ask.tolist()

    for text in texts:
        at = rng.randrange(len(text))
        for other in (text[:at] + text[at + 1 :], text[:at] + "x" + text[at:], text[:at] + "x" + text[at + 1 :]):
            short, long = sorted((text, other), key=len)
            if len(short) < 5:
                continue
            most = int(spelling._longest(np.array([len(short)]))[0])
            (own, ask), (listed, _) = grams(short, most), grams(long, most)
            first, second = (own[i] for i in ask)
            assert first[2] <= second[0] or second[2] <= first[0]
            places = {(p - shift, g) for p, g, _ in listed for shift in range(len(long) - len(short) + 1)}
            assert {first[:2], second[:2]} & places


def test_words_of_a_corpus(spark):
    rows = rows_of() + [(i, "Ça Ébène ébène ÉBÈNE naïveté×÷ don't x1y2 " * 3 + "étrange" * (i % 3), "fr", "s") for i in range(2000, 2060)]
    for length, least in ((5, 3), (4, 1)):
        got = corpus_words(frame(spark, rows).repartition(4), length, least)
        expected = brute_words(rows, length, least)
        assert dict(got.collect()) == expected
    assert found(variants(corpus_words(frame(spark, rows)))) == brute_variants(brute_words(rows))


def test_partial_counts_are_summed(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rows = rows_of()
    assert dict(corpus_words(frame(spark, rows)).collect()) == brute_words(rows)


def test_long_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w0") for i in range(5)]
    got = dict(follow(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w37" for w, _ in chain}


@pytest.mark.parametrize("letters", ["ab", "abé" + "".join(chr(0x4E00 + k) for k in range(300))])
@pytest.mark.parametrize("c", [5, 8, 9, 17])
def test_packed_words(letters, c):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(c)
    texts = []
    for _ in range(400):
        base = rng.choice(texts)[:c] if texts and rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(c))
        at = rng.randrange(c)
        base = base.ljust(c, "a")
        texts.append(rng.choice([base[:at] + rng.choice(letters) + base[at + 1 :], base[:at] + rng.choice(letters) + base[at:]]))
    packed = spelling.Packed(pa.array(texts), c)
    a, b = (x.ravel() for x in np.meshgrid(*[[i for i, t in enumerate(texts) if len(t) == k] for k in (c, c)]))
    assert packed.replaced(a, b).tolist() == [one_edit(texts[i], texts[j]) for i, j in zip(a, b)]
    a, b = (x.ravel() for x in np.meshgrid(*[[i for i, t in enumerate(texts) if len(t) == k] for k in (c, c + 1)]))
    expected = [one_edit(texts[i], texts[j]) for i, j in zip(a, b)]
    assert packed.inserted(a, b).tolist() == expected and any(expected)


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        variants(spark.createDataFrame([("abc", 3)], "word string, n long"), least_length=3)


def test_empty(spark):
    assert variants(corpus_words(spark.createDataFrame([], SCHEMA))).count() == 0
