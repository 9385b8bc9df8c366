"""Language model, quality rules and licenses against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shellfield.llm import lm, quality
from shellfield.llm.licenses import PHRASES, TEMPLATES, LicenseAutomaton, Scanner, scan_licenses, words as license_words
from tests.llm.corpus import SCHEMA, frame, rows_of, text_of, words


def held_out(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_FREQUENT", 60)  # so that rare words are joined
    rows = rows_of(150)
    counts = Counter()
    for i, t, *_ in rows:
        if not held_out(i):
            counts.update(words(t, lower=True) + [""])
    total, distinct = sum(counts.values()), len(counts)
    got = lm.score(frame(spark, rows).repartition(4)).collect()
    expected = []
    for i, t, *_ in rows:
        own = words(t, lower=True) + [""]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        expected.append((i, held_out(i), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(expected, key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_sum_to_one():
    """Over all classes and the words of a class, with one place for a word that was never seen."""
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << lm.FEATURE_BITS, lm.N_CLASSES)).astype(np.float32)
    vocabulary = lm.Vocabulary([b"a", b"b", b"c"], np.array([5, 3, 2]), ["en", "de", "en"], 20, 9, 4)
    codes = lm.Codes(vocabulary)
    tokens, counts, _ = lm.encode([b"a b zz A", b""], codes)
    logs = lm.log_softmax(weights, np.zeros(lm.N_CLASSES, np.float32), lm.feature_rows(tokens, counts))
    assert np.allclose(np.exp(logs).sum(1), 1, atol=1e-5)
    for k in set(vocabulary.classes[vocabulary.first :]):
        inside = vocabulary.inside[vocabulary.first :][vocabulary.classes[vocabulary.first :] == k]
        assert math.isclose((10.0**inside).sum(), 1)


def test_word_three_back_is_a_feature():
    rows = lm.feature_rows(np.array([20, 21, 22, 23, 0]), np.array([5]))
    other = lm.feature_rows(np.array([30, 21, 22, 23, 0]), np.array([5]))
    changed = rows[:, 3] != other[:, 3]  # of the fourth word only the skip over two words sees the first
    assert lm.FEATURES == len(rows) == 4 and changed.tolist() == [False, False, False, True]


def test_model_beats_unigrams_on_held_out_texts(spark):
    """Two languages with words of their own and a fixed order of words: the history tells the class."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(400):
        lang = "xy"[i % 2]
        rows.append((i, " ".join(f"{lang}{rng.choice('abcdefgh')}{rng.randrange(9)}" for _ in range(60)), lang, "s"))
    got = [r for r in lm.score(frame(spark, rows)).collect() if r.held_out]
    assert len(got) > 30
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.2 * sum(r.n_tokens for r in got) * math.log10(2)


def test_gradient_is_that_of_the_cross_entropy():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 5, (lm.FEATURES, 7)).astype(np.uint16)
    target = rng.integers(0, lm.N_CLASSES, 7)
    weights = rng.normal(size=(5, lm.N_CLASSES))
    bias = np.zeros(lm.N_CLASSES)

    def loss(w):
        return -lm.log_softmax(w, bias, rows)[np.arange(7), target].sum()

    moved, squares, touched = weights.copy(), np.zeros_like(weights), np.zeros(5, np.float32)
    lm.gradient_step(moved, squares, touched, bias, rows, target)
    assert loss(moved) < loss(weights)
    assert touched.sum() == lm.FEATURES * 7


def test_scores_without_training_texts(spark):
    only = [i for i in range(100) if held_out(i)][:3]
    got = lm.score(frame(spark, [(only[0], "a b", "en", "s"), (only[1], None, None, None)])).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 2
    assert all(math.isfinite(r.score) and r.base_score == 0 for r in got)
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_statistics(text):
    own = words(text)
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    repeated = {i + j for i in range(len(own) - 4) if grams[tuple(own[i : i + 5])] > 1 for j in range(5)}
    n = [len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)]
    return (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])


def brute_mcd(x):
    """The estimate of one group as quality.mcd makes it, with exact quantiles."""
    p = x.shape[1]
    floor = np.diag(np.square(quality.TOLERANCE))
    pick = lambda v, q: np.sort(v, axis=0)[max(0, math.ceil(q * len(v)) - 1)]
    mean = pick(x, 0.5)
    inverse = np.linalg.inv(np.diag((1.4826 * pick(np.abs(x - mean), 0.5)) ** 2) + floor)
    for _ in range(quality.STEPS):
        d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
        core = x[d <= pick(d, quality.KEPT_SHARE)]
        mean = core.mean(0)
        scatter = core.T @ core / len(core) - np.outer(mean, mean)
        inverse = np.linalg.inv(scatter * max(1, pick(d, 0.5) / quality.HALF_CHI2) + floor)
        assert inverse.shape == (p, p)
    return mean, inverse


def brute_judge(rows, least):
    stats = [brute_statistics(t) for _, t, *_ in rows]

    def vector(s):
        w, c = max(s[0], 1), max(s[1], 1)
        return [math.log(c / w), math.log1p(100 * s[2] / c), math.log1p(10 * s[3] / w), math.sqrt(s[4] / w)]

    x = np.array([vector(s) for s in stats])
    groups = {}
    for k, (r, s) in enumerate(zip(rows, stats)):
        if not s[5]:
            for g in ((0, r[2], r[3]), (1, r[2]), (2,)):
                groups.setdefault(g, []).append(k)
    fits = {g: brute_mcd(x[m]) for g, m in groups.items()}
    out = []
    for k, (r, s) in enumerate(zip(rows, stats)):
        kept = not s[5]
        if kept:
            g = next(g for g in ((0, r[2], r[3]), (1, r[2]), (2,)) if len(groups[g]) >= least or g == (2,))
            mean, inverse = fits[g]
            gap = x[k] - mean
            kept = not gap @ inverse @ gap > quality.CUTOFF
        out.append((r[0], *s, kept))
    return out


def quality_rows():
    import random

    rng = random.Random(8)
    rows = rows_of(200)
    for i in range(12):
        w = text_of(rng, 60).split()
        rows.append((2000 + i, " ".join(x + "###" for x in w), ("en", "de")[i % 2], "src0"))
    rows.append((3000, ("same line here\n" * 3) + text_of(rng, 40), "en", "src0"))
    rows.append((3001, " ".join(["a b c d e f"] * 9), "en", "src0"))
    return rows


def test_quality(spark):
    rows = quality_rows()
    got = quality.judge(frame(spark, rows), least_rows=30).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(brute_judge(rows, 30), key=repr)
    verdict = {r.doc_id: r.kept for r in got}
    assert not any(verdict[2000 + i] for i in range(12)) and not verdict[3001]
    assert sum(verdict.values()) > 0.8 * len(verdict)


def test_quality_drops_rows(spark):
    rows = quality_rows()
    keep = [r.doc_id for r in quality.judge(frame(spark, rows), least_rows=30).collect() if r.kept]
    left = quality.drop_rejected(frame(spark, rows), least_rows=30)
    assert "a.b" in left.columns
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(map(repr, keep))


def test_quality_rejects_junk_that_is_a_third_of_its_group(spark):
    import random

    rng = random.Random(9)
    junk = " ".join(w + "#$%" for w in text_of(rng, 60).split())
    rows = [(i, junk if i % 3 == 0 else text_of(rng, 40 + i % 50), "en", "src0") for i in range(330)]
    verdict = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert not any(verdict[i] for i in range(0, 330, 3))
    assert all(verdict[i] for i in range(330) if i % 3)


def test_quality_rejects_plain_outliers(spark):
    import random

    rng = random.Random(10)
    rows = [(i, text_of(rng, 40 + i % 50), "en", "src0") for i in range(200)]
    plain = text_of(rng, 200).split()
    marked = " ".join(w + "#" * (i % 3 == 0) for i, w in enumerate(plain))
    assert 0.04 < marked.count("#") / len(marked.replace(" ", "")) < 0.06
    rows += [(1000, marked, "en", "src0"), (1001, " ".join(w + w for w in plain), "en", "src0"), (1002, " ".join(plain), "en", "src0")]
    verdict = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert not verdict[1000] and not verdict[1001] and verdict[1002]
    assert all(verdict[i] for i in range(200))


def test_quality_rejects_rows_off_in_several_statistics_together(spark):
    """No statistic alone reaches a third of the cutoff, all four together pass it."""
    import random

    rng = random.Random(12)
    rows = [(i, text_of(rng, 60 + i % 30), "en", "src0") for i in range(300)]
    line = "same as the line before it"
    odd = []
    for w in text_of(rng, 150).split():
        odd.append(w + w[:2] if len(odd) % 2 else w)
    odd = [w + "#" * (i % 29 == 0) for i, w in enumerate(odd)]
    rows.append((1000, f"{line}\n{line}\n" + " ".join(odd), "en", "src0"))
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    expected = {r[0]: r[-1] for r in brute_judge(rows, 100)}
    assert {i: r.kept for i, r in got.items()} == expected
    assert all(r.kept == (not r.base_failed and r.distance <= quality.CUTOFF) for r in got.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "a b c", "en", "s")] * 3])
def test_quality_of_tiny_tables(spark, rows):
    got = quality.judge(frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)).collect()
    assert [r.kept for r in got] == [False] * len(rows)


LICENSED = [
    "Released under the MIT License.",
    "x GNU general\n public LICENSE, gnu General Public License y",
    "cc by cc-by CC/BY cc bye",
    "Licensed under CC BY-NC 4.0.",
    "mit mit license apache apache license license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
    "copy, modify, merge, publish, distribute, sublicense, and sell copies of the Software",
    "the software and the license of any person " * 20,
    "This work, licensed under the GNU General Public License version 2",
    "é mit license é",
]


def test_licenses(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(LICENSED)] + rows_of(20)
    got = scan_licenses(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t, *_) in zip(got, rows):
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower().decode())
        places = [(p, label) for phrase, label in PHRASES.items() for p in range(len(own)) if own[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(own), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.labels.split(","))) == {x for _, x in places} | {s.label for s in r.spans}
        assert 0 <= r.score <= 1 and r.score == max((s.covered for s in r.spans), default=0)
    by_id = {r.doc_id: r for r in got[: len(LICENSED)]}
    assert by_id[0].labels == "mit" and by_id[0].score == 1
    assert by_id[3].labels == "cc-by,cc-by-nc"
    assert by_id[5].labels == "mit" and by_id[5].base_labels == "" and 0.7 < by_id[5].score < 1
    assert by_id[6].labels == ""
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_spans(own, least_match=3, most_gap=6, least_covered=0.6):
    """All common runs of a text and each template by comparing every pair of places, and every chain of them."""
    spans = []
    for label, template in TEMPLATES:
        theirs = license_words(template.encode())
        runs = []
        for p in range(len(own)):
            for q in range(len(theirs)):
                if own[p] == theirs[q] and (p == 0 or q == 0 or own[p - 1] != theirs[q - 1]):
                    n = 0
                    while p + n < len(own) and q + n < len(theirs) and own[p + n] == theirs[q + n]:
                        n += 1
                    if n >= least_match:
                        runs.append((p, p + n, q))
        runs.sort()
        chains = {}

        def chain(i):
            if i not in chains:
                s, e, t = runs[i]
                chains[i] = (e - s, s, e)
                for j, (s0, e0, t0) in enumerate(runs):
                    over = max(0, e0 - s, t0 + e0 - s0 - t)
                    if s0 < s and t0 < t and e0 < e and s - e0 <= most_gap and over < e - s:
                        n = chain(j)[0] + e - s - over
                        if n > chains[i][0]:
                            chains[i] = (n, chain(j)[1], e)
            return chains[i]

        taken = []
        for n, s, e in sorted((chain(i) for i in range(len(runs))), key=lambda c: (-c[0], c[1], c[2])):
            if n / len(theirs) >= least_covered and all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                spans.append((s, e, label, n / len(theirs)))
    return sorted(spans)


def test_changed_notices(spark):
    """Every 4th, 6th or 8th word of a notice changed: label and score of all common runs in their best chain."""
    rows = []
    for label, notice in TEMPLATES:
        for every in (0, 4, 6, 8):
            own = notice.split()
            own = ["other" if every and i % every == every - 1 else w for i, w in enumerate(own)]
            rows.append((len(rows), "Some words before. " + " ".join(own) + " And some after.", label, every))
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, label string, every int")).collect()}
    for i, text, label, every in rows:
        expected = brute_spans(license_words(text.encode()))
        assert [(s.start, s.end, s.label, s.covered) for s in got[i].spans] == expected, (label, every)
        assert got[i].score == max((s[3] for s in expected), default=0)
        if every == 0:
            assert label in got[i].labels.split(",") and got[i].score == 1
        if every in (6, 8) and len(text.split()) > 30:
            assert label in got[i].labels.split(","), (label, every)
    gpl = [got[i].score for i, _, label, every in rows if label == "gpl" and every == 4 and len(rows[i][1].split()) > 30]
    assert gpl and min(gpl) > 0.6


def test_a_long_notice_is_one_span(spark):
    """Also where a run of it comes twice."""
    notice = max((t for label, t in TEMPLATES if label == "apache"), key=len)
    got = scan_licenses(spark.createDataFrame([(1, notice), (2, f"{notice} x y z u v w a b c {notice}")], "doc_id long, text string"))
    whole = {r.doc_id: [s for s in r.spans if s.covered == 1 and s.end - s.start > 50] for r in got.collect()}
    size = len(license_words(notice.encode()))
    assert {(s.start, s.end) for s in whole[1]} >= {(0, size)}
    assert {(s.start, s.end) for s in whole[2]} >= {(0, size), (size + 9, 2 * size + 9)}


def test_matching_statistics():
    """The automaton's lengths are those of a search for each run in every template."""
    import random

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25))) for _ in range(4)]
    machine = LicenseAutomaton([(str(i), t) for i, t in enumerate(texts)], {"a b": "ab", "b": "b", "c a b": "cab"})
    known = [license_words(t.encode()) for t in [*texts, "a b", "b", "c a b"]]
    for _ in range(30):
        own = [rng.choice("abcd").encode() for _ in range(40)]
        ids = [machine.vocabulary.get(w, 0) for w in own]
        for at, _, length in machine.stream(ids):
            best = max(
                n for n in range(at + 2) if n == 0 or any(own[at + 1 - n : at + 1] == k[j : j + n] for k in known for j in range(len(k)))
            )
            assert length == best
        places, _ = Scanner(machine, 3, 6, 0.6).scan(np.array(ids))
        expected = [
            (p, k) for k, phrase in enumerate(([b"a", b"b"], [b"b"], [b"c", b"a", b"b"])) for p in range(40) if own[p : p + len(phrase)] == phrase
        ]
        runs = Scanner(machine, 3, 6, 0.6).runs(np.array(ids))
        inside = {p for a, b in runs for p in range(a, b)}
        assert sorted(places) == sorted(x for x in expected if x[0] in inside)
