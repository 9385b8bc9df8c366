"""Spelling variants of a vocabulary by an index of variable-length grams.

1. A dictionary of frequent grams is counted over all words (with a mark before and after each) by
   rising length; a longer gram is counted only where the one it grows from is frequent.
2. A word has one gram at each place: the shortest of the lengths in ``LENGTHS`` that is not
   frequent. Which gram that is depends on its own characters alone, so an edit changes only
   the grams that lie over it.
3. From that comes a bound for each word: of any of its grams, one edit affects at most as many as lie over
   one character. A word asks with so few grams that this bound is still less than their
   number: the two rarest of which none lies over a character of the other. One of them stays whatever the edit.
4. Every word is listed under all its grams, by place and length of the word, and the lists of the grams that
   a word asks with are merged: who is in one of them and passes verification is one edit away.

Two words of lengths c and c or c + 1 are compared by grams of less than c characters, so that each word
has two grams that lie apart: nothing is missed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import batches, discard, mix, pieces, plain, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LENGTHS = (3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20)
FIRST_LENGTHS = 3  # so many lengths are counted in the first pass over the words
LEAST_LENGTH = 4
KNOWN, OFTEN = 32, 512
DICTIONARY = 1 << 20  # grams at most, of 16 bytes each
LIST_WORDS = 4096
PAIRS = 1_000_000  # compared at a time
HELD_WORDS = 300_000
_BASE = 0x9E3779B97F4A7C15
_START, _END = 1, 2


def changed_runs(doc_id: bytes | None, text: bytes, every: int) -> Counter:
    """The lower-cased runs of a text with their counts, some with a character left out.

    A run goes without its character h % length if ``every`` divides h, the crc32 of ``<doc_id>:<run>``.
    """
    counts = Counter(RUN.findall(text.lower().decode("utf-8", "replace")))
    if doc_id is None or not every:
        return counts
    seed = zlib.crc32(doc_id + b":")
    out: Counter = Counter()
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), seed)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _count_words(least_length: int, every: int):
    def flush(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
        )

    def run(source):
        held: dict[str, int] = {}
        for batch in pieces(source, 1):
            ids, texts = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, text in zip(ids, texts):
                for word, n in changed_runs(doc_id, text or b"", every).items():
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield flush(held)
                    held = {}
        yield flush(held)

    return run


def corpus_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts with their counts.

    Runs are of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. With ``every`` some runs lose a
    character, see ``changed_runs``; 0 leaves all as they are.

    Defined cases: null texts have no words; a row with a null doc_id has its runs unchanged. Repeated rows count
    again. Other columns are ignored.

    Scale: counts are summed in each task before they are shuffled; a task holds at most ``HELD_WORDS``.
    """
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("string"), "text")
    counted = rows.mapInArrow(_count_words(least_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Words:
    """The characters of many words one after the other, each word with a mark before and after it."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        marked = chr(_START) + (chr(_END) + chr(_START)).join(words) + chr(_END)
        chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.empty(0, np.uint32)
        self.ends = np.cumsum(self.lengths + 2)
        self.starts = self.ends - self.lengths - 2
        power = np.full(len(chars) + 1, _BASE, np.uint64)
        power[0] = 1
        inverse = np.full(len(chars) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        self.sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, word) wherever a gram can start: up to the last that has the least length."""
        counts = np.maximum(self.lengths + 2 - LENGTHS[0] + 1, 0)
        word = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        return self.starts[word] + np.arange(len(word)) - first[word], word

    def grams(self, place: np.ndarray, length) -> np.ndarray:
        """Polynomial hash, modulo 2**64, of the characters from each place on, and of their number."""
        value = (self.sums[place + length] - self.sums[place]) * self.inverse[place]
        return mix(value + np.asarray(length, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Grams:
    """Known grams: sorted hashes and how many places have each; often is the count above which a gram has to grow."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, often: int):
        order = np.argsort(grams)
        self.grams, self.counts, self.often = grams[order], counts[order], often

    def counted(self, grams: np.ndarray) -> np.ndarray:
        """The counts of grams, 0 of unknown ones."""
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        return np.where(self.grams[at] == grams, self.counts[at], 0)


def _count_grams(steps: range, dictionary):
    """Grams of the lengths LENGTHS[steps] with their number of places; a longer one only where the one before is known."""

    def run(source):
        for batch in batches(source):
            words = Words(batch.column(0).to_pylist())
            place, word = words.places()
            for step in steps:
                fits = place + LENGTHS[step] <= words.ends[word]
                if step == steps[0] and step:
                    fits[fits] = dictionary.value.counted(words.grams(place[fits], LENGTHS[step - 1])) > 0
                place, word = place[fits], word[fits]
                gram, n = np.unique(words.grams(place, LENGTHS[step]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return run


def gram_dictionary(words: DataFrame):
    """The frequent grams of all words as broadcast ``Grams``, at most ``DICTIONARY`` of them.

    Known are those at more than ``KNOWN`` places; more for a vocabulary with so many places that there
    could be more than ``DICTIONARY`` of them. A gram at more than ``OFTEN`` places, and 16 times as many as
    have to be for a known one, has to grow.
    """
    sc = words.sparkSession.sparkContext
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    known = max(KNOWN, places * len(LENGTHS) // DICTIONARY + 1)
    often = max(OFTEN, known * (OFTEN // max(KNOWN, 1)))
    grams, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for steps in (range(FIRST_LENGTHS), range(FIRST_LENGTHS, len(LENGTHS))):
        so_far = sc.broadcast(Grams(grams, counts, often))
        counted = words.select("word").mapInArrow(_count_grams(steps, so_far), "gram long, n long")
        more = counted.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > known)
        more = more.toArrow()  # at most places * lengths / known
        grams = np.concatenate([grams, more.column("gram").to_numpy().view(np.uint64)])
        counts = np.concatenate([counts, more.column("n").to_numpy()])
    return sc.broadcast(Grams(grams, counts, often))


def decompose(words: Words, dictionary: Grams, most: np.ndarray):
    """(place, word, gram, length, count) of the gram at each place; ``most`` bounds the lengths for each word.

    A gram that is frequent grows to the next length. Where the word ends before that, the gram takes in all up to
    the end. count is what the dictionary knows of the gram, or of the last one that it has grown from.
    """
    place, word = words.places()
    length = np.full(len(place), LENGTHS[0], np.int64)
    gram = words.grams(place, length)
    count = dictionary.counted(gram)
    growing = np.flatnonzero(count > dictionary.often)
    for step in LENGTHS[1:]:
        growing = growing[most[word[growing]] >= step]
        left = words.ends[word[growing]] - place[growing]
        length[growing] = np.minimum(left, step)
        gram[growing] = words.grams(place[growing], length[growing])
        growing = growing[left >= step]
        count[growing] = dictionary.counted(gram[growing])
        growing = growing[count[growing] > dictionary.often]
    return place, word, gram, length, count


def asked(words: Words, place, word, length, cost) -> np.ndarray:
    """The two grams of each word that lie apart and cost least together, as indexes into ``place``.

    One edit affects grams over one character only, so at most one of the two.
    """
    cost = np.minimum(cost, (1 << 20) - 1).astype(np.int64)
    end = place + length
    order = np.lexsort((end, word))
    # The least cost so far and where, in each word: later words have smaller codes, so the minimum starts anew.
    code = (-(word[order].astype(np.int64)) << 48) + (cost[order] << 28) + order
    least = np.minimum.accumulate(code)
    before = np.searchsorted(end[order], place, side="right") - 1  # ends rise over all words
    same = (before >= 0) & (word[order[np.maximum(before, 0)]] == word)
    later = np.flatnonzero(same)
    found = least[before[later]] + (word[later].astype(np.int64) << 48)
    earlier, total = found & ((1 << 28) - 1), (found >> 28) + cost[later]
    pick = np.lexsort((later, total, word[later]))
    first = np.unique(word[later[pick]], return_index=True)[1]
    return np.sort(np.concatenate([later[pick][first], earlier[pick][first]]))


def _longest(classes: np.ndarray) -> np.ndarray:
    """The largest length in LENGTHS under each class."""
    lengths = np.array(LENGTHS)
    return lengths[np.maximum(np.searchsorted(lengths, classes) - 1, 0)]


# A longer word is listed at the place of a gram and at the one before: the edit is behind the gram, or before it.
ASKS, SAME, LONGER, MOVED = 0, 1, 2, 3


def _post(dictionary, least_length: int, only_often: bool = False):
    """Words -> postings (class, key, role, left, right, word, n).

    A word asks in the class of its length with two grams, is listed there with all, and in the class below with
    all, each once at its own place and once at the one before. left and right are hashes of all up to the gram's
    end and of all from its start. ``only_often`` leaves just the lists of frequent grams.
    """

    def run(source):
        for batch in batches(source):
            words = Words(batch.column(0).to_pylist())
            for role in (SAME, LONGER):
                classes = words.lengths - (role == LONGER)
                place, word, gram, length, count = decompose(words, dictionary.value, _longest(classes))
                often = count > dictionary.value.often
                used = np.flatnonzero((classes[word] >= least_length) & (often | (not only_often)))
                takes = [(role, used)]
                if role == LONGER:
                    takes.append((MOVED, used))
                elif not only_often:
                    takes.append((ASKS, asked(words, place, word, length, _costs(words, place, word, length, count))))
                for as_role, take in takes:
                    w, p = word[take], place[take]
                    at = p - words.starts[w] - (as_role == MOVED)
                    key = mix(gram[take] + mix(at.astype(np.uint64) * np.uint64(_BASE) + classes[w].astype(np.uint64)))
                    left = words.grams(words.starts[w], p + length[take] - words.starts[w])
                    right = words.grams(p, words.ends[w] - p)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(classes[w]),
                            pa.array(key.view(np.int64)),
                            pa.array(np.full(len(w), as_role, np.int32)),
                            pa.array(left.astype(np.uint32).view(np.int32)),
                            pa.array(right.astype(np.uint32).view(np.int32)),
                            batch.column(0).take(pa.array(w)),
                            batch.column(1).take(pa.array(w)),
                        ],
                        names=["class", "key", "role", "left", "right", "word", "n"],
                    )

    return run


def _costs(words: Words, place, word, length, count) -> np.ndarray:
    """How long the lists of grams are, about: those at either end of a word have one place, others many."""
    at_end = (place == words.starts[word]) | (place + length == words.ends[word])
    return np.maximum(count, KNOWN // 2) * np.where(at_end, 6, 1)


class Packed:
    """Words of c characters, and some of c + 1, in whole 64-bit numbers: 8, 4 or 2 characters each, by the largest."""

    def __init__(self, texts: pa.StringArray, c: int):
        padded = pa.concat_arrays([pc.utf8_rpad(texts, c + 1, "\0")])  # a copy without an offset
        joined = padded.buffers()[2].to_pybytes().decode("utf-8")
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.bits = next(b for b in (8, 16, 32) if int(chars.max(initial=0)) < 1 << b)
        codes = chars.reshape(-1, c + 1).astype(f"u{self.bits // 8}")
        own, moved = codes[:, :c], codes[:, 1:]
        full = -(-c * self.bits // 64) * (64 // self.bits)
        self.own, self.moved = (
            np.ascontiguousarray(np.pad(x, ((0, 0), (0, full - c)))).view(np.uint64).T.copy() for x in (own, moved)
        )
        one = np.uint64(sum(1 << k for k in range(0, 64, self.bits)))
        self.high = one << np.uint64(self.bits - 1)

    def _other(self, x: np.ndarray) -> np.ndarray:
        """The highest bit of each character that is not zero."""
        rest = ~self.high
        return (((x & rest) + rest) | x) & self.high

    def replaced(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of words of c characters differ in exactly one."""
        n = np.zeros(len(a), np.int64)
        for own in self.own:
            n += np.bitwise_count(self._other(own[a] ^ own[b]))
        return n == 1

    def inserted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which words b of c + 1 characters are the words a with one more: all behind the first other one moves by one."""
        fits, parted = np.ones(len(a), bool), np.zeros(len(a), bool)
        for own, moved in zip(self.own, self.moved):
            x = own[a]
            other, behind = self._other(x ^ own[b]), x ^ moved[b]
            first = (other & (~other + np.uint64(1))) >> np.uint64(self.bits - 1)
            fits &= np.where(parted, behind == 0, (other == 0) | (behind < first))
            parted |= other != 0
        return fits


def _merge(source):
    """Postings sorted by (class, key, part, role) -> pairs of words that are one edit apart.

    One edit leaves all on one side of a gram as it is, so only pairs with an equal side are looked at.
    """

    def pairs(table: pa.Table):
        table = table.combine_chunks()
        classes, role = table.column(0).to_numpy(), table.column(3).to_numpy()
        new = np.ones(len(role), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in (table.column(i).to_numpy() for i in range(3))], axis=0)
        group = np.cumsum(new) - 1
        # Lists that nobody asks for are left out.
        used = np.bincount(group, role == ASKS)[group] > 0
        table, classes, role = table.filter(pa.array(used)), classes[used], role[used]
        if not len(role):
            return
        group = group[used].astype(np.uint64) << np.uint64(32)
        text = table.column(6).combine_chunks()
        packs = {}
        for side, kept in ((4, LONGER), (5, MOVED)):
            # List and side in one number: those who ask find the listed ones with all equal on that side.
            code = group | table.column(side).to_numpy().view(np.uint32)
            listed = np.flatnonzero((role == SAME) | (role == kept))
            listed = listed[np.argsort(code[listed], kind="stable")]
            asking = np.flatnonzero(role == ASKS)
            low = np.searchsorted(code[listed], code[asking], side="left")
            many = np.searchsorted(code[listed], code[asking], side="right") - low
            asking, low, many = asking[many > 0], low[many > 0], many[many > 0]
            for c in np.unique(classes[asking]).tolist():
                first, last = (int(np.searchsorted(classes, c, x)) for x in ("left", "right"))
                packed = packs[c] = packs.get(c) or Packed(text.slice(first, last - first), c)
                own = np.flatnonzero(classes[asking] == c)
                step = np.cumsum(many[own]) // PAIRS
                for some in np.split(own, np.flatnonzero(np.diff(step)) + 1):
                    n = many[some]
                    a = np.repeat(asking[some], n)
                    b = listed[np.arange(len(a)) + np.repeat(low[some] - (np.cumsum(n) - n), n)]
                    more = role[b] == kept
                    near = np.empty(len(a), bool)
                    near[~more] = packed.replaced(a[~more] - first, b[~more] - first)
                    near[more] = packed.inserted(a[more] - first, b[more] - first)
                    a, b = a[near], b[near]
                    for x, y in ((a, b), (b, a)) if len(a) else ():
                        x, y = pa.array(x), pa.array(y)
                        yield pa.RecordBatch.from_arrays(
                            [text.take(x), text.take(y), table.column(7).take(y).combine_chunks()],
                            names=["word", "near", "near_n"],
                        )

    held: list[pa.RecordBatch] = []
    for batch in batches(source):
        # All but the last list are whole; that one waits for the next batch.
        ids = [batch.column(i).to_numpy() for i in range(3)]
        last = np.all([x == x[-1] for x in ids], axis=0)
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif held and any(held[-1].column(i)[-1].as_py() != x[0] for i, x in enumerate(ids)):
            yield from pairs(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from pairs(pa.Table.from_batches(held))


def near_words(words: DataFrame, least_length: int = 5) -> DataFrame:
    """(word, near, near_n): every pair of words that are one inserted, deleted or replaced code point apart, both ways.

    ``words(word, n)`` has each word once; all have ``least_length`` (four at least) code points or more.

    Scale: a word is listed about three times for each of its characters, and asks twice. A list of a gram that is
    not frequent has at most ``OFTEN`` words, or what ``gram_dictionary`` makes of it; the others are counted,
    and long ones dealt out in parts, each of which those that ask come to.
    """
    if least_length < LEAST_LENGTH:
        raise ValueError(f"words need {LEAST_LENGTH} code points or more")
    dictionary = gram_dictionary(words)
    schema = "class long, key long, role int, left int, right int, word string, n long"
    posted = words.select("word", "n").mapInArrow(_post(dictionary, least_length), schema)
    often = words.select("word", "n").mapInArrow(_post(dictionary, least_length, True), schema)
    long = often.groupBy("class", "key").agg(F.count("*").alias("m")).filter(F.col("m") > LIST_WORDS)
    long = stage(long.select("class", "key", F.ceil(F.col("m") / LIST_WORDS).cast("long").alias("parts")), "lists")
    by = ["class", "key", "part"]
    rows = posted.withColumn("part", F.lit(0).cast("long"))
    if long.take(1):
        last = F.coalesce("parts", F.lit(1)) - 1
        own = F.pmod(F.xxhash64("word"), last + 1)
        parts = F.when(F.col("role") == ASKS, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array(own))
        rows = posted.join(long, ["class", "key"], "left").withColumn("part", F.explode(parts))
    rows = rows.select(*by, "role", "left", "right", "word", "n").repartition(*by).sortWithinPartitions(*by, "role")
    found = stage(rows.mapInArrow(_merge, "word string, near string, near_n long").distinct(), "near")
    discard(long)
    return found


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: where the forms of forms end; no word leads back to itself.

    Every round joins the table with itself, so k rounds follow 2 ** k steps.
    """
    current = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(
            current.join(onward, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        discard(current)
        current = moved
        if not moved.filter("moved").take(1):
            return moved.select("word", "root")
        current = moved.drop("moved")
        current.staged_path = moved.staged_path


def variants(words: DataFrame, least_length: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words(word, n)``.

    n_near counts the words one edit away. The form is the one of them with the largest n (ties: the
    smallest in code-point order) if that is at least twice the word's own, else null; the root is
    where forms lead to, the word itself without one.

    Defined cases: an empty table has no rows. Words come once each, with n of 1 or more, as from ``corpus_words``.
    """
    words = stage(words.select("word", "n"), "words")
    near = near_words(words, least_length)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.rank") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.rank")).alias("n"))).alias("to"),
    )
    joined = stage(joined, "forms")
    discard(near, words)
    roots = follow(joined.filter("to is not null").select("word", F.col("to.form").alias("form")))
    return joined.join(roots, "word", "left").select(
        "word",
        F.col("to.form").alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        "n_near",
        F.col("to.n").alias("form_n"),
    )
