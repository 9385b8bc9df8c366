"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(word | class).

Words are put into classes: one for the end of a text, a few for rare words (told by
spelling), the others of frequent words by language and frequency. P(class | history) is a
maximum-entropy model over hashed features of the history: the last word, the last two
words, and skips over one and two words. P(word | class) is its relative frequency, which is the
maximum-entropy solution for the feature "the word itself"; classes of rare words add one to each
count and keep one place for a word that was never seen.

Weights are trained by gradient steps in every partition of the training texts; the
steps are averaged between rounds, each feature by how often partitions had it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import batches, binary_texts, discard, pieces, stage

N_CLASSES, RARE_CLASSES = 32, 8
END_CLASS = 0
MOST_FREQUENT = 1 << 17  # words in the broadcast table at most
FEATURE_BITS = 16
FEATURES = 4
STEP = 16384  # tokens in a gradient step
RATE = 0.5
ROUNDS = ((0, 1), (1, 4))  # quarters of the training texts, by hash, in each round
ROW_BLOCK = 1024
MEMO_WORDS = 120_000
LOG10 = math.log(10)


def rare_class(word: bytes) -> int:
    """The class of a word that is not in the table, by its spelling."""
    return 1 + 4 * (max(word) >= 0x80) + word[-1] % 4


def _count(source):
    """(word, lang, n) of training texts, summed over many batches; the end of a text is the empty word."""
    held: dict[str, Counter] = {}

    def flush():
        for lang, counter in held.items():
            words = list(counter)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w.decode() for w in words], pa.string()),
                    pa.array([lang] * len(words), pa.string()),
                    pa.array([counter[w] for w in words], pa.int64()),
                ],
                names=["word", "lang", "n"],
            )
        held.clear()

    for batch in pieces(source, 0):
        for text, lang in zip(binary_texts(batch.column(0)), batch.column(1).to_pylist()):
            counter = held.get(lang)
            if counter is None:
                counter = held[lang] = Counter()
            counter.update(text.lower().split())
            counter[b""] += 1
        if sum(map(len, held.values())) > 400_000:
            yield from flush()
    yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, lang): the count of each word of ``docs(text, lang)`` and the language that has it most."""
    pieces = docs.select("text", "lang").mapInArrow(_count, "word string, lang string, n long")
    by_lang = pieces.groupBy("word", "lang").agg(F.sum("n").alias("n"))
    top = F.max(F.struct("n", F.coalesce("lang", F.lit("")).alias("lang")))["lang"]
    return by_lang.groupBy("word").agg(F.sum("n").alias("c"), top.alias("lang"))


def frequent_threshold(counts: DataFrame, most: int = MOST_FREQUENT) -> int:
    """The smallest count so that at most ``most`` words have it or more."""
    step = F.floor(F.log2("c") * 16)
    steps = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()
    total, threshold = 0, None
    for row in sorted(steps, key=lambda r: -r["s"]):  # at most 16 rows for each doubling of the count
        if total + row["n"] > most:
            break
        total += row["n"]
        threshold = row["low"]
    return threshold if threshold is not None else 1 << 62


class Vocabulary:
    """The frequent words with their counts and classes; a fixed number at most, sent to all tasks."""

    def __init__(self, words: list[bytes], counts: np.ndarray, langs: list[str], total: int, distinct: int, ends: int):
        order = sorted(range(len(words)), key=lambda i: (langs[i], -counts[i], words[i]))
        self.words = [words[i] for i in order]
        counts = counts[order] if len(order) else np.zeros(0, np.int64)
        self.total, self.distinct = total, distinct
        mass = np.cumsum(np.sqrt(counts))
        n = N_CLASSES - 1 - RARE_CLASSES
        share = np.minimum((mass / (mass[-1] if len(mass) else 1) * n).astype(np.int64), n - 1)
        # Codes: 0 the end, 1.. rare classes, then the frequent words.
        self.first = 1 + RARE_CLASSES
        self.classes = np.concatenate([np.arange(self.first), self.first + share]).astype(np.int64)
        self.counts = np.concatenate([[ends], np.zeros(RARE_CLASSES, np.int64), counts]).astype(np.int64)
        self.class_total = np.bincount(self.classes, weights=self.counts, minlength=N_CLASSES)
        denominator = max(1, total + distinct + 1)
        with np.errstate(divide="ignore"):
            self.base = np.log10((self.counts + 1) / denominator)
            inside = np.log10(self.counts / np.maximum(1, self.class_total[self.classes]))
        # What a rare word adds inside its class is known only after the join with all counts.
        inside[1 : self.first] = 0
        inside[0] = 0
        self.inside = inside
        self.base[1 : self.first] = 0


class Codes(dict):
    """Word -> code, remembered for rare words up to a fixed number."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__({w: i + vocabulary.first for i, w in enumerate(vocabulary.words)})
        self.frequent = len(self)
        self.rare: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        code = self.rare.get(word)
        if code is None:
            if len(self.rare) >= MEMO_WORDS:
                self.rare.clear()
            code = self.rare[word] = rare_class(word)
        return code


def encode(texts: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Codes of all words and ends, the number of tokens of each text, and its words."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    look = codes.__getitem__

    def every():
        for ws in words:
            yield from map(look, ws)
            yield 0

    return np.fromiter(every(), np.int32, int(counts.sum())), counts, words


def feature_rows(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rows of the weight table that the history of each token selects, one column for each token."""
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(tokens)) - starts
    back = []
    for k in (1, 2, 3):
        before = np.zeros(len(tokens), np.uint64)
        before[k:] = tokens[:-k].astype(np.uint64) + np.uint64(1) if len(tokens) > k else 0
        before[place < k] = 0  # in front of the text
        back.append(before)
    one, two, three = back
    salted = (
        one * np.uint64(4),
        ((one << np.uint64(20)) + two) * np.uint64(4) + np.uint64(1),
        two * np.uint64(4) + np.uint64(2),
        three * np.uint64(4) + np.uint64(3),
    )
    shift = np.uint64(64 - FEATURE_BITS)
    return np.stack([((x * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.uint16) for x in salted])


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        total += weights.take(r, axis=0)
    total += bias
    total -= total.max(axis=1, keepdims=True)
    total -= np.log(np.exp(total) @ np.ones((total.shape[1], 1), total.dtype))
    return total


def gradient_step(weights, squares, touched, bias, rows, target) -> None:
    """One AdaGrad step of the cross-entropy of ``target`` on the table."""
    error = np.exp(log_softmax(weights, bias, rows))
    error[np.arange(len(target)), target] -= 1
    columns = np.arange(error.shape[1])
    flat = error.ravel()
    for r in rows:
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        which = ordered[new]
        place = np.empty(len(r), np.int64)
        place[order] = np.cumsum(new) - 1
        # The sum of the errors of each row that occurs, all columns in one count.
        slope = np.bincount((place[:, None] * len(columns) + columns).ravel(), flat, len(which) * len(columns))
        slope = slope.reshape(len(which), -1).astype(weights.dtype)
        seen = squares.take(which, axis=0) + slope * slope
        squares[which] = seen
        weights[which] -= RATE * slope / np.sqrt(seen + 1)
        touched[which] += np.bincount(place)


def _train(vocabulary, weights, bias):
    def run(source):
        words, start = vocabulary.value, weights.value
        codes = Codes(words)
        own = start.copy()
        squares = np.zeros_like(own)
        touched = np.zeros(len(own), np.float32)
        for batch in pieces(source, 0):
            tokens, counts, _ = encode(binary_texts(batch.column(0)), codes)
            rows = feature_rows(tokens, counts)
            target = words.classes[tokens]
            for at in range(0, len(tokens), STEP):
                part = slice(at, at + STEP)
                gradient_step(own, squares, touched, bias, rows[:, part], target[part])
        if touched.any():
            moved = (own - start) * touched[:, None]
            n = len(own) // ROW_BLOCK
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(n), pa.int32()),
                    pa.array([moved[i * ROW_BLOCK : (i + 1) * ROW_BLOCK].tobytes() for i in range(n)], pa.binary()),
                    pa.array([touched[i * ROW_BLOCK : (i + 1) * ROW_BLOCK].tobytes() for i in range(n)], pa.binary()),
                ],
                names=["block", "moved", "touched"],
            )

    return run


def _average(source):
    """Rows (block, moved, touched) -> their sums, for each block of a partition."""
    moved: dict[int, np.ndarray] = {}
    touched: dict[int, np.ndarray] = {}
    for batch in batches(source):
        for block, m, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            m, t = np.frombuffer(m, np.float32).astype(np.float64), np.frombuffer(t, np.float32).astype(np.float64)
            moved[block] = moved[block] + m if block in moved else m
            touched[block] = touched[block] + t if block in touched else t
    blocks = list(moved)
    mean = [
        (moved[b].reshape(ROW_BLOCK, -1) / np.maximum(touched[b], 1)[:, None]).astype(np.float32).tobytes() for b in blocks
    ]
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(mean, pa.binary())], names=["block", "mean"])


def train(docs: DataFrame, vocabulary, bias: np.ndarray) -> np.ndarray:
    """The weight table after all rounds over ``docs(text, part)``."""
    sc = docs.sparkSession.sparkContext
    n = 1 << FEATURE_BITS
    weights = np.zeros((n, N_CLASSES), np.float32)
    for low, high in ROUNDS:
        chosen = docs.filter((F.col("part") >= low) & (F.col("part") < high)).select("text")
        steps = chosen.mapInArrow(_train(vocabulary, sc.broadcast(weights), bias), "block int, moved binary, touched binary")
        means = steps.repartition(n // ROW_BLOCK, "block").mapInArrow(_average, "block int, mean binary")
        weights = weights.copy()
        for block, mean in means.collect():  # the table, whatever the number of texts
            at = slice(block * ROW_BLOCK, (block + 1) * ROW_BLOCK)
            weights[at] += np.frombuffer(bytes(mean), np.float32).reshape(ROW_BLOCK, -1)
    return weights


def _score(vocabulary, weights, bias):
    rare = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(source):
        words, table = vocabulary.value, weights.value
        codes = Codes(words)
        for batch in pieces(source, 1):
            tokens, counts, texts = encode(binary_texts(batch.column(1)), codes)
            rows = feature_rows(tokens, counts)
            target = words.classes[tokens]
            chosen = np.empty(len(tokens))
            for at in range(0, len(tokens), STEP):
                part = slice(at, at + STEP)
                logs = log_softmax(table, bias, rows[:, part])
                chosen[part] = logs[np.arange(len(logs)), target[part]]
            starts = np.cumsum(counts) - counts
            known = (tokens >= words.first) | ((tokens == 0) & (words.counts[0] > 0))
            is_rare = (tokens > 0) & (tokens < words.first)
            model = np.add.reduceat(chosen / LOG10 + words.inside[tokens], starts)
            base = np.add.reduceat(words.base[tokens], starts)
            tails = []
            for row, ws in enumerate(texts):
                at = np.flatnonzero(is_rare[starts[row] : starts[row] + counts[row]])
                tail = Counter([ws[i] for i in at.tolist()])
                tails.append([{"word": w.decode(), "n": n} for w, n in tail.items()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(base),
                    pa.array(model),
                    pa.array(tails, rare),
                ],
                names=["row", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    return run


def _rare_classes(source):
    for batch in batches(source):
        classes = [rare_class(w) if w else END_CLASS for w in binary_texts(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(classes, pa.int32())], names=["word", "c", "class"]
        )


def score(docs: DataFrame, folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang)``: its base score and the model's.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows whose
    crc32 of the doc_id's text leaves ``held_out_fold`` modulo ``folds`` are held out; the model learns
    from all others. Words are lower-cased (A-Z); each text ends with an end token. Scores
    are log10 probabilities.

    Defined cases: a null text is an empty one: one token, the end. A null doc_id counts as
    the empty text for the fold. A null language is one of its own. Without training texts
    nothing is known and P(class) is even. Repeated rows count and are scored each. Other columns are ignored.

    Scale: counts are summed before the shuffle. The table of frequent words has 131,072 at
    most and the weights 2**16 rows of 32, whatever the size of the corpus; all
    other words are joined with their counts by Spark. The texts themselves are never moved.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    fold = F.pmod(F.crc32(F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    named = docs.select(
        F.struct(F.col("`doc_id`").cast("long").alias("doc_id"), (fold == held_out_fold).alias("held_out")).alias("row"),
        F.coalesce(F.col("`text`"), F.lit("")).alias("text"),
        F.col("`lang`").alias("lang"),
    )
    training = named.filter(~F.col("row.held_out"))
    counts = stage(word_counts(training), "counts")
    sums = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    total, distinct, ends = (int(x or 0) for x in sums)

    words_only = counts.filter("word <> ''")
    threshold = frequent_threshold(words_only)
    frequent = words_only.filter(F.col("c") >= threshold).collect()  # MOST_FREQUENT rows at most
    vocabulary = Vocabulary(
        [r["word"].encode() for r in frequent],
        np.array([r["c"] for r in frequent], np.int64),
        [r["lang"] for r in frequent],
        total, distinct, ends,
    )
    rare = words_only.filter(F.col("c") < threshold).select("word", "c")
    rare = stage(rare.mapInArrow(_rare_classes, "word string, c long, class int"), "rare")
    rare_sums = {r["class"]: r for r in rare.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    mass = vocabulary.class_total.copy()
    for k, r in rare_sums.items():
        mass[k] = r["c"]
    bias = np.log((mass + 1) / (mass.sum() + N_CLASSES)).astype(np.float32)
    vocabulary = sc.broadcast(vocabulary)
    parted = training.select("text", F.pmod(F.xxhash64("text"), F.lit(ROUNDS[-1][1])).alias("part"))
    weights = sc.broadcast(train(parted, vocabulary, bias))

    scored = named.select("row", "text").mapInArrow(
        _score(vocabulary, weights, bias),
        "row struct<doc_id:bigint,held_out:boolean>, n_tokens long, n_known long, base_score double, score double, "
        "rare array<struct<word:string,n:bigint>>",
    )
    scored = stage(scored.withColumn("id", F.monotonically_increasing_id()), "scored")
    # A rare word: its count, or none; inside its class it has (c + 1) of all counts, words and one place for the unseen.
    sizes = F.create_map(
        *[
            x
            for k in range(1, 1 + RARE_CLASSES)
            for x in (F.lit(k), F.lit(float(rare_sums[k]["c"] + rare_sums[k]["v"] + 1 if k in rare_sums else 1)))
        ]
    )
    tail = scored.select("id", F.explode("rare").alias("r")).select("id", "r.word", "r.n")
    count = F.coalesce("c", F.lit(0))
    # The sum over a class needs the class of unseen words as well, so it is found by spelling here too.
    code = F.encode("word", "utf-8")
    spelled = F.lit(1) + F.when(F.length("word") < F.octet_length("word"), 4).otherwise(0) + F.pmod(
        F.conv(F.hex(F.substring(code, -1, 1)), 16, 10).cast("int"), F.lit(4)
    )
    added = (
        tail.join(rare.select("word", "c"), "word", "left")
        .select(
            "id",
            F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"),
            (F.col("n") * F.log10((count + 1) / F.lit(float(max(1, total + distinct + 1))))).alias("base"),
            (F.col("n") * F.log10((count + 1) / sizes[spelled])).alias("inside"),
        )
        .groupBy("id")
        .agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("inside").alias("inside"))
    )
    discard(counts)
    return (
        scored.drop("rare")
        .join(added, "id", "left")
        .select(
            "row.doc_id",
            "row.held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("inside", F.lit(0.0))).alias("score"),
        )
    )
