"""Chat formatting with Spark expressions only.

A conversation becomes one text. Adjacent turns of one role form a block:

    <|im_start|>role\\n text <|im_next|> text <|im_end|>\\n

Inside roles and texts a backslash becomes two, and ``<|`` becomes ``<\\|``, so no control
string is left in them and ``unescape`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 128  # turns summed together
START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """A role is one line: its line breaks become a backslash and an n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")  # at escaped backslashes, so that \n is a line break in what is left
    return F.array_join(
        F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\"
    )


def running_starts(lengths: Column) -> Column:
    """The sum of all that is before each element of an array.

    By sums of slices of the array, and in a slice by the elements before: a fold that appends to an array
    would copy it every time.
    """
    last = F.greatest(F.floor((F.size(lengths) - 1) / SLICE), F.lit(0)).cast("int")

    def total(of, start, n):
        return F.aggregate(F.slice(of, start, n), F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    slices = F.transform(F.sequence(F.lit(0), last), lambda k: total(lengths, k * SLICE + 1, F.lit(SLICE)))
    before = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), total(slices, F.lit(1), k).alias("n")))
    inside = F.transform(
        before,
        lambda s: F.transform(
            F.slice(lengths, s["k"] * SLICE + 1, F.lit(SLICE)),
            lambda _, i: s["n"] + total(lengths, s["k"] * SLICE + 1, i),
        ),
    )
    return F.flatten(inside)


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, text, n_turns, n_blocks, loss_spans) for each conv_id of ``turns(conv_id, turn, role, text)``.

    loss_spans are the intervals [start, end) of the formatted text, in code points, that hold the
    texts of the role ``learn``: markers are outside, and a text stays escaped.

    Defined cases: null texts and roles are empty ones. Rows are ordered by turn, null first,
    then by role and text, so repeated turn numbers have one order and repeated rows
    are kept. Null is a conversation of its own. A conversation whose texts are empty
    has empty spans. Other columns are ignored. No rows, no conversations.

    Scale: one shuffle by conv_id. A formatted conversation is one value, so the turns of
    one have to meet in one task; they are escaped before and joined as arrays. Where they start
    comes from sums of slices, a step for every other turn of a slice of 128 and for every slice.
    """
    row = F.struct(
        F.col("`turn`").alias("turn"),
        F.coalesce(F.col("`role`"), F.lit("")).alias("role"),
        F.coalesce(F.col("`text`"), F.lit("")).alias("text"),
    )
    collected = turns.groupBy(F.col("`conv_id`").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def role(i):
        return F.get(F.col("turns"), i)["role"]

    # A turn opens a block unless the one before has its role, and closes it unless the one after has.
    def part(x, i):
        opens = ~F.coalesce(role(i - 1) == x["role"], F.lit(False))
        closes = ~F.coalesce(role(i + 1) == x["role"], F.lit(False))
        return F.struct(
            F.when(opens, F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))).otherwise(F.lit(NEXT)).alias("head"),
            escape(x["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (x["role"] == learn).alias("learned"),
            opens.alias("opens"),
        )

    parts = collected.select("conv_id", F.transform("turns", part).alias("parts"))
    lengths = F.transform(
        "parts", lambda x: (F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])).cast("long")
    )
    placed = parts.withColumn("lengths", lengths).withColumn("starts", running_starts(F.col("lengths")))
    spans = F.transform(
        F.filter(F.arrays_zip("parts", "starts"), lambda z: z["parts"]["learned"]),
        lambda z: F.struct(
            (z["starts"] + F.length(z["parts"]["head"])).alias("start"),
            (z["starts"] + F.length(z["parts"]["head"]) + F.length(z["parts"]["body"])).alias("end"),
        ),
    )
    return placed.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("text"),
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda x: x["opens"])).cast("long").alias("n_blocks"),
        spans.alias("loss_spans"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    blocks = F.filter(F.split(text, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block):
        body = F.substring_index(block, "<|im_end|>", 1)
        head = F.substring_index(body, "\n", 1)
        texts = F.split(F.substr(body, F.length(head) + F.lit(2)), r"<\|im_next\|>")
        return F.transform(texts, lambda t: F.struct(unescape_role(head).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_texts(text: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(
        spans, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
