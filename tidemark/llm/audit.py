"""Audit of filters applied one after another: what each removes in every order, by parity sums.

With five filters a row fails one of 32 sets of them. Each part and label adds up 32 signed sums: for each set S the rows, counted
minus where they fail an odd number of S's filters. These sums are additive, so they combine before the shuffle and over tables that
come later; the Walsh-Hadamard transform, its own inverse but for a factor of 32, turns them into exact counts of the 32 cells.
All orders and Shapley values are read off the cells, without going over the rows again.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)


def words_of_text(text: Column) -> Column:
    return F.filter(F.split(text, WORD.replace("[^", "[")), lambda w: w != "")


def text_failures(text: Column, words: Column) -> Column:
    """Bits 1, 2, 4 and 8: under 50 words; under 65 distinct words in 100; over 5 capitals in 100 characters; any of #$%&*|."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    conditions = [n < 50, 100 * different < 65 * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)])


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, label, failed (bits of the filters), n: so many rows of docs (doc_id, text, source) fail just these filters.

    The last bit: an equal text stands in the table under a smaller doc_id. Equal means equal SHA-256. label: 1 if a row of
    labels with that doc_id has quality 1, plus 2 if one has toxic 1. A null text counts as empty, a null source is part ''. A row
    without doc_id has no label, no smaller one, and is smaller than none; rows of one doc_id and text are not copies of each other.

    Rows of one text, part and doc_id are put together first, then those of one text, part and label, both before they are
    shuffled; what meets by text is a row for each part and label, so a text in a third of all rows makes no large group.
    """
    text, id_ = F.col("text"), F.col("doc_id")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words_of_text(text))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("key"), text_failures(text, F.col("words")).alias("failed"))
    rows = rows.groupBy("key", "failed", "part", "doc_id").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.expr("max(if(quality <=> 1, 1, 0)) + max(if(toxic <=> 1, 2, 0))").alias("label"))
    # Rows without doc_id are spread by their text, under keys that no label has.
    rows = rows.withColumn("_id", F.coalesce(id_.cast("string"), F.concat(F.lit("?"), F.hex("key"))))
    marks = marks.select(id_.cast("string").alias("_id"), "label")
    rows = rows.join(marks, "_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    alike = rows.groupBy("key", "failed", "part", "label").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(id_.isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(id_.isNotNull(), F.struct("doc_id", "n"))).alias("least")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("key"))
    alike = alike.withColumn("heads", F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct("failed", F.col("heads").alias("n")), F.struct(F.col("failed").bitwiseOR(CELLS >> 1).alias("failed"), (F.col("n") - F.col("heads")).alias("n")))
    return alike.select("part", "label", F.inline(both))


def parity_sums(counts: DataFrame) -> DataFrame:
    """part, label and sums: for each set S of filters, 0 to 31, the rows counted minus where they fail an odd number of S's."""
    sums = [F.sum(F.when(F.bit_count(F.col("failed").bitwiseAND(s)) % 2 == 0, F.col("n")).otherwise(-F.col("n"))) for s in range(CELLS)]
    return counts.groupBy("part", "label").agg(*[x.alias(f"s{s}") for s, x in enumerate(sums)]).select("part", "label", F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


#: Rows in each of the 32 cells from the parity sums w, rows that fail none of a set from the cells c, and the sum over all orders
#: of what the filter of a bit removes: of the orders, one in as many as a row fails has that filter first among those.
_EACH = f"sequence(0, {CELLS - 1})"
_CELLS = f"transform({_EACH}, m -> aggregate({_EACH}, 0L, (t, s) -> t + if(bit_count(m & s) % 2 = 0, {{w}}[s], -{{w}}[s])) div {CELLS})"
_FREE = f"transform({_EACH}, p -> aggregate({_EACH}, 0L, (t, m) -> t + if((m & p) = 0, {{c}}[m], 0L)))"
_SHAPLEY = f"aggregate({_EACH}, 0L, (t, m) -> t + if((m & bit) = 0, 0L, {{c}}[m] * 120 div bit_count(m)))"


def audit(sums: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step's filter does there. sums: see parity_sums.

    filter_order, step (from 1), kept (rows that pass up to here), removed (here), redundant (fail here, gone before),
    unique_fails (fail here only), good_lost and toxic_lost (removed here, by label), shapley (removed by this filter over
    all 120 orders). Parts of all values, and all zeros; no rows of a table without rows.
    """
    total = lambda labels: F.array(*[F.sum(F.when(F.col("label").isin(labels), F.col("sums")[s]).otherwise(0)) for s in range(CELLS)])
    parts = sums.groupBy("part").agg(total([0, 1, 2, 3]).alias("all"), total([1, 3]).alias("good"), total([2, 3]).alias("toxic"))
    cells = parts.select("part", *[F.expr(_CELLS.format(w=f"`{c}`")).alias(c) for c in ("all", "good", "toxic")])
    free = cells.select("part", F.col("all").alias("cells"), *[F.expr(_FREE.format(c=f"`{c}`")).alias(c) for c in ("all", "good", "toxic")])
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = free.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, ascii(substring(filter_order, {0}, 1)) - 65)"
    steps = steps.withColumn("bit", F.expr(bit.format("step"))).withColumn("upto", F.expr(f"aggregate(sequence(1, step), 0, (b, k) -> b | {bit.format('k')})"))
    lost = lambda c: F.col(c)[F.col("upto") - F.col("bit")] - F.col(c)[F.col("upto")]
    return steps.select(
        "part", "filter_order", "step", F.col("all")[F.col("upto")].alias("kept"), lost("all").alias("removed"), (F.col("all")[0] - F.col("all")[F.col("bit")] - lost("all")).alias("redundant"),
        F.col("cells")[F.col("bit")].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.expr(_SHAPLEY.format(c="cells")).alias("shapley"),
    )
