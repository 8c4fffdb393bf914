"""Filter interaction audit: what each of five filters removes, in every order of application.

Words are exploded and counted by (document, word), then by document for totals and distinct
words; the flags that need no words come from a second reading of the rows and meet the counts in
an outer join. A document is then five bits, the filters that it fails. Each part gets 32
conditional counts, one for each set of failed filters, for all, good and toxic documents; all
120 orders follow from these by arithmetic, as does each filter's Shapley value.

Texts are dealt by document once, so that both aggregates find their rows together; no row
leaves for another task on the way. Copies are told by SHA-256: a copy is a row that is not the
smallest doc_id of its text, so that large groups of copies are only ever counted down to one row.

Null text counts as empty, null lang as ''. A row without a doc_id never fails filter E and has
no labels. Rows that repeat a doc_id each count, with their own text; of labels that repeat a
doc_id any 1 counts. Other columns are ignored. Long texts are read whole. An empty table gives no
rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the filters, in the order of their bits (fixed values).
FILTERS = "ABCDE"
#: Failure conditions' numbers: fewest words, least share of distinct words, largest share of capitals, both in percent (fixed values).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
#: Characters that a text must not hold (fixed values).
MARKS = r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
SETS = 1 << len(FILTERS)


def keyed(documents: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # coalesce() tells that it is never null: else joins would work it out once more to filter by it
    return rows.select("doc_id", "part", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("text_key"), *more)


def word_counts(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, words and distinct words of the documents that have any; rows that are equal in both keys add up."""
    rows = keyed(documents, F.col("text")).repartition("doc_id", "text_key")
    words = rows.select("doc_id", "text_key", F.explode(F.split("text", BLANKS)).alias("word")).where("word <> ''")
    each = words.groupBy("doc_id", "text_key", "word").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id", "text_key").agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the bits of the filters that it fails, good and toxic of each row of documents."""
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    shown = keyed(documents, (100 * capitals > MOST_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(MARKS).alias("d"))
    rows = shown.withColumn("copies", F.count("*").over(Window.partitionBy("doc_id", "text_key")))
    firsts = shown.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    counts = word_counts(documents).withColumnsRenamed({"doc_id": "of", "text_key": "of_key"})
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = rows.join(counts, rows.doc_id.eqNullSafe(counts.of) & (rows.text_key == counts.of_key), "left").drop("of", "of_key")
    met = met.join(firsts, ["doc_id", "text_key"], "left").join(told, "doc_id", "left")
    words = F.coalesce("words", F.lit(0)) / F.col("copies")
    fails = {"A": words < LEAST_WORDS, "B": 100 * F.coalesce("distinct", F.lit(0)) < LEAST_DISTINCT * words, "C": F.col("c"), "D": F.col("d"), "E": F.col("doc_id").isNotNull() & F.col("first").isNull()}
    bits = sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return met.select("part", bits.alias("fails"), yes("good"), yes("toxic"))


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley."""
    rows = failures(documents, labels)
    groups = {"docs": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = rows.groupBy("part").agg(*[F.count_if((F.col("fails") == s) & which).alias(f"{name}_{s}") for name, which in groups.items() for s in range(SETS)])
    parts = counted.select("part", *[F.array(*[F.col(f"{name}_{s}") for s in range(SETS)]).alias(name) for name in groups])
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("bit", F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.col("filter"))))
    steps = steps.withColumn("before", sum((F.when(F.contains(before, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0)))
    has = lambda s, bits: s.bitwiseAND(F.col(bits)) != 0

    def total(name: str, value) -> Column:
        """The sum over all sets of failed filters of a value of the set and its count."""
        each = F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda s: value(s, F.get(F.col(name), s)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    zero = F.lit(0).cast("long")
    out = lambda s, n: F.when(has(s, "bit") & ~has(s, "before"), n).otherwise(zero)
    every = len(list(permutations(FILTERS)))
    return steps.select(
        "part", "filter_order", "step", "filter",
        total("docs", lambda s, n: F.when(has(s, "bit") | has(s, "before"), zero).otherwise(n)).alias("kept"),
        total("docs", out).alias("removed"),
        total("docs", lambda s, n: F.when(has(s, "bit") & has(s, "before"), n).otherwise(zero)).alias("redundant"),
        F.get("docs", F.col("bit")).alias("unique_fails"),
        total("good", out).alias("good_lost"),
        total("toxic", out).alias("toxic_lost"),
        # of the orders, those share in which the filter comes first of all that the document fails
        total("docs", lambda s, n: F.when(has(s, "bit"), (n * F.lit(every) / F.bit_count(s)).cast("long")).otherwise(zero)).alias("shapley"),
    )
