"""Benchmark decontamination by template windows, in Spark expressions alone.

Numbers, names (capitalised words within a sentence) and units become typed placeholders, so
an item asked again with other numbers or names keeps its template. Windows of ``WINDOW``
template words of documents meet those of items in a hash join. Matches are gathered by
alignment (the window's place in the document less that in the item). In an alignment, windows
whose words equal the item's count; a window that differs in a slot counts if each of its slot
values has one value in the whole alignment. A document is contaminated by an item if the
windows that count make up ``LEAST_SHARE`` of the item's, or ``LEAST_WINDOWS``. An item of fewer than
``WINDOW`` words is too short for a template: it is one window of its own length and matches where all
its words stand, whatever their case.

Null and empty texts match nothing. Rows that repeat
a doc_id count as one document; rows without a doc_id count as one document for each text. Other
columns are kept by ``keep_clean`` whatever their names, and ignored else; empty tables give no
rows. Long texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 5
LEAST_SHARE = 0.5
LEAST_WINDOWS = 10
#: Items' windows that may be sent to all executors; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000

#: Units (fixed values).
UNITS = ["mm", "cm", "km", "mg", "kg", "ml", "lb", "lbs", "oz", "mph", "kmh", "usd", "eur", "gbp", "percent", "dollars", "euros", "pounds", "cents", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "miles", "metres", "meters", "kilometers", "kilometres", "feet", "inches", "litres", "liters", "grams", "kilograms", "degrees"]

NUMBER, NAME, UNIT = 1, 2, 3
NAME_MARK = "\x01"


def templates(rows: DataFrame) -> DataFrame:
    """Adds ``words`` (lower case, names marked) and ``keys`` (placeholders 1 to 3, other words' hashes)."""
    text = F.regexp_replace(F.translate("text", NAME_MARK, " "), r"[.,](?=[0-9])(?<=[0-9].)", "")
    named = F.regexp_replace(text, r"\p{Lu}(?=\p{Ll})(?<=[\p{Ll}\p{N},;] .)", NAME_MARK + "$0")
    words = F.array_remove(F.split(F.lower(named), r"[^\p{L}\p{N}\x01]+"), "")
    key = lambda w: F.when(w < "0", F.lit(NAME).cast("long")).when(w < ":", F.lit(NUMBER).cast("long")).when(w.isin(UNITS), F.lit(UNIT).cast("long")).otherwise(F.xxhash64(w))
    return rows.withColumn("words", words).withColumn("keys", F.transform("words", key))


def windows(rows: DataFrame, prefix: str) -> DataFrame:
    """One row for each window: its place and hash besides the words and keys of its text."""
    hashed = F.expr(f"if(size(keys) < {WINDOW}, null, transform(sequence(0, size(keys) - {WINDOW}), i -> xxhash64({', '.join(f'get(keys, i + {j})' for j in range(WINDOW))})))")
    # the outer form: for the other one the optimiser adds a filter that works the array out a second time
    return rows.select("*", F.posexplode_outer(hashed).alias(f"{prefix}_place", "window"))


def document_key():
    """The document that a row belongs to: its doc_id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def short_items(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """The documents that hold an item of fewer than ``WINDOW`` words, as ``contaminated`` gives them; None without such items."""
    lengths = [r.n for r in items.select(F.size("words").alias("n")).where(f"n between 1 and {WINDOW - 1}").distinct().collect()]  # WINDOW - 1 at most
    if not lengths:
        return None
    plain = F.transform("words", lambda w: F.translate(w, NAME_MARK, "")).alias("plain")
    runs = ", ".join(f"if(size(plain) < {n}, array(), transform(sequence(0, size(plain) - {n}), i -> array_join(slice(plain, i + 1, {n}), ' ')))" for n in lengths)
    held = docs.select("doc_id", "document", plain).select("doc_id", "document", F.explode(F.expr(f"array_distinct(concat({runs}))")).alias("run"))
    wanted = items.where(f"size(words) between 1 and {WINDOW - 1}").select("item_id", F.array_join(plain, " ").alias("run"))
    one = F.lit(1).cast("long")
    return held.join(wanted, "run").select("doc_id", "item_id", one.alias("n_windows"), one.alias("item_windows"), F.lit(1.0).alias("share"), F.lit(0).cast("long").alias("n_slots"), "document").distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, share and n_slots of each contaminated document and item."""
    items = templates(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")).drop("text")
    searched = windows(items, "item").select("item_id", "item_place", "window", (F.size("words") - WINDOW + 1).alias("item_windows"), F.slice("words", F.col("item_place") + 1, WINDOW).alias("item_words"), F.slice("keys", F.col("item_place") + 1, WINDOW).alias("item_keys")).where("window is not null")
    if searched.count() <= BROADCAST_WINDOWS:
        searched = F.broadcast(searched)
    docs = templates(documents.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("document"), "text")).drop("text")
    met = windows(docs, "doc").join(searched, "window")
    slots = F.expr(f"filter(transform(sequence(0, {WINDOW - 1}), j -> if(item_keys[j] between 1 and 3, named_struct('item', item_words[j], 'doc', get(words, doc_place + j)), null)), s -> s is not null)")
    # within coalesce(), as a bare equation would become a join key that is cut out of every window
    same = F.coalesce(F.slice("keys", F.col("doc_place") + 1, WINDOW) == F.col("item_keys"), F.lit(False))
    aligned = met.where(same).select("doc_id", "document", "item_id", "item_windows", "item_place", (F.col("doc_place") - F.col("item_place")).alias("shift"), slots.alias("slots"))
    runs = aligned.groupBy("doc_id", "document", "item_id", "shift", "item_windows").agg(F.collect_set(F.struct("item_place", "slots")).alias("met"))
    pairs = runs.withColumn("pairs", F.expr("array_sort(array_distinct(flatten(transform(met, m -> m.slots))))"))
    torn = pairs.withColumn("torn", F.expr("transform(filter(pairs, (s, i) -> i > 0 and get(pairs, i - 1).item = s.item), s -> s.item)"))
    counted = torn.withColumn("met", F.expr("filter(met, m -> size(torn) = 0 or forall(m.slots, s -> s.item = s.doc) or not exists(m.slots, s -> array_contains(torn, s.item)))"))
    good = counted.where("size(met) > 0").select("doc_id", "document", "item_id", "item_windows", F.expr("transform(met, m -> m.item_place)").alias("places"), F.expr("array_distinct(flatten(transform(met, m -> m.slots)))").alias("slots"))
    found = good.groupBy("doc_id", "document", "item_id", "item_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"), F.max(F.size("slots")).cast("long").alias("n_slots"))
    share = F.col("n_windows") / F.col("item_windows")
    long = found.where((share >= LEAST_SHARE) | (F.col("n_windows") >= LEAST_WINDOWS)).select("doc_id", "item_id", "n_windows", F.col("item_windows").cast("long").alias("item_windows"), share.alias("share"), "n_slots", "document")
    short = short_items(docs, items)
    return long if short is None else long.unionByName(short)


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with their own columns. The keys of the others are
    written first, so that the planner knows their size and sends small ones to all executors."""
    found = stored(contaminated(documents, benchmark).select(F.col("document").alias("found")).distinct(), "contaminated")
    key = document_key()
    return documents.join(found, key == found.found, "left_anti")
